"""DuckDB expression text for the oracle side of text operators.

These mirror ``choicekit.functions.text`` one to one (same patterns, same
stop words) so a query and its oracle differ only in engine.
"""
from __future__ import annotations

from ..functions.stopwords import stop_words


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def stop_list() -> str:
    return ", ".join(q(w) for w in stop_words())


def preprocess(x: str) -> str:
    return f"regexp_replace(lower({x}), '\\p{{Nd}}+', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def no_stop(t: str) -> str:
    return f"list_filter({t}, lambda w: w NOT IN ({stop_list()}))"


def ngrams(t: str, lo: int, hi: int) -> str:
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(t)
        else:
            parts.append(f"list_transform(range(1, len({t}) - {n - 2}), "
                         f"lambda i: array_to_string({t}[i : i + {n - 1}], ' '))")
    return parts[0] if len(parts) == 1 else "flatten([" + ", ".join(parts) + "])"


def vocabulary(a: str) -> str:
    return f"CASE WHEN len(list_distinct({a})) > 0 THEN list_sort(list_distinct({a})) END"


def ngram_text(x: str, lo: int = 1, hi: int = 1) -> str:
    return vocabulary(ngrams(no_stop(tokens(preprocess(x))), lo, hi))


def sentences(x: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?]+[.!?]*'), "
            f"lambda s: trim(s)), lambda s: s <> '')")


# CTEs and final select of ``metrics.evaluate`` over a CTE ``predictions``
EVALUATE = """
lse AS (SELECT item_id, max(m) + ln(sum(exp(logit - m))) AS lse
        FROM (SELECT *, max(logit) OVER (PARTITION BY item_id) AS m FROM predictions)
        GROUP BY item_id),
ce AS (SELECT p.split, avg(l.lse - p.logit) AS ce FROM predictions p
       JOIN lse l ON p.item_id = l.item_id WHERE p.label = 1 GROUP BY p.split),
am AS (SELECT item_id, split, choice_idx AS pred_choice FROM (
         SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY logit DESC, choice_idx) AS r
         FROM predictions) WHERE r = 1),
gold AS (SELECT item_id, min(choice_idx) AS gold_choice FROM predictions WHERE label = 1
         GROUP BY item_id),
acc AS (SELECT split, count(*) AS n_items,
               CAST(coalesce(sum(CAST(pred_choice = gold_choice AS INTEGER)), 0) AS BIGINT)
                 AS n_correct
        FROM am LEFT JOIN gold ON am.item_id = gold.item_id GROUP BY split),
bce AS (SELECT split, avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))) AS bce
        FROM predictions GROUP BY split)
SELECT acc.split, n_items, n_correct, round(n_correct / n_items, 9) AS accuracy,
       round(ce.ce, 9) AS cross_entropy, round(bce.bce, 9) AS bce
FROM acc JOIN ce ON acc.split = ce.split JOIN bce ON acc.split = bce.split"""
