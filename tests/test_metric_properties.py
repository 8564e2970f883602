"""Property tests against brute force: split evaluation (accuracy,
cross-entropy, BCE) on random prediction tables, and frequency-ranked
vocabulary ids with encoding."""
import math
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from choicekit.operators import encode as N
from choicekit.operators import metrics as M

item = st.tuples(st.sampled_from(["train", "test"]),
                 st.lists(st.integers(-30, 30).map(lambda x: x / 7), min_size=1, max_size=5),
                 st.integers(0, 5))


@settings(max_examples=8, deadline=None, derandomize=True,
          suppress_health_check=list(HealthCheck))
@given(st.lists(item, min_size=1, max_size=30))
def test_evaluate_matches_brute_force(spark, items):
    rows, expect = [], {}
    for iid, (split, logits, gold) in enumerate(items):
        gold = gold % len(logits)
        for c, x in enumerate(logits):
            rows.append((iid, c, round(x, 6), int(c == gold), split))
    df = spark.createDataFrame(rows, "item_id long, choice_idx long, logit double, label int, "
                                     "split string")
    got = {r.split: (r.n_items, r.n_correct, r.accuracy, r.cross_entropy, r.bce)
           for r in M.evaluate(df).collect()}
    for split in {s for s, _, _ in items}:
        its = [(i, s, l, g % len(l)) for i, (s, l, g) in enumerate(items) if s == split]
        n = len(its)
        right = 0
        ce = 0.0
        for _, _, logits, gold in its:
            xs = [round(x, 6) for x in logits]
            pred = max(range(len(xs)), key=lambda c: (xs[c], -c))
            right += pred == gold
            m = max(xs)
            ce += m + math.log(sum(math.exp(x - m) for x in xs)) - xs[gold]
        bces = [max(r[2], 0) - r[2] * r[3] + math.log1p(math.exp(-abs(r[2])))
                for r in rows if r[4] == split]
        g = got[split]
        assert (g[0], g[1]) == (n, right)
        assert abs(g[2] - round(right / n, 9)) < 1e-9
        assert abs(g[3] - ce / n) < 1e-8
        assert abs(g[4] - sum(bces) / len(bces)) < 1e-8


@settings(max_examples=8, deadline=None, derandomize=True,
          suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["x", "y", "z", "w", "v", "u"]), max_size=8),
                min_size=1, max_size=20))
def test_vocabulary_ranks_match_counter(spark, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, tokens array<string>")
    vocab = {r.token: r.id for r in N.build_vocabulary(df).collect()}
    counts = Counter(t for d in docs for t in d)
    ranked = sorted(counts, key=lambda t: (-counts[t], t))
    assert vocab == {t: i + 2 for i, t in enumerate(ranked)}
    enc = {r.doc_id: r.ids for r in N.encode_tokens(df, N.build_vocabulary(df), "doc_id").collect()}
    assert enc == {i: [vocab[t] for t in d] for i, d in enumerate(docs)}
