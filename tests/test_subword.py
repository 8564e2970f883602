"""Positional word look-ups and longest-match sub-word ids against plain loops."""
import contextlib
import io
import random
import time

from choicekit.operators import encode as N
from choicekit.operators import subword as SW
from choicekit.operators import udf as U
from choicekit.operators import joins as J
from choicekit.operators.joins import resolve_words

PIECES = [("un", False, 2), ("a", False, 3), ("a", True, 4), ("ab", True, 5), ("abc", True, 6), ("b", True, 7),
          ("é", False, 8), ("é", True, 9), ("word", False, 10), ("unword", False, 11), ("c", True, 12)]


def plain(word):
    table = {(p, inner): i for p, inner, i in PIECES}
    if (word, False) in table:
        return [table[word, False]]
    ids, at = [], 0
    while at < len(word):
        fits = [n for n in range(1, len(word) - at + 1) if (word[at:at + n], at > 0) in table]
        if not fits:
            return [1]
        ids.append(table[word[at:at + max(fits)], at > 0])
        at += max(fits)
    return ids


def test_longest_match_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(SW, "WINDOW", 4)            # words of several windows
    rng = random.Random(3)
    words = ["".join(rng.choice("abcuné") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    words += ["un" + "abc" * 700, "un" + "ab" * 900 + "x", "word", "unword", "x", "é"]
    rows = [(i, words[i % len(words):][:7] * (i % 3)) for i in range(200)] + [(900, None), (901, [])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>")
    pieces = spark.createDataFrame(PIECES, "piece string, inner boolean, id long")
    got = {r.k: r.ids for r in SW.subword_encode(df, pieces, "k").collect()}
    assert got == {k: [i for w in t or [] for i in plain(w)] for k, t in rows}


def test_resolve_words_keeps_order_and_unknown(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))]) for i in range(60)]
    table = spark.createDataFrame([(w, ord(w)) for w in "abcd"], "src string, tgt long")
    got = {r.k: [(x.word, x.tgt) for x in r._said] for r in resolve_words(
        spark.createDataFrame(rows, "k long, ws array<string>"), ["k"], "ws", table).collect()}
    assert got == {k: [(w, ord(w) if w in "abcd" else None) for w in ws] for k, ws in rows if ws}


def test_a_long_text_is_linear(spark):
    """40,000 words, all different: a search of a list or map per word would take far longer."""
    words = [f"w{i}" for i in range(40_000)]
    df = spark.createDataFrame([(1, " ".join(words))], "k long, t string")
    table = spark.createDataFrame([(w, w.upper()) for w in words[::2]], "src string, tgt string")
    vocab = N.build_vocabulary(spark.createDataFrame([(words[:1000],)], "tokens array<string>"))
    start = time.perf_counter()
    said = U.dictionary_translate(df, "k", "t", "o", table).first().o.split(" ")
    ids = N.encode_tokens(spark.createDataFrame([(1, words)], "k long, tokens array<string>"), vocab, "k").first().ids
    assert time.perf_counter() - start < 25
    assert said == [w.upper() if i % 2 == 0 else w for i, w in enumerate(words)]
    assert len(ids) == 40_000 and set(ids[1000:]) == {1} and sorted(ids[:1000]) == list(range(2, 1002))


def test_translate_list_null_and_empty(spark):
    d = spark.createDataFrame([("aa", "AA")], "src string, tgt string")
    df = spark.createDataFrame([(1, ["aa bb", None, ""]), (2, None), (3, [])], "k long, o array<string>")
    assert {r.k: r.x for r in U.translate_list(df, "k", "o", "x", d).collect()} == {1: ["AA bb", None, ""], 2: None, 3: []}


def test_resolve_words_merges_rows_of_a_key(spark, monkeypatch):
    """Blocks of a few rows; rows of one key are one text, word beside word."""
    monkeypatch.setattr(J, "ROWS", 5)
    rows = [(i % 17, [f"w{j % 7}" for j in range(i, i + i % 4)]) for i in range(40)] + [(50, None), (51, [])]
    table = spark.createDataFrame([(f"w{j}", [j, j]) for j in range(5)], "src string, tgt array<long>")
    got = {r.k: [(x.word, x.tgt) for x in r._said] for r in resolve_words(
        spark.createDataFrame(rows, "k long, ws array<string>"), ["k"], "ws", table).collect()}
    want = {}
    for k, ws in rows:
        want.setdefault(k, []).extend((at, w) for at, w in enumerate(ws or []))
    assert got == {k: [(w, [int(w[1:])] * 2 if int(w[1:]) < 5 else None) for _, w in sorted(ws)]
                   for k, ws in want.items() if ws}


def test_no_exploded_words_are_broadcast(spark):
    """The substrings of words look as few as their words to the planner."""
    words = spark.createDataFrame([(1, "unab")], "wid long, word string")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        SW.longest_matches(words, spark.createDataFrame(PIECES, "piece string, inner boolean, id long")).explain()
    assert "Broadcast" not in out.getvalue()
