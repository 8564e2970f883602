"""Findings of round 4: what travels and is written of word look-ups, translations, sub-words and the build."""
import contextlib
import io
import random

from pyspark.sql import functions as F

from choicekit.operators import encode as N
from choicekit.operators import joins as J
from choicekit.operators import subword as SW
from choicekit.operators import udf as U
from choicekit.sources import files as FS
from choicekit.sources.tables import texts


def final_plan(df):
    """The plan as it ran."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue().split("Initial Plan")[0]


def test_encoded_rows_travel_once(spark):
    """the rows are shuffled to their blocks and nowhere else."""
    docs = spark.createDataFrame([(i, [f"w{i % 9}", "a b", ""]) for i in range(50)], "doc_id long, tokens array<string>")
    vocab = N.build_vocabulary(docs.where("doc_id < 40"))
    plan = final_plan(N.encode_tokens(docs, vocab, "doc_id"))
    assert "ReusedExchange" in plan and plan.count("FlatMapCoGroupsInArrow") == 1
    assert plan.index("FlatMapCoGroupsInArrow") < plan.index("Exchange")      # none above it


def test_encoding_of_odd_words_keys_and_rows(spark, monkeypatch):
    """words that a joined string would not give back, rows of one key, null keys."""
    monkeypatch.setattr(J, "ROWS", 2)
    rows = [(1, ["a", "b"]), (1, ["c"]), (2, []), (3, None), (4, [""]), (5, ["x\0y", "a"]), (6, [None, "b"]), (None, ["a"])]
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(["a", "b", "c", "", "x\0y"], 2)], "token string, id long")
    got = N.encode_tokens(spark.createDataFrame(rows, "k long, tokens array<string>"), vocab, "k").collect()
    assert sorted(((r.k, r.ids) for r in got), key=str) == sorted(
        [(1, [2, 4, 3]), (1, [2, 4, 3]), (2, []), (3, []), (4, [5]), (5, [6, 2]), (6, [1, 3]), (None, [])], key=str)


LISTS = [(1, ["aa bb", None]), (1, ["cc", "dd"]), (None, ["aa"]), (None, []), (2, []), (3, None), (3, ["Aa", "", "!"]),
         (4, ["bb aa bb", "zz"])]
SAID = [(1, ["AA cc bb", "AA cc bb", None, "dd"])] * 2 + [(None, None), (None, []), (2, [])] + [(3, ["AA", "", ""])] * 2 + [
    (4, ["bb AA bb", "zz"])]


def test_lists_are_translated_whole(spark):
    """null and empty items, items at one place of rows of one key, null keys; no item travels alone."""
    d = spark.createDataFrame([("aa", "AA"), ("xx", "XX")], "src string, tgt string")
    df = spark.createDataFrame(LISTS, "k long, o array<string>")
    said = U.translate_list(df, "k", "o", "x", d)
    assert sorted(((r.k, r.x) for r in said.collect()), key=str) == sorted(SAID, key=str)
    once = spark.createDataFrame([(k, o) for k, o in LISTS if k == 4], "k long, o array<string>")
    assert U.translate_list(once, "k", "o", "x", d).first().x == ["bb AA bb", "zz"]
    assert "Generate" not in final_plan(said.select("k", "x")) and "ReusedExchange" in final_plan(said.select("k", "x"))


def test_translated_rows_leave_their_texts_behind(spark):
    """only keys and translations are shuffled after the look-up, no text and no word beside its target."""
    d = spark.createDataFrame([("aa", "AA")], "src string, tgt string")
    rows = [(1, "Aa bb"), (1, "cc"), (2, None), (3, ""), (None, "aa")]
    df = spark.createDataFrame(rows, "k long, t string")
    said = U.dictionary_translate(df, "k", "t", "o", d)
    assert said.columns == ["k", "t", "o"]
    assert sorted(((r.k, r.t, r.o) for r in said.collect()), key=str) == sorted(
        [(1, "Aa bb", "AA cc bb"), (1, "cc", "AA cc bb"), (2, None, None), (3, "", ""), (None, "aa", "")], key=str)
    plan = final_plan(said.select("k", "o"))
    assert "ReusedExchange" in plan and "struct<word" not in plan and "_said" in plan


def test_texts_dealt_evenly_are_not_shuffled(spark, tmp_path):
    """Files that keep the cores busy are read as they are, others are spread."""
    cores = spark.sparkContext.defaultParallelism
    for files, even in ((2 * cores, True), (1, False)):
        d = str(tmp_path / str(files))
        spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text")) \
            .repartition(files).write.parquet(f"{d}/documents.parquet")
        with small_splits(spark):
            t = texts(spark, d, "doc_id", "text")
            assert ("Exchange" not in final_plan(t)) == even and t.count() == 400


@contextlib.contextmanager
def small_splits(spark):
    """Small files are tasks of their own, as large ones are."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


PIECES = [("un", False, 2), ("a", False, 3), ("a", True, 4), ("ab", True, 5), ("abé", True, 6), ("b", True, 7), ("é", False, 8),
          ("é", True, 9), ("word", False, 10), ("日本", True, 11), ("日", True, 12), ("", False, 13)]


def spelt(word):
    """The ids of a word that is no piece, by a plain loop."""
    table, ids, at = {(p, inner): i for p, inner, i in PIECES}, [], 0
    while at < len(word):
        fits = [n for n in range(1, len(word) - at + 1) if (word[at:at + n], at > 0) in table]
        if not fits:
            return None
        ids.append(table[word[at:at + max(fits)], at > 0])
        at += max(fits)
    return ids


def test_walks_along_likely_pieces(spark, monkeypatch):
    """pieces on the walk alone meet the table; a filter that errs at every place costs no
    word its ids, as unsure words are encoded the exact way."""
    rng = random.Random(5)
    words = ["".join(rng.choice(["a", "b", "ab", "é", "un", "日", "本"]) for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    words = sorted({*words, "un" + "ab" * 40, "", "x", "unx"} - {"un", "a", "é", "word"})
    pieces = spark.createDataFrame(PIECES, "piece string, inner boolean, id long")
    df = spark.createDataFrame([*enumerate(words), (900, None)], "wid long, word string")
    for slots, chunk, sure in ((1 << 20, 64, True), (1, 1 << 20, False)):
        monkeypatch.setattr(SW, "SLOTS", slots)
        monkeypatch.setattr(SW, "CHUNK", chunk)
        got = {r.word: (r.ids, r.sure) for r in SW.walked(df, pieces).collect()}
        assert {w for w, (ids, ok) in got.items() if ok and ids != spelt(w)} == set()
        if sure:
            assert [w for w, x in got.items() if not x[1]] == [w for w in got if w is None or len(w.encode()) > 64]
        else:
            assert sum(not ok for w, (_, ok) in got.items() if w) > 1
        ids = {r.src: r.tgt for r in SW.word_ids(spark.createDataFrame([(w,) for w in words if w], "word string"), pieces).collect()}
        assert ids == {w: spelt(w) or [1] for w in words if w}


def test_substrings_of_words_are_not_shuffled(spark):
    """words with a likely walk send its pieces, not all their substrings."""
    words = spark.createDataFrame([(1, "unab" + "ab" * 20)], "wid long, word string")
    out = SW.walked(words, spark.createDataFrame(PIECES, "piece string, inner boolean, id long"))
    assert "Generate" not in final_plan(out) and "MapInArrow" in final_plan(out)


def test_rows_to_join_are_dealt_out_once(spark):
    """the rows that are deduplicated and joined go to their keys in one shuffle; copies of a
    first row, null orders and null keys as before."""
    left = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, "u"), (4, "v"), (None, "w")], "k long, v string")
    right = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (1, 5, "c"), (1, None, "d"), (2, None, "e"), (2, None, "f"),
                                   (4, 7, "g"), (None, 1, "h")], "k long, o long, w string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left", "outer"):
            got = J.join_deduped(left, right, "k", "o", how)
            want = left.join(J.dedup_keep_first(right, "k", "o"), on="k", how=how)
            assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
        assert final_plan(J.join_deduped(left, right, "k", "o")).count("Exchange hashpartitioning(") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stages_are_packed_tightly(spark, tmp_path):
    """a stage takes less disk than Spark's default codec gives it."""
    df = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 512).alias("t")).coalesce(1)
    size = lambda d: sum(p.stat().st_size for p in (tmp_path / d).rglob("*.parquet"))
    df.write.parquet(str(tmp_path / "plain"))
    FS.write_stage(df, str(tmp_path / "stage"))
    assert size("stage") < 0.8 * size("plain")
