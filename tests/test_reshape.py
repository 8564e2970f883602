"""Reshape / join / union operators incl. the reference quirks B1–B3."""
from choicekit.operators import joins as J
from choicekit.operators import reshape as R


def items(spark):
    return spark.createDataFrame(
        [(1, "q1", ["a", "b", "c", "d"], "B", 1, "ctx", "train"),
         (2, "q2", ["e", "f"], "E", 0, "ctx2", "test")],
        "example_id long, question string, options array<string>, answer string, "
        "correct_answer_id int, article string, split string")


def test_binarise_by_letter_unknown_letter_has_no_correct(spark):
    rows = R.binarise_by_letter(items(spark)).orderBy("example_id", "choice_idx").collect()
    assert [(r.example_id, r.choice_idx, r.correct) for r in rows] == \
        [(1, 0, 0), (1, 1, 1), (1, 2, 0), (1, 3, 0), (2, 0, 0), (2, 1, 0)]


def test_binarise_by_index(spark):
    rows = R.binarise_by_index(items(spark), options="options", context="article").collect()
    assert sum(r.correct for r in rows) == 2 and len(rows) == 6


def test_regroup_restores_order(spark):
    flat = R.binarise_by_letter(items(spark))
    g = {r.example_id: r.answers for r in R.regroup_choices(flat).collect()}
    assert g == {1: ["a", "b", "c", "d"], 2: ["e", "f"]}


def test_dedup_keep_first_and_fanout(spark):
    left = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k long, v string")
    right = spark.createDataFrame([(1, 10, "r1"), (1, 5, "r0"), (2, 7, "r2")],
                                  "k long, row_id long, w string")
    first = {r.k: r.w for r in J.dedup_keep_first(right, "k", "row_id").collect()}
    assert first == {1: "r0", 2: "r2"}
    assert J.join_deduped(left, right, "k", "row_id").count() == 3      # no N x M
    prof = {r.k: r.joined_rows for r in J.fanout_profile(left, right, "k").collect()}
    assert prof == {1: 4, 2: 1}


def test_union_missing_columns_are_null(spark):
    a = spark.createDataFrame([(1, "q")], "example_id long, question string")
    b = spark.createDataFrame([("q2", "extra")], "question string, reason string")
    u = R.union_by_name({"a": a, "b": b}).orderBy("source").collect()
    assert u[0].reason is None and u[1].example_id is None and u[1].source == "b"


def test_unnest_choices(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6], 3)], "example_id long, flat_ids array<int>, n_choices int")
    rows = R.unnest_choices(df, length=2).orderBy("choice_idx").collect()
    assert [r.ids for r in rows] == [[1, 2], [3, 4], [5, 6]]
