"""Text operators on literal edge cases (SURVEY FIXTURES 'Text edge cases')."""
from choicekit.functions import text as tx


def one(spark, expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_preprocess_lower_and_digits(spark):
    assert one(spark, tx.preprocess_text("t"), "Año 2016 CAINE2016x") == "año  cainex"
    assert one(spark, tx.preprocess_text("t"), None) is None


def test_tokens_two_or_more_word_chars(spark):
    r = one(spark, tx.word_tokens("t"), "a bb ccc d_e Ingeniería x1 ß")
    assert r == ["bb", "ccc", "d_e", "Ingeniería", "x1"]


def test_ngram_text_sorted_distinct_and_null_when_empty(spark):
    r = one(spark, tx.ngram_text("t"), "El profesor y el alumno; the professor and THE student 2016")
    assert r == sorted(set(r)) and "profesor" in r and "el" not in r and "the" not in r
    assert one(spark, tx.ngram_text("t"), "the and of y el la") is None     # stop words only
    assert one(spark, tx.ngram_text("t"), "123 456") is None                # digits only
    assert one(spark, tx.ngram_text("t"), "") is None
    assert one(spark, tx.ngram_text("t"), None) is None


def test_bigrams_after_stop_word_removal(spark):
    df = spark.createDataFrame([("red car of the big house",)], "t string")
    r = tx.with_ngram_text(df, "t", "g", 1, 2).first()["g"]
    assert "car big" in r and "red car" in r and "big house" in r and "car of" not in r


def test_split_literal_keeps_empties_and_regex_chars(spark):
    assert one(spark, tx.split_literal("t", "|"), "a||b|") == ["a", "", "b", ""]
    assert one(spark, tx.split_literal("t", "."), "a.b") == ["a", "b"]


def test_drop_first_char_tolerates_short_arrays(spark):
    df = spark.createDataFrame([(["a", " b"],), (["a", " b", " c", " d", " e"],)], "t array<string>")
    rows = [r["r"] for r in df.select(tx.drop_first_char("t").alias("r")).collect()]
    assert rows == [["a", "b"], ["a", "b", "c", "d", " e"]]


def test_sentences_and_rejoin(spark):
    r = one(spark, tx.sentences("t"), "One. Two!  Three?? four")
    assert r == ["One.", "Two!", "Three??", "four"]


def test_entity_text_missing_parts(spark):
    df = spark.createDataFrame([("L", None), (None, "D")], "l string, d string")
    r = [x["r"] for x in df.select(tx.entity_text("l", "d").alias("r")).collect()]
    assert r == ["L.  .", " . D."]


def test_replace_and_join(spark):
    df = spark.createDataFrame([(["a,b", None],)], "t array<string>")
    assert df.select(tx.join_list(tx.replace_in_items("t"), "|", "None")).first()[0] == "a b|None"
