"""Property test: the JVM text chain equals a plain-Python statement of the
same rules on random texts (letters of several scripts, accents, digits,
underscores, punctuation, whitespace).  All examples run in one Spark job."""
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from choicekit.functions import text as tx
from choicekit.functions.stopwords import stop_words

ALPHABET = "abcxyzABCXYZéèñüßçÉÑ_0123456789 \t\n.,;!?'-|" + "αβγжщ" + "٣५"


def python_vocab(t):
    if t is None:
        return None
    clean = regex.sub(r"\p{Nd}+", "", t.lower())
    stop = set(stop_words())
    toks = [w for w in regex.findall(r"[\p{L}\p{N}_]{2,}", clean) if w not in stop]
    v = sorted(set(toks))
    return v or None


@settings(max_examples=5, deadline=None, derandomize=True,
          suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=60)),
                min_size=200, max_size=200))
def test_vocabulary_chain_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.v for r in df.select("i", tx.ngram_text("t").alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == python_vocab(t), (t, got[i])


def python_vocab_1_2(t):
    if t is None:
        return None
    clean = regex.sub(r"\p{Nd}+", "", t.lower())
    stop = set(stop_words())
    toks = [w for w in regex.findall(r"[\p{L}\p{N}_]{2,}", clean) if w not in stop]
    grams = toks + [" ".join(toks[i:i + 2]) for i in range(len(toks) - 1)]
    v = sorted(set(grams))
    return v or None


@settings(max_examples=3, deadline=None, derandomize=True,
          suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=80)),
                min_size=200, max_size=200))
def test_bigram_vocabulary_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r.i: r.v for r in tx.with_ngram_text(df, "t", "v", 1, 2).collect()}
    for i, t in enumerate(texts):
        assert got[i] == python_vocab_1_2(t), (t, got[i])


CSV_ALPHABET = 'ab é,;"\'\n\r\t|\\ N'


@settings(max_examples=3, deadline=None, derandomize=True,
          suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text(alphabet=CSV_ALPHABET, max_size=30)
                          .filter(lambda s: s != "\\N")),
                min_size=100, max_size=100))
def test_csv_round_trip_random_text(spark, texts):
    from choicekit.session import shared_dir
    from choicekit.sources import files as FS
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for sep in (",", "\t"):
        path = FS.write_csv(df, shared_dir(spark, "csvprop"), sep=sep)
        back = {r.i: r.t for r in FS.read_csv(spark, path, "i long, t string", sep=sep).collect()}
        assert back == dict(enumerate(texts))


@settings(max_examples=3, deadline=None, derandomize=True,
          suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab .!?\n", max_size=40)),
                min_size=50, max_size=50))
def test_sentences_match_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.s for r in df.select("i", tx.sentences("t").alias("s")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i] is None
            continue
        parts = [p.strip(" ") for p in regex.findall(r"[^.!?]+[.!?]*", t)]
        assert got[i] == [p for p in parts if p != ""]


@settings(max_examples=3, deadline=None, derandomize=True,
          suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.text(alphabet="ab,|.* ", max_size=5), max_size=5),
                min_size=20, max_size=20), st.sampled_from(["|", ".", "*", ","]))
def test_literal_split_join_round_trip(spark, lists, delim):
    df = spark.createDataFrame(list(enumerate(lists)), "i long, a array<string>")
    out = df.select("i", tx.split_literal(tx.join_list(tx.replace_in_items("a", delim, " "),
                                                       delim), delim).alias("b")).collect()
    got = {r.i: r.b for r in out}
    for i, a in enumerate(lists):
        cleaned = [x.replace(delim, " ") for x in a]
        assert got[i] == (cleaned if cleaned else [""])


@settings(max_examples=3, deadline=None, derandomize=True,
          suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(1, 99), max_size=12), min_size=20, max_size=20),
       st.integers(1, 10))
def test_pad_truncate_mask(spark, arrays, length):
    from choicekit.operators import encode as N
    df = spark.createDataFrame(list(enumerate(arrays)), "i long, a array<int>")
    got = {r.i: (r.p, r.m) for r in df.select(
        "i", N.pad_truncate("a", length).alias("p"), N.attention_mask("a", length).alias("m"))
        .collect()}
    for i, a in enumerate(arrays):
        k = min(len(a), length)
        assert got[i] == (a[:k] + [0] * (length - k), [1] * k + [0] * (length - k))
