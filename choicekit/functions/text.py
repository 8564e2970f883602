"""Text expressions.

All functions return Columns built from ``pyspark.sql.functions`` so they run
inside whole-stage codegen and never leave the JVM.  Null in gives null out.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import stop_words

# Fixed patterns (must agree with the SQL oracle).
DIGIT_RUN = r"\p{Nd}+"                 # digits removed by the preprocessor
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"      # word tokens of two or more word chars
SENTENCE = r"[^.!?]+[.!?]*"            # sentence = text up to end punctuation
WHITESPACE = r"\s+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def preprocess_text(c) -> Column:
    """Lower-case and drop digit runs."""
    return F.regexp_replace(F.lower(col(c)), DIGIT_RUN, "")


def word_tokens(c) -> Column:
    """Tokens of two or more letters/digits/underscores, in text order."""
    return F.regexp_extract_all(col(c), F.lit(WORD_TOKEN), 0)


def remove_stop_words(tokens, words: tuple[str, ...] | None = None) -> Column:
    """Drop stop words from a token array (hash-set lookup per token)."""
    words = list(words if words is not None else stop_words())
    return F.filter(col(tokens), lambda x: ~x.isin(words))


def _gram_at(t: Column, n: int):
    # one-argument lambda: PySpark passes (element, index) to two-argument ones
    return lambda i: F.array_join(F.slice(t, i, n), " ")


def ngrams(tokens, lo: int = 1, hi: int = 1) -> Column:
    """All n-grams for n in [lo, hi], space-joined, in position order."""
    t = col(tokens)
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(t)
        else:
            grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), _gram_at(t, n))
            parts.append(F.when(F.size(t) >= n, grams)
                         .otherwise(F.array().cast("array<string>")))
    return parts[0] if len(parts) == 1 else F.flatten(F.array(*parts))


def vocabulary(arr) -> Column:
    """Sorted distinct entries; an empty vocabulary is null."""
    v = F.array_sort(F.array_distinct(col(arr)))
    return F.when(F.size(v) > 0, v)


def ngram_text(text, lo: int = 1, hi: int = 1,
               words: tuple[str, ...] | None = None) -> Column:
    """X1→X2→X3→X4→A8 as one expression.  Only for unigrams or short texts:
    lambdas re-evaluate captured expressions per element, so for n > 1 use
    ``with_ngram_text``, which materialises the token array first."""
    toks = remove_stop_words(word_tokens(preprocess_text(text)), words)
    return vocabulary(ngrams(toks, lo, hi))


def with_ngram_text(df, text: str, out: str, lo: int = 1, hi: int = 1,
                    words: tuple[str, ...] | None = None):
    """DataFrame form of ``ngram_text``: tokens, then n-grams, then the sorted
    distinct vocabulary, each in its own projection.  The staged columns are
    referenced more than once, so Catalyst keeps the projections apart and the
    tokeniser runs once per row."""
    tok, grams = f"__{out}_tok", f"__{out}_grams"
    return (df.withColumn(tok, remove_stop_words(word_tokens(preprocess_text(text)), words))
            .withColumn(grams, F.array_sort(F.array_distinct(ngrams(F.col(tok), lo, hi))))
            .withColumn(out, F.when(F.size(grams) > 0, F.col(grams)))
            .drop(tok, grams))


def sentences(c, collapse_whitespace: bool = False) -> Column:
    """Sentence split on end punctuation, trimmed, empties dropped."""
    def clean(s):
        if collapse_whitespace:
            s = F.regexp_replace(s, WHITESPACE, " ")
        return F.trim(s)
    parts = F.transform(F.regexp_extract_all(col(c), F.lit(SENTENCE), 0), clean)
    return F.filter(parts, lambda s: s != "")


def join_sentences(arr) -> Column:
    """X11."""
    return F.array_join(col(arr), " ")


def split_literal(c, delimiter: str) -> Column:
    """Split on a literal delimiter, keeping empty pieces."""
    pattern = "".join(f"[{ch}]" if ch not in "\\^]" else f"\\{ch}" for ch in delimiter)
    return F.split(col(c), pattern, -1)


def join_list(arr, delimiter: str, null_text: str | None = None) -> Column:
    """Elements to string, joined; nulls optionally rendered as text."""
    a = col(arr).cast("array<string>")
    return F.array_join(a, delimiter, null_text) if null_text is not None \
        else F.array_join(a, delimiter)


def replace_in_items(arr, old: str = ",", new: str = " ") -> Column:
    """Replace a delimiter inside every list item."""
    return F.transform(col(arr), lambda x: F.replace(x, F.lit(old), F.lit(new)))


def repair_list_text(c, delimiter: str = ",") -> Column:
    """Strip quotes and brackets of a list literal, then split."""
    return split_literal(F.translate(col(c), "'[]", ""), delimiter)


def drop_first_char(arr, first: int = 1, last: int = 3) -> Column:
    """Drop the first character of items ``first..last`` (0-based);
    arrays shorter than ``last + 1`` are tolerated."""
    return F.transform(col(arr), lambda x, i: F.when(i.between(first, last),
                                                     F.substring(x, 2, 1 << 30))
                       .otherwise(x))


def entity_text(label, description) -> Column:
    """``label + '. ' + description + '.'``, missing parts as a space."""
    return F.concat(F.coalesce(col(label), F.lit(" ")), F.lit(". "),
                    F.coalesce(col(description), F.lit(" ")), F.lit("."))
