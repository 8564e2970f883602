"""Knowledge-graph lookups over an edge table (SURVEY J3–J6, J10, T3, T4, S8,
F2–F6).

Edge table: ``start_text, start_lang, end_text, end_lang, relation, weight``.
Everything is set-at-a-time: all (word, target) pairs are answered by joins,
never by a lookup per word.

Determinism (B22): where the reference returns "the first match in store
order", the edge with the highest weight wins, then the lowest relation, then
the lowest end text.  Such choices are ``min_by`` aggregates, which combine
map-side, so hub nodes are pre-aggregated before any shuffle.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.files import stage

EDGE = ("relation", "weight")
GRAM = 3               # characters of the runs that substring targets are looked up by
HUB_PART = 10_000      # edges of a word that one task joins, about


def _edge_order() -> Column:
    # smaller is better: weight desc, relation asc, end text asc
    return F.struct((-F.col("weight")).alias("w"), F.col("relation").alias("r"),
                    F.col("end_text").alias("e"))


def best_edges(kg: DataFrame, start_lang: str | None = "en",
               end_lang: str | None = None, labels: bool = True) -> DataFrame:
    """One edge per (start, end) text pair, after the language filters; without
    ``labels`` only its two ends, which need no sorted aggregate."""
    e = kg
    if start_lang is not None:
        e = e.where(F.col("start_lang") == start_lang)
    if end_lang is not None:
        e = e.where(F.col("end_lang") == end_lang)
    if not labels:
        return e.select("start_text", "end_text").distinct()
    best = F.min_by(F.struct(*EDGE), _edge_order())
    return e.groupBy("start_text", "end_text").agg(best.alias("_b")) \
        .select("start_text", "end_text", "_b.relation", "_b.weight")


def neighbours(kg: DataFrame, words: DataFrame, word: str = "word",
               lang: str = "en") -> DataFrame:
    """J3 (+F2, F3): outgoing edges of each word whose end is in ``lang``."""
    e = kg.where((F.col("start_lang") == lang) & (F.col("end_lang") == lang))
    w = words.select(F.col(word).alias("word")).distinct()
    return w.join(e, w.word == e.start_text).select("word", "end_text", "relation", "weight")


def one_hop(kg: DataFrame, pairs: DataFrame, target_lang: str | None = None) -> DataFrame:
    """J4 (+F6): is ``target`` an end of ``word``?  Any end language by default
    (B8).  One row per matched pair: the best edge, chosen among asked edges only."""
    asked = pairs.select(F.col("word").alias("start_text"), F.col("target").alias("end_text")).distinct()
    be = best_edges(kg.join(asked, ["start_text", "end_text"], "left_semi"), "en", target_lang)
    return pairs.join(be, (pairs.word == be.start_text) & (pairs.target == be.end_text)) \
        .select("word", "target", "relation", "weight")


def hops_of(kg: DataFrame, pairs: DataFrame, target_lang: str | None = None, hop1: DataFrame | None = None,
            labels: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(open pairs, first hops, second hops) of J5: the pairs without a one-hop
    edge, and the edges that can lie on their paths, one per (start, end).
    ``hop1``: what ``one_hop`` gave for these pairs, when it is known already."""
    hop1 = (one_hop(kg, pairs, target_lang) if hop1 is None else hop1).select("word", "target")
    # each feeds several joins below: materialise them once (reliable checkpoints in the
    # shared folder)
    ensure_checkpoint_dir(kg.sparkSession)
    open_pairs = pairs.join(hop1, ["word", "target"], "left_anti").checkpoint()
    names = {"relation": "relation_{}", "weight": "weight_{}"} if labels else {}
    ends = kg.join(open_pairs.select(F.col("target").alias("end_text")).distinct(), "end_text", "left_semi")
    second = best_edges(ends, "en", target_lang, labels).select(
        F.col("start_text").alias("middle"), F.col("end_text").alias("target"),
        *[F.col(c).alias(n.format(2)) for c, n in names.items()]).checkpoint()
    starts = kg.join(open_pairs.select(F.col("word").alias("start_text")).distinct(), "start_text", "left_semi") \
        .join(second.select(F.col("middle").alias("end_text")).distinct(), "end_text", "left_semi")
    first = best_edges(starts, "en", "en", labels).select(
        F.col("start_text").alias("word"), F.col("end_text").alias("middle"),
        *[F.col(c).alias(n.format(1)) for c, n in names.items()]).checkpoint()
    return open_pairs, first, second


def half_paths(open_pairs: DataFrame, first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with first hops, pairs with second hops): every pair takes the end with
    fewer edges, so a pair of a hub and a rare word costs the rare word's edges.
    The edges of a hub are split by a hash of the middle into parts of about
    ``HUB_PART``, which meet its pairs in different tasks."""
    out = first.groupBy("word").agg(F.count(F.lit(1)).alias("d_out"))
    into = second.groupBy("target").agg(F.count(F.lit(1)).alias("d_in"))
    p = open_pairs.join(out, "word").join(into, "target")

    def meet(side: DataFrame, edges: DataFrame, degrees: DataFrame, key: str, degree: str) -> DataFrame:
        last = F.floor((F.col(degree) - 1) / HUB_PART).cast("int")
        parted = edges.join(degrees, key).withColumn(
            "_part", F.pmod(F.xxhash64("middle"), last + 1).cast("int")).drop(degree)
        asked = side.withColumn("_part", F.explode(F.sequence(F.lit(0), last))).drop("d_out", "d_in")
        return asked.join(parted, [key, "_part"]).drop("_part")

    by_word = F.col("d_out") <= F.col("d_in")
    return (meet(p.where(by_word), first, out, "word", "d_out"),
            meet(p.where(~by_word), second, into, "target", "d_in"))


def two_hop(kg: DataFrame, pairs: DataFrame, target_lang: str | None = None, hop1: DataFrame | None = None,
            labels: bool = True) -> DataFrame:
    """Only for pairs without a one-hop edge: word -> middle (English end)
    -> target (any language).  Middle nodes are de-duplicated (best edge per
    hop), so a path is one row per (word, middle, target).  A pair's paths are
    listed from its end of lower degree and closed by an equi-join with the
    other hop, so the rows in between are the sum over pairs of the smaller
    degree, never a product of both.  Without ``labels`` a path is its three words."""
    open_pairs, first, second = hops_of(kg, pairs, target_lang, hop1, labels)
    begun, ended = half_paths(open_pairs, first, second)
    cols = ("word", "middle", "target") + (("relation_1", "weight_1", "relation_2", "weight_2") if labels else ())
    return begun.join(second, ["middle", "target"]).select(*cols) \
        .unionByName(ended.join(first, ["word", "middle"]).select(*cols))


def link_pairs(kg: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair, the hop count of the link (1, 2 or null) and the number
    of distinct paths at that distance."""
    ensure_checkpoint_dir(kg.sparkSession)
    p = pairs.select("word", "target").distinct()
    hop1 = one_hop(kg, p).select("word", "target").checkpoint()      # of the answer and of the open pairs
    h1 = hop1.withColumn("h1", F.lit(1))
    h2 = two_hop(kg, p, hop1=hop1, labels=False).groupBy("word", "target").agg(F.count(F.lit(1)).alias("n2"))
    j = p.join(h1, ["word", "target"], "left").join(h2, ["word", "target"], "left")
    hops = F.when(F.col("h1").isNotNull(), 1).when(F.col("n2").isNotNull(), 2)
    paths = F.when(F.col("h1").isNotNull(), F.lit(1).cast("bigint")).otherwise(F.col("n2"))
    return j.select("word", "target", hops.alias("hops"), paths.alias("n_paths"))


def top_k_by_weight(kg: DataFrame, k: int, lang: str = "en") -> DataFrame:
    """Per start word, the k heaviest English-end edges, emitted in
    ascending weight order; among equal weights the later edge (larger end
    text, relation) is kept.  k = 0 gives no rows (B9)."""
    e = kg.where((F.col("start_lang") == lang) & (F.col("end_lang") == lang)) \
        .select(F.col("start_text").alias("word"), "end_text", "relation", "weight")
    if k <= 0:
        return e.limit(0).withColumn("pos", F.lit(0).cast("bigint"))
    best_first = Window.partitionBy("word").orderBy(
        F.col("weight").desc(), F.col("end_text").desc(), F.col("relation").desc())
    kept = e.withColumn("_r", F.row_number().over(best_first)).where(F.col("_r") <= k)
    ascending = Window.partitionBy("word").orderBy("weight", "end_text", "relation")
    return kept.withColumn("pos", (F.row_number().over(ascending) - 1).cast("bigint")) \
        .drop("_r")


def limit_per_word(kg: DataFrame, n: int = 1000) -> DataFrame:
    """T4: at most ``n`` edges per start word, heaviest first (a per-key
    limit, not a global one; planned with a map-side partial group limit)."""
    w = Window.partitionBy("start_text").orderBy(F.col("weight").desc(), "end_text",
                                                 "relation", "end_lang")
    return kg.withColumn("rank", F.row_number().over(w).cast("bigint")) \
        .where(F.col("rank") <= n)


def char_grams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters of a text; none when it is shorter."""
    at = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))) \
        .otherwise(F.array().cast("array<string>"))


def substring_candidates(kg: DataFrame, pairs: DataFrame, n: int = GRAM) -> DataFrame:
    """(word, target, end_text): ends of the word's edges that hold the target's
    rarest character trigram among them.  The inverted list of a word's ends is
    built for asked words and asked trigrams only, and a target with a trigram
    that no end of its word has is gone before it meets any edge.  Targets shorter
    than ``n`` are looked up by runs of their own length."""
    asked = pairs.select("word", "target").where("word IS NOT NULL AND target IS NOT NULL").distinct() \
        .withColumn("size", F.least(F.lit(n), F.length("target")))
    ends = kg.select(F.col("start_text").alias("word"), "end_text").distinct()
    out = None
    # sizes 1 to n and empty targets, which every end contains: a fixed, small number of lists
    for size in range(n + 1):
        part = asked.where(F.col("size") == size).drop("size")
        if size == 0:
            found = part.join(ends, "word")
        else:
            want = part.select("word", "target", F.explode(char_grams(F.col("target"), size)).alias("gram"))
            have = ends.join(part.select("word").distinct(), "word", "left_semi") \
                .select("word", "end_text", F.explode(char_grams(F.col("end_text"), size)).alias("gram")) \
                .join(want.select("word", "gram").distinct(), ["word", "gram"], "left_semi")
            often = have.groupBy("word", "gram").agg(F.count(F.lit(1)).alias("n"))
            rarest = want.join(often, ["word", "gram"], "left").groupBy("word", "target").agg(
                F.count(F.lit(1)).alias("_grams"), F.count("n").alias("_known"),
                F.min_by("gram", F.struct("n", "gram")).alias("gram")).where("_grams = _known")
            found = rarest.select("word", "target", "gram").join(have, ["word", "gram"])
        found = found.select("word", "target", "end_text")
        out = found if out is None else out.unionByName(found)
    return out


def _substring_hits(kg: DataFrame, pairs: DataFrame) -> DataFrame:
    return substring_candidates(kg, pairs).where(F.col("end_text").contains(F.col("target")))


def _best_of_block(edges: pa.Table, asked: pa.Table) -> pa.Table:
    """The best edge of every (word, target) of a block: each run of an end that is as long
    as some target of its word is looked up among these targets."""
    targets: dict = {}
    for w, t in zip(asked["_word"].to_pylist(), asked["_target"].to_pylist(), strict=True):
        targets.setdefault(w, {}).setdefault(len(t), set()).add(t)
    best: dict = {}
    for w, e, r, x in zip(*(edges[c].to_pylist() for c in ("word", "end_text", "relation", "weight")), strict=True):
        if w not in targets or e is None:
            continue
        # smaller is better, as in _edge_order: null first, NaN last
        rank = ((0, 0.0) if x is None else (2, 0.0) if x != x else (1, -x), (r is not None, r or ""), e)
        for size, known in targets[w].items():
            for t in known.intersection(e[i:i + size] for i in range(len(e) - size + 1)):
                if (w, t) not in best or rank < best[w, t][0]:
                    best[w, t] = rank, e, r, x
    found = [(*k, *v[1:]) for k, v in best.items()]
    cols = list(zip(*found, strict=True)) or [()] * 5
    return pa.table([pa.array(c, pa.float64() if i == 4 else pa.string()) for i, c in enumerate(cols)],
                    names=["word", "target", "end_text", "relation", "weight"])


def best_substring_edges(kg: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, target, end_text, relation, weight): the best edge of ``word`` whose end
    contains ``target``.  Edges of asked words meet the targets of their words in blocks of
    about ``HUB_PART`` edges; a hub's edges are split by a hash of the end into parts, and
    its targets go to each.  An edge and a target travel once per block; the runs of an end
    stay inside the block."""
    asked = pairs.select("word", "target").where("word IS NOT NULL AND target IS NOT NULL").distinct()
    edges = kg.select(F.col("start_text").alias("word"), "end_text", "relation", F.col("weight").cast("double").alias("weight"))
    often = edges.groupBy("word").agg((F.floor((F.count(F.lit(1)) - 1) / HUB_PART) + 1).cast("int").alias("parts"))
    words = stage(asked.select("word").distinct().join(often, "word"), "substring-words")
    blocks = kg.count() // HUB_PART + 1
    block = F.pmod(F.xxhash64("word", "_part"), F.lit(blocks))
    parted = edges.join(words, "word").withColumn("_part", F.pmod(F.xxhash64("end_text"), F.col("parts")).cast("int")) \
        .select(block.alias("_block"), "word", "end_text", "relation", "weight")
    want = asked.join(words, "word").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .select(block.alias("_b"), F.col("word").alias("_word"), F.col("target").alias("_target")).distinct()
    found = parted.groupBy("_block").cogroup(want.groupBy("_b")).applyInArrow(
        _best_of_block, "word string, target string, end_text string, relation string, weight double")
    best = F.min_by(F.struct("end_text", "relation", "weight"), _edge_order())
    return found.groupBy("word", "target").agg(best.alias("_m")).select("word", "target", "_m.*")


def substring_target(kg: DataFrame, pairs: DataFrame) -> DataFrame:
    """J6 (+F4, F5): per (word, target): the best edge of ``word`` whose end
    contains ``target``; when none matches, the number of the word's edges
    that are not self edges (the relations the reference returns)."""
    e = kg.select(F.col("start_text").alias("word"), "end_text")
    matched = best_substring_edges(kg, pairs).select(
        "word", "target", F.struct("end_text", "relation", "weight").alias("_m"))
    rel_count = e.where(F.col("end_text") != F.col("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_rel"))
    j = pairs.join(matched, ["word", "target"], "left").join(rel_count, "word", "left")
    return j.select("word", "target",
                    F.col("_m.end_text").alias("match_end"),
                    F.col("_m.relation").alias("match_relation"),
                    F.col("_m.weight").alias("match_weight"),
                    F.when(F.col("_m").isNull(), F.coalesce(F.col("n_rel"), F.lit(0)))
                    .alias("n_relations"))


def substring_relations(kg: DataFrame, pairs: DataFrame) -> DataFrame:
    """J6 (+F4, F5) when nothing matches: the edges, but for self edges, of each
    word none of whose ends contains its target.  One row per (word, edge), not
    per pair: all such targets of a word share the word's edges."""
    e = kg.select(F.col("start_text").alias("word"), "end_text", "relation", "weight")
    hit = _substring_hits(kg, pairs).select("word", "target").distinct()
    words = pairs.join(hit, ["word", "target"], "left_anti").select("word").distinct()
    return e.where(F.col("end_text") != F.col("word")).join(words, "word", "left_semi") \
        .select("word", "end_text", "relation", "weight")


# ------------------------------------------------------------------ S8: JSON
EDGE_JSON_SCHEMA = ("edges ARRAY<STRUCT<surfaceText: STRING, weight: DOUBLE, "
                    "rel: STRUCT<label: STRING>, end: STRUCT<label: STRING>>>")


def edges_to_json(kg: DataFrame, page_size: int = 1000) -> DataFrame:
    """Edge documents as an edge service returns them: one JSON document per
    (word, page), each page holding about ``page_size`` edges.  Pages are hash
    buckets sized from the word's degree, so no word is ever sorted or
    gathered whole in one task."""
    deg = kg.groupBy("start_text").agg(F.count(F.lit(1)).alias("_deg"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("_deg") / page_size))
    bucket = F.pmod(F.xxhash64("end_text", "relation", "end_lang"), pages)
    edge = F.struct(
        F.concat(F.lit("[["), F.col("start_text"), F.lit("]] "), F.col("relation"),
                 F.lit(" [["), F.col("end_text"), F.lit("]]")).alias("surfaceText"),
        F.col("weight"), F.struct(F.col("relation").alias("label")).alias("rel"),
        F.struct(F.col("end_text").alias("label")).alias("end"))
    return (kg.join(deg, "start_text").withColumn("page", bucket)
            .groupBy(F.col("start_text").alias("word"), "page")
            .agg(F.to_json(F.struct(F.collect_list(edge).alias("edges"))).alias("json")))


def parse_edge_json(docs: DataFrame, word: str = "word", doc: str = "json") -> DataFrame:
    """S8 + F4: parse edge documents, one row per edge, self edges dropped."""
    parsed = docs.select(word, F.explode(F.from_json(doc, EDGE_JSON_SCHEMA)["edges"]).alias("e"))
    return parsed.select(word, F.col("e.surfaceText").alias("surface_text"),
                         F.col("e.weight").alias("weight"),
                         F.col("e.rel.label").alias("relation"),
                         F.col("e.end.label").alias("end_text")) \
        .where(F.col("end_text") != F.col(word))
