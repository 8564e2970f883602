"""Operators of the training-data subpackage against brute force and on hard rows."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from choicekit.llm import (ann, chat_format, decontaminate, hmm_lm, language_id, mixing, ngram_join,
                           token_output, toxicity, url_filter)
from choicekit.llm.encoder import ByteEncoder
from choicekit.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def words(text):
    return (text or "").encode().lower().split()


def hard_docs(spark):
    """Null and blank texts, short ones, copies, repeated rows, a null source, a clashing column."""
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w59", "zz")
    far = " ".join(f"v{i}" for i in range(60))
    rows = [(1, base, "en", "a", 0, "x"), (2, base.upper(), "en", "a", 0, "x"), (3, near, None, None, 0, None),
            (4, far, "de", "b", 0, "x"), (5, None, None, "b", 0, "x"), (6, "", "en", "b", 0, "x"),
            (7, " \t\n ", "en", "b", 0, "x"), (8, "one two", "en", "b", 0, "x"), (9, "one  two", "en", "b", 0, "x"),
            (10, "a.\nB  c, d", "en", "b", 0, "x"), (10, "a.\nB  c, d", "en", "b", 0, "x"),
            (11, "é ü " * 3000, "de", "a", 0, "x"), (12, "???", "en", "a", 0, "x")]
    return spark.createDataFrame(rows, DOC)


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def brute_components(rows):
    sets = [(i, ngram_join.word_shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                n = len(x & y)
                if n and 100 * n >= 80 * (len(x) + len(y) - n):
                    up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[root(k)] = min(low.get(root(k), i), i)
    return {i: (len(s), low[root(k)]) for k, (i, s) in enumerate(sets)}


@pytest.mark.parametrize("kind", ["hard", "table"])
def test_ngram_join_equals_brute_force(spark, sf_dir, kind):
    docs = hard_docs(spark) if kind == "hard" else docs_of(spark, sf_dir)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = ngram_join.with_components(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_ngram_join_edits_around_one_text(spark):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):                     # near copies at, above and below the threshold
        w = list(base)
        for j in rng.choice(120, rng.integers(0, 6), replace=False):
            w[j] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.with_components(docs).collect()}
    assert got == brute_components(rows)


def test_tiles_split_a_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 8)
    rows = [(i, " ".join([f"t{j}" for j in range(60)] + [f"x{i}"])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in ngram_join.with_components(docs).collect()} == {0}


def test_keep_one_keeps_columns(spark):
    docs = hard_docs(spark)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == [1, 4, 5, 6, 7, 8, 10, 11, 12]


def test_ids_with_several_texts(spark):
    """Rows are joined by their texts, whatever rows their ids share."""
    a, b = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    near = a.replace("a59", "zz")
    rows = [(3, b, None), (5, a, None), (5, b, None), (7, near, None), (2, a + " more", None), (2, "other words here", None),
            (2, a + " more", None), (None, b, None), (None, "alone at last", None), (4, None, None), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, count long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.with_components(docs).collect()),
                 key=lambda r: (r[0] is None, *(-1 if v is None else v for v in r)))
    assert [g for g in got if g[0] is not None] == [
        (2, 1, 2), (2, 57, 2), (2, 57, 2), (3, 56, 3), (4, 0, 4), (4, 0, 4), (5, 56, 2), (5, 56, 3), (7, 56, 2)]
    assert got[-2:] == [(None, 1, got[-2][2]), (None, 56, 3)] and got[-2][2] > 7
    kept = sorted((r.doc_id or 0, r.text or "") for r in ngram_join.keep_one(docs).collect())
    assert kept == [(0, "alone at last"), (2, a + " more"), (2, "other words here"), (3, b), (4, ""), (4, "")]


def test_guests_bring_every_reached_pair_together(spark):
    """Whatever groups a key's buyers and index rows are in, both are members of one group,
    and the larger side of two groups does not move."""
    rng = np.random.default_rng(8)
    home = {n: int(rng.integers(0, 6)) if n < 60 else 1000 + n for n in range(90)}     # the last are alone
    buys = [(int(rng.integers(0, 25)), int(rng.integers(0, 2)), int(n), home[int(n)]) for n in rng.integers(0, 90, 200)]
    index = [(int(rng.integers(0, 25)), int(rng.integers(0, 2)), int(n), home[int(n)]) for n in rng.integers(0, 90, 200)]
    got = {tuple(r) for r in ngram_join.guests(
        spark.createDataFrame(sorted(set(buys)), "key long, side int, node long, center long"),
        spark.createDataFrame(sorted(set(index)), "key long, side int, other long, home long")).collect()}
    member = got | {(h, n) for n, h in home.items()}
    for k, s, n, c in buys:
        for k2, s2, o, h in index:
            if (k, s) == (k2, s2) and c != h:
                assert any((g, n) in member and (g, o) in member for g in (c, h))
    many = [(1, 0, n, 5) for n in range(20)]
    got = {tuple(r) for r in ngram_join.guests(
        spark.createDataFrame(many, "key long, side int, node long, center long"),
        spark.createDataFrame([(1, 0, 77, 6)], "key long, side int, other long, home long")).collect()}
    assert got == {(5, 77), (5, 5)}


def test_keep_one_row_of_a_repeated_document(spark):
    docs = hard_docs(spark)
    docs = docs.union(docs.where("doc_id IN (1, 2, 4, 6)"))      # 6 has no words: both rows stay
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == [1, 4, 5, 6, 6, 7, 8, 10, 11, 12]


@pytest.mark.parametrize("bits", [1, 3, 16, 17, 20])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 9001).astype(np.uint32)
    assert (token_output.unpack(token_output.pack(ids, bits), bits, len(ids)) == ids).all()
    docs = [ids[:10], ids[:0], ids[10:9001]]
    s = token_output.Shard(token_output.image(np.array([3, 4, 9]), docs, bits))
    assert all((s.doc(i) == d).all() for i, d in enumerate(docs))


@pytest.mark.parametrize("kind", ["hard", "table"])
def test_token_output_equals_library(spark, sf_dir, kind):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path(token_output.VOCABULARY))
    docs = hard_docs(spark) if kind == "hard" else docs_of(spark, sf_dir)
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    files, places = token_output.write(docs)
    got = token_output.digest(files, places).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
    one = token_output.read_doc(files, 4)
    assert len(one) == 1 and one[0][-1] == 2


def test_encoder_cuts_only_where_tokens_start():
    enc = ByteEncoder(token_output.VOCABULARY)
    rng = np.random.default_rng(2)
    parts = ["a", "é", "the", " ", " ", "\n", ".", ",", "'s", "1", "  ", "\t", "\u3000", "\u00a0", "\x00", "_", "\x1c"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)]
    for t, a, b in zip(texts, enc.encode(pa.array(texts)), enc.whole(texts), strict=True):
        assert a.tolist() == b.tolist(), repr(t)


def fill(sizes, weights):
    """Shares by weight, none above three times its size, the excess given out again."""
    total, cap = sum(sizes), [3 * s for s in sizes]
    got, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_ and left > 1e-9:
        w = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / w >= cap[i]}
        if not full:
            for i in open_:
                got[i] = left * weights[i] / w
            break
        for i in full:
            got[i] = cap[i]
        left = total - sum(got[i] for i in set(range(len(sizes))) - (open_ - full))
        open_ -= full
    return got


@pytest.mark.parametrize("kind", ["hard", "table"])
def test_mixing_targets_and_limits(spark, sf_dir, kind):
    docs = hard_docs(spark) if kind == "hard" else docs_of(spark, sf_dir)
    docs = docs.select("doc_id", "text", "source")
    out = mixing.taken_words(mixing.plan(docs)).collect()
    again = mixing.taken_words(mixing.plan(docs)).collect()
    key = sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in out)
    assert key == sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in again)
    rows = docs.collect()
    assert len(out) == len(rows)
    size = {r.doc_id: len(words(r.text)) for r in rows}
    per = Counter()
    for r in rows:
        per[r.source] += len(words(r.text))
    names = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None] * (None in per)
    want = dict(zip(names, fill([per[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    source = {r.doc_id: r.source for r in rows}
    taken = Counter()
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == per[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= max(0.1 * want[s], 4 * mixing.BLOCK)


def test_mixing_small_sources_come_near_their_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(1000 * k + j, " ".join(["w"] * int(n)), f"s{k:03}") for k in range(60)
            for j, n in enumerate(rng.multinomial(10 + 5 * k, [0.5, 0.3, 0.2]))]
    rows += [(10 ** 6 + i, " ".join(["w"] * 500), "s100") for i in range(30)]
    out = mixing.taken_words(mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    source = {r[0]: r[2] for r in rows}
    taken, target, size = Counter(), {}, {}
    for r in out:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]], size[source[r.doc_id]] = r.target, r.source_size
        assert r.taken <= 3 * r.size
    for s, want in target.items():
        assert abs(taken[s] - want) <= -(-size[s] // mixing.BLOCK) + 1
    assert abs(sum(taken.values()) - sum(target.values())) < 0.01 * sum(target.values())


def test_mixing_columns_of_any_name(spark):
    docs = docs_of(spark, "/root/testdata/sf0.001").limit(50)
    for c in ("size", "words", "parts", "epoch", "first", "n", "block", "target", "h", "si", "p0"):
        docs = docs.withColumn(c, F.lit(c))
    out = mixing.mix(docs)
    assert out.columns == docs.columns and {r.epoch for r in out.collect()} == {"epoch"}


def test_mixing_text_holds_the_words_taken(spark):
    docs = hard_docs(spark)
    p = mixing.plan(docs, block=4)
    want = Counter()
    for r in mixing.taken_words(p).collect():
        want[r.doc_id] += r.taken
    mixed = mixing.mix(docs, block=4)
    assert mixed.columns == docs.columns
    got, texts = Counter(), {}
    for r in docs.collect():
        texts[r.doc_id] = r.text or ""
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
        assert set(words(r.text)) <= set(words(texts[r.doc_id]))
    assert got == Counter({k: v for k, v in want.items() if v})


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(99).cast("long")).alias("x"))
        assert sorted(r.x for r in got.collect()) == list(range(n))


def judge_one(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_url_filter_rules_and_list(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(
        [(-1, None), (-2, ""), (-3, "no host"), (-4, "HTTP://WWW.Example.COM/en/x?utm_source=a#b"),
         (-5, "x://other.net"), (-6, "x://a.net/es/1"), (-6, "x://a.net/es/1"), (-7, "s://q.org/p/?b=2&a=1&ref=z"),
         (-8, "s://www.q.org/p?a=1&b=2")], "page_id long, url string"))
    listed = spark.createDataFrame([("q.org/p?a=1&b=2",), (None,), ("never.org/x",)], "canon string")
    got = url_filter.judge(pages, listed, blocks=8).collect()
    assert len(got) == pages.count()
    for r in got:
        host, path, rule, verdict = judge_one(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.listed == (r.page_id in (-7, -8))
        assert r.verdict == (verdict or ("block" if r.listed else "allow"))


def test_url_filter_has_no_false_positive(spark):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("h://a.org/"), "id").alias("url"))
    listed = spark.range(0, 3000, 3).select(F.concat(F.lit("a.org/"), "id").alias("canon"))
    got = url_filter.judge(pages, listed, rules=(), blocks=16).where("listed")
    assert sorted(r.page_id for r in got.collect()) == list(range(0, 3000, 3))


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "CHUNK", 4)
    nasty = ["\\", "<", "\\l", "\\b<", "</turn>\n", "<more>", "<turn>assistant<says>", "", None, "é😀"]
    rows = [(1, i, "assistant" if i % 3 else "user", nasty[i % len(nasty)]) for i in range(23)]
    rows += [(2, 0, None, "x"), (2, 0, None, "x"), (2, None, "a<b", "y"), (3, 7, "assistant", "z"), (3, 8, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = chat_format.format_conversations(df)
    out = out.select("*", chat_format.turns_of(F.col("formatted")).alias("turns"),
                     chat_format.loss_text(F.col("formatted"), F.col("spans")).alias("loss")).collect()
    assert len(out) == 3
    for r in out:
        mine = sorted(((x[1] is not None, x[1] or 0, x[2] or "null", x[3] or "") for x in rows if x[0] == r.conv_id))
        want = [(x[2], x[3]) for x in mine]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert len(r.spans) == sum(role == "assistant" for role, _ in want)
        assert r.n_blocks == sum(i == 0 or want[i - 1][0] != w[0] for i, w in enumerate(want))


def test_chat_query_digests(spark, sf_dir):
    got = {r.conv_id: r for r in QUERIES["op5_chat_format"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.turn):
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    by[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    assert set(got) == set(by)
    for k, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(turns), digest(turns))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_toxicity_learns_labels(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        w = [f"w{x}" for x in rng.integers(0, 300, 40)]
        bad = i % 8 == 0
        if bad:
            w[5] = ["grumpf", "vexalor", "vexalum"][i // 8 % 3]
        rows.append((i, " ".join(w), "en", "a", 0, "x"))
        if i < 300:
            labels.append((i, int(bad)))
    rows += [(1000, None, None, None, 0, None), (1001, "", "en", "a", 0, "x"), (1002, "Vexalix!", "en", "a", 0, "x")]
    docs = spark.createDataFrame(rows, DOC)
    lab = spark.createDataFrame([*labels, (5, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert {i for i, r in got.items() if r.toxic} == {i for i in range(0, 400, 8)} | {1002}
    assert all(0 <= r.severity <= 2 for r in got.values())
    assert model.thresholds[0] <= model.thresholds[1]
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 51
    none = toxicity.fit(docs, lab.where("toxic = 0"))
    assert not any(r.toxic for r in toxicity.score(docs, none).collect())


def test_toxicity_learns_rare_labels(spark):
    """One in a hundred is toxic and the sample is small: both labels are still in it."""
    rng = np.random.default_rng(6)
    common = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*rng.choice(common, 40), *(["vile", "nasty"] * 3 if i % 100 == 0 else [])])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 100 == 0)) for i, _ in rows] + [(10 ** 6 + i, 0) for i in range(3000)],
                                   "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, toxicity.fit(docs, labels, 160)).collect()}
    assert sum(bool(got[i]) for i in range(0, 2000, 100)) >= 19
    assert sum(bool(v) for i, v in got.items() if i % 100) <= 20


def test_language_id_query_null_id(spark, tmp_path):
    docs = docs_of(spark, "/root/testdata/sf0.001").limit(80)
    docs.union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op6_language_id"](spark, str(tmp_path)).collect()
    assert [r.held_out for r in out if r.doc_id is None] == [False] and all(r.held_out is not None for r in out)


def test_language_id_held_out(spark, sf_dir):
    got = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01")
    lang = docs_of(spark, "/root/testdata/sf0.01").select("doc_id", "lang")
    held = got.join(lang, "doc_id").where("held_out AND lang IS NOT NULL")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()


def test_language_id_hard_rows(spark):
    docs = hard_docs(spark)
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (5, 6, 7, 12))
    assert all(got[i].lang_pred in ("de", "en") and 0 <= got[i].score <= 1 for i in (1, 4, 11))
    assert language_id.fit(docs.where("lang = 'xx'")) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def forward_backward(m, s):
    n, k = len(s), len(m.start)
    a, b = np.zeros((n, k)), np.ones((n, k))
    a[0] = m.start * m.emit[s[0]]
    for t in range(1, n):
        a[t] = (a[t - 1] @ m.move) * m.emit[s[t]]
    for t in range(n - 2, -1, -1):
        b[t] = m.move @ (m.emit[s[t + 1]] * b[t + 1])
    total = a[-1].sum()
    moves = sum((a[t][:, None] * m.move * (m.emit[s[t + 1]] * b[t + 1])[None, :] for t in range(n - 1)),
                np.zeros((k, k))) / total
    return np.log(total), a * b / total, moves


def test_hmm_messages_are_exact(monkeypatch):
    monkeypatch.setattr(hmm_lm, "CHUNK", 5)
    rng = np.random.default_rng(0)
    m = hmm_lm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3), hmm_lm.CLASSES))
    seqs = [rng.integers(0, hmm_lm.CLASSES, n) for n in (1, 4, 5, 6, 17, 23)]
    ref = [forward_backward(m, s) for s in seqs]
    assert np.allclose(hmm_lm.log_likelihood(m, seqs), [r[0] for r in ref])
    init, move, emit = hmm_lm.expected(m, seqs)
    assert np.allclose(init, sum(r[1][0] for r in ref)) and np.allclose(move, sum(r[2] for r in ref))
    want = np.zeros_like(emit)
    for s, r in zip(seqs, ref, strict=True):
        np.add.at(want, s, r[1])
    assert np.allclose(emit, want)


@pytest.mark.parametrize("kind", ["hard", "table"])
def test_lm_base_score_and_gain(spark, sf_dir, kind, monkeypatch):
    if kind == "hard":
        monkeypatch.setattr(hmm_lm, "HEAD", 20)          # most words take the join
    docs = hard_docs(spark) if kind == "hard" else docs_of(spark, sf_dir)
    rows = [(r.doc_id, [*words(r.text), "END"]) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, ws in rows if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = hmm_lm.score(docs).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        ws = by[r.doc_id]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ws), n)
        assert r.n_known == sum(c[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0
    if kind == "table":
        out = [r for r in got if r.held_out]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)


def brute_search(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 3
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            s = sorted(((-float(v @ w), j) for j, w in ok if j != i))
            out[i] = [j for _, j in s[:k]]
    return out


def test_ann_hard_rows(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 60)]                    # one vector, many rows
    rows += [(100, [0.0, 1.0, 0.5]), (101, [0.0, 2.0, 1.0]), (120, None), (140, [0.0, 0.0, 0.0]),
             (160, [float("nan"), 1.0, 1.0]), (180, [1.0, None, 1.0]), (None, [1.0, 1.0, 1.0]),
             (200, [float("inf"), 1.0, 1.0]), (102, [1.0]), (103, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, lambda v: v % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute_search(rows, 20)
    assert ann.search(df.where("vec_id = 120"), lambda v: v % 20 == 0).count() == 0


def test_ann_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in ann.search(df, lambda v: v % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(got[q] & set(ids[np.argsort(-s, kind="stable")[:20]]))
    assert hit >= 0.9 * 20 * len(got)


def brute_leaks(docs, items):
    found = set()
    for d, t in docs:
        w = words(t)
        for i, text in items:
            x = words(text)
            k = min(5, len(x))
            if not x or len(w) < k:
                continue
            a = Counter(tuple(x[j:j + k]) for j in range(len(x) - k + 1))
            for s in range(max(0, len(w) - len(x)) + 1):
                part = w[s:s + len(x)]
                b = Counter(tuple(part[j:j + k]) for j in range(len(part) - k + 1))
                n = sum((a & b).values())
                if n and n / (sum(a.values()) + sum(b.values()) - n) >= 0.8:
                    found.add((d, i))
                    break
    return found


def test_decontamination_hard_rows(spark):
    rng = np.random.default_rng(4)
    noise = lambda n: [f"n{x}" for x in rng.integers(0, 5000, n)]
    items = [(i, " ".join(f"i{i}_{j}" for j in range(n))) for i, n in enumerate((15, 22, 37, 57, 3))]
    items += [(50, None), (51, ""), (52, items[2][1])]
    docs = [(i, " ".join(noise(90 + i) + text.upper().split() + noise(40))) for i, text in items[:5]]
    docs += [(20, items[2][1]), (21, " ".join(items[3][1].split()[3:])), (22, " ".join(noise(300))), (23, None),
             (24, "  "), (25, " ".join(noise(40_000)) + " " + items[1][1]), (26, " ".join(items[3][1].split()[:20]))]
    d = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    want = brute_leaks(docs, items)
    got = decontaminate.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, per_pass=2).collect()} == want
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {x[0] for x in docs} - {x[0] for x in want}


def test_decontamination_finds_edited_items(spark):
    """One changed word in 50 to 60, two in 97 to 100, a dropped and an added word: near 0.8."""
    rng = np.random.default_rng(6)
    items, docs = [], []
    for i in range(400):
        n = int(rng.integers(50, 61) if i % 2 else rng.integers(97, 101))
        w = [f"i{i}_{j}" for j in range(n)]
        items.append((i, " ".join(w)))
        for at in rng.choice(np.arange(5, n - 5), 1 if i % 2 else 2, replace=False):
            w[at] = "changed"
        if i % 7 == 0:
            w = w[:20] + w[21:] if i % 14 else [*w[:20], "more", *w[20:]]
        pad = [f"p{i}_{j}" for j in range(int(rng.integers(0, 40)))]
        docs.append((i, " ".join(pad + w + pad)))
    want = {x for d, item in zip(docs, items, strict=True) for x in brute_leaks([d], [item])}
    assert 200 < len(want) <= 400
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == want


def test_decontamination_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in docs_of(spark, sf_dir).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = QUERIES["op1_decontaminate"](spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(rows, items)


def test_null_ids_are_decided_too(spark):
    text = lambda name, n=60: " ".join(f"{name}{j}" for j in range(n))
    rows = [(1, text("a")), (None, text("b")), (None, text("a")), (None, None), (None, None)]
    items = spark.createDataFrame([(7, text("b")), (8, text("c"))], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "en", "a", 0, "x") for i, t in rows], DOC)
    for per_pass in ((), (1,)):
        left = decontaminate.clean(docs, items, *per_pass)
        assert left.columns == docs.columns
        assert Counter(r.text for r in left.collect()) == Counter({text("a"): 2, None: 2})

    model = toxicity.Model(np.array(sorted(toxicity.word_features(b"b3"))), np.full(len(toxicity.word_features(b"b3")), 9.0),
                           np.array([1.0, 2.0]), 0.5)
    assert Counter(r.text for r in toxicity.reject(docs, model).collect()) == Counter({text("a"): 2, None: 2})

    w = text("d", 110).split()                 # the first and last are linked by the middle one alone
    chain = [" ".join(w[i:i + 90]) for i in (0, 5, 10)]
    near = [(3, chain[0]), (None, chain[1]), (4, chain[2]), (None, chain[1]), (None, text("e")), (None, text("e")),
            (None, text("f")), (None, None), (None, " ")]
    want = brute_components([(i if i is not None else 100 + k, t) for k, (i, t) in enumerate(near)])
    assert want[4][1] == 3 and brute_components([(3, chain[0]), (4, chain[2])])[4][1] == 4
    docs = spark.createDataFrame([(i, t, "en", "a", 0, "x") for i, t in near], DOC)
    got = ngram_join.with_components(docs).collect()
    assert len(got) == len(near)
    sizes = lambda c: sorted(Counter(c).values())
    assert sizes(r.component_id for r in got) == sizes(c for _, c in want.values())
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(3, 3), (4, 3)}
    assert sum(r.doc_id is None and r.component_id == 3 for r in got) == 2
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(3, chain[0]), (None, text("e")), (None, text("f")), (None, None), (None, " ")])


def test_empty_tables(spark):
    docs = hard_docs(spark).where("doc_id < 0")
    items = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.with_components(docs).count() == 0
    assert token_output.digest(*token_output.write(docs)).count() == 0
    assert mixing.taken_words(mixing.plan(docs)).count() == 0
    assert hmm_lm.score(docs).count() == 0
    assert decontaminate.contaminated(hard_docs(spark), items).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda v: v >= 0).count() == 0
    assert chat_format.format_conversations(spark.createDataFrame(
        [], "conv_id long, turn int, role string, text string")).count() == 0
