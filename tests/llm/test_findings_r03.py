"""Tests of the findings of round 3: each failed before its fix."""
from __future__ import annotations

import numpy as np

from choicekit.llm import decontaminate, ngram_join
from choicekit.operators import graph


def test_running_votes_wrap_and_stay_exact():
    h = np.random.default_rng(3).integers(0, 1 << 64, 3_000, np.uint64)
    ones = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(decontaminate.votes(h), axis=0, dtype=np.int64)])
    for longest, kind in ((51, np.uint8), (255, np.uint8), (256, np.uint16), (2_900, np.uint16), (70_000, np.uint32)):
        sums = decontaminate.running_votes(h, longest)
        assert sums.dtype == kind             # a byte a vote for windows of everyday benchmarks
        n = min(longest, 2_900)
        assert ((sums[n:] - sums[:-n]) == (ones[n:] - ones[:-n])).all()
        assert (decontaminate.fingerprint(sums[n:] - sums[:-n], n)
                == decontaminate.fingerprint(ones[n:] - ones[:-n], n)).all()


def test_running_votes_of_equal_shingles_reach_the_largest_value():
    h = np.full(600, (1 << 64) - 1, np.uint64)
    sums = decontaminate.running_votes(h, 255)
    assert (sums[255:] - sums[:-255] == 255).all()


def test_sets_that_link_are_few_size_classes_apart():
    n = np.unique(np.concatenate([np.arange(1, 3_000), (1.001 ** np.arange(8_000, 21_000)).astype(np.int64)]))
    for r in n.tolist():
        s = -(-4 * r // 5)                   # the smallest partner
        assert ngram_join.size_class(r) - ngram_join.size_class(s) <= ngram_join.SIZE_SPAN
    assert ngram_join.size_class(1) == 0 and ngram_join.size_class(1 << 31) < 1 << 11


def test_no_guests_between_sizes_that_cannot_link(spark):
    """A key that buyers share with sets far too small or too large brings none of them."""
    buys = [(1, 0, 10, 5, 100), (1, 0, 11, 5, 104), (2, 0, 12, 5, 100)]
    index = [(1, 0, 20, 6, 91), (1, 0, 21, 6, 40), (1, 0, 22, 7, 113), (1, 0, 23, 8, 117), (2, 0, 24, 9, 60)]
    got = {tuple(r) for r in ngram_join.guests(
        spark.createDataFrame(buys, "key long, side int, node long, center long, size int"),
        spark.createDataFrame(index, "key long, side int, other long, home long, size int")).collect()}
    # groups 6 and 7 have no more rows than the buyers and send them; 8 is too large, 9 too small
    assert got == {(5, 20), (5, 22), (5, 5)}


def test_paths_without_labels_are_the_paths_and_known_hops_are_not_looked_up_again(spark):
    rng = np.random.default_rng(11)
    words = [*"abcdefgh", None]
    pick = lambda: words[int(rng.integers(0, 9))]
    kg = spark.createDataFrame(
        [(pick(), ["en", "en", "fr"][i % 3], pick(), ["en", "de"][i % 2], f"r{i % 4}", float(i % 5)) for i in range(60)],
        "start_text string, start_lang string, end_text string, end_lang string, relation string, weight double")
    pairs = spark.createDataFrame([(pick(), pick()) for _ in range(50)], "word string, target string").distinct()
    full = graph.two_hop(kg, pairs)
    slim = graph.two_hop(kg, pairs, hop1=graph.one_hop(kg, pairs), labels=False)
    assert slim.columns == ["word", "middle", "target"]
    key = lambda r: tuple(r)
    assert sorted(map(key, slim.collect())) == sorted(map(key, full.select(*slim.columns).collect()))
    none = spark.createDataFrame([], "word string, target string")
    asked = graph.two_hop(kg, pairs, hop1=none, labels=False).select("word", "target").distinct().count()
    assert asked >= slim.select("word", "target").distinct().count()
    linked = {(r.word, r.target): (r.hops, r.n_paths) for r in graph.link_pairs(kg, pairs).collect()}
    one = {tuple(r) for r in graph.one_hop(kg, pairs).select("word", "target").collect()}
    count = {(r.word, r.target): r["count"] for r in full.groupBy("word", "target").count().collect()}
    assert linked == {tuple(r): (1, 1) if tuple(r) in one else (2, count[tuple(r)]) if tuple(r) in count else (None, None)
                      for r in pairs.collect()}


def test_sketches_lose_no_link_and_keep_strangers_out():
    """Texts are sent to a tile only for documents that may link there."""
    rng = np.random.default_rng(5)
    for n in (1, 4, 9, 20, 53, 54, 107, 300, 1_000, 6_000, 50_000):
        one = rng.integers(0, 1 << 64, n, np.uint64)
        for part in (0.0, 0.05, 0.1, 0.2, 0.25):
            cut, add = int(n * part), int(n * part * rng.random())
            for two in (one[cut:], np.concatenate([one, rng.integers(0, 1 << 64, cut, np.uint64)]),
                        np.concatenate([one[add // 2:], rng.integers(0, 1 << 64, add // 2, np.uint64)])):
                inter = len(np.intersect1d(one, two))
                if 100 * inter < 80 * (len(one) + len(two) - inter):
                    continue
                far = [rng.integers(0, 1 << 64, n + 7, np.uint64) for _ in range(3)]
                sets = [one, *far[:1], two, *far[1:]]
                for first in (None, 2):
                    got = ngram_join.may_link(np.array([len(s) for s in sets], np.int64),
                                              [ngram_join.sketch(np.sort(s)) for s in sets], first)
                    assert got[0] and got[2]
                    assert n < 54 or not got[[1, 3, 4]].any()
    same_side = [one[:100], one[:99], rng.integers(0, 1 << 64, 100, np.uint64)]
    assert not ngram_join.may_link(np.array([100, 99, 100], np.int64), [ngram_join.sketch(s) for s in same_side], 2).any()


def test_a_folded_sketch_is_the_sketch_of_half_as_many_segments(monkeypatch):
    s = np.random.default_rng(6).integers(0, 1 << 64, 400, np.uint64)
    whole = np.frombuffer(ngram_join.sketch(s), np.uint8)
    monkeypatch.setattr(ngram_join, "sketch_size", lambda n: len(whole) // 2)
    assert (np.frombuffer(ngram_join.sketch(s), np.uint8) == whole[:len(whole) // 2] + whole[len(whole) // 2:]).all()


def test_window_prints_are_the_fingerprints_of_all_windows():
    """Votes are counted a few windows at a time, running sums from block to block."""
    rng = np.random.default_rng(7)
    for size in (12, 63, 64, 65, 129, 5_000):
        h = rng.integers(0, 1 << 64, size, np.uint64)
        ones = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(decontaminate.votes(h), axis=0, dtype=np.int64)])
        for n, step in ((10, 1), (11, 2), (255, 3), (300, 3)):
            if size <= n:
                continue
            sums = decontaminate.running_votes(h, n)
            assert sums.shape == (size + 1, 64) and not sums[0].any()
            plain = [sum(1 << (8 * (b // 8) + 7 - b % 8) for b in range(64) if v[b] > n // 2)
                     for v in ones[n::step][:200] - ones[:-n:step][:200]]
            got = decontaminate.window_prints(sums, n, step)
            assert len(got) == len(range(0, size - n + 1, step)) and got[:200].tolist() == plain
