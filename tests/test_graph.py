"""Graph operators: B8 (target ignores language), B9 (k = 0), B21 (missing
word), F4 (self edges), two-hop only without one-hop, hub words."""
from choicekit.operators import graph as G

EDGES = [
    ("car", "en", "wheel", "en", "HasA", 2.0),
    ("car", "en", "auto", "es", "Synonym", 1.0),       # target in a non-English end
    ("car", "en", "road", "en", "AtLocation", 3.0),
    ("car", "en", "car", "en", "RelatedTo", 0.5),        # self edge
    ("wheel", "en", "circle", "en", "IsA", 1.5),
    ("road", "en", "circle", "fr", "RelatedTo", 0.7),
    ("road", "en", "circle", "en", "RelatedTo", 0.9),
]


def kg(spark):
    return spark.createDataFrame(EDGES, "start_text string, start_lang string, end_text string, "
                                        "end_lang string, relation string, weight double")


def pairs(spark, rows):
    return spark.createDataFrame(rows, "word string, target string")


def test_one_hop_any_language(spark):
    r = G.one_hop(kg(spark), pairs(spark, [("car", "auto"), ("car", "circle")])).collect()
    assert [(x.word, x.target, x.relation) for x in r] == [("car", "auto", "Synonym")]


def test_two_hop_only_when_no_one_hop(spark):
    p = pairs(spark, [("car", "circle"), ("car", "wheel"), ("nope", "circle")])
    r = sorted((x.target, x.middle, x.weight_2) for x in G.two_hop(kg(spark), p).collect())
    assert r == [("circle", "road", 0.9), ("circle", "wheel", 1.5)]
    links = {(x.word, x.target): (x.hops, x.n_paths) for x in G.link_pairs(kg(spark), p).collect()}
    assert links == {("car", "circle"): (2, 2), ("car", "wheel"): (1, 1), ("nope", "circle"): (None, None)}


def test_top_k_ascending_and_zero(spark):
    r = G.top_k_by_weight(kg(spark), 2).where("word = 'car'").orderBy("pos").collect()
    assert [x.end_text for x in r] == ["wheel", "road"]
    assert G.top_k_by_weight(kg(spark), 0).count() == 0
    assert G.top_k_by_weight(kg(spark), 99).where("word = 'car'").count() == 3


def test_substring_target_and_relations(spark):
    p = pairs(spark, [("car", "whe"), ("car", "zzz"), ("nope", "x")])
    r = {x.target: (x.match_end, x.n_relations) for x in G.substring_target(kg(spark), p).collect()}
    assert r == {"whe": ("wheel", None), "zzz": (None, 3), "x": (None, 0)}


def test_json_round_trip_drops_self_edges(spark):
    docs = G.edges_to_json(kg(spark), page_size=2)
    parsed = G.parse_edge_json(docs)
    assert parsed.count() == len(EDGES) - 1
    assert parsed.where("word = end_text").count() == 0


def test_limit_per_word(spark):
    assert G.limit_per_word(kg(spark), 2).where("start_text = 'car'").count() == 2


def test_json_pages_bounded_for_a_hub_word(spark):
    hub = [("hub", "en", f"n{i}", "en", "RelatedTo", float(i)) for i in range(40)]
    kg = spark.createDataFrame(hub, "start_text string, start_lang string, end_text string, "
                                    "end_lang string, relation string, weight double")
    docs = G.edges_to_json(kg, page_size=10)
    sizes = [r.n for r in docs.selectExpr(
        "size(from_json(json, 'edges ARRAY<STRUCT<weight: DOUBLE>>').edges) AS n").collect()]
    assert len(sizes) >= 2 and sum(sizes) == 40     # split into pages, nothing lost
    assert G.parse_edge_json(docs).count() == 40


def test_two_hop_lists_paths_from_the_rarer_end(spark, monkeypatch):
    """A hub word, a hub target and pairs between: rows in between are the sum of the smaller
    degrees, hubs are split, and the paths are those of a plain loop."""
    monkeypatch.setattr(G, "HUB_PART", 7)
    edges = {("hub", f"m{i}") for i in range(400)} | {(f"m{i}", "sink") for i in range(0, 400, 2)}
    edges |= {(f"m{i}", f"t{i % 5}") for i in range(10)} | {(f"w{i}", f"m{i}") for i in range(30)} | {("hub", "hub")}
    pairs = [("hub", f"t{i}") for i in range(5)] + [(f"w{i}", "sink") for i in range(30)] + \
        [("hub", "sink"), ("hub", "m3"), ("w1", "nowhere"), ("absent", "sink")]
    kg = spark.createDataFrame([(a, "en", b, "en", "r", 1.0) for a, b in edges],
                               "start_text string, start_lang string, end_text string, end_lang string, relation string, weight double")
    asked = spark.createDataFrame(pairs, "word string, target string")
    want = {(w, m, t) for w, t in pairs if (w, t) not in edges for a, m in edges if a == w and (m, t) in edges}
    got = [(r.word, r.middle, r.target) for r in G.two_hop(kg, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    open_pairs, first, second = G.hops_of(kg, asked)
    out, into = ({r[0]: r[1] for r in d.groupBy(k).count().collect()} for d, k in ((first, "word"), (second, "target")))
    between = sum(min(out[w], into[t]) for w, t in pairs if (w, t) not in edges and w in out and t in into)
    assert sum(d.count() for d in G.half_paths(open_pairs, first, second)) == between < len(want) + 40


def test_substrings_by_rarest_trigram(spark):
    """Against a plain loop, with short, empty and missing targets; candidates near the hits."""
    import random
    rng = random.Random(4)
    ends = {"".join(rng.choice("abé ") for _ in range(rng.randrange(0, 9))) for _ in range(300)}
    rows = [(w, "en", e, "en", r, float(i % 7)) for i, (w, e, r) in enumerate(
        (rng.choice(["x", "y", "hub"]), e, rng.choice("rs")) for e in sorted(ends) for _ in range(2))]
    rows += [("x", "en", "x", "en", "self", 9.0)]
    kg = spark.createDataFrame(rows, "start_text string, start_lang string, end_text string, end_lang string, relation string, weight double")
    asked = {(rng.choice(["x", "y", "hub", "none"]), "".join(rng.choice("abé ") for _ in range(rng.randrange(0, 6)))) for _ in range(200)}
    pairs = spark.createDataFrame(sorted(asked), "word string, target string")
    want = {}
    for w, t in asked:
        hits = [(-x, r, e) for a, _, e, _, r, x in rows if a == w and t in e]
        want[w, t] = (min(hits)[2], min(hits)[1], None) if hits else \
            (None, None, sum(a == w and e != w for a, _, e, _, _, _ in rows))
    got = {(r.word, r.target): (r.match_end, r.match_relation, r.n_relations) for r in G.substring_target(kg, pairs).collect()}
    assert got == want
    left = {w for (w, _), v in want.items() if v[0] is None}
    assert sorted(map(tuple, G.substring_relations(kg, pairs).collect())) == sorted(
        (a, e, r, x) for a, _, e, _, r, x in rows if a in left and e != a)
    long = pairs.where("length(target) >= 3")
    hits = sum(t in e for w, t in asked if len(t) >= 3 for e in {e for a, _, e, _, _, _ in rows if a == w})
    assert hits <= G.substring_candidates(kg, long).count() < 0.5 * sum(
        len({e for a, _, e, _, _, _ in rows if a == w}) for w, t in asked if len(t) >= 3)


def test_substring_targets_in_small_blocks(spark, monkeypatch):
    """Hubs in several parts, null and NaN weights, an edge per language: the best of all."""
    import random
    monkeypatch.setattr(G, "HUB_PART", 7)
    rng = random.Random(9)
    rows = [(rng.choice(["hub", "hub", "x"]), "en", "".join(rng.choice("abé") for _ in range(5)), l, "r",
             rng.choice([None, float("nan"), 1.0, 2.0, 3.0])) for _ in range(60) for l in ("en", "es")]
    kg = spark.createDataFrame(rows, "start_text string, start_lang string, end_text string, end_lang string, relation string, weight double")
    asked = [(w, t) for w in ("hub", "x", "none", None) for t in ("", "a", "bé", "aab", "aaaaaaa", None)]
    pairs = spark.createDataFrame(asked, "word string, target string")
    rank = lambda x: (0, 0.0) if x is None else (2, 0.0) if x != x else (1, -x)
    got = {(r.word, r.target): r.match_end for r in G.substring_target(kg, pairs).collect()}
    assert got == {(w, t): min(((rank(x), e) for a, _, e, _, _, x in rows if a == w and t is not None and t in e),
                               default=(None, None))[1] for w, t in asked}


def test_substring_targets_shuffle_no_runs_of_ends(spark):
    import contextlib
    import io
    kg = spark.createDataFrame([("w", "en", "abc", "en", "r", 1.0)],
                               "start_text string, start_lang string, end_text string, end_lang string, relation string, weight double")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        G.substring_target(kg, spark.createDataFrame([("w", "ab")], "word string, target string")).explain()
    assert "FlatMapCoGroupsInArrow" in out.getvalue() and "gram" not in out.getvalue()
