"""The pipeline's stages against brute force on the smoke tables."""
import corpus_pipeline as P

from .test_operators import brute_components, brute_leaks


def test_stages(spark, sf_dir):
    docs = P.read(spark, sf_dir, "documents")
    columns = docs.columns
    seen = []
    for name, fn in P.STAGES[:-1]:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = P.stage(fn(spark, docs, sf_dir), f"test-{name}")
        assert out.columns == columns
        ids = {r.doc_id for r in out.collect()}
        if name == "near_duplicates":
            assert ids == {c for _, c in brute_components(rows).values()}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in P.read(spark, sf_dir, "benchmark").collect()]
            assert ids == {i for i, _ in rows} - {d for d, _ in brute_leaks(rows, items)}
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in P.read(spark, sf_dir, "labels").collect()}
            gone = {i for i, _ in rows} - ids
            assert sum(labels.get(i) == 0 for i in gone) <= 0.02 * sum(v == 0 for v in labels.values()) + 1
            assert sum(v == 1 and i in ids for i, v in labels.items()) <= 0.1 * sum(labels.values()) + 1
        seen.append(name)
        docs = out
    last = P.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()
    assert [*seen, P.STAGES[-1][0]] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
