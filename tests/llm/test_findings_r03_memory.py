"""Pipeline finding: memory of an executor in token_output."""
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline as P
from choicekit.llm import encoder, token_output


def test_frequent_pieces_outlive_a_full_cache(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(encoder, "CACHED_PIECES", 40)
    enc = encoder.ByteEncoder(token_output.VOCABULARY)
    tok = Tokenizer.from_file(public_tokenizers.path(token_output.VOCABULARY))
    learned, learn = [], enc._learn
    monkeypatch.setattr(enc, "_learn", lambda new: (learned.extend(new), learn(new)))
    for i in range(30):
        texts = [f"often seen words, word{chr(97 + i % 26)}{'x' * i} rare{'y' * j}{'z' * i}." for j in range(5)]
        got = enc.encode(pa.array([*texts, None]))
        assert [x.tolist() for x in got] == \
            [tok.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]
        assert len(enc.slot) <= 40
    assert learned.count("often") == learned.count(" seen") == 1     # once, though the cache was full
    assert len(learned) > 40


def test_batches_of_the_pipeline_are_small(spark):
    old = spark.conf.get(P.BATCH_CONF)
    try:
        spark.conf.set(P.BATCH_CONF, 10_000)
        P.ready(spark)

        def rows(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

        n = [r.n for r in spark.range(0, 9_000, 1, 1).mapInArrow(rows, "n long").collect()]
        assert sum(n) == 9_000 and max(n) <= P.BATCH_ROWS
        spark.conf.set(P.BATCH_CONF, 500)
        P.ready(spark)                                               # a smaller one stays
        assert int(spark.conf.get(P.BATCH_CONF)) == 500
    finally:
        spark.conf.set(P.BATCH_CONF, old)
