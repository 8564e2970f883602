"""Sources and sinks: CSV/TSV round trip of hostile text, delimited lists at
the CSV edge, split-partitioned catalog with pruning, stage Parquet, and the
incremental file stream (exactly-once, resumes from its checkpoint)."""
import io
import contextlib

from choicekit.operators import reshape as R
from choicekit.plans.fixtures import mc_items_from
from choicekit.session import shared_dir
from choicekit.sources import files as FS
from choicekit.sources.catalog import Catalog
from choicekit.streaming.incremental import start_file_stream

ROWS = [(1, 'line one\nline "two", with comma', "a|b"), (2, "", None), (3, None, "x\ty"),
        (4, "  spaced  ", "")]
SCHEMA = "id long, text string, opts string"


def test_csv_and_tsv_round_trip_hostile_text(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for sep in (",", "\t"):
        path = FS.write_csv(df, shared_dir(spark, "csvtest"), sep=sep)
        back = FS.read_csv(spark, path, SCHEMA, sep=sep)
        assert sorted(back.collect()) == sorted(df.collect())


def test_delimited_lists_at_the_edge(spark):
    df = spark.createDataFrame([(1, ["a,b", "c", ""])], "id long, opts array<string>")
    flat = FS.to_delimited(df, ["opts"], "|")
    assert flat.first().opts == "a,b|c|"
    assert FS.from_delimited(flat, ["opts"], "|").first().opts == ["a,b", "c", ""]


def test_catalog_partition_pruning(spark):
    df = spark.createDataFrame([(1, "train"), (2, "validation"), (3, "test")], "id long, split string")
    cat = Catalog()
    cat.save(df, "toy", None, shared_dir(spark, "cat"))
    out = cat.load(spark, "toy", None, splits=["test"])
    assert [r.id for r in out.collect()] == [3]
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    assert "PartitionFilters: [isnotnull(split" in buf.getvalue()


def test_stage_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(FS.stage(df, "st").collect()) == sorted(df.collect())


def test_incremental_stream_is_exactly_once(spark):
    src = shared_dir(spark, "stream_src")
    out = shared_dir(spark, "stream_out")
    text = "Q one. Opt a. Opt b. Opt c. Opt d."

    import os
    import pyarrow as pa
    import pyarrow.parquet as pq
    os.makedirs(src, exist_ok=True)

    def drop(batch, name):                # a new file lands in the watched folder
        ids, texts = zip(*batch)
        pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()),
                                 "text": pa.array(texts, pa.string())}),
                       f"{src}/{name}.parquet")

    def run():
        q = start_file_stream(spark, src, "*.parquet",
                              lambda d: R.binarise_by_letter(mc_items_from(d)),
                              f"{out}/data", f"{out}/ck")
        q.awaitTermination()
        return spark.read.parquet(f"{out}/data")

    drop([(1, text), (2, text)], "b1")
    first = run()
    assert first.count() == 8
    drop([(3, text)], "b2")
    second = run()                      # restart: only the new file is read
    assert second.count() == 12
    assert second.groupBy("example_id").count().where("count != 4").count() == 0


def test_stream_of_a_folder_and_of_a_file(spark):
    """A table is one file or a folder of files."""
    base = shared_dir(spark, "stream-folder")
    spark.range(10).repartition(3).write.parquet(f"{base}/many.parquet")
    spark.range(10).coalesce(1).write.parquet(f"{base}/parts")
    import glob
    import shutil
    shutil.copy(glob.glob(f"{base}/parts/*.parquet")[0], f"{base}/one.parquet")
    for name in ("many.parquet", "one.parquet"):
        out = shared_dir(spark, "stream-out")
        start_file_stream(spark, base, name, lambda d: d, f"{out}/data", f"{out}/ck").awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(f"{out}/data").collect()) == list(range(10))


def test_catalog_json_entry(spark):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string")
    path = shared_dir(spark, "catjson")
    df.write.partitionBy("split").json(path)
    cat = Catalog()
    cat.register("toy_json", "v1", path, fmt="json")
    assert [r.id for r in cat.load(spark, "toy_json", "v1", splits=["train"]).collect()] == [1]
