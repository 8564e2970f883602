"""Named, restartable stages of a flow.

Every stage of a flow writes one folder, ``<root>/<stage>/<key>``.  The key is a digest of
the stage's name, its parameters, the files of its inputs (path, length, time of change) and
the keys of the stages it uses, so another input, parameter or upstream result makes another
folder.  A mark is written after the data is committed; a stage with a mark is read, any
other folder is a broken attempt and is written anew.  A flow that broke is simply run again:

    flow = Stages(spark, "<shared folder>/enrich", inputs=[items_path])
    grams = flow.run("ngrams", lambda: with_ngrams(spark.read.parquet(items_path)))
    said = flow.run("translated", lambda: translate(grams), uses=["ngrams"])
    flow.clean()      # removes folders of other keys

All paths go through Spark's file systems, so the root may be any shared storage.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

MARK = "_stage.json"


class Stages:
    def __init__(self, spark: SparkSession, root: str, inputs: Sequence[str] = (), version: str = "1"):
        """``inputs``: files or folders every stage depends on.  ``version`` stands for the
        code of the flow: another one builds everything anew."""
        self.spark, self.root = spark, root.rstrip("/")
        self._of = {"version": version, "inputs": [self._signature(p) for p in inputs]}
        self.keys: dict[str, str] = {}
        self.built: list[str] = []       # stages written by this run, in order
        self.reused: list[str] = []      # stages that were found whole

    # -- files ---------------------------------------------------------------------------
    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _signature(self, path: str) -> list:
        p, fs = self._path(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        found, out = fs.listFiles(p, True), []
        while found.hasNext():
            f = found.next()
            out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
        return sorted(out)

    def _mark(self, folder: str) -> dict | None:
        p, fs = self._path(f"{folder}/{MARK}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write_mark(self, folder: str, mark: dict) -> None:
        p, fs = self._path(f"{folder}/{MARK}")
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(json.dumps(mark).encode()))
        finally:
            stream.close()

    # -- stages --------------------------------------------------------------------------
    def key(self, name: str, params: dict | None = None, uses: Sequence[str] = ()) -> str:
        missing = [u for u in uses if u not in self.keys]
        if missing:
            raise KeyError(f"stage {name!r} uses stages that have not run: {missing}")
        text = json.dumps([name, params or {}, self._of, [self.keys[u] for u in uses]], sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:24]

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}/{self.keys[name]}"

    def run(self, name: str, build: Callable[[], DataFrame], params: dict | None = None,
            uses: Sequence[str] = (), partition_by: str | None = None) -> DataFrame:
        """The stage's rows, read back from its folder; ``build`` is called only when no
        whole folder of this key exists."""
        if not name or "/" in name or name.startswith(("_", ".")):
            raise ValueError(f"not a stage name: {name!r}")
        key = self.key(name, params, uses)
        folder = f"{self.root}/{name}/{key}"
        mark = self._mark(folder)
        if mark is None:
            df = build()
            w = df.write.mode("overwrite")
            (w.partitionBy(partition_by) if partition_by else w).parquet(folder)
            mark = {"key": key, "schema": df.schema.jsonValue()}
            self._write_mark(folder, mark)
            self.built.append(name)
        else:
            self.reused.append(name)
        self.keys[name] = key
        # the schema of the mark: partition columns keep their type, an empty stage reads too
        return self.spark.read.schema(StructType.fromJson(mark["schema"])).parquet(folder)

    def clean(self) -> list[str]:
        """Remove what other keys, broken attempts included, left of the stages of this run."""
        gone = []
        for name, key in self.keys.items():
            p, fs = self._path(f"{self.root}/{name}")
            for status in fs.listStatus(p):
                if status.getPath().getName() != key:
                    fs.delete(status.getPath(), True)
                    gone.append(f"{name}/{status.getPath().getName()}")
        return gone
