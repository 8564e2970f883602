"""Restart of a flow from its last whole stage."""
import os

import pytest

from choicekit.session import shared_dir
from choicekit.sources.stages import MARK, Stages


@pytest.fixture
def source(spark):
    path = shared_dir(spark, "flow-input")
    spark.range(20).selectExpr("id", "id % 3 AS split").write.parquet(path)
    return path


class Flow:
    """Three stages; counts the calls of each builder and may break in one."""

    def __init__(self, spark, root, source):
        self.spark, self.root, self.source, self.calls = spark, root, source, []

    def run(self, stop=None, factor=2, version="1"):
        st = Stages(self.spark, self.root, [self.source], version)

        def step(name, fn):
            def build():
                self.calls.append(name)
                if name == stop:
                    raise InterruptedError(name)
                return fn()
            return build
        a = st.run("a", step("a", lambda: self.spark.read.parquet(self.source)))
        b = st.run("b", step("b", lambda: a.selectExpr("id", f"id * {factor} AS x", "split")), {"factor": factor},
                   ["a"], partition_by="split")
        c = st.run("c", step("c", lambda: b.groupBy("split").sum("x")), uses=["b"])
        return st, c


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_broken_flow_goes_on_from_its_last_stage(spark, source):
    f = Flow(spark, shared_dir(spark, "flow"), source)
    with pytest.raises(InterruptedError):
        f.run(stop="c")
    st, out = f.run()
    assert f.calls == ["a", "b", "c", "c"] and st.reused == ["a", "b"] and st.built == ["c"]
    want = {k: sum(2 * i for i in range(20) if i % 3 == k) for k in range(3)}
    assert dict(rows(out)) == want
    st, out = f.run()
    assert st.built == [] and dict(rows(out)) == want


def test_unmarked_folder_is_written_anew(spark, source):
    f = Flow(spark, shared_dir(spark, "flow"), source)
    st, _ = f.run()
    os.remove(f"{st.folder('b')}/{MARK}".removeprefix("file:"))
    st, out = f.run()
    assert st.reused == ["a", "c"] and st.built == ["b"]


def test_other_parameters_inputs_and_versions_build_anew(spark, source):
    f = Flow(spark, shared_dir(spark, "flow"), source)
    first, _ = f.run()
    st, out = f.run(factor=3)
    assert st.built == ["b", "c"] and dict(rows(out))[0] == 3 * sum(range(0, 20, 3))
    assert sorted(st.clean()) == sorted(f"{n}/{first.keys[n]}" for n in "bc")
    spark.range(5).selectExpr("id", "id % 3 AS split").write.mode("append").parquet(source)
    assert f.run()[0].built == ["a", "b", "c"]
    assert f.run(version="2")[0].built == ["a", "b", "c"]


def test_empty_stage_and_errors(spark, source):
    st = Stages(spark, shared_dir(spark, "flow"), [source])
    out = st.run("none", lambda: spark.read.parquet(source).where("id < 0"), partition_by="split")
    assert out.count() == 0 and dict(out.dtypes) == {"id": "bigint", "split": "bigint"}
    with pytest.raises(KeyError):
        st.run("x", lambda: out, uses=["never"])
    with pytest.raises(ValueError):
        st.run("a/b", lambda: out)
    with pytest.raises(FileNotFoundError):
        Stages(spark, "/nowhere", ["/no/such/input"])
