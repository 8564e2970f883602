"""Registering the queries needs no Spark jar, no JVM and no session."""
import subprocess
import sys

CODE = """
import glob
glob.glob = lambda *a, **k: []
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) >= 84 and len(o) >= 76, (len(q), len(o))
"""


def test_queries_import_without_jars(tmp_path):
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True,
                         text=True, env=os.environ | {"PYTHONPATH": root, "SPARK_HOME": "/nonexistent"})
    assert run.returncode == 0, run.stderr
