import os
import re

from skeinflow.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 100


def test_nothing_outside_llm_imports_it():
    for base, dirs, files in os.walk(os.path.join(ROOT, "skeinflow")):
        dirs[:] = [d for d in dirs if d != "llm"]
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"skeinflow\.llm|from \.+llm", open(os.path.join(base, f)).read()), f


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5


def test_queries_run_from_anywhere(tmp_path):
    """The package travels to the Python workers, so neither the folder nor a path setting matters."""
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from skeinflow.session import get_session, release
s = get_session("t", "local[2]", **{{"spark.sql.shuffle.partitions": "2"}})
assert e.queries()["p4_found"](s, "/root/testdata/sf0.001").count() > 0
assert e.queries()["packet_graph"](s, "/root/testdata/sf0.001").count() > 5
assert release(s) > 0 and release(s) == 0
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in got.stdout, got.stderr[-2000:]
