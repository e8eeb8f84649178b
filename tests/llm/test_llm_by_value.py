"""Operators whose tasks run where the package is not installed."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {root!r})
from eventloom.session import get_session
spark = get_session("away", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g"}})
from eventloom.llm import queries
for key, fn in queries.PLANS.items():
    print("DONE", key, len(fn(spark, {sf!r}).collect()), flush=True)
"""


def test_workers_need_no_package(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    from eventloom.llm import queries
    assert [line.split()[1] for line in out.stdout.splitlines() if line.startswith("DONE")] == list(queries.PLANS), out.stderr[-2000:]
