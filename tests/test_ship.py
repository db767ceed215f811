"""The workers need no installed package: it goes with the session."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from outcry.operators import cluster
from outcry.session import build_session
spark = build_session("ship", "local[1]", **{{"spark.ui.enabled": "false"}})
rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "id int, embedding array<double>")
print(sorted((r["id"], r["leader"]) for r in cluster.greedy_clusters(rows, threshold=0.9).collect()))
"""


def test_operators_run_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().splitlines()[-1:] == ["[(1, 1), (2, 1), (3, 3)]"], done.stderr[-1500:]
