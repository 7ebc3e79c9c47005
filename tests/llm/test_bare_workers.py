"""Executors hold no copy of the package: every query runs from a folder that isn't the repository's."""

import os
import subprocess
import sys

REPOSITORY = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.append(sys.argv[1])
import __spark_entry__ as entry
from quillfind.functions.session import build_session
spark = build_session("bare", cpus=2, shuffle=2)
for name, query in sorted(entry.queries().items()):
    if name.endswith("_found") or name.startswith(("p8", "log_apply", "summarize", "ppr")):
        print(name, query(spark, sys.argv[2]).count(), flush=True)
"""


def test_bare_workers(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, REPOSITORY, sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert "p4_found" in done.stdout and "p9_found" in done.stdout
