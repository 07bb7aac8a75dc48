"""A fresh driver process in another folder: workers get the package from it."""

import os
import subprocess
import sys

from tests.conftest import ROOT, SF001

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from milepost.session import build_session
spark = build_session("local[2]", shuffle_partitions=2)
from milepost.llm.registry import LLM_QUERIES
for name in {names!r}:
    print(name, LLM_QUERIES[name](spark, {sf!r}).count())
"""


def test_python_queries_run_without_the_package_on_the_path(tmp_path):
    names = [f"op{n}_{x}" for n, x in (
        (1, "quality"), (3, "substring_dedup"), (4, "jaccard_join"), (6, "topk"), (8, "packing"), (9, "packed_ids"),
        (10, "bpe"), (11, "spelling"), (12, "html"), (13, "collocations"),
    )]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=ROOT, names=names, sf=SF001)
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    assert [line.split()[0] for line in out.stdout.splitlines() if line.startswith("op")] == names
