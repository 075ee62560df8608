"""What a session settles and writes is gone once it says so. Runs in a process of its own, as it clears a whole session."""

from __future__ import annotations

import os
import subprocess
import sys

CODE = """
import os, sys
sys.path.insert(0, sys.argv[1])
from millwright.session import clear, local_session, own_folder, settle
spark = local_session(1, "cleanup")
root = sys.argv[2]
spark.sparkContext.setCheckpointDir(root)
settle(spark.range(10)).count()
spark.range(3).write.parquet(own_folder(spark, "results") + "/x")
files = lambda: [f for _, _, names in os.walk(root) for f in names]
assert files()
clear(spark)
assert not files(), files()
assert settle(spark.range(5)).count() == 5
"""


def test_clear_removes_what_a_session_left(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", CODE, repo, str(tmp_path)], check=True, timeout=300)
