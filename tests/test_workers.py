"""Jobs with Python workers must run where the package is not importable."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as contract
from lapforge.session import build_session
spark = build_session("elsewhere", 4)
found = contract.queries()
print("ROWS", found["m6_run_meta"](spark, {sf!r}).count(), found["s2_sessions_of_a_year"](spark, {sf!r}).count())
"""


def test_from_another_folder(tmp_path, sf_dir):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, sf=sf_dir)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS 60 3" in out.stdout, out.stderr[-2000:]
