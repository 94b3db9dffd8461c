"""The entry point can be imported and asked before any session exists."""

import subprocess
import sys
from pathlib import Path


def test_entry_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(s) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
