import subprocess
import sys
from pathlib import Path


def test_entry_is_imported_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
