"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 80; print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_nothing_else_imports_the_training_operators():
    for path in (ROOT / "weft").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "weft.llm" not in path.read_text(), path
