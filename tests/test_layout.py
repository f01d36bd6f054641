"""Nothing outside the llm folders needs them."""

import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_library_does_not_import_llm():
    for path in (ROOT / "docindex").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path


def test_entry_imports_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "docindex"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = "import sys; sys.modules['docindex.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries()) and not any(n.startswith('op1') for n in e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
