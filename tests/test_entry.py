"""The entry points without what the training-data operators need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(block: str) -> set[str]:
    code = f"import sys; {block}; import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_missing_dependencies():
    for module in ("sentencepiece", "tiktoken", "regex", "public_tokenizers", "xxhash"):
        found = names(f"sys.modules[{module!r}] = None")
        assert "item_support" in found and "graph_patterns" in found
        assert "pipeline" not in found and not any(n.startswith("op1_") for n in found)


def test_missing_subpackage():
    found = names("sys.modules['motifloom.llm'] = None")
    assert "item_support" in found and "pipeline" not in found
    assert "item_support" in names("sys.modules['corpus_pipeline'] = None")
