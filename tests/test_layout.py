"""The library stands without the subpackage for training text."""

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_imports_llm():
    for path in [*ROOT.glob("wakeline/**/*.py"), ROOT / "bench.py"]:
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("wakeline.llm") for n in names), path


def test_no_local_checkpoint():
    for path in [*ROOT.glob("wakeline/**/*.py"), *ROOT.glob("*.py")]:
        assert "localCheckpoint" not in path.read_text(), path
