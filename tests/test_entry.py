"""The registry: every oracle belongs to a query, and the library stands without its llm part."""

import ast
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_nothing_else_imports_llm():
    for p in (ROOT / "quillspark").rglob("*.py"):
        if "llm" in p.parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("quillspark.llm") for n in names), p
