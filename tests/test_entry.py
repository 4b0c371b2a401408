import re
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent


def test_names_and_sql():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "macro_scores" in names and set(entry.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_training_data_operators():
    for path in (HERE / "lodewright").rglob("*.py"):
        if "llm" not in path.relative_to(HERE).parts:
            assert not re.search(r"^\s*(from|import)\s+\S*\bllm\b", path.read_text(), re.M), path


def test_entry_rows(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables aren't here")
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
