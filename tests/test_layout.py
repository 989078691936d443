"""The training-data operators stay apart from the rest."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_llm():
    for path in (ROOT / "tallyspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text(encoding="utf-8")), path


def test_every_query_has_a_callable_and_a_reason():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert all(callable(f) for f in queries.values()) and set(sql) <= set(queries)
    assert all(n in sql for n in queries if not n.startswith("op") and n != "pipeline")
