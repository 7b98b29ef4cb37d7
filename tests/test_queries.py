"""Every registered query of the library against its SQL in DuckDB."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare

from weftgraph.plans import cache_queries, format_queries, graph_queries, list_queries, registry, report_queries, service_queries, store_queries, walk_queries  # noqa: F401  they register their queries

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    assert compare(registry.QUERIES[name](spark, SF), registry.SQL[name], SF) == ""


def test_entry_without_the_training_data_operators(tmp_path):
    """The rest must stand alone where the llm folders are deleted, with or without the pipeline beside it."""
    root = Path(__file__).parents[1]
    for name in ("weftgraph", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) == len(e.oracle_sql()) > 100 and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
