"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry
from check import compare, open_tables
from rotorline.plans import catalog
from rotorline.plans.catalog import QUERIES
from rotorline.plans.oracle import statements

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return open_tables(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    _, _, problem = compare(spark, con, name, SF_DIR)
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(QUERIES) == set(statements())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_the_rest_works_without_the_text_operators(tmp_path):
    """Where the subpackage and its pipeline are left out, the entry points still import."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    for name in ("__spark_entry__.py", "check.py", "bench.py"):
        shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "rotorline", tmp_path / "rotorline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run(
        [sys.executable, "-B", "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"],
        cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert said.stdout.split() == ["True", str(len(QUERIES))], said.stderr


def test_changed_only_lands_with_all_partitions(spark, con, tmp_path, monkeypatch):
    """Each piece of the deliveries is written by as many tasks as hold it, and is one batch."""
    whole = catalog.fx.deliveries
    monkeypatch.setattr(catalog, "_scratch", lambda s, name: str(tmp_path / name))
    monkeypatch.setattr(catalog.fx, "deliveries", lambda s, d: whole(s, d).repartition(4, "arrival_seq"))
    _, _, problem = compare(spark, con, "stream_changed_only", SF_DIR)
    assert problem is None, problem
    landed = list((tmp_path / "changed-landing").glob("part-*"))
    assert len(landed) > catalog.PIECES, landed
