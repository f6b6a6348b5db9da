"""Where per-user tables are stored."""

import subprocess
import sys
from pathlib import Path

from driftwarden import session

ROOT = Path(__file__).resolve().parent.parent


def test_scratch_paths_are_new_and_in_the_shared_folder(spark):
    folder = session.shared_folder(spark)
    first, second = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert first != second
    assert first.startswith(folder) and second.startswith(folder)


def test_materialized_rows_have_no_lineage(spark):
    df = session.materialize(spark.range(10).selectExpr("id * 2 as x"))
    assert sorted(r.x for r in df.collect()) == list(range(0, 20, 2))
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_are_read_column_by_column(spark):
    df = session.materialize(spark.range(10).selectExpr("id", "id * 2 as x", "cast(id as string) as y"))
    plan = df.select("x").where("x > 3")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<x:bigint>" in plan and "PushedFilters: [IsNotNull(x)" in plan


def test_stored_tables_are_deleted_at_the_end(tmp_path):
    """In a process of its own, with a folder of its own."""
    script = """
import sys
from driftwarden.session import build_session, materialize
spark = build_session("own", "local[2]", **{"spark.ui.enabled": "false", "spark.checkpoint.dir": sys.argv[1]})
df = materialize(spark.range(10))
assert df.count() == 10
if sys.argv[2] == "stop":
    spark.stop()
"""
    for end in ("stop", "leave"):
        folder = tmp_path / end
        folder.mkdir()
        subprocess.run([sys.executable, "-c", script, str(folder), end], check=True, cwd=ROOT, timeout=120)
        assert not [p for p in folder.rglob("*.parquet")]
