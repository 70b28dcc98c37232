from __future__ import annotations

from pathlib import Path

from pricelens.session import discard, materialize, work_dir


def test_discard_deletes_only_written_tables(spark, tmp_path):
    own = materialize(spark.range(5), "own")
    kept = materialize(spark.range(6), "kept")
    spark.range(3).write.parquet(f"{tmp_path}/outside")
    outside = spark.read.parquet(f"{tmp_path}/outside")
    made = materialize(own.union(outside), "made")
    discard(own, outside)
    names = {p.name.split("-")[0] for p in Path(work_dir(spark)).iterdir()}
    assert "own" not in names and "made" in names
    assert made.count() == 8 and outside.count() == 3 and kept.count() == 6
