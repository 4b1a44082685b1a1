"""Staged tables: written, read, deleted when old."""

from corpusloom import staging


def test_sweep_deletes_staged_tables_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "stage_dir", lambda spark: str(tmp_path))
    (tmp_path / "mine").mkdir()
    table = staging.stage(spark.range(3), "old")
    assert table.count() == 3 and staging.sweep(spark, 1) == 0 and staging.sweep(spark, -1) == 1
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["mine"]
