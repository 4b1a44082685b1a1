"""Queries against their SQL over documents that the driver's small tables don't have: empty texts, missing ones, signs only."""

import duckdb

from corpusloom.plans import registry

TEXTS = ["", "", "tea and bread", "oolong", None, None, "...", "!?", " ", "\n"]


def test_rebuilt_vectors_without_text(spark, tmp_path):
    rows = [(i, text, "en", f"src{i % 3}") for i, text in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    (path,) = (tmp_path / "documents.parquet").glob("part-*.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = {r[0]: tuple(r[1:]) for r in con.execute(f"SELECT chunk_id, dimension, made FROM ({registry.oracle_sql()['rebuilt_vectors']})").fetchall()}
    have = {r["chunk_id"]: (r["dimension"], r["made"]) for r in registry.queries()["rebuilt_vectors"](spark, str(tmp_path)).collect()}
    assert have == want
    assert (have[0], have[1], have[4], have[5]) == ((48, True), (48, False), (48, True), (48, None))
