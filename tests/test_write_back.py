"""Write-back: names are settled before anything is written, and a transaction is done as a whole or not at all."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import documents, vault

COLUMNS = "folder string, title string, content string, created string"
CHANGES = "action string, folder string, title string, path string, content string, metadata map<string,string>, version string"


def texts(path):
    return sorted(p.read_text().rstrip().rsplit("\n", 1)[-1] for p in path.rglob("*.md"))


def test_no_document_of_a_title_is_lost(spark, tmp_path):
    rows = spark.createDataFrame([("f", "T", f"text {i}", "2024") for i in range(14)], COLUMNS).repartition(4)
    made = documents.write_documents(rows, str(tmp_path)).collect()
    assert len({r["path"] for r in made}) == 14 and all(r["error"] is None for r in made)
    assert texts(tmp_path / "f") == sorted(f"text {i}" for i in range(14))
    # more of that title later: no file is written over
    more = spark.createDataFrame([("f", "T", f"later {i}", "2024") for i in range(3)] + [("f", "T (2)", "own", "2024")] * 2, COLUMNS)
    assert len({r["path"] for r in documents.write_documents(more, str(tmp_path)).collect()}) == 5
    assert texts(tmp_path / "f") == sorted([f"text {i}" for i in range(14)] + [f"later {i}" for i in range(3)] + ["own", "own"])
    assert not list(tmp_path.rglob("*.draft")) and not list(tmp_path.glob(".*"))


def test_titles_that_end_in_numbers_meet_no_numbered_name(spark, tmp_path):
    for name in ("T", "T (1)", "T (2) (1)", "U (7)"):
        (tmp_path / f"{name}.md").write_text("there")
    titles = ["T", "T", "T (1)", "T (2)", "T (2)", "T (2) (1)", "T (3)", "U", "U", "U (8)", "V (1)", "V", "V"]
    rows = spark.createDataFrame([(None, t, f"{t} {i}", None) for i, t in enumerate(titles)], COLUMNS).repartition(3)
    made = documents.write_documents(rows, str(tmp_path)).collect()
    paths = {r["path"] for r in made}
    assert len(paths) == len(titles) and all(r["error"] is None for r in made)
    assert texts(tmp_path) == sorted(["there"] * 4 + [f"{t} {i}" for i, t in enumerate(titles)])
    assert {"T (4).md", "T (5).md", "T (2).md", "T (2) (2).md", "T (1) (1).md", "U.md", "U (9).md", "V (1).md", "V.md", "V (2).md"} <= paths


def test_rows_that_cannot_be_written_are_reported(spark, tmp_path):
    rows = spark.createDataFrame([(None, "A", None, None), ("../up", "B", "x", "2024"), ("f", "  ", "x", "2024"), ("f", None, "x", "2024")], COLUMNS)
    made = {r["title"]: (r["path"], r["error"]) for r in documents.write_documents(rows, str(tmp_path / "new")).collect()}
    assert made["A"] == ("A.md", None) and made["B"][1] == "folder isn't a valid path" and made[None][1] == made["  "][1] == "no title"
    assert len(list((tmp_path / "new").rglob("*.md"))) == 1


def test_update_and_delete(spark, tmp_path):
    old = "---\ntitle: One\ntags:\n  - a\n  - b\nkind: x\n---\n\nold body"
    for name in ("one", "two", "three", "four"):
        (tmp_path / f"{name}.md").write_text(old)
    right = hashlib.sha256(old.encode()).hexdigest()
    rows = [
        ("update", None, None, "one.md", "new body", {"tags": "c", "more": "1"}, right),
        ("update", None, None, "two.md", "lost", None, "0" * 64),
        ("update", None, None, "absent.md", "lost", None, None),
        ("delete", None, None, "three.md", None, None, right),
        ("update", None, None, "four.md", None, {"kind": "y"}, None),
        ("delete", None, None, "../four.md", None, None, None),
        ("rename", None, None, "two.md", None, None, None),
        ("create", "new", "Five", None, "body", {"kind": "z"}, None),
    ]
    done = vault.change_documents(spark.createDataFrame(rows, CHANGES).repartition(3), str(tmp_path)).collect()
    errors = {(r["action"], r["path"]): r["error"] for r in done}
    assert errors == {
        ("update", "one.md"): None, ("update", "two.md"): "changed since that version", ("update", "absent.md"): "no such document", ("delete", "three.md"): None,
        ("update", "four.md"): None, ("delete", "../four.md"): "path isn't valid", ("rename", "two.md"): "unknown action", ("create", "new/Five.md"): None,
    }
    assert (tmp_path / "one.md").read_text() == "---\ntitle: One\ntags: c\nkind: x\nmore: 1\n---\n\nnew body"
    assert (tmp_path / "two.md").read_text() == old and not (tmp_path / "three.md").exists()
    assert (tmp_path / "four.md").read_text() == old.replace("kind: x", "kind: y")
    assert (tmp_path / "new/Five.md").read_text() == "---\ntitle: Five\ncreated: \nkind: z\n---\n\nbody"
    assert not list(tmp_path.glob(".*"))


def test_a_second_change_of_a_path_is_refused(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    rows = [("update", None, None, "a.md", f"t{i}", None, None) for i in range(3)]
    done = vault.change_documents(spark.createDataFrame(rows, CHANGES), str(tmp_path)).collect()
    assert sorted(str(r["error"]) for r in done) == ["None", "a second change of this path", "a second change of this path"]


def prepare(spark, root, job, rows):
    """The first phase alone: drafts, manifests and the marker."""
    spark.dataSource.register(vault.Vault)
    found = spark.createDataFrame(rows, f"{vault.CHANGE}, error string")
    found.write.format("vault").option("root", vault.qualified(spark, str(root))).option("job", job).mode("append").save()


def test_what_was_committed_is_carried_on(spark, tmp_path):
    (tmp_path / "gone.md").write_text("x")
    prepare(spark, tmp_path, "j1", [("create", f"{i}.md", "t", f"body {i}", None, None, None) for i in range(9)] + [("delete", "gone.md", None, None, None, None, None)])
    assert sorted(p.name for p in tmp_path.rglob("*.md")) == ["gone.md"]  # nothing is visible before the last phase
    # the last phase died half-way: some drafts are moved already
    home = tmp_path / f"{vault.FOLDER}j1"
    manifest = next(p for p in home.glob("*.manifest") if "[\"create\"" in p.read_text())
    import json

    _, path, _, draft, _ = json.loads(manifest.read_text().splitlines()[0])
    (home / draft).rename(tmp_path / path)
    assert vault.recover(spark, str(tmp_path)) == ["j1"] and vault.recover(spark, str(tmp_path)) == []
    assert texts(tmp_path) == [f"body {i}" for i in range(9)] and not home.exists()


def test_a_failed_write_changes_nothing(spark, tmp_path):
    (tmp_path / "keep.md").write_text("x")
    rows = spark.range(20).select(
        F.lit("create").alias("action"), F.lit("f").alias("folder"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("path"),
        F.when(F.col("id") == 19, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("content"),
    )
    with pytest.raises(Exception, match="lost"):
        vault.change_documents(rows, str(tmp_path))
    vault.recover(spark, str(tmp_path))
    assert [p.name for p in tmp_path.rglob("*") if p.is_file()] == ["keep.md"] and not list(tmp_path.glob(".*"))


def test_a_name_that_is_taken_meanwhile_stays(spark, tmp_path):
    prepare(spark, tmp_path, "j2", [("create", "a.md", "t", "mine", None, None, None)])
    (tmp_path / "a.md").write_text("theirs")
    assert [r["error"] for r in vault.apply(spark, str(tmp_path), "j2").collect()] == ["taken meanwhile"]
    assert (tmp_path / "a.md").read_text() == "theirs"
