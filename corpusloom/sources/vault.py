"""Write-back to a tree of Markdown files as one transaction: create, update and delete, all or nothing.

A task writes drafts and a manifest of them into a hidden folder of the tree; the driver commits by renaming one marker
that names the manifests; then tasks move the drafts of the named manifests into place. A job that dies before the marker
leaves drafts that nobody reads, one that dies after it is carried on by `recover`: every step of the last phase may run
again.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import text as X

#: Folder of a transaction within the tree, and the marker that commits it.
FOLDER, MARKER = ".writing-", "committed"
CHANGE = "action string, path string, title string, body string, metadata map<string,string>, version string"
DONE = "action string, path string, title string, error string"
NUMBERED = r"^(.*) \((\d{1,9})\)$"


def qualified(spark: SparkSession, root: str) -> str:
    """root with its file system's scheme, as Spark resolves it: what lists and what writes see the same tree."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    found = str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString())
    return re.sub(r"^file:/+", "file:///", found)


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _read(files, name: str) -> bytes | None:
    from pyarrow import fs

    if files.get_file_info(name).type != fs.FileType.File:
        return None
    with files.open_input_stream(name) as f:
        return f.read()


def _write(files, name: str, data: bytes) -> None:
    """Under a name of its own first, then moved: a file is there whole or not at all."""
    draft = f"{name}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft) as out:
        out.write(data)
    files.move(draft, name)


def edited(current: str, body: str | None, metadata: dict | None) -> str:
    """A document with its body replaced (None: kept) and frontmatter keys set (None: kept); other keys stay."""
    m = re.match(r"---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|\Z)\n?", current, re.S)
    head, rest = ((m.group(1) or "").splitlines(), current[m.end() :]) if m else ([], current)
    for key, value in (metadata or {}).items():
        at = next((i for i, line in enumerate(head) if line.startswith(f"{key}:")), None)
        if at is None:
            head.append(f"{key}: {value or ''}")
            continue
        end = at + 1  # a block list under the key goes with it
        while end < len(head) and re.match(r"\s*- |\s+\S", head[end]):
            end += 1
        head[at:end] = [f"{key}: {value or ''}"]
    rest = rest if body is None else body
    return "---\n" + "\n".join(head) + "\n---\n\n" + rest if head else rest


class _Message(WriterCommitMessage):
    def __init__(self, manifest: str):
        self.manifest = manifest


class _Writer(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.job = root, job

    def write(self, iterator):
        """Drafts and the manifest of one task. Rows whose target isn't as expected carry an error and have no draft."""
        files, base = _open(self.root)
        home, name = f"{base}/{FOLDER}{self.job}", uuid.uuid4().hex
        files.create_dir(f"{home}/{name}", recursive=True)
        lines = []
        for n, row in enumerate(iterator):
            action, path, title, body, metadata, version, error = (row[c] for c in ("action", "path", "title", "body", "metadata", "version", "error"))
            draft = None
            if error is None and action != "create":
                current = _read(files, f"{base}/{path}")
                if current is None:
                    error = "no such document"
                elif version is not None and version != hashlib.sha256(current).hexdigest():
                    error = "changed since that version"
                elif action == "update":
                    body = edited(current.decode("utf-8", "replace"), body, metadata)
            if error is None and action != "delete":
                draft = f"{name}/{n}"
                _write(files, f"{home}/{draft}", (body or "").encode("utf-8", "surrogatepass"))
            lines.append(json.dumps([action, path, title, draft, error]))
        _write(files, f"{home}/{name}.manifest", "\n".join(lines).encode())
        return _Message(f"{name}.manifest")

    def commit(self, messages) -> None:
        files, base = _open(self.root)
        home = f"{base}/{FOLDER}{self.job}"
        files.create_dir(home, recursive=True)
        _write(files, f"{home}/{MARKER}", "\n".join(m.manifest for m in messages if m).encode())

    def abort(self, messages) -> None:
        files, base = _open(self.root)
        files.delete_dir_contents(f"{base}/{FOLDER}{self.job}", missing_dir_ok=True)


class Vault(DataSource):
    """Sink `vault`: options root and job. It prepares and commits a transaction; `apply` carries it out."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return f"{CHANGE}, error string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["root"], self.options["job"])


def _carry_out(root: str, job: str):
    def task(batches):
        import pyarrow as pa

        files, base = _open(root)
        home = f"{base}/{FOLDER}{job}"
        for batch in batches:
            for manifest in batch.column("manifest").to_pylist():
                rows = [json.loads(line) for line in _read(files, f"{home}/{manifest}").decode().splitlines()]
                for row in rows:
                    action, path, _, draft, error = row
                    if error is not None:
                        continue
                    name = f"{base}/{path}"
                    if action == "delete":
                        if _read(files, name) is not None:
                            files.delete_file(name)
                    elif (body := _read(files, f"{home}/{draft}")) is not None:  # else an earlier run has moved it
                        # a file that came to that name after the names were settled isn't written over
                        if action == "create" and (there := _read(files, name)) is not None and there != body:
                            row[4] = "taken meanwhile"
                            continue
                        files.create_dir(name.rsplit("/", 1)[0], recursive=True)
                        files.move(f"{home}/{draft}", name)
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[i], pa.string()) for i in (0, 1, 2, 4)], ["action", "path", "title", "error"])

    return task


def apply(spark: SparkSession, root: str, job: str) -> DataFrame:
    """Carry out a committed transaction: action, path, title, error of its rows. It may run again after a failure."""
    from ..staging import stage

    root = qualified(spark, root)
    files, base = _open(root)
    marker = _read(files, f"{base}/{FOLDER}{job}/{MARKER}")
    if marker is None:
        raise ValueError("this transaction isn't committed")
    names = [(n,) for n in marker.decode().split("\n") if n]  # one a task of the write
    todo = spark.createDataFrame(names, "manifest string").repartition(max(1, len(names)), "manifest")
    done = stage(todo.mapInArrow(_carry_out(root, job), DONE), "written")
    files.delete_dir(f"{base}/{FOLDER}{job}")
    return done


def recover(spark: SparkSession, root: str) -> list[str]:
    """Carry on what was committed and clear what wasn't; names the transactions that were carried on. Call it while
    nobody writes to the tree."""
    from pyarrow import fs

    root = qualified(spark, root)
    files, base = _open(root)
    carried = []
    for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if info.type == fs.FileType.Directory and info.base_name.startswith(FOLDER):
            job = info.base_name.removeprefix(FOLDER)
            if _read(files, f"{info.path}/{MARKER}") is None:
                files.delete_dir(info.path)
            else:
                apply(spark, root, job)
                carried.append(job)
    return carried


def names_in(spark: SparkSession, root: str) -> DataFrame:
    """name (path below root) of the tree's Markdown files."""
    root = qualified(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "name string")
    base = re.sub(r"^[a-z0-9]+:(//[^/]*)?(?=/)", "", root)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root).select("path")
    return listed.select(F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", ""), "^" + X.quoted(base) + "/", "").alias("name"))


def free_names(drafts: DataFrame, taken: DataFrame, order: list) -> DataFrame:
    """drafts (stem) with `path`, a name that neither taken (name) nor another draft has.

    The first draft of a stem is called like it if that is free; others get ` (n)`, n above every number that the stem
    has in the tree or as another draft's own stem. So `T (2)` as a title and the third `T` never meet, and no round of
    trying is needed.
    """
    stems = taken.select(F.regexp_replace("name", r"\.md$", "").alias("full")).distinct()
    names = stems.unionByName(drafts.select(F.col("stem").alias("full")).distinct())
    numbers = names.select(F.regexp_extract("full", NUMBERED, 1).alias("_of"), F.expr(f"try_cast(regexp_extract(full, '{NUMBERED.replace(chr(92), chr(92) * 2)}', 2) as int)").alias("_n"))
    numbers = numbers.where("_n is not null").groupBy("_of").agg(F.max("_n").alias("_most"))
    there = stems.select(F.col("full").alias("_full"), F.lit(1).alias("_there"))
    turn = F.row_number().over(Window.partitionBy("stem").orderBy(*order)) - 1
    rows = drafts.withColumn("_turn", turn).join(numbers, F.col("stem") == F.col("_of"), "left").join(there, F.col("stem") == F.col("_full"), "left")
    place = F.col("_turn") + F.coalesce("_there", F.lit(0))
    number = F.when(place > 0, place + F.coalesce("_most", F.lit(0)))
    path = F.concat("stem", F.when(number.isNotNull(), F.concat(F.lit(" ("), number.cast("string"), F.lit(")"))).otherwise(""), F.lit(".md"))
    return rows.withColumn("path", path).drop("_turn", "_of", "_most", "_full", "_there")


def change_documents(changes: DataFrame, root: str) -> DataFrame:
    """One transaction of changes (action, folder, title, path, content, created, metadata, version) on the tree at root.

    create: a file named by title in folder, under a free name; frontmatter holds title, created and metadata.
    update: the file at path gets content as its body (null: kept) and the metadata's keys (null: kept).
    delete: the file at path goes.
    version, where given, is the SHA-256 of the file's bytes that the change expects.
    A row that can't be done carries an error and changes nothing: no such document, changed since that version, a path or
    title that isn't valid, an unknown action, or a second change of one path. All others are done, or, where the job
    fails before its commit, none. Columns that changes lacks count as null. Returns action, path, title, error of each
    row. The writing is done when this returns; `recover` ends what a failure after the commit has left.
    """
    spark = changes.sparkSession
    root = qualified(spark, root)
    kinds = {"action": "string", "folder": "string", "title": "string", "path": "string", "content": "string", "created": "string", "metadata": "map<string,string>", "version": "string"}
    rows = changes.select(*((F.col(c) if c in changes.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))
    safe, folder = X.sanitise_title(F.col("title")), F.coalesce("folder", F.lit(""))
    making = F.col("action") == "create"
    error = (
        F.when(F.coalesce(~F.col("action").isin("create", "update", "delete"), F.lit(True)), "unknown action")
        .when(making & (F.coalesce(F.length(safe), F.lit(0)) == 0), "no title")
        .when(making & (folder != "") & ~X.valid_path(folder), "folder isn't a valid path")
        .when(~making & ~(X.valid_path(F.col("path")) & F.rlike("path", F.lit(r"\.md$")) & ~F.rlike("path", F.lit(r"(^|/)\."))), "path isn't valid")
    )
    stem = F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), safe)
    rows = rows.withColumn("stem", stem).withColumn("error", error)
    made = free_names(rows.where("error is null and action = 'create'"), names_in(spark, root), [F.sha2(F.coalesce("content", F.lit("")), 256), F.xxhash64("created"), "title"])
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("title", "created"))
    more = F.array_join(F.transform(F.map_entries(own), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")), F.lit("\n"))), "")
    head = F.concat(F.lit("---\ntitle: "), "title", F.lit("\ncreated: "), F.coalesce("created", F.lit("")), F.lit("\n"), more, F.lit("---\n\n"))
    made = made.withColumn("body", F.concat(head, F.coalesce("content", F.lit(""))))
    others = rows.where("error is null and action <> 'create'").withColumn("body", F.col("content"))
    twice = F.row_number().over(Window.partitionBy("path").orderBy("action", F.xxhash64("content", "version"))) > 1
    others = others.withColumn("error", F.when(twice, "a second change of this path"))
    columns = ["action", "path", "title", "body", "metadata", "version", "error"]
    left = rows.where("error is not null").withColumn("body", F.lit(None).cast("string"))
    job = uuid.uuid4().hex
    spark.dataSource.register(Vault)
    out = made.select(*columns).unionByName(others.select(*columns)).unionByName(left.select(*columns))
    out.write.format("vault").option("root", root).option("job", job).mode("append").save()
    return apply(spark, root, job)
