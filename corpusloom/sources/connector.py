"""Connectors as Python data sources: paged full reads in parallel, and change feeds as streams with an offset cursor."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import to_arrow_schema

from .documents import DOCUMENT

_FIELDS = [f.split()[0] for f in DOCUMENT.split(", ")]


class Page(InputPartition):
    def __init__(self, start: int, size: int):
        self.start, self.size = start, size


class DocumentSource(DataSource):
    """Subclass with a name and these, and register: a page is one task's work, and can be read again.

    total() -> documents there are; page(start, size) -> dicts with the readers' columns;
    changes(cursor) -> (dicts, next cursor) of documents changed after a cursor (a JSON-able dict, {} at first);
    fetch(source_doc_id) -> one document's dict, or None where there is none.
    """

    page_size = 100

    def schema(self) -> str:
        return DOCUMENT

    def total(self) -> int:
        raise NotImplementedError

    def page(self, start: int, size: int) -> list[dict]:
        raise NotImplementedError

    def changes(self, cursor: dict) -> tuple[list[dict], dict]:
        raise NotImplementedError

    def fetch(self, source_doc_id: str) -> dict | None:
        raise NotImplementedError

    def health(self) -> bool:
        return self.total() >= 0

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Changes(self)


def _row(document: dict) -> tuple:
    return tuple(document.get(f) for f in _FIELDS)


class _Reader(DataSourceReader):
    def __init__(self, source: DocumentSource):
        self.source = source

    def partitions(self) -> list[Page]:
        size = int(self.source.options.get("page_size", self.source.page_size))
        return [Page(start, size) for start in range(0, self.source.total(), size)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for document in self.source.page(partition.start, partition.size) if partition.size else ():
            yield _row(document)


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, source: DocumentSource):
        self.source = source

    def initialOffset(self) -> dict:
        return {"cursor": "{}"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, cursor = self.source.changes(json.loads(start["cursor"]))
        return iter([_row(r) for r in rows]), {"cursor": json.dumps(cursor)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        stop = json.loads(end["cursor"])
        cursor = json.loads(start["cursor"])
        while cursor != stop:
            rows, cursor = self.source.changes(cursor)
            yield from map(_row, rows)
            if not rows:
                break


class Stretch(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class ChangeFeed(DataSource):
    """A source's log of changes as a stream whose tasks read it. Subclass with a name and these two, and register.

    head(etag) -> (position, etag) after the last change there is, or None where nothing is newer than that etag (a
    source's "not modified"); changes(low, high) -> dicts with the readers' columns of the changes at positions low to
    high - 1, each with its `position`, and `deleted` true where a document went. A stretch of positions can be read again
    and gives the same. `stretch` (an option, too) positions are one task's work; the driver asks for heads only.
    """

    stretch = 100

    def schema(self) -> str:
        return f"{DOCUMENT}, position long, deleted boolean"

    def head(self, etag: str | None) -> tuple[int, str | None] | None:
        raise NotImplementedError

    def changes(self, low: int, high: int) -> Iterator[dict]:
        raise NotImplementedError

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FeedReader(self)


class _FeedReader(DataSourceStreamReader):
    """Offsets hold the position and the etag that came with it, so a restarted query goes on from both."""

    def __init__(self, feed: ChangeFeed):
        self.feed, self.last = feed, {"at": 0, "etag": None}

    def initialOffset(self) -> dict:
        return {"at": 0, "etag": None}

    def latestOffset(self) -> dict:
        found = self.feed.head(self.last["etag"])
        if found is not None and found[0] > self.last["at"]:
            self.last = {"at": found[0], "etag": found[1]}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        # after a restart this comes first with offsets of the log: what is planned there isn't asked for again
        if end["at"] > self.last["at"]:
            self.last = end
        size = int(self.feed.options.get("stretch", self.feed.stretch))
        return [Stretch(low, min(low + size, end["at"])) for low in range(start["at"], end["at"], size)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for change in self.feed.changes(partition.low, partition.high):
            yield (*_row(change), change["position"], bool(change.get("deleted")))


def fetch_documents(source: DocumentSource, asked: DataFrame) -> DataFrame:
    """Documents as a source has them now: asked's id, the readers' columns, and error, for asked (id, source_doc_id).

    Tasks fetch, document by document; asked is spread over them first, as a source answers more slowly than Spark counts
    bytes. A document that isn't there has the error `not found`, one that the source fails for what it raised; neither
    stops the others. A null source_doc_id isn't asked for and counts as not found. A task that is run again fetches again.
    """
    schema = f"id long, {DOCUMENT}, error string"

    def fetched(batches):
        for batch in batches:
            rows = []
            for number, key in zip(batch.column("id").to_pylist(), batch.column("source_doc_id").to_pylist(), strict=True):
                found, error = None, "not found"
                try:
                    found = source.fetch(key) if key is not None else None
                except Exception as failed:  # a source may fail in any way
                    error = f"{type(failed).__name__}: {failed}"
                if found is None:
                    rows.append({"id": number, "source_doc_id": key, "error": error})
                else:
                    meta = found.get("metadata")
                    rows.append({f: found.get(f) for f in _FIELDS} | {"id": number, "source_doc_id": key, "metadata": list(meta.items()) if meta is not None else None})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    arrow = to_arrow_schema(asked.sparkSession.createDataFrame([], schema).schema)
    spread = asked.select(F.col("id").cast("long").alias("id"), "source_doc_id").repartition("source_doc_id")
    return spread.mapInArrow(fetched, schema)


def register_source(spark: SparkSession, source: type[DocumentSource]) -> None:
    """From now on spark.read.format(source.name()) and spark.readStream.format(source.name()) work."""
    spark.dataSource.register(source)
