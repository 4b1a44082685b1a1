"""Streaming jobs: session co-occurrence, view counts, document changes; and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: Idle seconds that end a session, and how late an access may come.
GAP, LATENESS = "5 minutes", "10 minutes"


def _pairs(sessions: DataFrame) -> DataFrame:
    """doc_a_id < doc_b_id of each session's distinct documents."""
    docs = F.array_sort(F.array_distinct("documents"))
    first = sessions.select("seen", F.posexplode(docs).alias("i", "doc_a_id"), docs.alias("d"))
    return first.select("seen", "doc_a_id", F.explode(F.slice("d", F.col("i") + 2, F.size("d"))).alias("doc_b_id"))


def session_pairs(accesses: DataFrame, gap: str = GAP) -> DataFrame:
    """Batch: doc_a_id, doc_b_id, co_occurrence_count, last_accessed from accesses (session_id, document_id, ts).

    A session ends after `gap` without an access; each pair of its distinct documents counts once. Pairs come from a join
    of a session's documents with themselves, which splits where one session holds very many; no session is one row.
    """
    own = Window.partitionBy("session_id").orderBy("ts")
    late = F.col("ts") >= F.lag("ts").over(own) + F.expr(f"INTERVAL {gap}")
    numbered = accesses.withColumn("_late", F.coalesce(late, F.lit(False)).cast("int")).withColumn("_n", F.sum("_late").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    seen = numbered.groupBy("session_id", "_n").agg(F.max("ts").alias("seen"))
    docs = numbered.select("session_id", "_n", "document_id").distinct()
    left, right = docs.withColumnRenamed("document_id", "doc_a_id"), docs.withColumnRenamed("document_id", "doc_b_id")
    pairs = left.join(right, ["session_id", "_n"]).where("doc_a_id < doc_b_id").join(seen, ["session_id", "_n"])
    return _counted(pairs.select("seen", "doc_a_id", "doc_b_id"))


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("doc_a_id", "doc_b_id").agg(F.count(F.lit(1)).alias("co_occurrence_count"), F.unix_timestamp(F.max("seen").cast("timestamp")).alias("last_accessed"))


def merge_pairs(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(new).groupBy("doc_a_id", "doc_b_id").agg(F.sum("co_occurrence_count").alias("co_occurrence_count"), F.max("last_accessed").alias("last_accessed"))


def stream_session_pairs(accesses: DataFrame, catalog, checkpoint: str, gap: str = GAP, lateness: str = LATENESS, **trigger):
    """Stream: closed sessions are merged into the catalog's document_co_refs. Accesses later than `lateness` are dropped.

    A batch rewrites the buckets of its own documents only. State is one set of ids an open session. The number of the last batch of each checkpoint is noted with the snapshot
    that holds its pairs, in one act, so a batch that runs again after a failure isn't counted twice.
    """
    grouped = accesses.withWatermark("ts", lateness).groupBy("session_id", F.session_window("ts", gap)).agg(F.collect_set("document_id").alias("documents"), F.max("ts").alias("seen"))

    def merge(batch: DataFrame, number: int) -> None:
        note = catalog.note("document_co_refs")
        if number <= note.get(checkpoint, -1):
            batch.write.format("noop").mode("overwrite").save()  # its pairs are there, but the stream's state is still to be committed
            return
        pairs = _counted(_pairs(batch.where(F.size("documents") > 1)))
        catalog.merge("document_co_refs", pairs, ["doc_a_id"], merge_pairs, note=note | {checkpoint: number})

    return grouped.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(**(trigger or {"availableNow": True})).start()


def stream_sessions(accesses: DataFrame, gap: str = GAP, lateness: str = LATENESS) -> DataFrame:
    """Stream: session_id, started, document_id, at (both microseconds) of accesses (session_id, document_id, ts), in the
    order of their times: started names the session as `session_pairs` cuts them.

    A session's state is the accesses of the last `lateness` and two times, however long it lasts; timers let accesses
    through when the watermark has passed them, and clear the state `gap` after the last. Accesses later than
    `lateness`, and those with a null, are dropped. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    idle = _micros(accesses.sparkSession, gap)

    class Sessions(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.waiting = handle.getListState("waiting", "at long, document_id long")
            self.last = handle.getValueState("last", "started long, at long")

        def _wake(self, at):
            """One timer, for the earliest that waits."""
            due = -(-at // 1000)
            for timer in list(self.handle.listTimers()):
                if timer <= due:
                    return
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

        def _rows(self, key, out):
            import pandas as pd

            times = {c: pd.Series([r[i] for r in out], dtype="int64") for i, c in enumerate(("started", "document_id", "at"))}
            return pd.DataFrame({"session_id": pd.Series([key[0]] * len(out), dtype=object), **times})

        def handleInputRows(self, key, rows, timerValues):
            first = None
            for part in rows:
                new = list(zip(map(int, part["at"]), map(int, part["document_id"]), strict=True))
                self.waiting.appendList(new)
                first = min([a for a, _ in new] + ([] if first is None else [first]))
            self._wake(first)
            yield self._rows(key, [])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = timerValues.getCurrentWatermarkInMs() * 1000
            waiting = sorted((int(r[0]), int(r[1])) for r in self.waiting.get())
            kept, out = [r for r in waiting if r[0] > now], []
            started, last = map(int, self.last.get()) if self.last.exists() else (None, None)
            for at, document in waiting[: len(waiting) - len(kept)]:
                if last is None or at >= last + idle:
                    started = at
                last = at
                out.append((started, document, at))
            if kept:
                self.waiting.put(kept)
            else:
                self.waiting.clear()
            if last is not None and now >= last + idle:
                last = None  # whatever comes now begins a session
            if last is None:
                self.last.clear()
            else:
                self.last.update((started, last))
            for timer in list(self.handle.listTimers()):
                if timer != expiredTimerInfo.getExpiryTimeInMs():
                    self.handle.deleteTimer(timer)
            if kept or last is not None:
                self.handle.registerTimer(max(-(-min([a for a, _ in kept] or [last + idle]) // 1000), now // 1000 + 1))
            yield self._rows(key, out)

        def close(self):
            pass

    whole = accesses.withWatermark("ts", lateness).where("session_id is not null and document_id is not null and ts is not null")
    rows = whole.select(F.col("session_id").cast("string"), "document_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("session_id").transformWithStateInPandas(Sessions(), "session_id string, started long, document_id long, at long", "Append", "EventTime")


def _micros(spark, interval: str) -> int:
    zero = F.lit("1970-01-01").cast("timestamp")
    return spark.range(1).select(F.unix_micros(zero + F.expr(f"INTERVAL {interval}")) - F.unix_micros(zero)).first()[0]


def new_pairs(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """doc_a_id < doc_b_id, seen of a session's new documents with each other and with those it held: two joins, which
    split where one session holds very many. seen is when the later of the two was first seen."""
    names = ["session_id", "started"]
    other = lambda rows: rows.select(*names, F.col("document_id").alias("_other"), F.col("at").alias("_at"))
    pairs = fresh.join(other(fresh), names).where("document_id < _other").unionByName(fresh.join(other(known), names))
    seen = F.timestamp_micros(F.greatest("at", "_at"))
    return pairs.select(seen.alias("seen"), F.least("document_id", "_other").alias("doc_a_id"), F.greatest("document_id", "_other").alias("doc_b_id"))


def stream_long_sessions(accesses: DataFrame, catalog, checkpoint: str, gap: str = GAP, lateness: str = LATENESS, **trigger):
    """Stream: pairs of a session are merged into the catalog's document_co_refs as they arise, in sessions of any length.

    Documents of open sessions are a table of the catalog (session_documents) dealt by session and document, not state of
    a key, so no task holds a session. Each table notes the batch that it holds, pairs first: a batch that runs again
    after a failure does what it had not done. Counts are those of `session_pairs`; last_accessed is when the later of
    the two was first seen, as the session's end isn't known yet. Sessions that are over leave the table when a later
    batch touches their buckets.
    """
    idle = _micros(accesses.sparkSession, gap)
    session, keys = ["session_id", "started"], ["session_id", "started", "document_id"]

    def merge(batch: DataFrame, number: int) -> None:
        rows = stage(batch.groupBy(*keys).agg(F.min("at").alias("at"), F.max("at").alias("last")), "accesses")
        pairs_note, own_note = catalog.note("document_co_refs"), catalog.note("session_documents")
        horizon = rows.agg(F.max("last")).first()[0]
        if horizon is None or number <= own_note.get(checkpoint, -1):
            return
        if number > pairs_note.get(checkpoint, -1):
            # sessions of this batch alone: the others have no new documents
            known = catalog.load("session_documents").join(rows.select(*session).distinct(), session, "left_semi")
            known = stage(known, "known")
            fresh = rows.join(known, keys, "left_anti")
            catalog.merge("document_co_refs", _counted(new_pairs(fresh, known)), ["doc_a_id"], merge_pairs, note=pairs_note | {checkpoint: number})

        # all that is let through later is later than the horizon
        held = catalog.load("session_documents").select(*session, "last").unionByName(rows.select(*session, "last"))
        live = held.groupBy(*session).agg(F.max("last").alias("_end")).where(F.col("_end") + F.lit(idle) > F.lit(horizon)).select(*session)

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.unionByName(new).groupBy(*keys).agg(F.min("at").alias("at"), F.max("last").alias("last")).join(live, session, "left_semi")

        catalog.merge("session_documents", rows, ["session_id", "document_id"], combine, note=own_note | {checkpoint: number})

    return stream_sessions(accesses, gap, lateness).writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(**(trigger or {"availableNow": True})).start()


def view_counts(views: DataFrame) -> DataFrame:
    """document_id, count, last_viewed of views (document_id, ts); batch or stream (output mode complete or update)."""
    return views.groupBy("document_id").agg(F.count(F.lit(1)).alias("count"), F.unix_timestamp(F.max("ts").cast("timestamp")).alias("last_viewed"))


def merge_views(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(new).groupBy("document_id").agg(F.sum("count").alias("count"), F.max("last_viewed").alias("last_viewed"))


def stream_view_counts(views: DataFrame, catalog, checkpoint: str, **trigger):
    """Stream: views (document_id, ts) are added to the catalog's view_counts, each batch once, in its own buckets."""

    def merge(batch: DataFrame, number: int) -> None:
        note = catalog.note("view_counts")
        if number > note.get(checkpoint, -1):
            catalog.merge("view_counts", view_counts(batch), ["document_id"], merge_views, note=note | {checkpoint: number})

    return views.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(**(trigger or {"availableNow": True})).start()


def debounced(changes: DataFrame, cooldown_seconds: float = 2.0) -> DataFrame:
    """Batch: changes (path, ts) at least a cooldown after the one before on the same path."""
    before = F.lag("ts").over(Window.partitionBy("path").orderBy("ts"))
    gap = F.col("ts").cast("timestamp").cast("double") - before.cast("timestamp").cast("double")
    return changes.withColumn("_gap", gap).where("_gap is null or _gap >= %f" % cooldown_seconds).drop("_gap")


#: Seconds without a change of a path after which it counts, and in which later ones don't.
QUIET, COOLDOWN = 0.5, 2.0


class Debouncer:
    """One path's changes, in the order of their times: after QUIET seconds without another the last one is let through, and
    what follows within COOLDOWN seconds of that is dropped. State is two times; all are seconds."""

    def __init__(self, quiet: float = QUIET, cooldown: float = COOLDOWN, pending: float | None = None, passed: float | None = None):
        self.quiet, self.cooldown, self.pending, self.passed = quiet, cooldown, pending, passed

    def change(self, at: float) -> list[float]:
        out = self.until(at)
        if self.passed is None or at >= self.passed + self.cooldown:
            self.pending = at if self.pending is None else max(at, self.pending)
        return out

    def until(self, now: float) -> list[float]:
        """What is let through once it is later than `now`."""
        if self.pending is None or now <= self.pending + self.quiet:
            return []
        at, self.passed, self.pending = self.pending, self.pending + self.quiet, None
        return [at]


def debounced_quietly(changes: DataFrame, quiet: float = QUIET, cooldown: float = COOLDOWN) -> DataFrame:
    """Batch: path, ts of changes (path, ts) that a Debouncer lets through."""

    def one(key, part):
        import pandas as pd

        state, out = Debouncer(quiet, cooldown), []
        for at in sorted(part["s"]):
            out += state.change(at)
        out += state.until(float("inf"))
        return pd.DataFrame({"path": [key[0]] * len(out), "s": out})

    # a group is one path's different times, eight bytes each
    rows = changes.select("path", F.col("ts").cast("timestamp").cast("double").alias("s")).distinct()
    made = rows.groupBy("path").applyInPandas(one, "path string, s double")
    return made.select("path", F.timestamp_micros(F.round(F.col("s") * 1_000_000).cast("long")).alias("ts"))


def stream_debounced(changes: DataFrame, lateness: str = "2 seconds", quiet: float = QUIET, cooldown: float = COOLDOWN) -> DataFrame:
    """Stream: path, ts of changes (path, ts) that a Debouncer lets through, by event time.

    A path's state is two times, held in the state store; a timer lets a change through when the watermark passes its
    quiet time, another clears the state when its cooldown is over. Changes later than `lateness` are dropped, and those
    that come out of order by less count as if they came last. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Quiet(StatefulProcessor):
        def init(self, handle):
            self.handle, self.times = handle, handle.getValueState("times", "pending double, passed double")

        def _state(self):
            found = self.times.get() if self.times.exists() else (None, None)
            return Debouncer(quiet, cooldown, *(None if x is None or x != x else float(x) for x in found))

        def _keep(self, state):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state.pending is None and state.passed is None:
                self.times.clear()
                return
            self.times.update((state.pending, state.passed))
            due = state.pending + quiet if state.pending is not None else state.passed + cooldown
            self.handle.registerTimer(int(due * 1000) + 1)

        def _rows(self, key, out):
            import pandas as pd

            return pd.DataFrame({"path": pd.Series([key[0]] * len(out), dtype=object), "ts": pd.to_datetime([round(x * 1e6) for x in out], unit="us", utc=True).tz_localize(None)})

        def handleInputRows(self, key, rows, timerValues):
            state, out = self._state(), []
            for part in rows:
                for at in sorted(part["s"]):
                    out += state.change(float(at))
            self._keep(state)
            yield self._rows(key, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            state = self._state()
            now = expiredTimerInfo.getExpiryTimeInMs() / 1000
            out = state.until(now)
            if state.pending is None and state.passed is not None and now >= state.passed + cooldown:
                state.passed = None
            self._keep(state)
            yield self._rows(key, out)

        def close(self):
            pass

    rows = changes.withWatermark("ts", lateness).withColumn("s", F.col("ts").cast("timestamp").cast("double"))
    return rows.groupBy("path").transformWithStateInPandas(Quiet(), "path string, ts timestamp", "Append", "EventTime")


def stream_changes(feed: DataFrame, apply, checkpoint: str, **trigger):
    """Stream: each micro-batch's latest row of a document goes to apply(batch, number)."""

    def each(batch: DataFrame, number: int) -> None:
        latest = Window.partitionBy("source_doc_id").orderBy(F.desc("updated_at"), F.desc(F.xxhash64("content")))
        apply(batch.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n"), number)

    return feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()


def stream_feed(feed: DataFrame, catalog, checkpoint: str, project_id: int, now: int, **trigger):
    """Stream: a `connector.ChangeFeed`'s changes reach the catalog's documents, deletions among them.

    Of a batch's changes of a document the last one counts. A batch rewrites its documents' buckets only, and its number
    is saved with them, so one that runs again after a failure changes nothing. New documents are numbered by a hash.
    """
    from ..functions import text as X
    from ..operators import sync

    keys = ["project_id", "source_doc_id"]

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        return sync.apply_page(old, new.where("not deleted"), new.where("deleted").select(*keys), None, now)[0]

    def each(batch: DataFrame, number: int) -> None:
        note = catalog.note("documents")
        if number <= note.get(checkpoint, -1):
            return
        last = Window.partitionBy("source_doc_id").orderBy(F.desc("position"))
        rows = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        owner = F.lit(project_id).cast("long")
        rows = rows.withColumns({"project_id": owner, "id": F.xxhash64(owner, "source_doc_id"), "content_hash": X.content_hash(F.col("content"))})
        catalog.merge("documents", rows, keys, combine, note=note | {checkpoint: number})

    return feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()
