"""Job schedules: next run times as column expressions, due jobs, run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Jobs every catalog starts with.
DEFAULT_JOBS = (
    {"id": 1, "name": "freshness", "schedule_json": '{"type":"daily","hour":3,"minute":0}', "executor": "builtin", "enabled": True, "immutable": True},
    {"id": 2, "name": "prune_co_refs", "schedule_json": '{"type":"daily","hour":4,"minute":0}', "executor": "builtin", "enabled": True, "immutable": True},
)


def install_defaults(jobs: DataFrame, owners: DataFrame) -> DataFrame:
    """jobs (owner, name, schedule_json, executor, enabled, immutable, next_run) with the default jobs of each of owners
    (owner, since) that has none of that name yet; the first run is the schedule's first after `since`."""
    fields = ("name", "schedule_json", "executor", "enabled", "immutable")
    wanted = F.inline(F.array(*(F.struct(*(F.lit(j[f]).alias(f) for f in fields)) for j in DEFAULT_JOBS)))
    made = owners.select("owner", "since", wanted).withColumn("next_run", next_run(F.col("schedule_json"), F.col("since"))).drop("since")
    there = jobs.select(F.col("owner").alias("_owner"), F.col("name").alias("_name"))
    missing = made.join(there, F.col("owner").eqNullSafe(F.col("_owner")) & (F.col("name") == F.col("_name")), "left_anti")
    return jobs.unionByName(missing)


def next_run(schedule_json: Column, after: Column) -> Column:
    """Epoch seconds of the first run after a time (epoch seconds), in the session's time zone.

    {type: interval, seconds} / daily {hour, minute} / weekly {weekday, ...} with 0 for Sunday / monthly {day, ...} with
    the day clamped to the month's length. A time that a clock change skips moves to the next that exists.
    """
    get = lambda k: F.get_json_object(schedule_json, f"$.{k}").cast("int")
    kind = F.lower(F.get_json_object(schedule_json, "$.type"))
    now = F.timestamp_seconds(after)
    today = F.to_date(now)
    hour, minute = F.coalesce(get("hour"), F.lit(0)), F.coalesce(get("minute"), F.lit(0))

    def at(day: Column) -> Column:
        return F.unix_timestamp(F.make_timestamp(F.year(day), F.month(day), F.day(day), hour, minute, F.lit(0)))

    def first_after(a: Column, b: Column) -> Column:
        return F.when(at(a) > after, at(a)).otherwise(at(b))

    daily = first_after(today, F.date_add(today, 1))
    shift = F.pmod(F.coalesce(get("weekday"), F.lit(0)) - (F.dayofweek(today) - 1), F.lit(7))
    weekly = first_after(F.date_add(today, shift), F.date_add(today, shift + 7))

    def month_day(months: int) -> Column:
        first = F.add_months(F.trunc(today, "month"), months)
        return F.date_add(first, F.least(F.coalesce(get("day"), F.lit(1)), F.day(F.last_day(first))) - 1)

    monthly = first_after(month_day(0), month_day(1))
    interval = after + F.get_json_object(schedule_json, "$.seconds").cast("long")
    return F.when(kind == "interval", interval).when(kind == "daily", daily).when(kind == "weekly", weekly).when(kind == "monthly", monthly)


def due_jobs(jobs: DataFrame, now: int, idle_minutes: int | None = None) -> DataFrame:
    """Enabled jobs whose time has come, and whose idle rule (if any) is met."""
    idle = F.col("idle_minutes").isNull() | (F.lit(idle_minutes if idle_minutes is not None else -1) >= F.col("idle_minutes"))
    return jobs.where(F.col("enabled") & (F.col("next_run") <= now) & idle).orderBy("next_run", "id")


def finish(jobs: DataFrame, runs: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs with their next run, runs with a row for each of done: job_id, started_at, finished_at, status, message)."""
    last = done.groupBy(F.col("job_id").alias("id")).agg(F.max("finished_at").alias("_at"))
    rows = jobs.join(last, "id", "left")
    rows = rows.withColumn("next_run", F.when(F.col("_at").isNotNull(), next_run(F.col("schedule_json"), F.col("_at"))).otherwise(F.col("next_run")))
    rows = rows.withColumn("last_run", F.coalesce("_at", "last_run")).select(*jobs.columns)
    return rows, runs.unionByName(done)


def edit(jobs: DataFrame, job_id: int, now: int, **changes) -> DataFrame:
    """Changes to a job; an immutable one only has its next run computed anew."""
    mine = (F.col("id") == job_id) & ~F.col("immutable")
    out = jobs
    for column, value in changes.items():
        out = out.withColumn(column, F.when(mine, F.lit(value)).otherwise(F.col(column)))
    return out.withColumn("next_run", F.when(F.col("id") == job_id, next_run(F.col("schedule_json"), F.lit(now).cast("long"))).otherwise(F.col("next_run")))


def delete(jobs: DataFrame, job_id: int) -> DataFrame:
    """Jobs without one; an immutable job stays."""
    return jobs.where((F.col("id") != job_id) | F.col("immutable"))


def prune_co_refs(co_refs: DataFrame, now: int, days: int = 30, least: int = 3) -> DataFrame:
    """Pairs seen at least `least` times or within `days` stay."""
    return co_refs.where((F.col("co_occurrence_count") >= least) | (F.col("last_accessed") >= now - days * 86400))
