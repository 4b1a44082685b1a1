"""The link graph: resolution, neighbours, shortest paths, clusters, export, path trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def target(raw: Column) -> Column:
    """A raw link without its alias."""
    return F.trim(F.split_part(raw, F.lit("|"), F.lit(1)))


def normalise(raw: Column) -> Column:
    """Alias, leading ./ and then ../, and .md off."""
    out = F.regexp_replace(F.regexp_replace(target(raw), r"^(?:\./)+", ""), r"^(?:\.\./)+", "")
    return F.regexp_replace(out, r"\.md$", "")


def _placed(batches, borders: list[bytes]):
    """Rows (kind, key, id) with the stretch of the sorted keys that they belong to: a path has one, a target every one
    that its range reaches into."""
    import bisect

    import pyarrow as pa

    for batch in batches:
        at, part = [], []
        for n, (kind, key) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), strict=True)):
            raw = key.encode()
            low = bisect.bisect_right(borders, raw)
            # no UTF-8 text holds 0xff: every text that begins with the key sorts before this
            high = low if kind else bisect.bisect_right(borders, raw + b"\xff")
            part += range(low, high + 1)
            at += [n] * (high - low + 1)
        rows = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *rows.columns], ["part", *rows.schema.names])


def _within(batches):
    """Smallest id under each target (key, id), from rows sorted by (part, key, kind): a target comes right before the paths
    that begin with it, and ranges are nested or apart, so one stack holds the open ones."""
    import pyarrow as pa

    open_, keys, ids, current = [], [], [], None

    def close():
        key, low = open_.pop()
        if low is not None:
            keys.append(key)
            ids.append(low)
            if open_ and (open_[-1][1] is None or low < open_[-1][1]):
                open_[-1][1] = low

    for batch in batches:
        for part, kind, key, number in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "key", "id")), strict=True):
            while open_ and (part != current or not key.startswith(open_[-1][0])):
                close()
            current = part
            if kind == 0:
                open_.append([key, None])
            elif open_ and (open_[-1][1] is None or number < open_[-1][1]):
                open_[-1][1] = number
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64())], ["key", "id"])
        keys, ids = [], []
    while open_:
        close()
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64())], ["key", "id"])


#: Paths from which the borders of the stretches are learned. They only shape tasks.
SAMPLE = 20_000


def suffix_join(targets: DataFrame, paths: DataFrame) -> DataFrame:
    """scope, suffix, id: for each of targets (scope, suffix) the smallest id among paths (scope, path, id) of its scope
    that end with it; without one no row.

    Both are reversed and sorted together: a target is the range of paths that begin with it. Borders cut the order into
    as many stretches as the session has shuffle partitions; a path goes to one stretch, a target to those that its range
    covers (one, mostly), and a task passes over its stretch once with the open targets on a stack. No row a path and
    possible length, no pair of a target and a path: equal paths and equal targets count once, a target that ends every
    path costs one row a stretch.
    """
    spark = paths.sparkSession
    text = lambda c: F.concat(F.col("scope"), F.lit("\n"), F.reverse(F.col(c)))
    docs = paths.where("path is not null and scope is not null").groupBy(text("path").alias("key")).agg(F.min("id").alias("id"))
    rows = docs.select(F.lit(1).alias("kind"), "key", "id").unionByName(targets.where("suffix is not null and scope is not null").select(F.lit(0).alias("kind"), text("suffix").alias("key"), F.lit(None).cast("long").alias("id")).distinct())
    rows = stage(rows, "suffixes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, rows.count() // SAMPLE)
    seen = sorted(r[0].encode() for r in rows.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key").collect())  # some SAMPLE rows
    borders = sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []
    dealt = rows.mapInArrow(lambda it: _placed(it, borders), "part int, kind int, key string, id long")
    found = dealt.repartition(parts, "part").sortWithinPartitions("part", "key", "kind").mapInArrow(_within, "key string, id long")
    found = found.groupBy("key").agg(F.min("id").alias("id"))
    return found.select(F.split_part("key", F.lit("\n"), F.lit(1)).alias("scope"), F.reverse(F.substr("key", F.instr("key", F.lit("\n")) + 1)).alias("suffix"), "id")


def resolve(links: DataFrame, documents: DataFrame, aliases: DataFrame, projects: DataFrame | None = None, scheme: str = "doc") -> DataFrame:
    """source_id, target_raw, target_id, resolution of links (source_id, target_raw).

    In order: an internal URI by its project's source id and document id; the source's own project; any project; an
    alias. In a project a target names a document by source id or title, or by any end of its path, with or without
    `.md`; A-Z match in any case. The smallest document id wins within a step. What nothing resolves, an empty target
    among it, has a null target and resolution `unresolved`, and is tried again whenever this runs.

    Equal targets of a project are resolved once. Documents that share a name are reduced to the smallest id of each
    project, and of all, before anything is joined: a target meets two rows a name, however many files are called README.
    Ends of paths are found by `suffix_join`, within the project and over all.
    """
    docs = documents.select(F.col("id").alias("_id"), F.col("project_id").alias("_project"))
    rows = links.join(docs, F.col("source_id") == F.col("_id"), "left").drop("_id")
    asked = rows.select("_project", "target_raw").distinct().withColumns({"t": target(F.col("target_raw")), "n": normalise(F.col("target_raw"))})

    def want(kind: str, x: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), fold_ascii(x).alias("key"))

    forms = F.array(want("name", F.col("t")), want("name", F.col("n")), want("end", F.col("t")), want("end", F.col("n")), want("end", F.concat("n", F.lit(".md"))))
    bare = (F.col("t") != "") & (F.col("n") != "")
    wanted = asked.where(bare).select("_project", "target_raw", F.inline(F.array_distinct(forms)))
    wanted = stage(wanted, "link-targets")
    names = F.explode(F.array_distinct(F.array_compact(F.array(fold_ascii(F.col("source_doc_id")), fold_ascii(F.col("title")))))).alias("key")
    keys = documents.select(names, "project_id", F.col("id").alias("document_id"))
    own = keys.groupBy("key", "project_id").agg(F.min("document_id").alias("document_id"))
    every = own.groupBy("key").agg(F.min("document_id").alias("document_id"))
    named, ended = wanted.where("kind = 'name'"), wanted.where("kind = 'end'")
    scopes = {2: F.concat(F.lit("p"), F.col("_project").cast("string")), 3: F.lit("all")}
    targets = ended.select(F.explode(F.array(*scopes.values())).alias("scope"), F.col("key").alias("suffix"))
    inside = F.explode(F.array(F.concat(F.lit("p"), F.col("project_id").cast("string")), F.lit("all"))).alias("scope")
    ends = stage(suffix_join(targets, documents.select(inside, fold_ascii(F.col("file_path")).alias("path"), "id")), "link-ends")
    found = named.join(own, "key").where("project_id = _project").select("_project", "target_raw", F.lit(2).alias("step"), "document_id")
    found = found.unionByName(named.join(every, "key").select("_project", "target_raw", F.lit(3).alias("step"), "document_id"))
    for step, scope in scopes.items():
        met = ended.withColumn("_scope", scope).join(ends, (F.col("_scope") == F.col("scope")) & (F.col("key") == F.col("suffix")))
        found = found.unionByName(met.select("_project", "target_raw", F.lit(step).alias("step"), F.col("id").alias("document_id")))
    known = aliases.groupBy(F.col("alias").alias("key")).agg(F.min("document_id").alias("document_id"))
    aliased = asked.where(bare).select("_project", "target_raw", F.explode(F.array_distinct(F.array("t", "n"))).alias("key")).join(known, "key")
    found = found.unionByName(aliased.select("_project", "target_raw", F.lit(4).alias("step"), "document_id"))
    if projects is not None:
        uri = rf"{scheme}://([^/\s]+(?: [^/\s]+)*)/([^\s\]\).,]+)"
        parts = asked.select("_project", "target_raw", *(F.regexp_extract("target_raw", uri, i).alias(f"_s{i}") for i in (1, 2))).where("_s1 <> ''")
        owned = documents.join(projects.select(F.col("id").alias("project_id"), "source_project_id"), "project_id")
        owned = owned.groupBy("source_project_id", "source_doc_id").agg(F.min("id").alias("document_id"))
        exact = parts.join(owned, (F.col("_s1") == F.col("source_project_id")) & (F.col("_s2") == F.col("source_doc_id")))
        found = found.unionByName(exact.select("_project", "target_raw", F.lit(1).alias("step"), "document_id"))
    best = found.groupBy("_project", "target_raw").agg(F.min(F.struct("step", "document_id")).alias("b")).withColumnsRenamed({"_project": "_p", "target_raw": "_t"})
    steps = F.element_at(F.array(*map(F.lit, ("uri", "project", "global", "alias"))), F.col("b.step"))
    out = rows.join(best, F.col("_project").eqNullSafe(F.col("_p")) & (F.col("target_raw") == F.col("_t")), "left")
    return out.select("source_id", "target_raw", F.col("b.document_id").alias("target_id"), F.when(F.col("b").isNull(), "unresolved").otherwise(steps).alias("resolution"))


def outgoing(edges: DataFrame, documents: DataFrame, document_id: int) -> DataFrame:
    """Distinct documents that a document links to: id, source_doc_id, title."""
    hit = edges.where((F.col("source_id") == document_id) & F.col("target_id").isNotNull()).select(F.col("target_id").alias("id")).distinct()
    return hit.join(documents.select("id", "source_doc_id", "title"), "id")


def backlinks(edges: DataFrame, documents: DataFrame, document_id: int) -> DataFrame:
    hit = edges.where(F.col("target_id") == document_id).select(F.col("source_id").alias("id")).distinct()
    return hit.join(documents.select("id", "source_doc_id", "title"), "id")


def neighbours(edges: DataFrame) -> DataFrame:
    """Each document's distinct neighbours in either direction: document_id, neighbour_id."""
    known = edges.where("target_id is not null")
    both = known.select(F.col("source_id").alias("document_id"), F.col("target_id").alias("neighbour_id"))
    return both.unionByName(known.select(F.col("target_id").alias("document_id"), F.col("source_id").alias("neighbour_id"))).distinct()


def shortest_path(edges: DataFrame, source: int, target: int, max_hops: int = 6) -> DataFrame:
    """path (ids in order) and hops of a directed shortest path, or no row. Ties go to the smallest ids.

    Breadth-first from both ends, always on the side whose frontier is smaller, until the frontiers meet: levels are
    tables of ids, and each grows to half the distance. Then levels are cut to what leads to the meeting ids, and only
    there are paths put together, the smallest for each id.
    """
    spark = edges.sparkSession
    none = spark.createDataFrame([], "path array<long>, hops int")
    if source == target:
        return spark.createDataFrame([([source], 0)], none.schema)
    steps = stage(edges.where("target_id is not null").select(F.col("source_id").cast("long").alias("source_id"), F.col("target_id").cast("long").alias("target_id")).distinct(), "edges")
    ways = {"out": steps.select(F.col("source_id").alias("at"), F.col("target_id").alias("to")), "back": steps.select(F.col("target_id").alias("at"), F.col("source_id").alias("to"))}
    levels = {side: [spark.createDataFrame([(end,)], "id long")] for side, end in (("out", source), ("back", target))}
    width, seen, met = {"out": 1, "back": 1}, {side: found[0] for side, found in levels.items()}, None
    for _ in range(max_hops):
        side = min(width, key=lambda s: (width[s], s == "back"))
        other = "back" if side == "out" else "out"
        last = levels[side][-1]
        moved = ways[side].join(last, F.col("at") == F.col("id"), "left_semi").select(F.col("to").alias("id")).distinct()
        level = stage(moved.join(seen[side], "id", "left_anti"), "frontier")
        width[side] = level.count()
        if not width[side]:
            return none
        levels[side].append(level)
        seen[side] = seen[side].unionByName(level)
        # ids that were met before would have met then: only the two frontiers can
        common = level.join(levels[other][-1], "id", "left_semi")
        if not common.isEmpty():
            met = stage(common, "meeting")
            break
    if met is None:
        return none
    parts = {}
    for side, found in levels.items():
        kept = [met]  # from the meeting ids towards the end, only ids that lead on
        for level in reversed(found[:-1]):
            before = ways[side].join(kept[-1], F.col("to") == F.col("id"), "left_semi").select(F.col("at").alias("id")).distinct()
            kept.append(stage(before.join(level, "id", "left_semi"), "kept"))
        trail = kept[-1].select("id", F.array("id").alias("trail"))
        for level in reversed(kept[:-1]):
            more = ways[side].join(trail, F.col("at") == F.col("id")).drop("id").join(level, F.col("to") == F.col("id"))
            longer = F.concat("trail", F.array("to")) if side == "out" else F.concat(F.array("to"), "trail")
            trail = stage(more.select(F.col("to").alias("id"), longer.alias("trail")).groupBy("id").agg(F.min("trail").alias("trail")), "trails")
        parts[side] = trail.withColumnRenamed("trail", side)
    whole = F.concat("out", F.slice("back", 2, F.size("back")))
    both = parts["out"].join(parts["back"], "id").select(whole.alias("path"))
    return both.select("path", (F.size("path") - 1).alias("hops")).orderBy("path").limit(1)


def distances(edges: DataFrame, sources: DataFrame, max_hops: int = 6) -> DataFrame:
    """source, id, hops: directed distances from every source at once, to max_hops."""
    steps = stage(edges.where("target_id is not null").select("source_id", "target_id").distinct(), "edges")
    frontier = sources.select(F.col("id").alias("source"), "id")
    out = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, max_hops + 1):
        moved = frontier.join(steps, F.col("id") == F.col("source_id")).select("source", F.col("target_id").alias("id")).distinct()
        frontier = stage(moved.join(out.select("source", "id"), ["source", "id"], "left_anti"), "frontier")
        out = out.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return out


def cluster(edges: DataFrame, source: int, depth: int = 2, directed: bool = True) -> DataFrame:
    """id, depth of documents within `depth` (at most 5) steps; a document shows at each level it is met on."""
    depth = min(depth, 5)
    steps = edges.where("target_id is not null").select("source_id", "target_id")
    if not directed:
        steps = steps.unionByName(steps.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))
    steps = steps.distinct()
    level = edges.sparkSession.createDataFrame([(source,)], "id long")
    out = level.withColumn("depth", F.lit(0))
    for n in range(1, depth + 1):
        level = stage(level.join(steps, F.col("id") == F.col("source_id")).select(F.col("target_id").alias("id")).distinct(), "level")
        out = out.unionByName(level.withColumn("depth", F.lit(n)))
    return out


def export(documents: DataFrame, edges: DataFrame, tags: DataFrame) -> DataFrame:
    """kind (node, edge), source, target, label: documents and `tag:` nodes, `link` and `tag_rel` edges."""
    nodes = documents.select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("source"), F.lit(None).cast("string").alias("target"), F.col("title").alias("label"))
    tag_nodes = tags.select("tag").distinct().select(F.lit("node").alias("kind"), F.concat(F.lit("tag:"), "tag").alias("source"), F.lit(None).cast("string").alias("target"), F.col("tag").alias("label"))
    link = edges.where("target_id is not null").select(F.lit("edge").alias("kind"), F.col("source_id").cast("string").alias("source"), F.col("target_id").cast("string").alias("target"), F.lit("link").alias("label"))
    rel = tags.select(F.lit("edge").alias("kind"), F.col("document_id").cast("string").alias("source"), F.concat(F.lit("tag:"), "tag").alias("target"), F.lit("tag_rel").alias("label"))
    return nodes.unionByName(tag_nodes).unionByName(link).unionByName(rel)


def graph_view(nodes: DataFrame, edges: DataFrame, project_ids: list[int] | None = None, plugins: list[str] | None = None) -> DataFrame:
    """Edges (source, target, kind) whose ends are both active: documents of the chosen projects and plugins, and tags
    that still have a link."""
    docs = nodes.where("not is_tag")
    if project_ids:
        docs = docs.where(F.col("project_id").isin(project_ids))
    if plugins:
        docs = docs.where(F.col("plugin_id").isin(plugins))
    active = docs.select(F.col("node").alias("_n"))
    kept = edges.join(active, F.col("source") == F.col("_n"), "left_semi")
    links = kept.where("kind = 'link'").join(active, F.col("target") == F.col("_n"), "left_semi")
    return links.unionByName(kept.where("kind = 'tag_rel'"))


def path_tree(documents: DataFrame) -> DataFrame:
    """path, parent, name, depth, document_id, is_leaf of the tree of hierarchy paths; on a clash the first document wins."""
    parts = F.split(F.regexp_replace("file_path", r"\.md$", ""), "/")
    rows = documents.select("id", parts.alias("p"), F.posexplode(parts).alias("i", "name"))
    rows = rows.select("id", "name", (F.col("i") + 1).alias("depth"), F.array_join(F.slice("p", 1, F.col("i") + 1), "/").alias("path"), F.array_join(F.slice("p", 1, "i"), "/").alias("parent"), (F.col("i") == F.size("p") - 1).alias("leaf"))
    return rows.groupBy("path", "parent", "name", "depth").agg(F.min(F.when(F.col("leaf"), F.col("id"))).alias("document_id"), F.max("leaf").alias("is_leaf"))


def ancestor_paths(pages: DataFrame, stop: int | None = None, max_levels: int = 50, drop: tuple = ("Project",)) -> DataFrame:
    """page_id, path, is_parent of pages (page_id, parent_id, title): titles from the root (or below `stop`) down.

    Walks all pages up one level a join, 50 at most; titles in `drop` and a repeat of the one before are left out.
    """
    up = pages.select(F.col("page_id").alias("_p"), F.col("parent_id").alias("_up"), F.col("title").alias("_t"))
    walk = pages.select("page_id", F.col("parent_id").alias("at"), F.array(F.col("title")).alias("trail"))
    done = None
    for _ in range(max_levels):
        ends = F.col("at").isNull() | (F.col("at") == F.lit(stop) if stop is not None else F.lit(False))
        finished = walk.where(ends).select("page_id", "trail")
        done = finished if done is None else done.unionByName(finished)
        step = walk.where(~ends).join(up, F.col("at") == F.col("_p"), "left")
        walk = stage(step.select("page_id", F.col("_up").alias("at"), F.concat(F.array_compact(F.array("_t")), "trail").alias("trail")), "walk")
        if walk.isEmpty():
            break
    done = done.unionByName(walk.select("page_id", "trail"))
    trail = F.filter("trail", lambda x: ~x.isin(*drop))
    trail = F.filter(trail, lambda x, i: (i == 0) | (x != F.get(trail, i - 1)))
    parents = pages.where("parent_id is not null").select(F.col("parent_id").alias("_parent")).distinct()
    joined = done.join(parents, F.col("page_id") == F.col("_parent"), "left")
    return joined.select("page_id", F.array_join(trail, "/").alias("path"), F.col("_parent").isNotNull().alias("is_parent"))


def rank_neighbours(edges: DataFrame, limit: int) -> DataFrame:
    """The `limit` documents with most distinct incoming links."""
    counted = edges.where("target_id is not null").groupBy(F.col("target_id").alias("id")).agg(F.count_distinct("source_id").alias("incoming"))
    return counted.orderBy(F.desc("incoming"), "id").limit(limit)
