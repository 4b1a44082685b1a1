"""Every operator against its brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common, decontaminate, embeddings, licenses, packing, quality, sharding, simhash, substrings, toxicity, warc
from corpusloom.llm.registry import tokenizer_path

from . import brute

RNG = np.random.default_rng(5)
VOCABULARY = ["the", "Der", "éa", "ion", "x1", "z", "and", "license", "mit", "apache", "le", "ß", "tion", "of", "general", "public"]


def sentence(n):
    return " ".join(RNG.choice(VOCABULARY, n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source, n_chars): null, empty, blank, short, long, repeated, near-equal, clashing rows."""
    passage, long = sentence(60), sentence(6000)
    texts = [None, "", " \t\n", "one", "two words", "Mit\x0bLicense", "the the the " * 40, long, passage, passage, passage + " tail", "head " + passage + " " + sentence(50)]
    texts += [sentence(int(RNG.integers(1, 300))) for _ in range(40)]
    texts += [texts[-1] + " extra", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "GNU General  Public-License x general public license", "KK Éßİ mit license"]
    texts += [" ".join(["dup"] + [str(i) for i in range(120)])] * 9
    out = [(i, t, "en", f"src{i % 3}" if i % 4 else "src0", len(t or "")) for i, t in enumerate(texts)]
    return out + [out[8], out[8], (8, "same id, other text", "en", None, 1), (None, "no id " + passage, None, None, None), (None, "no id " + passage, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for name in ("text_key", "spans", "fp", "rep", "score", "label", "bucket", "shard", "w", "part", "component_id"):
        extra = extra.withColumn(name, F.lit("clash"))
    return extra


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return Counter(map(tuple, rows))


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows]
    got = packing.pack(docs, tokenizer_path(), pool=8).collect()
    assert max(Counter(r["sequence_id"] for r in got).values()) >= 1
    sizes = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sizes[r["sequence_id"]]
        sizes[r["sequence_id"]] += r["length"]
    assert all(n & (n - 1) == 0 and n <= 2048 for n in sizes.values())  # no padding
    assert sum(sizes.values()) == sum(map(len, ids))
    by_id = {}
    for (doc, *_), one in zip(rows, ids, strict=True):
        by_id.setdefault(doc, []).append(one)
    for r in got:
        pieces = [np.array(one[r["start"] : r["start"] + r["length"]], "<u4").tobytes() for one in by_id[r["doc_id"]] if len(one) == r["doc_tokens"]]
        assert r["ids_crc32"] in map(zlib.crc32, pieces)
    for doc, parts in by_id.items():
        assert sum(r["length"] for r in got if r["doc_id"] == doc) == sum(map(len, parts))
    steps = Counter()
    for r in got:
        steps[r["step_group"]] += r["length"]
    assert max(steps.values()) <= 16 * 2048


def test_packing_balances_steps():
    """Groups of one deal hold nearly equal tokens and cost nearly equal attention, whatever order tiers come in."""
    packer = packing._Packer(0, packing.TIERS, 64, 4 * 2048)
    for n in [2048] * 30 + [1500, 700, 300, 120] * 60:
        packer.add(0, np.ones(n, np.uint32))
    packer.pack(last=True)
    rows = packer.flush().to_pylist()
    tokens, lengths = Counter(), Counter()
    for r in rows:
        tokens[r["step_group"]] += r["length"]
        lengths[r["step_group"], r["sequence_id"]] += r["length"]
    cost = Counter()
    for (group, _), n in lengths.items():
        cost[group] += n * n
    assert sum(tokens.values()) == 2048 * 30 + (1500 + 700 + 300 + 120) * 60
    assert len(tokens) == -(-sum(tokens.values()) // (4 * 2048)) and max(tokens.values()) <= 4 * 2048
    assert min(tokens.values()) >= 0.5 * max(tokens.values()) and max(cost.values()) <= 1.6 * min(cost.values())


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, tokenizer_path()).count() == 0


def test_packing_special_text(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["a<|endoftext|>b", "  x\n\n y", "it's 123ABC é ß", "\U0001f600 ok", "½²x", "don't\r\nwe'll"]
    encode = packing.encoder(tokenizer_path())
    assert [list(encode(t)) for t in texts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_substrings(docs, rows, nothing):
    want = bag((r[0], *x) for r, x in zip(rows, brute.substrings([r[1] for r in rows]), strict=True))
    for buckets, block in ((None, 24_000_000), (3, 2_000)):
        assert bag(substrings.report(docs, buckets=buckets, block_bytes=block).collect()) == want
    assert substrings.report(nothing).count() == 0


def test_substrings_remove(spark, docs, rows):
    kept = substrings.remove(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or -1, len((r["text"] or "").split()), r["n_chars"] or 0) for r in kept.collect())
    want = sorted((r[0] or -1, n - gone) for r, (n, gone, _) in zip(rows, brute.substrings([r[1] for r in rows]), strict=True))
    assert [g[:2] for g in got] == want
    passage = " ".join(f"w{i}" for i in range(40))
    pair = spark.createDataFrame([(1, f"keep  this,\n{passage}\nand  that"), (2, passage)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in substrings.remove(pair).collect()} == {1: "keep  this,\n\nand  that", 2: ""}


def test_repeated_windows_periodic(monkeypatch):
    ids = np.array([1, 2] * 5 + [9, 8, 7, 6])
    want = [k for k in range(11) if sum((ids[k : k + 4] == ids[j : j + 4]).all() for j in range(11)) > 1]
    for limit in (4_000_000, 3, 1):
        assert substrings.repeated(ids, np.array([14]), 4, limit).tolist() == want
    # a hash that tells nothing apart: the words decide
    monkeypatch.setattr(substrings, "mixed", lambda x: np.zeros(len(x), np.uint64))
    assert substrings.repeated(ids, np.array([14]), 4).tolist() == want


def test_frequent_lines_draw_no_windows():
    """A line of 20 words between other words: with its m-mers last, no window outside it takes one of them."""
    line = [b"line%d" % i for i in range(20)]
    late = np.zeros(1 << 22, np.uint64)
    late[substrings.mmers(line, 5) & np.uint64((1 << 22) - 1)] = 1
    words = [b"a%d" % i for i in range(60)] + line + [b"b%d" % i for i in range(60)]
    assert not (substrings.minimisers(words, 35, 5, late) >> np.uint64(63)).any()


def test_decontamination(spark, docs, rows, nothing):
    passage = rows[8][1]
    items = [(1, passage), (10, "one"), (2, passage), (3, None), (4, "!!"), (None, "two words"), (5, sentence(25)), (1, "two words"), (6, rows[7][1][300:900])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = bag((r[0], *x) for r, x in zip(rows, brute.contamination([r[1] for r in rows], items), strict=True))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for options in ({}, {"shard_bytes": 2_000}, {"block_chars": 60}):
        assert bag(decontaminate.report(docs, bench, **options).select(columns).collect()) == want
    assert decontaminate.report(nothing, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    cleaned = decontaminate.clean(docs, bench)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    left = decontaminate.clean(spark.createDataFrame([(1, "Keep me. " + passage + "! Bye")], "doc_id long, text string"), bench)
    assert left.first()["text"] == "Keep me. ! Bye"


def test_suffix_array_and_index():
    for n in (1, 2, 50, 400):
        text = np.append(RNG.integers(1, 4, n), 0)
        order = decontaminate.suffix_array(text)
        assert order.tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        index = decontaminate.FMIndex(text, 3)
        patterns = RNG.integers(1, 4, (20, 3))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            places = [i for i in range(n - 1) if text[i : i + 3].tolist() == p.tolist()]
            assert sorted(index.locate(np.arange(a, b))) == places


def test_simhash(spark, docs, rows, nothing):
    fps = {n: brute.fingerprint(r[1]) for n, r in enumerate(rows)}
    parts = brute.components_of(fps)
    low = {}
    for n, p in parts.items():
        if rows[n][0] is not None:
            low[p] = min(low.get(p, 1 << 60), rows[n][0])
    want = bag((rows[n][0], fps[n], low.get(parts[n])) for n in parts)
    for groups in (4, 5):
        got = simhash.near_duplicates(docs, groups=groups).select("doc_id", "fp", "component_id").collect()
        assert bag((r[0], r[1] % (1 << 64), r[2]) for r in got) == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(low.values())) and ids.count(None) == 2


def test_simhash_clusters(spark):
    """Fingerprints in chains and stars of few bits, some cells large."""
    base = RNG.integers(0, 1 << 62, 40)
    fps = set()
    for b in base.tolist():
        fps.add(b)
        for _ in range(25):
            b ^= int(1 << int(RNG.integers(0, 62))) | int(1 << int(RNG.integers(0, 62)))
            fps.add(b)
    fps = {i: f for i, f in enumerate(sorted(fps))}
    want = brute.components_of(fps)
    table = spark.createDataFrame([(f,) for f in fps.values()], "fp long")
    number = {f: i for i, f in fps.items()}  # numbered in their order
    for groups, batch in ((4, 10_000), (3, 7)):  # cells that hold much, in one batch and over many
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        keyed = simhash.cells(table, groups).repartition("key").sortWithinPartitions("key", "guest", "fp")
        links = keyed.mapInPandas(lambda it: simhash._cell_links(it, 2), "u long, v long")
        comp = {number[r["node"]]: number[r["component"]] for r in common.components(links).collect()}
        assert {i: comp.get(i, i) for i in fps} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_simhash_dense_cells(spark):
    """Thousands of fingerprints around two others: cells too large to be compared as they come, in parts and over batches."""
    fps = set()
    for center, width in ((int(RNG.integers(0, 1 << 62)), 20), (int(RNG.integers(0, 1 << 62)), 62)):
        for _ in range(1500):
            f = center
            for bit in RNG.integers(0, width, int(RNG.integers(1, 7))).tolist():
                f ^= 1 << bit
            fps.add(f)
    fps = {i: f for i, f in enumerate(sorted(fps))}
    want = brute.components_of(fps)
    assert 100 < len(set(want.values())) < len(want) - 100
    table = spark.createDataFrame([(f,) for f in fps.values()], "fp long")
    number = {f: i for i, f in fps.items()}
    held = simhash.cells(table).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert held > 2 * simhash.SMALL
    for batch in (10_000, 37):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        keyed = simhash.cells(table).repartition("key").sortWithinPartitions("key", "guest", "fp")
        links = keyed.mapInPandas(lambda it: simhash._cell_links(it, 2), "u long, v long")
        found = common.components(links).collect()
        comp = {number[r["node"]]: number[r["component"]] for r in found}
        assert {i: comp.get(i, i) for i in fps} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_simhash_grid_meets_every_pair_within_reach(spark):
    """Each pair within the radius shares a cell in which one of the two is at home; cells bound the Manhattan distance."""
    made = [(a := int(RNG.integers(0, 1 << 62)), a ^ (1 << int(RNG.integers(0, 62))) ^ (1 << int(RNG.integers(0, 62)))) for _ in range(60)]
    rows = simhash.cells(spark.createDataFrame([(f,) for p in made for f in p], "fp long").distinct()).collect()
    where = {}
    for r in rows:
        where.setdefault(r["fp"], set()).add((r["key"], r["guest"]))
    for a, b in made:
        homes = [{k for k, g in where[f] if not g} for f in (a, b)]
        assert homes[0] & {k for k, _ in where[b]} or homes[1] & {k for k, _ in where[a]}


def test_components_chain(spark):
    n = 300
    chain = [(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5000, 5000)]
    order = RNG.permutation(len(chain))
    edges = spark.createDataFrame([tuple(map(int, chain[k])) for k in order], "u long, v long").repartition(4)
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(50)}


def _vectors():
    x = RNG.normal(size=(60, 24))
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    for k in range(40):
        out.append((100 + k, (x[k % 8] + RNG.normal(size=24) * 0.12).tolist()))
    out += [(200, None), (201, []), (202, [0.0] * 24), (203, [float("nan")] * 24), (204, [1.0] * 23 + [None]), (205, [float("inf")] + [0.0] * 23), (206, [1.0, 0.0]), (207, [2.0, 0.0]), (208, (2 * x[0]).tolist())]
    return out + [out[3], out[3], (None, out[3][1]), (None, [9.0] * 24), (3, x[9].tolist())]


def test_embeddings(spark):
    vectors = _vectors()
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("tile", F.lit("x")).repartition(3)
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    want = bag((i, n, c, i is not None and i == c) for (i, _), (n, c) in zip(rounded, brute.cosines(rounded), strict=True))
    for options in ({}, {"tile": 7, "cuts": (4, 8)}, {"tile": 16, "cuts": ()}):
        assert bag(embeddings.near_duplicates(table, **options).collect()) == want
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_of_any_scale_and_at_the_threshold(spark):
    """Doubles whose squares over- or underflow, a cosine of exactly 0.95, and many ties in the leading coordinates."""
    out, step = [], 0
    for scale in (1.0, 2.0**-700, 2.0**700, 2.0**-1060, 8.0):
        for v in ([20.0, 0, 0, 0, 0], [19.0, 6, 1, 1, 1], [0, 1.0, 0, 0, 0], [0, 9.0, 2.0, 0, 0], [0, 0, 0, 1.0, 1.0], [0, 0, 0, 1.0, -1.0]):
            out.append((step, [x * scale for x in v], v))
            step += 1
    for k in range(60):
        v = [0.0, 0.0, 1.0, 0.0, 1e-3 * (k % 7)]
        out.append((1000 + k, v, v))
    table = spark.createDataFrame([(i, list(map(float, v))) for i, v, _ in out], "vec_id long, embedding array<double>").repartition(3)
    scaled = [(i, v) for i, _, v in out]
    want = bag((i, n, c, i == c) for (i, _), (n, c) in zip(scaled, brute.cosines(scaled), strict=True))
    for options in ({}, {"tile": 5}, {"tile": 11, "cuts": (1, 2, 3)}):
        assert bag(embeddings.near_duplicates(table, **options).collect()) == want
    assert dict(zip([i for i, _ in scaled], [x[1] for x in brute.cosines(scaled)], strict=True))[1] == 0  # 19/20 links


def test_sharding(docs, rows, nothing):
    got = sharding.report(docs, cells=8).collect()
    assert bag((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == bag((r[0], len((r[1] or "").encode()) + 1, brute.crc(r[1])) for r in rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    totals = Counter(r["source"] for r in got)
    for s in range(16):
        mix = Counter(r["source"] for r in got if r["shard"] == s)
        assert all(abs(mix[k] - totals[k] / 16) <= 1.5 for k in totals)
    assert bag(sharding.report(docs, cells=64).collect()) == bag(got)
    assert sharding.report(nothing).count() == 0


def test_sharding_write(spark, docs, rows, tmp_path):
    """Columns that clash with shard and slot give way; every row comes back."""
    clashing = docs.select("doc_id", "text", "source", "lang", "shard", F.lit("x").alias("slot"))
    sharding.write(clashing, str(tmp_path / "out"), cells=8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert bag((r["doc_id"], r["text"]) for r in back.collect()) == bag((r[0], r[1]) for r in rows)
    placed = bag((r["doc_id"], r["shard"], r["slot"]) for r in sharding.report(docs).collect())
    assert bag((r["doc_id"], r["shard"], r["slot"]) for r in back.collect()) == placed


def ranked(rows, shards=16):
    """Brute force: rows (doc_id, source, size, crc, hash) to (doc_id, size, crc, shard, slot)."""
    by, out = {}, []
    for r in rows:
        by.setdefault(r[1], []).append(r)
    for source, own in by.items():
        own.sort(key=lambda r: (r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
        out += [((k + 0.5) / len(own), source is not None, source or "", r[4], k, r) for k, r in enumerate(own)]
    out.sort(key=lambda x: x[:5])
    n = len(out)
    shard = [k * shards // n for k in range(n)]
    return [(x[5][0], x[5][2], x[5][3], s, k - shard.index(s)) for k, (x, s) in enumerate(zip(out, shard, strict=True))]


def hashed(docs):
    size, crc = F.octet_length(F.coalesce("text", F.lit(""))) + 1, F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.select("doc_id", "source", size.cast("long").alias("size"), crc.alias("crc")).withColumn("h", F.xxhash64(F.lit(42), "doc_id", "crc", "size")).collect()


def test_sharding_is_the_ranking_whatever_the_session(spark, docs):
    want = bag(ranked(list(map(tuple, hashed(docs)))))
    try:
        for partitions in (3, 7):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            for cells in (1, 8, 4096):
                got = sharding.report(docs.repartition(partitions), cells=cells).select("doc_id", "size", "text_crc32", "shard", "slot")
                assert bag(got.collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_licences(spark, docs, rows, nothing):
    got = licenses.scan(docs).collect()
    assert bag(tuple(r[k] for k in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in got) == bag((r[0], *brute.licences(r[1])) for r in rows)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    texts = {
        1: "Foo. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: a",
        2: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        3: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        4: "Licensed under CC BY-NC 4.0.",
        5: "modification forms binary source use redistribution conditions permitted",
        6: "we use this in the public and it is free",
    }
    found = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert found == {1: "bsd", 2: "mit", 3: "gpl", 4: "cc", 5: "", 6: ""}, found
    assert licenses.scan(nothing).count() == 0


JUNK = lambda: " ".join(w + "***" for w in RNG.choice(VOCABULARY, 40))
TOXIC = lambda: " ".join(np.insert(RNG.choice(VOCABULARY, 60).astype(object), [3, 20, 40], ["flurbig", "flurbon", "idiot"]))


@pytest.fixture(scope="module")
def labelled(spark):
    made = [(i, sentence(60) + ". " + sentence(9).capitalize(), 1, 0) for i in range(260)]
    made += [(i, JUNK(), 0, 0) for i in range(260, 400)] + [(i, TOXIC(), 1, 1) for i in range(400, 560)]
    docs = spark.createDataFrame([(*r[:2], "en", "s", 1) for r in made] + [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "x", "en", "s", 1), (5, made[5][1], "en", "s", 1)], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in made] + [(None, 1, 1), (900, None, None), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    return docs.withColumn("label", F.lit("clash")).withColumn("features", F.lit("clash")), labels, made


def test_quality(labelled, nothing):
    docs, labels, made = labelled
    got = quality.report(docs, labels).collect()
    assert len(got) == len(made) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    want = {r[0]: r[2] for r in made}
    held = [r for r in got if r["held_out"] and r["doc_id"] in want]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) >= 0.97
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.where(F.col("doc_id").between(0, 259)).count() == 261
    assert quality.report(nothing, labels).count() == 0
    assert {r["score"] for r in quality.report(docs, labels.limit(0)).collect()} == {0.5}
    assert all(r["score"] > 0.9 for r in quality.report(docs, labels.where("quality = 1")).collect())


def test_quality_never_reads_held_out_labels(spark, labelled):
    docs, labels, _ = labelled
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert bag(quality.report(docs, labels).collect()) == bag(quality.report(docs, turned).collect())


def test_toxicity(labelled, nothing):
    docs, labels, made = labelled
    got = toxicity.report(docs, labels).collect()
    assert len(got) == len(made) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    want = {r[0]: r[3] for r in made}
    held = [r for r in got if r["held_out"] and r["doc_id"] in want]
    assert held and np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) >= 0.97
    assert toxicity.report(nothing, labels).count() == 0
    assert {r["score"] for r in toxicity.report(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.report(docs, labels.where("toxic = 1")).collect()} == {1.0}


def test_toxicity_features_cover_long_texts():
    lexicon, at = toxicity.Lexicon({}), toxicity.NAMES.index("second")
    for n in (1, 3, 3000):
        words = ["idiot", "a", "b", "c", "you", "x", "x", "x", "x", "x"] * n + ["idiot"]
        near = sum(any(w in toxicity.SECOND for w in words[max(0, i - 4) : i + 5]) for i, w in enumerate(words) if w == "idiot")
        assert near == n and toxicity.features(" ".join(words), lexicon)[at] == near / len(words)
    assert toxicity.features("nothing here", lexicon)[at] == 0 and toxicity.features(None, lexicon) == [0.0] * len(toxicity.NAMES)


def test_toxicity_masked_tokens():
    text = "an id.iot, st00pid\u00a0f*ck a..b 3d x_y --a-- 1a1 \u00e9!\u00e9 tail"
    slow = [t for t in text.split() if re.search(r"[^\W\d_][0-9@$!|*._-]+[^\W\d_]", t)]
    assert toxicity.masked_tokens(text) == slow and len(slow) == 6
    lexicon = toxicity.Lexicon({})
    for long in ("a." * 200_000, "a" + "." * 400_000, "x" * 400_000):  # one token: linear time
        made = dict(zip(toxicity.NAMES, toxicity.features(long, lexicon), strict=True))
        assert made["obfuscated"] == len(toxicity.masked_tokens(long)) / len(toxicity.WORD.findall(long))


def test_warc(spark, tmp_path):
    html = '<html><head><title>A &amp; B</title><script>var t="</p>";</script><!-- x --></head><body><p>One<br>two <b>bold</b>&nbsp;&lt;3</p><a href="/x">link</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a/1", html), (2, None, None), (3, "http://a/3", ""), (1, "http://a/1", html), (None, "u", "plain < 3 text")], "page_id long, url string, html string").withColumn("block", F.lit("x"))
    made = warc.report(pages)
    rows = made.collect()
    assert len(rows) == 10
    text = next(r for r in rows if r["page_id"] == 1 and r["record_type"] == "conversion")
    assert text["block"] == "A & B\nOne\ntwo bold <3\nlink"
    meta = next(r for r in rows if r["page_id"] == 1 and r["record_type"] == "metadata")
    assert meta["refers_to"] == text["refers_to"] != text["record_id"] and "title: A & B\r\n" in meta["block"] and meta["block"].endswith("outlink: /x")
    assert next(r for r in rows if r["page_id"] is None and r["record_type"] == "conversion")["block"] == "plain < 3 text"
    assert warc.write(made, str(tmp_path / "w")) == 10
    import gzip

    for file in (tmp_path / "w").iterdir():  # each record is a member of its own
        assert file.name.endswith(".warc.gz") and file.read_bytes().count(b"\x1f\x8b\x08") >= gzip.decompress(file.read_bytes()).count(b"WARC/1.1\r\n")
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert Counter((r["warc_type"], r["headers"]["warc-record-id"], bytes(r["block"]).decode()) for r in back) == Counter((r["record_type"], r["record_id"], r["block"]) for r in rows)
    assert warc.report(pages.limit(0)).count() == 0


def test_warc_responses(spark, tmp_path):
    body = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hé</p>"
    record = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:AB\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record.encode() + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\ncut")
    rows = warc.derive(warc.as_responses(warc.read(spark, str(tmp_path)))).collect()
    assert len(rows) == 2 and {r["refers_to"] for r in rows} == {"<urn:uuid:1>"} and {r["source_digest"] for r in rows} == {"sha1:AB"}
    assert next(r for r in rows if r["record_type"] == "conversion")["block"] == "hé"


def test_warc_reads_what_it_can(spark, tmp_path):
    """Malformed records are counted, not fatal; blocks that hold the mark of a record are whole; a broken gzip gives its beginning."""
    import gzip

    def record(block, size=None, kind="resource"):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(block) if size is None else size}\r\n\r\n".encode() + block + b"\r\n\r\n"

    tricky = b"see WARC/1.0\r\nand WARC/1.1 \xff\x00\r\n\r\nend"
    (tmp_path / "a.warc").write_bytes(record(b"one") + record(b"x", "x") + record(tricky) + record(b"two", "-3") + record(b"three") + b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 99\r\n\r\ncut")
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(b"g%d" % i)) for i in range(3)))
    broken = gzip.compress(record(b"first")) + gzip.compress(record(b"second" * 50_000))[:60]
    (tmp_path / "c.warc.gz").write_bytes(broken)
    (tmp_path / "d.warc").write_bytes(b"")
    rows = warc.read(spark, str(tmp_path)).collect()
    good = Counter(bytes(r["block"]) for r in rows if r["warc_type"] != "malformed")
    assert good == Counter([b"one", tricky, b"three", b"g0", b"g1", b"g2"] + [b"first"] * (b"first" in good))
    assert sum(r["warc_type"] == "malformed" and r["file"].endswith("a.warc") for r in rows) == 3
    assert {r["headers"]["reason"] for r in rows if r["warc_type"] == "malformed" and r["file"].endswith("a.warc")} == {"no valid Content-Length", "cut off"}


def test_forest():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 60))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 80))))
        want = brute.union(range(n), zip(a.tolist(), b.tolist(), strict=True))
        assert common.forest(a, b, n).tolist() == [want[i] for i in range(n)]


def test_warc_text_equals_its_steps_one_by_one(spark):
    """Decoding in one pass, tags by their beginning and trimming give what the listed steps give in their order."""
    names = [n for n, _ in warc.ENTITIES]
    pieces = [*names, "&", ";", "lt;", "amp", "&amp;lt;", "&&lt;", "&LT;", "&lt", "&ltx;", "&#39", "&#8217;", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "a", "é", "<p>", "</Div >", "<preX>", "<heading>", "<tdx>", "<TD a=1>", "<i>", "<b", "<!--", "-->", "<script>", "</script>", "<Template x>", "</template>", ">"]
    rng = np.random.default_rng(3)
    texts = ["", *names, "&".join(names), *("".join(rng.choice(pieces, int(rng.integers(1, 25)))) for _ in range(1500))]
    tags = [*re.split(r"\|", warc.BLOCK), "b", "h7", "heade", "optio", "di", "dx", "addres", "u", "col"]
    texts += [f"x<{t}>y</{t} a='1'>z<{t}/>" for t in tags]
    slow = F.col("html")
    for pattern, to in warc.STEPS:
        slow = F.regexp_replace(slow, pattern, to)
    for name, to in warc.ENTITIES:
        slow = F.replace(slow, F.lit(name), F.lit(to))
    for pattern, to in warc.TIDY:
        slow = F.regexp_replace(slow, pattern, to)
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "html string").select("html", slow.alias("slow"), warc.plain(F.col("html")).alias("fast")).collect()
    assert [r["html"] for r in rows if r["slow"] != r["fast"]] == []
    got = spark.createDataFrame([("&amp;lt; &lt;&copy;&x;&",)], "t string").select(warc.decoded(F.col("t"))).first()[0]
    assert got == "&lt; <©&x;&"
