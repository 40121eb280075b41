"""Sharding by balanced label propagation.

Documents are nodes. They are linked over hubs: a hub stands for a word shingle
that documents sample alike (the smallest by each of a few hash functions, so
near copies share most of theirs); so a group of any number of near copies has
a few edges for each of them. Given links join nodes directly. Equal texts are
contracted to one node, or, where there are too many of them or too large ones,
to parcels that are packed into as few shards as hold them.

Spark joins then alternate: a hub takes the shard where most of its documents
are, and documents move to the shard of most of their hubs and neighbours, the
largest gains first, as far as the shards' quotas allow. Nodes without links fill what is
left, by size or by hash.

Law: ``bytes``. Sizes of shards are equal to within a thousandth of a shard,
or one document where that is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaspark.llm import common as C
from lexaspark.llm import shingles

SHARDS, ROUNDS = 8, 6
#: A parcel and a large unlinked document are at least this part of a shard, so there are at most SHARDS times as many.
PARCELS, LARGE = 16, 1000
#: Movers to a shard are admitted by gain, then by one of so many hash steps.
STEPS = 64
#: Shards may be over their share by these parts of it: while labels move, and in the end.
ROOM, SLACK = 0.1, 0.0005
#: Shingles that a document samples, and their words.
SAMPLED, WORDS = 4, 5


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, 0 for null, plus 1), text_crc32, the
    group's key (texts are equal if hash, CRC and size are; null is the empty text)
    and a number of the row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.monotonically_increasing_id().alias("row"))


KEY = ["text_hash", "text_crc32", "size"]


def contracted(base: DataFrame, total: int, n_rows: int, shards: int = SHARDS) -> DataFrame:
    """``base`` with parcels, part and node: rows of one text have one node, unless they hold more than a
    parcel of all bytes or of all rows, which is cut by the rows' numbers. One document is never cut."""
    bytes_each, rows_each = max(1.0, total / shards / PARCELS), max(1.0, n_rows / shards / PARCELS)
    held = F.greatest(F.col("rows") * F.col("size") / F.lit(bytes_each), F.col("rows") / F.lit(rows_each))
    # At most 2 * shards * PARCELS groups, as neither their bytes nor their rows add up to more than all.
    split = base.groupBy(*KEY).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) & (held > 1)).select(*KEY, F.least(F.ceil(held), F.col("rows")).cast("int").alias("parcels"))
    part = F.coalesce(F.pmod(F.xxhash64(F.lit(3), "row"), F.col("parcels")).cast("int"), F.lit(0))
    return base.join(F.broadcast(split), KEY, "left").withColumn("part", part).withColumn("parcels", F.coalesce("parcels", F.lit(1))).withColumn("node", F.xxhash64(*KEY, "part"))


def sampled_hubs(docs: DataFrame) -> DataFrame:
    """node, hub: the shingles that each text samples; a split group is stood for by its first parcel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch["text"].to_pylist(), batch["node"]
            for a, b in shingles.chunks(texts):
                grams, to = shingles.gram_hashes(*shingles.word_hashes(texts[a:b]), WORDS)
                some = np.flatnonzero(np.diff(to))
                for j in range(SAMPLED if len(some) else 0):
                    least = np.minimum.reduceat(shingles.mixed(grams * shingles.GRAM_KEYS[WORDS + j]), to[some])
                    yield pa.RecordBatch.from_arrays([keys.slice(a, b - a).take(pa.array(some)), pa.array(shingles.mixed(least + np.uint64(j)).view(np.int64))], ["node", "hub"])

    text = F.coalesce("text", F.lit(""))
    first = F.xxhash64(F.xxhash64(text), F.crc32(text.cast("binary")), (F.octet_length(text) + 1).cast("long"), F.lit(0))
    return docs.select(first.alias("node"), "text").mapInArrow(run, "node long, hub long").distinct()


def _hub_shards(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """hub, shard where most of its nodes are; of equal ones, by a hash."""
    votes = edges.join(nodes.select("node", "shard"), "node").groupBy("hub", "shard").agg(F.sum("weight").alias("votes"))
    return votes.groupBy("hub").agg(F.max_by("shard", F.struct("votes", F.xxhash64("hub", "shard"))).alias("shard"))


def propagate(nodes: DataFrame, edges: DataFrame, capacity: float, shards: int = SHARDS, rounds: int = ROUNDS, pairs: DataFrame | None = None) -> DataFrame:
    """``nodes``: node, size, shard, fixed; ``edges``: node, hub, weight; ``pairs``: a, b, each way once.
    Returns the nodes with the shards after the rounds; fixed ones vote and stay.

    A round: hubs take their nodes' majority; a node wants the shard with most votes
    of its hubs and neighbours if it has more there than at home. For each shard the wishes are
    summed by gain and hash step, and the largest gains that fit its quota are
    admitted. The driver gets shards x shards x gains x steps sums. As hubs and nodes take turns,
    they don't swap places for ever; where nodes are neighbours, half of them may move in a round. Empty tables give no row.
    """
    spark = nodes.sparkSession
    loads = {r["shard"]: r["n"] for r in nodes.groupBy("shard").agg(F.sum("size").alias("n")).collect()}  # a row for each shard
    for turn in range(rounds):
        votes = edges.join(_hub_shards(edges, nodes), "hub").select("node", "shard", "weight")
        if pairs is not None:
            votes = votes.unionByName(pairs.join(nodes.select(F.col("node").alias("b"), "shard"), "b").select(F.col("a").alias("node"), "shard", F.lit(1).cast("long").alias("weight")))
        votes = votes.groupBy("node", "shard").agg(F.sum("weight").alias("votes"))
        best = votes.groupBy("node").agg(F.max_by(F.struct("shard", "votes"), F.struct("votes", F.xxhash64("node", "shard"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("shard", "votes"))).alias("by"))  # shards entries at most
        free = nodes.where("NOT fixed" if pairs is None else (~F.col("fixed") & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)))
        wish = free.join(best, "node").withColumn("to", F.col("best.shard")).withColumn("gain", F.col("best.votes") - F.coalesce(F.element_at("by", F.col("shard")), F.lit(0)))
        moving = C.saved(wish.where((F.col("gain") > 0) & (F.col("to") != F.col("shard"))).select("node", "size", "shard", "to", F.least(F.floor(F.log2("gain")), F.lit(20)).cast("int").alias("class"), F.pmod(F.xxhash64("node"), F.lit(STEPS)).cast("int").alias("step")), "shard_wishes")
        sums = moving.groupBy("shard", "to", "class", "step").agg(F.sum("size").alias("n")).collect()  # bounded by shards, classes and steps
        admitted, waiting, some = set(), sorted(sums, key=lambda r: (-r["class"], r["step"], r["to"], r["shard"])), True
        while some:  # what leaves a shard makes room for others to come: shards exchange nodes
            some, rest = False, []
            for r in waiting:
                if loads.get(r["to"], 0) + r["n"] <= capacity * (1 + ROOM):
                    loads[r["to"]] = loads.get(r["to"], 0) + r["n"]
                    loads[r["shard"]] -= r["n"]
                    admitted.add((r["shard"], r["to"], r["class"], r["step"]))
                    some = True
                else:
                    rest.append(r)
            waiting = rest
        if not admitted:
            break
        allowed = F.broadcast(spark.createDataFrame(sorted(admitted), "shard int, to int, class int, step int"))  # bounded likewise
        moved = moving.join(allowed, ["shard", "to", "class", "step"]).select("node", "to")
        nodes = C.saved(nodes.join(moved, "node", "left").select("node", "size", F.coalesce("to", "shard").alias("shard"), "fixed"), "shard_labels")
    return nodes


def cut_edges(edges: DataFrame, nodes: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """node, links (its hubs and neighbours), cut (those whose shard is another than its own)."""
    ends = edges.join(_hub_shards(edges, nodes), "hub").select("node", F.col("shard").alias("_hub"))
    if pairs is not None:
        ends = ends.unionByName(pairs.join(nodes.select(F.col("node").alias("b"), F.col("shard").alias("_hub")), "b").select(F.col("a").alias("node"), "_hub"))
    at = ends.join(nodes.select("node", "shard"), "node")
    return at.groupBy("node").agg(F.count("*").alias("links"), F.count(F.when(F.col("_hub") != F.col("shard"), 1)).alias("cut"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, links: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law,
    shard, slot, grown_shard (null: the law is ``bytes``), links (the hubs that its text shares with
    others, and its neighbours), cut (those of them in another shard, a hub by most of its documents) and cut_by_hash
    (how many that would be if documents were dealt by a hash).

    ``links`` (a, b: doc ids) are further edges; a link with an unknown or null
    id counts for nothing, and one of an id with several rows is one of all their texts. ``slot`` counts from 0 in each shard, by doc_id, then
    hash; equal rows are interchangeable. Null texts have size 1 and are the
    empty text; wordless texts have no hub. Repeated rows are documents of their own, in one group. Other
    columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    base = C.saved(document_sizes(docs), "shard_sizes")
    total, n_rows = (int(x or 0) for x in base.agg(F.sum("size"), F.count("*")).first())
    capacity = total / shards
    base = C.saved(contracted(base, total, n_rows, shards), "shard_nodes")
    nodes = C.saved(base.groupBy("node").agg(F.sum("size").alias("size"), F.min(F.struct(*KEY)).alias("group"), F.min("part").alias("part"), F.min("parcels").alias("parcels")), "shard_parcels")

    # A few parcels for each shard; those of one group begin in as few shards as hold them, and stay.
    begun = spark.createDataFrame(_packed(nodes.where("parcels > 1").select("node", "size", "group", "part").collect(), capacity, shards), "node long, begin int")
    hubs = C.saved(sampled_hubs(docs), "shard_hubs")
    shared = hubs.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").select("hub")
    edges = C.saved(hubs.join(shared, "hub", "left_semi").withColumn("weight", F.lit(1).cast("long")), "shard_edges")
    pairs, ends = None, edges.select("node")
    if links is not None:
        at = base.select("doc_id", "node").distinct()
        given = links.select("a", "b").join(at.select(F.col("doc_id").alias("a"), F.col("node").alias("na")), "a").join(at.select(F.col("doc_id").alias("b"), F.col("node").alias("nb")), "b").where("na != nb")
        pairs = C.saved(given.select(F.explode(F.array(F.struct(F.col("na").alias("a"), F.col("nb").alias("b")), F.struct(F.col("nb").alias("a"), F.col("na").alias("b")))).alias("p")).select("p.*").distinct(), "shard_pairs")
        ends = ends.unionByName(pairs.select(F.col("a").alias("node")))
    linked = nodes.join(ends.distinct(), "node", "left_semi").select("node", "size").join(F.broadcast(begun), "node", "full")
    sized = linked.join(nodes.select("node", F.col("size").alias("_size")), "node")
    linked = C.saved(sized.select("node", F.col("_size").alias("size"), F.coalesce("begin", F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(shards)).cast("int")).alias("shard"), F.col("begin").isNotNull().alias("fixed")), "shard_labels")
    by_hash = cut_edges(edges, linked, pairs)
    linked = propagate(linked, edges, capacity, shards, ROUNDS if pairs is None else 2 * ROUNDS, pairs)
    loads = [0] * shards
    for r in linked.groupBy("shard").agg(F.sum("size").alias("n")).collect():  # a row for each shard
        loads[r["shard"]] = r["n"]
    over = {s for s in range(shards) if loads[s] > capacity * (1 + SLACK)}
    if over:  # such shards give back by hash step what is too much
        free = linked.where("NOT fixed")
        steps = free.where(F.col("shard").isin(sorted(over))).groupBy("shard", F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(1024)).cast("int").alias("step")).agg(F.sum("size").alias("n")).collect()
        bound = {}
        for r in sorted(steps, key=lambda r: (r["shard"], r["step"])):
            if loads[r["shard"]] > capacity * (1 + SLACK):
                loads[r["shard"]] -= r["n"]
                bound[r["shard"]] = r["step"]
        out = F.lit(False)
        for s, step in bound.items():
            out = out | ((F.col("shard") == s) & (F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(1024)) <= step))
        linked = C.saved(linked.where(F.col("fixed") | ~out), "shard_labels")

    # The rest: large nodes by size to the emptiest shard, at most shards * LARGE of them; small ones in hash order up to each shard's room.
    rest = C.saved(nodes.join(linked.select("node"), "node", "left_anti").select("node", "size"), "shard_rest")
    large, placed = rest.where(F.col("size") * LARGE > capacity).collect(), []
    for r in sorted(large, key=lambda r: (-r["size"], r["node"])):
        s = min(range(shards), key=lambda s: (loads[s], s))
        loads[s] += r["size"]
        placed.append((r["node"], s))
    small = C.with_running_totals(rest.where(F.col("size") * LARGE <= capacity), [F.xxhash64(F.lit(11), "node"), F.col("node")], {"size": "ahead"}, "shard_small")
    remaining = total - sum(loads)
    level = _water_level(loads, remaining)
    ends, at = [], 0.0
    for s in range(shards):
        at += max(0.0, level - loads[s])
        ends.append(at)
    slot_of = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        slot_of = F.when(F.col("ahead") + F.col("size") / 2 < ends[s], s).otherwise(slot_of)
    where = C.saved(linked.select("node", "shard").unionByName(spark.createDataFrame(placed, "node long, shard int")).unionByName(small.select("node", slot_of.cast("int").alias("shard"))), "shard_places")
    counted = cut_edges(edges, where, pairs).join(by_hash.select("node", F.col("cut").alias("cut_by_hash")), "node")
    where = where.join(counted, "node", "left").select("node", "shard", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("links", "cut", "cut_by_hash")])

    # A group can hold a third of all rows, but a node holds a parcel of them at most.
    more = ["links", "cut", "cut_by_hash"]
    out = base.select("doc_id", "size", "text_crc32", "text_hash", "row", "node").join(where, "node").select("doc_id", "size", "text_crc32", "text_hash", "row", "shard", *more)
    numbered = C.saved(C.with_running_totals(out, [F.col("shard"), F.col("doc_id"), F.col("text_hash"), F.col("row")], {}, "shard_order"), "shard_slots")
    first = F.broadcast(numbered.groupBy("shard").agg(F.min("_index").alias("_first")))  # a row for each shard
    return numbered.join(first, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_index") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *more)


def _packed(parcels: list, capacity: float, shards: int) -> list[tuple[int, int]]:
    """(node, shard) of the parcels: the largest groups first, each to the fullest shard
    that takes it whole; only what fits in none is cut, over as few as do."""
    groups: dict = {}
    for r in sorted(parcels, key=lambda r: r["part"]):
        groups.setdefault(tuple(r["group"]), []).append(r)
    loads, out = [0] * shards, []
    for key, parts in sorted(groups.items(), key=lambda g: (-sum(r["size"] for r in g[1]), g[0])):
        left = list(parts)
        while left:
            whole = sum(r["size"] for r in left)
            fits = [s for s in range(shards) if loads[s] + whole <= capacity]
            s = max(fits, key=lambda s: (loads[s], -s)) if fits else min(range(shards), key=lambda s: (loads[s], s))
            piece = [left.pop(0)]
            loads[s] += piece[0]["size"]
            while left and loads[s] + left[0]["size"] <= capacity:
                loads[s] += left[0]["size"]
                piece.append(left.pop(0))
            out += [(r["node"], s) for r in piece]
    return out


def _water_level(loads: list[int], more: float) -> float:
    """The common height after ``more`` is poured onto the loads."""
    low = sorted(loads)
    for n in range(1, len(low) + 1):
        level = (sum(low[:n]) + more) / n
        if n == len(low) or level <= low[n]:
            return level
    return 0.0


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shard_documents`` of all ``documents``."""
    return shard_documents(C.table(spark, sf_dir, "documents"))
