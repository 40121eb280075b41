"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, repeated epoch
after epoch up to ``max_repeats`` times. The virtual finish time of a queued
document is its source's running word count, itself included, divided by the
source's target. All queues are sorted by it over the whole cluster, which
serves each source in proportion to its target, and the order is truncated at
the total budget. As targets add up to the budget, it is spent at virtual time
1; a document that is in service then is taken in part, so that each source
comes to its target to the word.

Equal rows are one entry of the queue with a count, so that no number of copies
makes a task larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaspark.llm import common as C

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SPACED = r"[^\x20\x09-\x0D]+"
#: Queue segments for each source: a window holds one of them, whatever the size of a source.
SEGMENTS = 1024
#: Sources that are broadcast at most; more are joined.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sizes``: source, source_size -> source, source_size, weight, target.

    Sources in code point order, null last, take the weights in turn. A target
    above ``max_repeats`` times its source is set to that, and the excess goes
    to the others by weight, until none is above. Sources are ordered by a
    range partitioning; each round of resharing takes two sums to the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    turns = F.array(*[F.lit(float(w)) for w in weights])
    ranked = C.with_running_totals(sizes, order, {}, "mix_sources").withColumn("weight", F.element_at(turns, (F.col("_index") % len(weights) + 1).cast("int"))).drop("_index")
    ranked = C.saved(ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))), "mix_weights")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # tokens for each unit of weight; it only grows, and each round fixes one source at least
        free = F.col("cap") >= F.col("weight") * F.lit(level)
        w, fixed = ranked.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, F.col("cap")))).first()
        now = (total - float(fixed or 0.0)) / w if w else level
        if not w or now <= level * (1 + 1e-12):
            break
        level = now
    return ranked.select("source", "source_size", "weight", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def _placed(docs: DataFrame, seed: int, *more) -> DataFrame:
    place = F.xxhash64(F.lit(seed), "doc_id", "text")
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place.alias("place"), F.pmod(F.shiftright(place, 20), F.lit(SEGMENTS)).cast("int").alias("segment"), *more)


def queue(rows: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``rows``: doc_id, source, size, place, segment -> an entry for each distinct row
    with words: these, rows (how many are equal), source_size, target, finish (words
    of the source up to its end), full (epochs in which all its rows are taken),
    extra (words that the cut leaves it of one more).

    The running count inside a source adds the totals of its segments to a window
    over one segment's entries, so no task holds a source.
    """
    key = ["source", "segment", "place", "doc_id", "size"]
    entries = C.saved(rows.where("size > 0").groupBy(*key).agg(F.count("*").alias("rows")).withColumn("words", F.col("rows") * F.col("size")), "mix_entries")
    by_segment = C.saved(entries.groupBy("source", "segment").agg(F.sum("words").alias("segment_size")), "mix_segments")
    targets = C.saved(source_targets(by_segment.groupBy("source").agg(F.sum("segment_size").alias("source_size")), weights, max_repeats), "mix_targets")
    before = Window.partitionBy("source").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # SEGMENTS rows at most
    starts = by_segment.withColumn("segment_start", F.coalesce(F.sum("segment_size").over(before), F.lit(0))).alias("g").join(targets.alias("t"), F.expr("g.source <=> t.source")).select("g.source", "g.segment", "segment_start", "source_size", "target")
    inside = Window.partitionBy("source", "segment").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = entries.withColumn("inside", F.sum("words").over(inside)).alias("d").join(starts.alias("s"), F.expr("d.source <=> s.source AND d.segment = s.segment"))
    placed = placed.select(*[f"d.{k}" for k in key], "rows", "words", "source_size", "target", (F.col("segment_start") + F.col("inside")).alias("finish"))
    due = [_due(e) for e in range(max_repeats)]
    full = sum((F.when(w == F.col("words"), 1).otherwise(0) for w in due), F.lit(0))
    extra = sum((F.when(w < F.col("words"), w).otherwise(0) for w in due), F.lit(0))
    return C.saved(placed.withColumn("full", full.cast("long")).withColumn("extra", extra.cast("long")), "mix_queue")


def _due(epoch) -> Column:
    """Words of an entry that an epoch takes before virtual time 1."""
    start = F.col("finish") - F.col("words") + epoch * F.col("source_size")
    return F.greatest(F.lit(0), F.least(F.col("words"), F.floor(F.col("target") + 1e-6) - start)).cast("long")


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``nth``, from 0 among the rows of one key, by a range partitioning:
    a key's rows can be in many partitions."""
    order = [*[F.col(k) for k in key], F.col("_mono")]
    at = C.with_running_totals(rows.withColumn("_mono", F.monotonically_increasing_id()), order, {}, "mix_numbered")
    at = C.saved(at.drop("_mono"), "mix_numbered")
    first = at.groupBy(*key).agg(F.min("_index").alias("_first"))
    same = " AND ".join(f"a.{k} <=> f.{k}" for k in key)
    return at.alias("a").join(F.broadcast(first).alias("f"), F.expr(same)).select(*[f"a.{C.quoted(c)}" for c in rows.columns], (F.col("_index") - F.col("_first")).alias("nth"))  # a key for each source


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, source, size,
    source_size, target, taken, copies, mix_start.

    ``taken`` counts the words that the mix takes, repeats included; the budget is the
    sum of all sizes, and a source's taken words are its target, rounded down.
    ``copies`` is how many times the document is taken as a whole, where at most one of a source, which the cut
    falls in, is rounded. ``mix_start`` is the number of words before its first
    copy in the order of the whole mix, null if it isn't in it. Null and empty texts
    have size 0 and are taken 0 times. A null source is a source of its own. Equal virtual times go by source,
    then shuffled order, then doc_id, so reruns agree; equal rows are interchangeable and
    begin at one place. An empty table gives no row. Other columns are ignored.
    """
    base = C.saved(_placed(docs, seed), "mix_sizes")
    entries = queue(base, weights, max_repeats)
    key = ["source", "segment", "place", "doc_id", "size"]
    copies = entries.select(*key, "words", "source_size", "target", "finish", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("epoch")).withColumn("due", _due(F.col("epoch"))).where("due > 0")
    time = F.least(F.lit(1.0), (F.col("finish") + F.col("epoch") * F.col("source_size")) / F.col("target"))
    served = copies.select(*key, "due", "epoch", time.alias("time"))
    order = [F.col("time"), F.col("source").isNull(), F.col("source"), F.col("epoch"), F.col("segment"), F.col("place"), F.col("doc_id"), F.col("size")]
    starts = C.with_running_totals(served, order, {"due": "ahead"}, "mix_order").groupBy(*key).agg(F.min("ahead").alias("mix_start"))
    same = lambda a, b: F.expr(" AND ".join(f"{a}.{k} <=> {b}.{k}" if k in ("source", "doc_id") else f"{a}.{k} = {b}.{k}" for k in key))
    placed = entries.alias("e").join(starts.alias("o"), same("e", "o"), "left").select("e.*", "mix_start")
    joined = C.saved(base.alias("b").join(placed.alias("p"), same("b", "p"), "left").select(*[f"b.{k}" for k in key], "rows", "source_size", "target", F.coalesce("full", F.lit(0)).alias("full"), F.coalesce("extra", F.lit(0)).alias("extra"), "mix_start"), "mix_rows")
    shared = (F.col("rows") > 1) & (F.col("extra") > 0)
    alone = joined.where(~F.coalesce(shared, F.lit(False))).withColumn("part", F.col("extra"))
    nth = _numbered(joined.where(shared), ["source"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("nth") * F.col("size")))
    every = alone.unionByName(nth.withColumn("part", part.cast("long")).drop("nth"))
    sizes = joined.groupBy("source").agg(F.max("source_size").alias("_s"), F.max("target").alias("_t"))  # for rows without words
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_SOURCES else sizes
    every = every.alias("r").join(sizes.alias("z"), F.expr("r.source <=> z.source"))
    taken = (F.col("full") * F.col("size") + F.col("part")).cast("long")
    whole = F.col("full") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    return every.select("doc_id", "r.source", "size", F.coalesce("_s", F.lit(0)).cast("long").alias("source_size"), F.coalesce("_t", F.lit(0.0)).alias("target"), taken.alias("taken"), whole.cast("long").alias("copies"), "mix_start")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """The documents of the mix: each row of ``docs``, all its columns, as many times as
    ``mix_sources`` has copies of it. Documents are never cut; rows without words, null
    texts among them, are kept once. Equal rows share their copies as evenly as can be. An empty table stays empty.

    No text is shuffled: for each source, the place in its queue at which the mix ends
    tells how often a row is taken. That place is joined by source.
    """
    entries = queue(_placed(docs, seed), weights, max_repeats)
    low = entries.groupBy("source").agg(F.min("full").alias("low"))
    last = entries.alias("e").join(low.alias("l"), F.expr("e.source <=> l.source")).where("full = low")
    cuts = C.saved(last.groupBy("e.source").agg(F.min(F.struct("segment", "place", "doc_id", "size", "extra", "rows")).alias("cut"), F.first("low").alias("low")), "mix_cuts")
    few = cuts.count() <= BROADCAST_SOURCES
    placed = _placed(docs, seed, F.struct(*[F.col(C.quoted(c)) for c in docs.columns]).alias("doc"))
    joined = placed.alias("d").join((F.broadcast(cuts) if few else cuts).alias("c"), F.expr("d.source <=> c.source"), "left")
    at = F.struct("segment", "place", "doc_id", "size")
    cut = F.struct(*[F.col(f"cut.{k}").alias(k) for k in ("segment", "place", "doc_id", "size")])
    more = F.when(at == cut, F.floor(F.col("cut.extra") / F.col("size") + 0.5)).otherwise(0)  # of its equal rows, so many are taken once more
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("low") + F.when(at < cut, 1).otherwise(0))
    rows = joined.select("doc", "d.source", copies.cast("long").alias("copies"), F.when(F.col("size") > 0, more).otherwise(0).cast("long").alias("more"), F.coalesce("cut.rows", F.lit(0)).alias("rows"))
    shared = (F.col("more") > 0) & (F.col("more") < F.col("rows"))
    alone = rows.where(~shared).select("doc", (F.col("copies") + F.when(F.col("more") > 0, 1).otherwise(0)).alias("copies"))
    out = alone
    if not cuts.where("cut.rows > 1 AND cut.extra > 0").isEmpty():
        nth = _numbered(rows.where(shared), ["source"])
        out = alone.unionByName(nth.select("doc", (F.col("copies") + F.when(F.col("nth") < F.col("more"), 1).otherwise(0)).alias("copies")))
    return out.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix_sources`` of all ``documents``."""
    return mix_sources(C.table(spark, sf_dir, "documents")).drop("copies", "source")
