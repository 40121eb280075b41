"""N-gram Jaccard self-join by the chosen-path method.

Documents are sets of hashed five-word shingles; equal sets are contracted to a
class first. A class's set is stood for by a MinHash signature whose agreeing
coordinates are sampled shared tokens. From a run's root, every node picks a coordinate at random and splits
its members by the values there. Small nodes are compared by brute force, larger
ones are split again, and those that are still large at the last level are
compared in tiles. Independent runs raise the recall to its target. Classes that
may be similar by their signatures form neighbourhoods (a node gives each member
one link, never all pairs), and every neighbourhood is joined exactly, in tiles,
on the whole sets: so within it no link is lost, and a group of a thousand near
copies costs a row for each copy and tile, not for each pair. A large neighbourhood
is cut by the sets' sizes first: a set meets tiles of its own size band and the
two beside it alone, as sets farther apart can't be similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexaspark.llm import common as C
from lexaspark.llm import shingles

WORDS, SIMILARITY, COORDINATES = 5, 0.8, 64
TARGET_RECALL, LEVELS = 0.999, 4
#: Members of a node that is compared at once, and of one side of a tile of a larger one.
SMALL, TILE = 32, 512
#: Signatures of a similar pair agree on all but so many standard deviations of the similarity.
DEVIATIONS = 4.0
#: Ids that are broadcast at most to fetch candidates' texts; more are joined.
BROADCAST_IDS = 1_000_000


def runs_for(recall: float = TARGET_RECALL, similarity: float = SIMILARITY, levels: int = LEVELS) -> int:
    """Independent runs for the recall of a pair that has to pass all levels,
    each with the probability of its similarity."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**levels)))


def _set_ids(grams: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; 0 for empty ones."""
    out = np.zeros(len(to) - 1, np.uint64)
    some = np.flatnonzero(np.diff(to))
    if len(some):
        a = np.add.reduceat(shingles.mixed(grams), to[some])
        b = np.bitwise_xor.reduceat(shingles.mixed(grams + np.uint64(0x1234567)), to[some])
        out[some] = np.maximum(shingles.mixed(a ^ shingles.mixed(b + np.diff(to)[some].astype(np.uint64))), 1)
    return out


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, sid (the set's id, 0 without words), n (its size), sig."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in shingles.chunks(texts):
                grams, to = shingles.gram_sets(texts[a:b], WORDS)
                sig = shingles.signatures(grams, to, COORDINATES)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(_set_ids(grams, to).view(np.int64)), pa.array(np.diff(to).astype(np.int32)), pa.array([s.tobytes() for s in sig], pa.binary())], ["doc_id", "sid", "n", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sid long, n int, sig binary")


def _chosen(paths: np.ndarray) -> np.ndarray:
    """The coordinate that each node picks."""
    return (shingles.mixed(paths + np.uint64(0x5851F42D4C957F2D)) % np.uint64(COORDINATES)).astype(np.int64)


def _split(members: DataFrame, runs: int | None) -> DataFrame:
    """members: [path,] sid, sig -> path, sid one level down (from the roots of all runs if ``runs``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid = batch["sid"].to_numpy()
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint32).reshape(len(sid), COORDINATES).astype(np.uint64)
            roots = [np.full(len(sid), r + 1, np.uint64) for r in range(runs)] if runs else [batch["path"].to_numpy().view(np.uint64)]
            for path in roots:
                down = shingles.mixed(shingles.mixed(path) + sig[np.arange(len(sid)), _chosen(path)])
                yield pa.RecordBatch.from_arrays([pa.array(down.view(np.int64)), pa.array(sid)], ["path", "sid"])

    return members.mapInArrow(run, "path long, sid long")


def _grouped(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[list]:
    """The columns (as numpy arrays, or lists of bytes) of each run of equal keys."""
    held: list[pa.RecordBatch] = []

    def arrays(parts: list[pa.RecordBatch]) -> list:
        whole = pa.Table.from_batches(parts).combine_chunks()
        return [[x.as_buffer() for x in whole[c]] if pa.types.is_binary(whole[c].type) else whole[c].to_numpy() for c in columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy()
        if held and held[-1][key][0].as_py() != keys[0]:
            yield arrays(held)
            held = []
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield arrays([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cuts[-1]))
    if held:
        yield arrays(held)


def _labels(near: np.ndarray) -> np.ndarray:
    """For each member the first one it is connected with; ``near`` is symmetric."""
    near = near | np.eye(len(near), dtype=bool)
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(label)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _both_ways(side: np.ndarray, near: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Members x members from the pairs of a tile's two sides."""
    out = np.zeros((len(side), len(side)), bool)
    out[np.ix_(a, b)] = near
    return out | out.T


def _neighbours(nodes: DataFrame) -> DataFrame:
    """nodes: tile, side (0, 1; 2: compared with its own), sid, n, sig8, sorted by
    tile -> a, b: links that connect the members of a tile that may be similar."""
    least = SIMILARITY - DEVIATIONS * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)
    agree = COORDINATES * (least + (1 - least) / 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for side, sid, n, raw in _grouped(batches, "tile", ["side", "sid", "n", "sig8"]):
            if len(sid) < 2:
                continue
            sig = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, COORDINATES)
            a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if len(sid) <= SMALL:
                same = (sig[a][:, None, :] == sig[b][None, :, :]).sum(axis=2)
            else:
                same = np.zeros((len(a), len(b)), np.int16)
                for j in range(COORDINATES):
                    same += sig[a, j][:, None] == sig[b, j][None, :]
            near = (same >= agree) & (np.minimum(n[a][:, None], n[b][None, :]) >= SIMILARITY * np.maximum(n[a][:, None], n[b][None, :]))
            if near.sum() <= (len(a) if side[0] == 2 else 0):
                continue
            label = _labels(_both_ways(side, near, a, b))
            moved = np.flatnonzero(label != np.arange(len(label)))
            out.append((sid[moved], sid[label[moved]]))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b"])

    return nodes.mapInArrow(run, "a long, b long")


def _tiled(members: DataFrame, group: str, small: int) -> DataFrame:
    """members: group, sid, members -> tile, side, sid. A group above ``small`` is cut
    into chunks of about TILE; each member goes to the tiles that pair its chunk
    with every chunk."""
    m = F.when(F.col("members") <= small, 1).otherwise(F.ceil(F.col("members") / TILE)).cast("int")
    out = members.withColumn("m", m).withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    side = F.when(F.col("chunk") == F.col("other"), 2).when(F.col("chunk") < F.col("other"), 0).otherwise(1).cast("int")
    return out.select(F.xxhash64(group, F.least("chunk", "other"), F.greatest("chunk", "other")).alias("tile"), side.alias("side"), "sid")


def _banded(members: DataFrame, small: int, similarity: float) -> DataFrame:
    """members: root, sid, n, members -> tile, side, sid, as ``_tiled``. A neighbourhood above ``small``
    is cut into bands whose sizes grow by 1 / similarity, and bands into chunks of about
    TILE; a member goes to the tiles that pair its chunk with those of bands beside its own."""
    band = F.when(F.col("members") <= small, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity) + 1e-9)).cast("int")
    placed = members.withColumn("band", band)
    sizes = placed.groupBy("root", "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("m"))
    sizes = sizes.join(members.groupBy("root").agg(F.first("members").alias("members")), "root").select("root", "band", F.when(F.col("members") <= small, 1).otherwise(F.col("m")).alias("m"))
    sizes = C.saved(sizes, "size_bands")
    beside = sizes.select("root", "band", "m", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("other")).join(sizes.select("root", F.col("band").alias("other"), F.col("m").alias("chunks")), ["root", "other"])
    out = placed.select("root", "sid", "band").join(beside, ["root", "band"]).withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("m")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    own, with_ = F.struct(F.col("band"), F.col("chunk")), F.struct(F.col("other").alias("band"), F.col("with").alias("chunk"))
    side = F.when(own == with_, 2).when(own < with_, 0).otherwise(1).cast("int")
    return out.select(F.xxhash64("root", F.least(own, with_), F.greatest(own, with_)).alias("tile"), side.alias("side"), "sid")


def candidates(classes: DataFrame) -> DataFrame:
    """classes: sid, n, sig, sig8 -> a, b: distinct links that connect the classes
    which chosen paths bring together and whose signatures may be similar."""
    level = C.saved(_split(classes.select("sid", "sig"), runs_for()), "paths")
    leaves = None
    for depth in range(1, LEVELS + 1):
        sizes = level.groupBy("path").agg(F.count("*").alias("members")).where("members > 1")
        sized = C.saved(level.join(sizes, "path"), "path_members")
        now = sized if depth == LEVELS else sized.where(F.col("members") <= SMALL)
        leaves = now if leaves is None else leaves.unionByName(now)
        if depth == LEVELS:
            break
        large = sized.where(F.col("members") > SMALL).select("path", "sid")
        if large.isEmpty():
            break
        level = C.saved(_split(large.join(classes.select("sid", "sig"), "sid"), None).distinct(), "paths")

    tiles = _tiled(leaves, "path", SMALL).join(classes.select("sid", "n", "sig8"), "sid").select("tile", "side", "sid", "n", "sig8")
    return _neighbours(tiles.repartition("tile").sortWithinPartitions("tile")).distinct()


def _grams_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in shingles.chunks(texts):
                grams, to = shingles.gram_sets(texts[a:b], WORDS)
                yield pa.RecordBatch.from_arrays([pa.array(_set_ids(grams, to).view(np.int64)), pa.array([grams[x:y].tobytes() for x, y in zip(to, to[1:])], pa.binary())], ["sid", "grams"])

    return docs.select("text").mapInArrow(run, "sid long, grams binary")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sorted sets."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for some in (left, right):
        all_grams = np.concatenate(some)
        owner = np.repeat(np.arange(len(some)), [len(x) for x in some])
        at = np.minimum(np.searchsorted(common, all_grams), max(0, len(common) - 1))
        hit = common[at] == all_grams if len(common) else np.zeros(len(all_grams), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((owner[hit][order], at[hit][order]))
    for lo in range(0, len(common), 4096):  # dense columns of so many shingles at once
        width = min(4096, len(common) - lo)
        dense = []
        for some, (owner, at) in zip((left, right), places):
            x, y = np.searchsorted(at, [lo, lo + width])
            part = np.zeros((len(some), width), np.float32)
            part[owner[x:y], at[x:y] - lo] = 1
            dense.append(part)
        out += dense[0] @ dense[1].T
    return out


def _joined(tiles: DataFrame, similarity: float) -> DataFrame:
    """tiles: tile, side, sid, grams, sorted by tile -> sid, root (the first member
    of the tile that links connect it with), n_links (those in the tile)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for side, sid, raw in _grouped(batches, "tile", ["side", "sid", "grams"]):
            if len(sid) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in raw]
            a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if not len(a) or not len(b):
                continue
            both = _shared([sets[i] for i in a], [sets[i] for i in b])
            size = np.array([len(x) for x in sets], np.float64)
            near = both >= similarity * (size[a][:, None] + size[b][None, :] - both) - 1e-9
            whole = _both_ways(side, near, a, b)
            np.fill_diagonal(whole, False)
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(sid[_labels(whole)]), pa.array(whole.sum(axis=1).astype(np.int64))], ["sid", "root", "n_links"])

    return tiles.mapInArrow(run, "sid long, root long, n_links long")


def components(links: DataFrame) -> DataFrame:
    """links: a, b -> node, root (the smallest node it is connected with), by
    alternating large and small stars until nothing changes. A node's links are
    sent to its smallest neighbour, which Spark finds by partial aggregates."""
    edges = C.saved(links.select("a", "b").where("a != b").distinct(), "stars")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = C.saved(large, "stars")  # every link now goes from a larger node to a smaller one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        edges = C.saved(small, "stars")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def jaccard_links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, sid, n; linked sets: sid, root, n_links)."""
    base = C.saved(shingled(docs), "shingled")
    sig8 = F.expr(f"unhex(array_join(transform(sequence(0, {COORDINATES - 1}), i -> substr(hex(sig), 8 * i + 1, 2)), ''))")
    classes = C.saved(base.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id")).withColumn("sig8", sig8), "classes")
    around = C.saved(components(C.saved(candidates(classes), "candidate_links")), "neighbourhoods")
    members = C.saved(around.select(F.col("node").alias("sid"), "root").unionByName(around.select(F.col("root").alias("sid"), "root").distinct()), "neighbours")
    at = C.saved(classes.select("sid", "doc_id").join(members.select("sid"), "sid", "left_semi"), "candidate_ids")
    ids = at.select("doc_id").distinct().withColumnRenamed("doc_id", "_id")
    ids = F.broadcast(ids) if at.count() <= BROADCAST_IDS else ids
    texts = docs.select("doc_id", "text").join(ids, F.expr("doc_id <=> _id"), "left_semi")
    sets = C.saved(_grams_of(texts).join(at.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.first("grams").alias("grams")), "candidate_sets")
    sized = members.join(members.groupBy("root").agg(F.count("*").alias("members")), "root").join(classes.select("sid", "n"), "sid")
    tiles = _banded(sized, TILE, similarity).join(sets, "sid").select("tile", "side", "sid", "grams")
    found = C.saved(_joined(tiles.repartition("tile").sortWithinPartitions("tile"), similarity).where("n_links > 0"), "tile_links")
    roots = components(found.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("sid").agg(F.sum("n_links").alias("n_links")).join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    return base.select("doc_id", "sid", "n"), C.saved(links, "links")


def _set_classes(base: DataFrame, links: DataFrame) -> DataFrame:
    """sid, class_id, n_links, rows, stands (whether the set stands for its class)
    of every set with links or copies."""
    of_set = C.saved(base.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")).join(links, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "set_roots")
    order = F.struct(F.col("first_id").isNull(), "first_id", "sid")
    of_root = of_set.groupBy("root").agg(F.min("first_id").alias("class_id"), F.min_by("sid", order).alias("first_sid"))
    table = of_set.join(of_root, "root").select("sid", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "rows", (F.col("sid") == F.col("first_sid")).alias("stands"))
    return C.saved(table.where("rows > 1 OR n_links > 0"), "set_classes")


def jaccard_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, n_links,
    n_copies, set_id.

    Documents whose shingle sets have a Jaccard similarity of at least
    ``similarity`` are linked; ``class_id`` is the smallest doc_id of those that
    links connect. ``n_links`` counts the different sets that the document's own
    is linked to, ``n_copies`` the other documents with an equal set, which need
    no link between them. A text of one to four words is one shingle; a null,
    empty or wordless text is a class of its own without links or copies. Rows
    without an id take part; a class of such rows alone has no id. Repeated rows
    are copies. An empty table gives no row. Other columns are ignored.
    """
    base, links = jaccard_links(docs, similarity)
    out = base.join(_set_classes(base, links), "sid", "left")
    return out.select("doc_id", F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("rows") - 1, F.lit(0)).cast("long").alias("n_copies"), F.when(F.col("n") > 0, F.col("sid")).alias("set_id"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their class:
    the one with the class's id, once. Null, empty and wordless rows stay; of repeated rows one
    stays, and of a class without ids one; an empty table stays empty."""
    base, links = jaccard_links(docs, similarity)
    table = _set_classes(base, links).select(F.col("sid").alias("_set"), "class_id", "stands")
    small = table.count() <= BROADCAST_IDS
    twice = C.saved(base.where("n > 0").groupBy("doc_id", "sid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("sid").alias("_twice")), "repeated")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            ids = [_set_ids(*shingles.gram_sets(texts[a:b], WORDS)) for a, b in shingles.chunks(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(ids or [np.zeros(0, np.uint64)]).view(np.int64))], [*batch.schema.names, "_sid"])

    rows = docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField("_sid", T.LongType())]))
    kept = rows.select(F.struct(*[F.col(C.quoted(c)) for c in docs.columns]).alias("_doc"), "_sid").join(F.broadcast(table) if small else table, F.col("_sid") == F.col("_set"), "left")
    kept = kept.where(F.col("_set").isNull() | (F.col("stands") & F.col("_doc.doc_id").eqNullSafe(F.col("class_id")))).select("_doc", "_sid")
    if not twice.isEmpty():
        same = F.expr("_doc.doc_id <=> _id AND _sid = _twice")
        again = kept.join(twice, same, "left_semi").groupBy(F.col("_doc.doc_id").alias("_id"), "_sid").agg(F.first("_doc").alias("_doc"))
        kept = kept.join(twice, same, "left_anti").unionByName(again.select("_doc", "_sid"))
    return kept.select("_doc.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``jaccard_classes`` of all ``documents``."""
    return jaccard_classes(C.table(spark, sf_dir, "documents")).drop("set_id")
