"""Nearest neighbours by a block matrix join over int8 codes.

Vectors are packed into blocks of one dimension. Every vector is coded to int8
with its own scale, and the length of what the code leaves out is kept. Codes
alone go through the grid: the product of two blocks of them gives all distances
between the coded vectors, and by the triangle inequality each true distance to
within the two residual lengths. A grid cell passes on the pairs whose lower
bound is not above its k-th smallest upper bound of the query, and forgets them
before the next cell. Pairs that the bounds of all cells leave are computed from
the original vectors in double precision and merged by a heap for each query, so
the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaspark.llm import common as C

#: Vectors in a block of candidates and of queries.
BLOCK_ROWS, QUERY_ROWS = 1024, 1024
#: Dimensions whose int8 products a float32 sum holds exactly (127 * 127 * 1024 < 2**24).
EXACT = 1024

BLOCK_SCHEMA = "dim int, n int, rows binary, ids binary, codes binary, scale binary, residual binary"
PARTS = ("rows", "ids", "codes", "scale", "residual")


def numbered(vectors: DataFrame) -> DataFrame:
    """row, vec_id, embedding of the distinct vectors that take part. Equal rows are one."""
    fine = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = vectors.select("vec_id", "embedding").where(fine).where(F.exists("embedding", lambda x: F.abs(x.cast("double")) / 127 > 0)).distinct()
    return C.saved(some.withColumn("row", F.monotonically_increasing_id()), "vectors")


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of the codes of at most ``size`` vectors (row, vec_id, embedding) of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int, some: list) -> pa.RecordBatch:
            x = np.stack([v for _, _, v in some])
            codes, scale, residual = coded(x)
            parts = [np.array([r for r, _, _ in some], np.int64), np.array([i for _, i, _ in some], np.int64), codes, scale, residual]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(some)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["dim", "n", *PARTS])

        for batch in batches:
            for r, i, v in zip(batch["row"].to_pylist(), batch["vec_id"].to_pylist(), batch["embedding"]):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                some = held.setdefault(len(x), [])
                some.append((r, i, x))
                if len(some) == size:
                    yield block(len(x), held.pop(len(x)))
        for dim, some in held.items():
            yield block(dim, some)

    return vectors.select("row", "vec_id", "embedding").mapInArrow(run, BLOCK_SCHEMA)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, each vector's scale, and at least the length of what its code leaves out."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    left = x - codes * scale[:, None]
    return codes, scale, np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, dimension after dimension."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        diff = a[:, d] - b[:, d]
        total += diff * diff
    return np.sqrt(total)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT):
        out += a[:, d : d + EXACT].astype(np.float32) @ b[:, d : d + EXACT].astype(np.float32).T
    return out


def bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of two blocks' vectors (rows, ids, codes,
    scale, residual); infinite for one id."""
    (_, q_ids, q_codes, q_scale, q_res), (_, c_ids, c_codes, c_scale, c_res) = q, c
    q_norm = (q_codes.astype(np.float64) ** 2).sum(axis=1) * q_scale**2
    c_norm = (c_codes.astype(np.float64) ** 2).sum(axis=1) * c_scale**2
    dot = _product(q_codes, c_codes) * q_scale[:, None] * c_scale[None, :]
    size = q_norm[:, None] + c_norm[None, :]
    square = size - 2 * dot
    slack = size * 1e-12  # rounding of the norms and products above
    near = np.sqrt(np.maximum(square - slack, 0)) - q_res[:, None] - c_res[None, :]
    far = (np.sqrt(np.maximum(square + slack, 0)) + q_res[:, None] + c_res[None, :]) * (1 + 1e-9)
    own = q_ids[:, None] == c_ids[None, :]
    near[own] = far[own] = np.inf
    return near, far


class Cell:
    """What one grid cell has found: for each block of its queries, the pairs that its
    bounds leave, and each query's k smallest upper bounds."""

    def __init__(self, k: int):
        self.k, self.best, self.pairs = k, {}, {}

    def add(self, q: tuple, c: tuple) -> None:
        near, far = bounds(q, c)
        key = int(q[0][0])  # the block's first row
        best = np.concatenate([self.best.get(key, np.zeros((len(near), 0))), far], axis=1)
        self.best[key] = best = np.partition(best, self.k - 1, axis=1)[:, : self.k] if best.shape[1] > self.k else best
        limit = best.max(axis=1) if best.shape[1] == self.k else np.full(len(near), np.inf)
        r, s = np.nonzero((near <= limit[:, None]) & np.isfinite(near))
        self.pairs.setdefault(key, []).append((q[0], limit, r, c[0][s], near[r, s], far[r, s]))

    def left(self) -> Iterator[pa.RecordBatch]:
        for parts in self.pairs.values():
            rows, limit = parts[0][0], parts[-1][1]  # the last bounds are the smallest
            r, c, near, far = (np.concatenate([p[i] for p in parts]) for i in range(2, 6))
            ok = near <= limit[r]
            yield pa.RecordBatch.from_arrays([pa.array(rows[r[ok]]), pa.array(c[ok]), pa.array(near[ok]), pa.array(far[ok])], ["q_row", "c_row", "near", "far"])


def _unpacked(b: dict, at: str) -> tuple:
    dim, n = b["dim"], b[f"{at}n"]
    of = lambda name, kind: np.frombuffer(b[at + name], kind)
    return of("rows", np.int64), of("ids", np.int64), of("codes", np.int8).reshape(n, dim), of("scale", np.float64), of("residual", np.float64)


def _surviving(q: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """q_row, c_row, near, far of the pairs that the bounds of their grid cell leave."""
    stripes = C.shuffle_partitions(q.sparkSession)
    columns = max(1, q.count() // 4)
    to_q = F.pmod(F.xxhash64("ids"), F.lit(columns)).cast("int").alias("column")
    to_c = F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int").alias("stripe")
    left = q.select("dim", F.col("n").alias("q_n"), *[F.col(x).alias(f"q_{x}") for x in PARTS], to_q, F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    right = c.select("dim", F.col("n").alias("c_n"), *[F.col(x).alias(f"c_{x}") for x in PARTS], to_c, F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"))
    cell = ["stripe", "column", "dim"]
    tiles = left.hint("merge").join(right, cell)  # a merge join's rows come cell by cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = Cell(k), None
        for batch in batches:
            for i in range(batch.num_rows):
                b = {name: batch[name][i].as_py() for name in batch.schema.names}
                now = tuple(b[x] for x in cell)
                if at is not None and now != at:
                    yield from held.left()
                    held = Cell(k)
                at = now
                held.add(_unpacked(b, "q_"), _unpacked(b, "c_"))
        yield from held.left()

    return tiles.mapInArrow(run, "q_row long, c_row long, near double, far double")


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """For each query vector its ``k`` nearest candidates: query_id, rank (from
    1), vec_id, score (Euclidean distance, double), nearest first, ties to the
    smaller vec_id.

    Both tables have vec_id and embedding; other columns are ignored. Vectors
    that are null, empty, zero or hold a null or non-finite component, and those
    without an id, take no part; only vectors of one dimension are compared; a
    candidate with the query's id is its own. Copies of vectors under different
    ids are all found. Equal rows of one id count once, rows that differ under
    one id are candidates of their own, and the candidates of queries with one
    id are merged. With fewer than ``k`` candidates
    all are returned; empty tables give no row.

    The grid: query blocks are numbered into columns, candidate blocks are
    dealt to stripes; each stripe gets every column once by an equi-join on
    (stripe, column), so a task holds one cell's pairs at a time. Originals are
    joined by row to the pairs that the bounds of all stripes leave.
    """
    asked, held = numbered(queries), numbered(candidates)
    found = C.saved(_surviving(C.saved(packed(asked, QUERY_ROWS), "query_blocks"), C.saved(packed(held, BLOCK_ROWS), "candidate_blocks"), k), "near_pairs")
    by_far = Window.partitionBy("q_row").orderBy("far", "c_row")
    whole = Window.partitionBy("q_row")
    ranked = found.withColumn("nth", F.row_number().over(by_far)).withColumn("limit", F.when(F.count("*").over(whole) >= k, F.max(F.when(F.col("nth") <= k, F.col("far"))).over(whole)).otherwise(float("inf")))
    pairs = ranked.where("near <= limit").select("q_row", "c_row")
    pairs = pairs.join(held.select(F.col("row").alias("c_row"), "vec_id", F.col("embedding").alias("c")), "c_row").join(asked.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "q_row")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, at = {}, None

        def out() -> pa.RecordBatch:
            best = heapq.nsmallest(k, heap)
            n = len(best)
            return pa.RecordBatch.from_arrays([pa.array([at] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([i for _, i in best], pa.int64()), pa.array([d for d, _ in best], pa.float64())], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            ids, vec = batch["query_id"].to_numpy(), batch["vec_id"].to_pylist()
            for a, b in _runs(np.array([len(x) for x in batch["q"]])):
                x, y = (np.array(batch[c].slice(a, b - a).to_pylist(), np.float64) for c in ("q", "c"))
                for i, d in zip(range(a, b), exact_distances(x, y).tolist()):
                    if at is not None and ids[i] != at:
                        yield out()
                        heap = {}
                    at = int(ids[i])
                    heap[d, vec[i]] = None
                    if len(heap) > 64 * k:
                        heap = dict.fromkeys(heapq.nsmallest(k, heap))
        if at is not None:
            yield out()

    grouped = pairs.select("query_id", "vec_id", "q", "c").repartition(C.shuffle_partitions(queries.sparkSession), "query_id").sortWithinPartitions("query_id")
    return grouped.mapInArrow(merged, "query_id long, rank int, vec_id long, score double")


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of equal numbers."""
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all ``embeddings`` for each whose id is divisible by 100."""
    rows = C.table(spark, sf_dir, "embeddings")
    return nearest(rows.where(F.col("vec_id") % 100 == 0), rows)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id,
             sqrt(list_reduce(list_transform(list_zip(a.e, b.e), lambda t: (t[1] - t[2]) * (t[1] - t[2])), lambda s, t: s + t)) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
