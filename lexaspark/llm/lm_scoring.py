"""Language-model scoring by cross-entropy difference.

A target and a background bigram model are counted over all tokens of their
documents and share one vocabulary. A document's score is the mean, over its
tokens, of the target model's loss minus the background model's: the lower, the
more it is like the target.

Every word and every bigram of the corpus is in the models, so they grow with
the input and are never broadcast. Documents are packed into blocks of some
million tokens, written once. A block sends the hashes and counts of its
distinct bigrams to buckets by hash; a bucket sums them over the corpus and
sends each block the sums of what it asked for. Words go the same way, with the
number of distinct bigrams they begin, and then a block scores its documents.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaspark.llm import common as C
from lexaspark.llm import shingles

DISCOUNT, SMOOTHING = 0.75, 0.5
#: Tokens and documents that a block holds; a longer document is worked on alone.
HELD = 3_000_000
#: Tokens of the corpus for each bucket of hashes.
BUCKET_TOKENS = 2_000_000
#: Target ids that are broadcast at most; more are joined.
BROADCAST_IDS = 1_000_000
#: In place of the hash of a word before a text's first.
START = np.uint64(0x6C6D5F7374617274)
PAIRS, WORDS = 0, 1
ASKED = "block long, bucket int, keys binary, counts binary"
ANSWERS = "block long, kind int, bucket int, counts binary, fresh long"


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers of 0 or more, by byte planes, compressed."""
    x = np.ascontiguousarray(x).astype("<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(x).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(pa.decompress(data[9:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def _blocks(marked: DataFrame) -> DataFrame:
    """marked: doc_id, text, is_target -> rows of packed documents: a block's distinct
    words, and its tokens as places in them."""
    kind, held = marked.schema["doc_id"].dataType, HELD
    schema = f"block long, tokens long, target_tokens long, ids array<{kind.simpleString()}>, marks array<boolean>, sizes binary, words binary, places binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, hashes, sizes, n = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            all_ids, all_marks = pa.concat_arrays(ids), pa.concat_arrays(marks)
            size = np.concatenate(sizes)
            words, places = np.unique(np.concatenate(hashes), return_inverse=True)
            row = [
                pa.array([int.from_bytes(os.urandom(8), "little", signed=True)]),
                pa.array([int(size.sum())]),
                pa.array([int(size[all_marks.to_numpy(zero_copy_only=False)].sum())]),
                pa.ListArray.from_arrays([0, len(all_ids)], all_ids),
                pa.ListArray.from_arrays([0, len(all_marks)], all_marks),
                *(pa.array([_packed(x)], pa.binary()) for x in (size, np.diff(words, prepend=np.uint64(0)), places)),
            ]
            return pa.RecordBatch.from_arrays(row, ["block", "tokens", "target_tokens", "ids", "marks", "sizes", "words", "places"])

        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in shingles.chunks(texts):
                h, at = shingles.word_hashes(texts[a:b])
                ids.append(batch["doc_id"].slice(a, b - a))
                marks.append(batch["is_target"].slice(a, b - a))
                hashes.append(h)
                sizes.append(np.diff(at))
                n += len(h) + b - a
                if n >= held:
                    yield block()
                    ids, marks, hashes, sizes, n = [], [], [], [], 0
        if ids:
            yield block()

    return marked.select("doc_id", "text", "is_target").mapInArrow(run, schema)


class Block:
    """The distinct words and bigrams of a block, and how often they occur in it."""

    def __init__(self, row: dict):
        self.id, self.sizes = row["block"], _unpacked(row["sizes"]).astype(np.int64)
        words, right = np.cumsum(_unpacked(row["words"]), dtype=np.uint64), _unpacked(row["places"]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        marked = np.array(row["marks"], bool)[self.owner]
        start, self.n_words = len(words), len(words) + 1
        self.hashes = np.append(words, START)
        left = np.append(start, right[:-1])[: len(right)]
        left[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = start
        pairs, self.pair_of = np.unique(left * self.n_words + right, return_inverse=True)
        self.left, self.right = pairs // self.n_words, pairs % self.n_words
        keys = shingles.mixed(self.hashes[self.left] * shingles.GRAM_KEYS[0] + self.hashes[self.right] * shingles.GRAM_KEYS[1])
        self.pair_order, self.word_order = np.argsort(keys), np.argsort(self.hashes)
        self.keys = keys
        count = lambda x, size: (np.bincount(x, minlength=size), np.bincount(x[marked], minlength=size))
        self.pair_counts = count(self.pair_of, len(pairs))
        self.word_counts = (*count(right, self.n_words), *count(left, self.n_words))

    def pairs_asked(self, buckets: int) -> Iterator[tuple]:
        return _asked(self.id, self.keys[self.pair_order], [c[self.pair_order] for c in self.pair_counts], buckets)

    def words_asked(self, answers: list[dict], buckets: int) -> Iterator[tuple]:
        """A pair is counted as distinct in the one block that a bucket names for it."""
        n, target, first = self.pair_answers(answers)
        distinct = [np.bincount(self.left[which], minlength=self.n_words) for which in (first > 0, (first > 0) & (target > 0))]
        return _asked(self.id, self.hashes[self.word_order], [c[self.word_order] for c in (*self.word_counts, *distinct)], buckets)

    def pair_answers(self, answers: list[dict]) -> np.ndarray:
        return _answered(answers, PAIRS, self.pair_order, 3)

    def losses(self, answers: list[dict], whole: tuple[int, int], vocabulary: int) -> list[np.ndarray]:
        """Each document's summed losses in bits by the background and the target model."""
        if not len(self.owner):
            return [np.zeros(len(self.sizes))] * 2
        pairs, words = self.pair_answers(answers), _answered(answers, WORDS, self.word_order, 7)
        out = []
        for m in (0, 1):
            count, unigrams, contexts, distinct = pairs[m], words[m], words[2 + m][self.left], words[4 + m][self.left]
            back = np.where(contexts > 0, DISCOUNT * distinct / np.maximum(contexts, 1), 1.0)
            word = (unigrams[self.right] + SMOOTHING) / (whole[m] + SMOOTHING * (vocabulary + 2))  # unknown words and starts besides
            bits = -np.log2(np.maximum(count - DISCOUNT, 0) / np.maximum(contexts, 1) + back * word)
            out.append(np.bincount(self.owner, bits[self.pair_of], len(self.sizes)))
        return out


def _asked(block: int, keys: np.ndarray, counts: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Sorted keys and their counts, cut by bucket."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
    for bucket in np.flatnonzero(np.diff(at)):
        a, b = at[bucket], at[bucket + 1]
        yield block, int(bucket), _packed(np.diff(keys[a:b], prepend=np.uint64(0))), _packed(np.concatenate([c[a:b] for c in counts]))


def _answered(answers: list[dict], kind: int, order: np.ndarray, n: int) -> np.ndarray:
    """The sums that buckets sent, as n rows in the block's own order."""
    parts = [_unpacked(r["counts"]).astype(np.int64).reshape(n, -1) for r in sorted((r for r in answers if r["kind"] == kind), key=lambda r: r["bucket"])]
    out = np.zeros((n, len(order)), np.int64)
    if len(order):
        out[:, order] = np.concatenate(parts, axis=1)
    return out


def _summed(asked: DataFrame, kind: int, n: int) -> DataFrame:
    """asked: ASKED, with n counts for each key -> ANSWERS: the counts' sums over
    all blocks, and 1 in the one block that is named for a key, 0 in others."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [np.cumsum(_unpacked(r["keys"]), dtype=np.uint64) for r in rows]
        sizes = [len(k) for k in keys]
        counts = np.concatenate([_unpacked(r["counts"]).astype(np.int64).reshape(n, -1) for r in rows], axis=1)
        _, first, of = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        sums = [np.bincount(of, c).astype(np.int64)[of] for c in counts]
        named = np.zeros(len(of), np.int64)
        named[first] = 1
        whole, ends = np.stack([*sums, named]), np.cumsum(sizes)
        parts = [whole[:, b - size : b] for b, size in zip(ends, sizes)]
        columns = [
            table["block"].combine_chunks(),
            pa.array([kind] * len(rows), pa.int32()),
            table["bucket"].combine_chunks(),
            pa.array([_packed(p.ravel()) for p in parts], pa.binary()),
            pa.array([int(p[-1].sum()) for p in parts], pa.int64()),
        ]
        return pa.Table.from_arrays(columns, ["block", "kind", "bucket", "counts", "fresh"])

    return asked.groupBy("bucket").applyInArrow(run, ANSWERS)


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    types = pa.int64(), pa.int32(), pa.binary(), pa.binary()
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def lm_scores(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, is_target,
    target_bits, background_bits (mean loss of a token), score (their difference).

    ``target_ids`` (doc_id) names the documents of the target corpus; the
    background is all documents. Repeated or null target ids change nothing.
    Texts without words, null ones too, have 0 tokens and null losses. Repeated
    rows count as often as they occur and each get a row. Without any target the
    target model is uniform. No documents give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ids = target_ids.select(F.col("doc_id").alias("_target")).where("_target IS NOT NULL").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_target"), "left").select("doc_id", "text", F.col("_target").isNotNull().alias("is_target"))
    blocks = C.saved(_blocks(marked), "lm_blocks")
    tokens, target_tokens = (int(x or 0) for x in blocks.agg(F.sum("tokens"), F.sum("target_tokens")).first())
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    names = ["block", "bucket", "keys", "counts"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _batches(Block(batch.slice(k, 1).to_pylist()[0]).pairs_asked(buckets), names)

    def ask_words(block: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_batches(Block(block.to_pylist()[0]).words_asked(answers.to_pylist(), buckets), names))

    body = blocks.where("tokens > 0").select("block", "marks", "sizes", "words", "places")
    pairs = C.saved(_summed(body.mapInArrow(ask_pairs, ASKED), PAIRS, 2), "lm_pairs")
    asked = body.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(ask_words, ASKED)
    words = C.saved(_summed(asked, WORDS, 6), "lm_words")
    vocabulary = int(words.agg(F.sum("fresh")).first()[0] or 1) - 1  # START is none of them

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, marks = (block[c].combine_chunks().flatten() for c in ("ids", "marks"))
        one = Block(block.drop_columns(["ids"]).to_pylist()[0])
        background, target = one.losses(answers.to_pylist(), (tokens, target_tokens), vocabulary)
        n, none = one.sizes, one.sizes == 0
        some = np.maximum(n, 1)
        columns = [ids, pa.array(n), marks, *(pa.array(x / some, mask=none) for x in (target, background, target - background))]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "is_target", "target_bits", "background_bits", "score"])

    answers = pairs.unionByName(words)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_tokens long, is_target boolean, target_bits double, background_bits double, score double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that are labelled of good quality."""
    good = C.table(spark, sf_dir, "labels").where("quality = 1")
    return lm_scores(C.table(spark, sf_dir, "documents"), good)
