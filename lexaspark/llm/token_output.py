"""Token ids as blocks of a static range asymmetric numeral system (rANS).

File format. A dataset is a folder with two Parquet tables:

* ``frequencies`` (token, freq): one table for all blocks, over every token that
  occurs; the frequencies add up to 2**SCALE.
* ``blocks`` (part, start, tokens, doc_ids, lengths, frame): whole documents in
  ascending doc_id order, about ``BLOCK`` tokens a row. Parts are ranges of ids in
  ascending order, ``start`` is the number of ids before the block in its part,
  ``tokens`` that of the block's own, ``lengths`` holds little-endian uint32.

A frame is ``LXR1``, then uint32: CRC-32 of what follows it, tokens, lanes,
words, checkpoints; the lanes' first states (uint64); for each checkpoint its
step and word (uint32 each, then the states); then the words (uint32). Lane j
of step s holds token ``s * lanes + j``, so all lanes go on together, and a
reader can begin at any block or at any checkpoint in it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaspark.llm import common as C

END = 2
SCALE = 20
LANES, BLOCK, CHECKPOINT = 1024, 1 << 18, 128
LOW = np.uint64(1 << 31)
MAGIC = b"LXR1"
#: Bytes of words, and of chunks of other texts, whose ids a Python worker keeps.
WORD_BYTES, CHUNK_BYTES = 96 << 20, 16 << 20


# --- tokens


class Kept(dict):
    """Values by key; a missing one is made. Beyond half of ``limit`` bytes, what has
    been asked for since the last time stays, and the rest goes."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.before, self.held = make, limit, {}, 0

    def __missing__(self, key: str) -> bytes:
        value = self.before.pop(key, None)
        if value is None:
            value = self.make(key)
        if self.held > self.limit // 2:
            self.before, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += 180 + len(key) + len(value)  # with the objects' own sizes
        return value


class CachedTokenizer:
    """Ids of whole texts, equal to ``Tokenizer.encode(add_special_tokens=False)``.

    The file's rules cut a lower-cased text into contractions, runs of letters,
    digits and runs of other signs, and its model gives each piece's ids. Where a
    text has only ASCII and the letters of Latin-1, a regular expression cuts the
    same pieces and each distinct piece is given to the model once. Other texts are
    encoded chunk by chunk between white space, which the rules drop.
    """

    LATIN = "".join(map(chr, [*range(192, 215), *range(216, 247), *range(248, 256)]))
    EASY = (" \n" + "".join(map(chr, range(33, 127))) + LATIN).encode("latin-1")
    SMALL = "a-zß-öø-ÿ"
    PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{SMALL}]+|[0-9]|[^\s{SMALL}0-9]+")
    STOPS = (LATIN + "".join(map(chr, [*range(65, 91), *range(97, 123)])) + " \n.,;:!?").encode("latin-1")
    ONE_STOP = bytes(46 if b in b".,;:!?" else b for b in range(256))

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.sign = re.compile("|".join(map(re.escape, self.special)), re.I) if self.special else None
        known = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(known)]
        self.bytemap = {b: b for b in known} | {b: 256 + i for i, b in enumerate(other)}
        self.pieces, self.chunks = Kept(self._piece, WORD_BYTES), Kept(self._chunk, CHUNK_BYTES)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _piece(self, piece: str) -> bytes:
        known = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytemap)
        return self._packed([t.id for t in self.model.tokenize(known)]) if piece else b""

    def _chunk(self, chunk: str) -> bytes:
        return self._packed(self.whole.encode(chunk, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian numbers of ``kind``."""
        pieces, chunks = self.pieces.__getitem__, self.chunks.__getitem__
        out = []
        for t in texts:
            cut = self._cut(t)
            out.append(b"".join(map(chunks, t.replace("\n", " ").split(" ")) if cut is None else map(pieces, cut)))
        return out

    def _cut(self, text: str) -> list[str] | None:
        """The pieces of a text; None if the rules must cut it."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if raw.translate(None, self.EASY) or (self.sign and any(x[0] in text for x in self.special) and self.sign.search(text)):
            return None
        text = text.lower()
        if raw.translate(None, self.STOPS) or b".." in raw.translate(self.ONE_STOP):
            return self.PIECES.findall(text)
        text = text.replace("\n", " ")  # words and single stops alone: split at spaces
        for stop in ".,;:!?":
            text = text.replace(stop, f" {stop} ")
        return text.split(" ")


def tokenizer(path: str) -> CachedTokenizer:
    return C.in_worker("tokenizer", path, lambda: CachedTokenizer(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- rANS


def quantised(tokens: np.ndarray, counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**scale, near the counts."""
    if len(tokens) > 1 << (scale - 1):
        raise ValueError("more tokens than the frequency scale can hold")
    if not len(tokens):
        return np.zeros(0, np.int64)
    total, room = int(counts.sum()), (1 << scale) - len(tokens)
    share = [int(c) * room // total for c in counts]
    freq = np.array(share, np.int64) + 1
    order = np.lexsort((tokens, -counts))
    freq[order[: (1 << scale) - int(freq.sum())]] += 1
    return freq


class Coder:
    def __init__(self, tokens: np.ndarray, freq: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, f = tokens[order].astype(np.uint32), freq[order].astype(np.uint64)
        size = int(self.tokens[-1]) + 1 if len(tokens) else 1
        self.freq, self.cum = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[self.tokens] = f
        self.cum[self.tokens] = np.cumsum(f) - f
        self.slots = np.repeat(self.tokens, f.astype(np.int64))

    def encode(self, tokens: np.ndarray) -> bytes:
        lanes = LANES
        x = np.full(lanes, LOW, np.uint64)
        steps = -(-len(tokens) // lanes)
        words, marks, n = [], [], 0
        up, mask32, scale, room = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(SCALE), np.uint64(63 - SCALE)
        f_all, c_all = self.freq[tokens], self.cum[tokens]
        for s in range(steps - 1, -1, -1):
            f, c = f_all[s * lanes : (s + 1) * lanes], c_all[s * lanes : (s + 1) * lanes]
            now = x[: len(f)]
            full = now >= (f << room)
            out = now[full]
            words.append((out & mask32).astype(np.uint32))
            n += len(out)
            now[full] = out >> up
            whole = now // f
            now[:] = (whole << scale) + (now - whole * f) + c
            if s and s % CHECKPOINT == 0:
                marks.append((s, n, x.tobytes()))
        head = b"".join(struct.pack("<II", s, n - at) + state for s, at, state in reversed(marks))
        body = struct.pack("<IIII", len(tokens), lanes, n, len(marks)) + x.tobytes() + head + np.concatenate(words[::-1] or [np.zeros(0, np.uint32)]).tobytes()
        return MAGIC + struct.pack("<I", zlib.crc32(body)) + body

    def decode(self, frame, checkpoint: int | None = None) -> np.ndarray:
        """The tokens of a frame; from its checkpoint-th checkpoint on, if given."""
        frame = memoryview(frame)
        if bytes(frame[:4]) != MAGIC or struct.unpack_from("<I", frame, 4)[0] != zlib.crc32(frame[8:]):
            raise ValueError("damaged frame")
        n_tokens, lanes, n_words, n_marks = struct.unpack_from("<IIII", frame, 8)
        at, each = 24 + 8 * lanes, 8 + 8 * lanes
        x = np.frombuffer(frame, np.uint64, lanes, 24).copy()
        words = np.frombuffer(frame, np.uint32, n_words, at + n_marks * each).astype(np.uint64)
        step = pos = 0
        if checkpoint is not None:
            step, pos = struct.unpack_from("<II", frame, at + checkpoint * each)
            x = np.frombuffer(frame, np.uint64, lanes, at + checkpoint * each + 8).copy()
        out = np.empty(n_tokens, np.uint32)
        low, scale, up = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        first = step * lanes
        for a in range(first, n_tokens, lanes):
            now = x[: min(lanes, n_tokens - a)]
            slot = now & low
            sym = self.slots[slot]
            out[a : a + len(sym)] = sym
            now[:] = self.freq[sym] * (now >> scale) + slot - self.cum[sym]
            short = np.flatnonzero(now < LOW)
            now[short] = (now[short] << up) | words[pos : pos + len(short)]
            pos += len(short)
        return out[first:]


# --- Spark


def tokenised(docs: DataFrame, tokenizer_path: str, end: int) -> DataFrame:
    """doc_id, tie (a hash of the text), row, n, ids of every document; and for each
    task a row with n = -1 and ``hist``, its tokens and their counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, row, total = tokenizer(tokenizer_path), TaskContext.get().partitionId() << 33, np.zeros(0, np.int64)
        names = ["doc_id", "tie", "row", "n", "ids", "hist"]
        key = None
        for batch in batches:
            key = batch["doc_id"].type
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                kinds = tok.kind if end < 1 << 8 * tok.kind.itemsize else np.dtype("<u4")
                stop = np.array([end], kinds).tobytes()
                ids = [(i if kinds == tok.kind else np.frombuffer(i, tok.kind).astype(kinds).tobytes()) + stop for i in tok.encode(some["text"].to_pylist())]
                c = np.bincount(np.frombuffer(b"".join(ids), kinds), minlength=len(total))
                c[: len(total)] += total
                total = c
                n = pa.array([len(i) // kinds.itemsize for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["tie"], pa.array(np.arange(row, row + len(ids))), n, pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
                row += len(ids)
        if key is not None:
            t = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key), pa.nulls(1, pa.int64()), pa.array([row]), pa.array([-1]), pa.nulls(1, pa.binary()), pa.array([np.stack([t, total[t]]).astype("<i8").tobytes()], pa.binary())], names)

    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie")).mapInArrow(run, f"doc_id {kind}, tie long, row long, n long, ids binary, hist binary")


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch["hist"].to_pylist():
            t, c = np.frombuffer(raw, "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(c)], ["token", "n"])


def write_token_blocks(docs: DataFrame, path: str, tokenizer_path: str, end: int = END) -> None:
    """Writes the token ids of ``docs`` (doc_id, text) to ``path``, in the file
    format above, in ascending doc_id order (null first; rows with one id by a
    hash of the text; equal rows are interchangeable).

    Each document is all its ids and then ``end``; null and empty texts are
    ``end`` alone. An empty table gives an empty dataset. Other columns are
    ignored. Texts are tokenised once, where they are read, into a table, and
    counted on the way; ids alone are sorted by range, so rows of one id and text
    can be in several parts. The driver gets a row for each token.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = C.saved(tokenised(docs, tokenizer_path, end), "tokens")
    counts = table.where("n < 0").select("hist").mapInArrow(_tallies, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
    symbols = np.array([r["token"] for r in counts], np.int64)
    freq = quantised(symbols, np.array([r["n"] for r in counts], np.int64))
    spark.createDataFrame(list(zip(symbols.tolist(), freq.tolist())), "token long, freq long").coalesce(1).write.parquet(f"{path}/frequencies")
    sent = spark.sparkContext.broadcast((symbols, freq))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(*sent.value), TaskContext.get().partitionId()
        held: list[tuple] = []
        size = start = 0
        arrow = None

        def block() -> pa.RecordBatch:
            ids = np.concatenate([i for _, i in held])
            lengths = np.array([len(i) for _, i in held], np.uint32)
            columns = [pa.array([part], pa.int32()), pa.array([start]), pa.array([size]), pa.array([[d for d, _ in held]], pa.list_(arrow)), pa.array([lengths.tobytes()], pa.binary()), pa.array([coder.encode(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "start", "tokens", "doc_ids", "lengths", "frame"])

        for batch in batches:
            arrow = batch["doc_id"].type
            for doc, n, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "ids"))):
                if size >= BLOCK:
                    yield block()
                    held, start, size = [], start + size, 0
                held.append((doc, np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")))
                size += n
        if held:
            yield block()

    order = ["doc_id", "tie", "row"]
    ranged = table.where("n >= 0").select(*order, "n", "ids").repartitionByRange(C.shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    ranged.select("doc_id", "n", "ids").mapInArrow(code, f"part int, start long, tokens long, doc_ids array<{kind}>, lengths binary, frame binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_token_blocks(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32,
    and with ``ids`` the ids themselves. Blocks are decoded independently; a
    damaged one raises. An empty dataset gives no row."""
    C.small_batches(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    table = spark.read.parquet(f"{path}/frequencies").collect()  # the vocabulary at most
    before, at = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("tokens").alias("n")).collect()):  # a row for each part
        before[r["part"]] = at
        at += r["n"]
    sent = spark.sparkContext.broadcast((np.array([r["token"] for r in table], np.int64), np.array([r["freq"] for r in table], np.int64), before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, freq, before = sent.value
        coder = Coder(symbols, freq)
        for batch in batches:
            for k in range(batch.num_rows):
                lengths = np.frombuffer(batch["lengths"][k].as_buffer(), np.uint32).astype(np.int64)
                tokens = coder.decode(batch["frame"][k].as_buffer())
                ends = np.cumsum(lengths)
                raw = memoryview(tokens.astype("<u4", copy=False)).cast("B")
                first = before[batch["part"][k].as_py()] + batch["start"][k].as_py()
                columns = [batch["doc_ids"][k].values, pa.array(first + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(tokens.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.select("part", "start", "doc_ids", "lengths", "frame").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def token_output(docs: DataFrame, tokenizer_path: str | None = None, end: int = END) -> DataFrame:
    """Writes the ids to a new folder in the shared directory and reads them back:
    rows, nulls, empty texts, repeated rows and other columns as in
    ``write_token_blocks`` and ``read_token_blocks``."""
    path = C.new_path(docs.sparkSession, "token_blocks")
    write_token_blocks(docs, path, tokenizer_path or default_path(), end)
    return read_token_blocks(docs.sparkSession, path)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``token_output`` of all ``documents``."""
    return token_output(C.table(spark, sf_dir, "documents"))
