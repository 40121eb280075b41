"""Benchmark decontamination with one Aho-Corasick automaton.

Items and documents are normalised alike: A-Z lower-cased, words joined by one
space. The automaton holds every window of ten consecutive item words, each
with a space at both ends, so that its matches fall on word bounds. A document
is scanned once; matches become word places and those become character spans
of the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaspark.llm import common as C

WINDOW = 10
#: Bytes of item text that one automaton may hold; more items are scanned for in further passes.
AUTOMATON_BYTES = 64 << 20
#: UTF-8 bytes: A-Z to a-z, word bytes unchanged, all else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORDS = re.compile(C.WORD_ANY_CASE)

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start:long,end:long>>"


def folded(text: str | None) -> list[bytes]:
    """The words of a text, none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(items: list[tuple[str | None, str | None]], width: int = WINDOW) -> dict[bytes, tuple[int, set]]:
    """Window between spaces -> (its words, ids of the items that have it)."""
    found: dict[bytes, tuple[int, set]] = {}
    for item, text in items:
        words = folded(text)
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            found.setdefault(b" " + b" ".join(words[i : i + n]) + b" ", (n, set()))[1].add(item)
    return found


def _automaton(key: str, found: dict):
    """Built once for each Python worker, and kept until another operator's turn."""

    def make():
        import ahocorasick

        made = ahocorasick.Automaton()
        for w, value in found.items():
            made.add_word(w.decode("latin-1"), value)
        if found:
            made.make_automaton()
        return made

    return C.in_worker("automaton", key, make)


def scan(text: str | None, automaton) -> tuple[int, np.ndarray | None, set]:
    """Words, which of them are hit (None: none), and the items that occur."""
    words = folded(text)
    if not words or not len(automaton):
        return len(words), None, set()
    joined = b" " + b" ".join(words) + b" "
    hits = list(automaton.iter(joined.decode("latin-1")))
    if not hits:
        return len(words), None, set()
    ended = np.cumsum(np.frombuffer(joined, np.uint8) == 32) - 1  # words that end before each byte
    marks, items = np.zeros(len(words) + 1, np.int64), set()
    for at, (n, ids) in hits:
        marks[ended[at] - n] += 1
        marks[ended[at]] -= 1
        items |= ids
    return len(words), np.cumsum(marks[:-1]) > 0, items


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the runs of hit words in the original text."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    at = [m.span() for m in WORDS.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in zip(edge[::2], edge[1::2])]


def _groups(benchmark: DataFrame) -> Iterator[tuple[list, bool]]:
    """The items, in groups of at most ``AUTOMATON_BYTES`` of text where items
    allow, and whether there are more; one group after the other is on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // AUTOMATON_BYTES
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for g in range(n):
        yield [tuple(r) for r in items.where(part == g).toLocalIterator()], g + 1 < n  # at most AUTOMATON_BYTES


def _in_passes(docs: DataFrame, benchmark: DataFrame, width: int, step) -> DataFrame:
    """``step`` (documents, windows broadcast, their key, whether it is the last) for each group. A pass
    before the last is written, so that its broadcast can go before the next is made."""
    out = docs
    for items, more in _groups(benchmark):
        found = windows(items, width)
        key = hashlib.sha256(repr(sorted((w, sorted(map(str, v[1]))) for w, v in found.items())).encode()).hexdigest()
        sent = docs.sparkSession.sparkContext.broadcast(found)  # ten words for each of the items' at most
        out = step(out, sent, key, not more)
        if more:
            out = C.saved(out, "decontamination_pass")
            sent.destroy()
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit,
    n_items, items_sha256, contaminated, item_ids, spans.

    An item of fewer words than ``width`` is one window; an item without words
    has none. Null and empty texts have no words and are clean. Items with one
    id count once; an item whose id is null marks words but is not counted.
    Repeated rows each get a row. With no items all is clean; no documents give
    no rows. Further columns of either table are ignored. ``spans`` are
    character offsets in the original text.
    """
    rows = docs.select("doc_id", "text").withColumn("_items", F.array().cast("array<string>")).withColumn("_hit", F.lit(None).cast("binary"))
    return _in_passes(rows, benchmark, width, _pass)


def _pass(docs: DataFrame, sent, key: str, last: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + (RESULT if last else "text string, _items array<string>, _hit binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, sent.value)
        for batch in batches:
            rows = []
            for text, had, before in zip(batch["text"].to_pylist(), batch["_items"].to_pylist(), batch["_hit"].to_pylist()):
                n, hit, ids = scan(text, automaton)
                ids = {*had, *(i for i in ids if i is not None)}
                if before:
                    earlier = np.frombuffer(before, np.bool_)
                    hit = earlier if hit is None else hit | earlier
                rows.append((n, hit, ids))
            if not last:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array([sorted(i) for _, _, i in rows], pa.list_(pa.string())), pa.array([None if h is None else h.tobytes() for _, h, _ in rows], pa.binary())], ["doc_id", "text", "_items", "_hit"])
                continue
            texts = batch["text"]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([0 if h is None else int(h.sum()) for _, h, _ in rows], pa.int64()),
                    pa.array([len(i) for _, _, i in rows], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for _, _, i in rows], pa.string()),
                    pa.array([h is not None for _, h, _ in rows], pa.bool_()),
                    pa.array([sorted(i) for _, _, i in rows], pa.list_(pa.string())),
                    pa.array([[] if h is None else [{"start": a, "end": b} for a, b in spans_of(texts[k].as_py(), h)] for k, (_, h, _) in enumerate(rows)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans"],
            )

    return docs.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no window occurs in; null and
    empty texts stay, repeated rows are judged alike, and without items all stay. An
    empty table stays empty.

    Rows are filtered where they are read: no join and no shuffle."""

    def step(rows: DataFrame, sent, key: str, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, sent.value)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([scan(t, automaton)[1] is None for t in texts.to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    return _in_passes(docs, benchmark, width, step)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contamination`` of all ``documents`` by all ``benchmark`` items."""
    return contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("item_ids", "spans")


def _words(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{C.UPPER}', '{C.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words("text")} AS ws FROM benchmark),
iw AS (SELECT item_id, least({WINDOW}, len(ws)) AS n, ws, unnest(generate_series(1, len(ws) - least({WINDOW}, len(ws)) + 1)) AS p FROM i WHERE len(ws) > 0),
wi AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS w FROM iw),
ns AS (SELECT DISTINCT n FROM wi),
dp AS (SELECT r, ns.n, ws, unnest(generate_series(1, len(ws) - ns.n + 1)) AS p FROM d, ns WHERE len(ws) >= ns.n),
dw AS (SELECT r, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w FROM dp),
m AS (SELECT r, dw.n, p, item_id FROM dw JOIN wi ON dw.w = wi.w AND dw.n = wi.n),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r
"""
