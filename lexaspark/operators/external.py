"""A second ranker outside of Spark, to hold results against: SQLite's FTS5, in memory.

It is a harness for small corpora on one machine, not a part of the engine.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable


def available() -> bool:
    """Whether this Python's SQLite has FTS5."""
    with sqlite3.connect(":memory:") as con:
        return con.execute("SELECT count(*) FROM pragma_compile_options WHERE compile_options = 'ENABLE_FTS5'").fetchone()[0] > 0


def fts5_search(docs: Iterable[tuple[int, str, str]], queries: Iterable[str], k: int = 10) -> list[list[int]]:
    """For each query the ids of its k best of ``docs`` (doc_id, title, text) by FTS5's own
    BM25. A query that FTS5 can't parse finds nothing."""
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE d USING fts5(title, text)")
        con.executemany("INSERT INTO d(rowid, title, text) VALUES (?, ?, ?)", docs)
        out = []
        for query in queries:
            try:
                out.append([r[0] for r in con.execute("SELECT rowid FROM d WHERE d MATCH ? ORDER BY bm25(d) LIMIT ?", (query, k))])
            except sqlite3.OperationalError:
                out.append([])
        return out
    finally:
        con.close()
