"""Rows that the tests of the training-data operators share."""

SF = "/root/testdata/sf0.001"
CLASHING = ["size", "n", "sig", "sid", "part", "start", "shard", "time", "key", "token", "hits", "copies", "_row", "_index", "_part", "is_target", "held_out", "tile", "member", "doc", "place"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=True):
    """rows: (doc_id, text[, lang[, source]]); with columns whose names operators may use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) + (("x",) * len(CLASHING) if extra else ()) for r in rows]
    return spark.createDataFrame(full, SCHEMA + ("".join(f", {c} string" for c in CLASHING) if extra else ""))


LONG = "licensed under the mit license and more words of text " * 12000
ODD = [
    (None, "a text without an id", "en", "s"),
    (None, None, None, None),
    (1, None, "en", "s"),
    (2, "", "en", None),
    (3, " \n\t ", "de", "t"),
    (4, "12 34 !? --", "de", "t"),
    (5, LONG, "en", "u"),
    (6, "The same text stands here twice, MIT License.", "en", "s"),
    (6, "The same text stands here twice, MIT License.", "en", "s"),
    (7, "The same text stands here twice, MIT License.", "fr", "t"),
    (8, "Ünïcödé 😀 text with\x00odd characters ́", "fr", "ü"),
    (9, "one", "es", "t"),
]
