import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexaspark.functions import varint


@pytest.mark.parametrize("value, size", [(0, 1), (127, 1), (128, 2), (16383, 2), (16384, 3), (2**32 - 1, 5)])
def test_sizes(value, size):
    assert len(varint.encode(value)) == size and varint.decode(varint.encode(value)) == (value, size)


def test_truncated():
    assert varint.decode(b"\x80")[1] == -1 and varint.decode(b"")[1] == -1
    with pytest.raises(ValueError):
        varint.decode_postings(b"\x01\x80")
    with pytest.raises(ValueError):
        varint.encode(-1)


@given(st.dictionaries(st.integers(0, 2**40), st.integers(1, 9999), max_size=50))
def test_round_trip(found):
    entries = sorted(found.items())
    assert varint.decode_postings(varint.encode_postings(entries)) == entries


def test_lengths_and_report(spark):
    from pyspark.sql import functions as F

    from lexaspark.functions import varint
    from lexaspark.operators.index import posting_bytes

    values = [0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**55, 2**62]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(varint.length(F.col("v"))).collect()]
    assert got == [len(varint.encode(v)) for v in values]
    lists = {"a": [(3, 1), (200, 300), (201, 2)], "b": [(0, 5)]}
    rows = spark.createDataFrame([(t, d, n) for t, ps in lists.items() for d, n in ps], "term string, doc_id long, tf long")
    assert posting_bytes(rows).first()["bytes"] == sum(len(varint.encode_postings(ps)) for ps in lists.values())
