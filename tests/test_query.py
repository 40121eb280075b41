import random

import pytest
from pyspark.sql import functions as F

from lexaspark.functions.analysis import analyze_text
from lexaspark.operators import index as I
from lexaspark.operators import postings as P
from lexaspark.plans import query as Q
from lexaspark.plans.evaluate import evaluate, evaluate_as_coded

WORDS = "alpha beta gamma delta omega".split()


@pytest.mark.parametrize("text, kind, size", [("foo bar", Q.And, 2), ("foo OR bar", Q.Or, 2), ("foo NOT bar", Q.And, 2), ("(foo OR bar) baz", Q.And, 2), ("foo and bar", Q.And, 2), ("AND foo bar", Q.And, 2)])
def test_shapes(text, kind, size):
    tree = Q.parse(text)
    assert isinstance(tree, kind) and len(tree.children) == size


def test_atoms():
    assert Q.parse("foo") == Q.Term("foo")
    assert Q.parse('"climate change"') == Q.Phrase(("climate", "change"))
    assert Q.parse('"open end') == Q.Phrase(("open", "end"))
    assert Q.parse("title:x") == Q.Field("title", Q.Term("x"))
    assert Q.parse("AND AND") == Q.Term("AND")
    assert Q.parse("(a b") == Q.And((Q.Term("a"), Q.Term("b")))
    assert Q.parse("") == Q.And(())
    assert Q.parse("a AND AND b") == Q.And((Q.Term("a"), Q.Term("AND"), Q.Term("b")))
    assert Q.parse("NOT NOT a") == Q.And((Q.Not(Q.Term("NOT")), Q.Term("a")))
    assert Q.parse("title:(a OR text:b) OR") == Q.Or((Q.Field("title", Q.Or((Q.Term("a"), Q.Field("text", Q.Term("b"))))), Q.And(())))
    assert Q.parse("NOT ) :") == Q.And((Q.Not(Q.Term(")")), Q.Term(":")))


@pytest.mark.parametrize("text", ["a )", "foo NOT", "title:"])
def test_errors(text):
    with pytest.raises(Q.QueryError):
        Q.parse(text)


def _lists(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, tf long, positions array<int>")


def _docs(spark, ids):
    return _lists(spark, [(i, 1, [0]) for i in ids])


def test_set_operations(spark):
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(P.intersect(_docs(spark, [1, 3, 5, 7]), _docs(spark, [2, 3, 5, 8]))) == [3, 5]
    assert ids(P.intersect(_docs(spark, [1, 2]), _docs(spark, [3, 4]))) == []
    assert ids(P.union(_docs(spark, [1, 3]), _docs(spark, [2, 3, 4]))) == [1, 2, 3, 4]
    assert ids(P.difference(_docs(spark, [1, 2, 3, 4]), _docs(spark, [2, 4]))) == [1, 3]
    assert [r["tf"] for r in P.union(_docs(spark, [1]), _docs(spark, [1])).collect()] == [2]


def test_phrase_gaps(spark):
    a, b = _lists(spark, [(0, 2, [2, 5]), (1, 1, [0])]), _lists(spark, [(0, 2, [3, 9]), (2, 1, [1])])
    assert [r["doc_id"] for r in P.phrase_intersect(a, b).collect()] == [0]
    a, b = _lists(spark, [(0, 1, [0])]), _lists(spark, [(0, 1, [2])])
    assert P.phrase_intersect(a, b, 1).count() == 0 and P.phrase_intersect(a, b, 2).count() == 1


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 2))), " ".join(rnd.choices(WORDS + ["the"], k=rnd.randint(0, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string").withColumn("links", F.array().cast("array<string>"))
    found = I.build_index(docs)
    return rows, I.Index(found.docs.cache(), found.postings.cache(), found.term_stats, found.corpus_stats, found.config)


def _tree(rnd, depth):
    kind = rnd.choice("tpfaon") if depth else rnd.choice("tp")
    if kind == "t":
        return rnd.choice(WORDS)
    if kind == "p":
        return '"' + " ".join(rnd.choices(WORDS + ["the"], k=rnd.randint(2, 3))) + '"'
    if kind == "f":
        return rnd.choice(["title:", "text:"]) + rnd.choice(WORDS)
    if kind == "n":
        return "NOT (" + _tree(rnd, depth - 1) + ")"
    return "(" + (" AND " if kind == "a" else " OR ").join(_tree(rnd, depth - 1) for _ in range(2)) + ")"


def _brute(node, tokens, titled, field=None):
    if isinstance(node, Q.Field):
        return _brute(node.child, tokens, titled, node.name)
    if isinstance(node, Q.And):
        got = [x for x in (_brute(c, tokens, titled, field) for c in node.children) if x is not None]
        return all(got) if got else None
    if isinstance(node, Q.Or):
        got = [x for x in (_brute(c, tokens, titled, field) for c in node.children) if x is not None]
        return any(got) if got else None
    if isinstance(node, Q.Not):
        x = _brute(node.child, tokens, titled, field)
        return None if x is None else not x
    kept = analyze_text(node.word if isinstance(node, Q.Term) else " ".join(node.words))
    if not kept:
        return None
    at = {p: t for p, t in tokens if field is None or (field == "title") == (p < titled)}
    return any(all(at.get(s + p - kept[0][0]) == t for p, t in kept) for s in at)


def test_random_trees(corpus):
    rows, index = corpus
    rnd = random.Random(11)
    for _ in range(25):
        text = _tree(rnd, 2)
        tree = Q.parse(text)
        want = sorted(i for i, title, body in rows if _brute(tree, analyze_text(f"{title} {body}"), len(title.split())))
        assert sorted(r["doc_id"] for r in evaluate(index, text).rows.collect()) == want, text


def test_as_coded(corpus):
    rows, index = corpus
    got = lambda q: sorted((r["doc_id"], r["tf"]) for r in evaluate_as_coded(index, q).rows.collect())
    count = lambda r, w: f"{r[1]} {r[2]}".split().count(w)
    assert got("alpha NOT beta") == [] and got("unknown OR alpha") == [] and got("the alpha") == []
    assert got('"alpha beta gamma"') == []
    assert got("alpha OR unknown") == [(r[0], count(r, "alpha")) for r in rows if count(r, "alpha")]
    assert got("alpha beta") == [(r[0], count(r, "alpha") + count(r, "beta")) for r in rows if count(r, "alpha") and count(r, "beta")]
    assert got("title:alpha") == got("alpha")
    assert got('alpha OR "beta gamma"') != [] and evaluate_as_coded(index, '"beta gamma"', segment=True).rows.count() == 0 < evaluate_as_coded(index, '"beta gamma"').rows.count()
    assert sorted(r["doc_id"] for r in evaluate_as_coded(index, 'alpha OR "beta gamma"', segment=True).rows.collect()) == [i for i, _ in got("alpha")]
