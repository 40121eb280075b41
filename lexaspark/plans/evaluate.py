"""From a query's tree to one filtered, once-aggregated scan of the postings.

All terms of a query are read with one ``term IN (...)`` filter and one
aggregation by document; the boolean tree is a Column over its results, so no
clause costs a join. Two named semantics:

* ``intended``: the documented algebra. NOT subtracts, phrases have any length,
  fields restrict, words that analysis drops vanish, a word of several tokens is
  a phrase.
* ``as_coded``: what the engine that this one follows really computes. NOT and
  unknown or dropped words fail their clause; a failed clause empties an AND, and
  an OR if it is the first; only a word's first token counts; phrases of three
  and more kept words match nothing; fields are ignored; scoring takes the sum of
  the clauses' frequencies for every term. On a written index no phrase of two kept words matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexaspark.functions.analysis import analyze_text
from lexaspark.operators.index import Index, field_positions, field_tf
from lexaspark.operators.postings import phrase_positions, shifted
from lexaspark.plans import query as Q


@dataclass(frozen=True)
class Leaf:
    """Terms with their places from the first one, in one field or in all."""

    terms: tuple[tuple[int, str], ...]
    field: str | None = None


def resolve(tree, config, field: str | None = None):
    """The intended tree over leaves; None for what analysis drops."""
    if isinstance(tree, Q.Term):
        kept = analyze_text(tree.word, config)
    elif isinstance(tree, Q.Phrase):
        kept = analyze_text(" ".join(tree.words), config)
    elif isinstance(tree, Q.Field):
        return resolve(tree.child, config, tree.name)
    elif isinstance(tree, Q.Not):
        child = resolve(tree.child, config, field)
        return None if child is None else child.child if isinstance(child, Q.Not) else Q.Not(child)
    else:
        kind = type(tree)
        flat = []
        for c in (resolve(c, config, field) for c in tree.children):
            flat += c.children if isinstance(c, kind) else [] if c is None else [c]
        return None if not flat else flat[0] if len(flat) == 1 else kind(tuple(flat))
    return Leaf(tuple((pos - kept[0][0], term) for pos, term in kept), field) if kept else None


def leaves(tree) -> list[Leaf]:
    if tree is None:
        return []
    if isinstance(tree, Leaf):
        return [tree]
    return [x for c in (getattr(tree, "children", None) or (tree.child,)) for x in leaves(c)]


def scoring_terms(tree) -> list[tuple[str, str | None]]:
    """(term, field) of every leaf that isn't under NOT; repeated ones count again."""
    if tree is None or isinstance(tree, Q.Not):
        return []
    if isinstance(tree, Leaf):
        return [(t, tree.field) for _, t in tree.terms]
    return [x for c in tree.children for x in scoring_terms(c)]


def matches(tree, has: Callable[[Leaf], object], both=lambda a, b: a & b, either=lambda a, b: a | b, no=lambda a: ~a):
    """The tree's truth from its leaves' truths; for columns, or for Python booleans."""
    if isinstance(tree, Leaf):
        return has(tree)
    if isinstance(tree, Q.Not):
        return no(matches(tree.child, has, both, either, no))
    out = None
    for c in tree.children:
        x = matches(c, has, both, either, no)
        out = x if out is None else (both if isinstance(tree, Q.And) else either)(out, x)
    return out


def _gathered(index: Index, tf: dict, positions: dict) -> DataFrame:
    """doc_id, doc_len and, for each wanted (term, field), its frequency and positions."""
    terms = sorted({t for t, _ in [*tf, *positions]})
    of = lambda t: F.col("term") == t
    columns = [F.coalesce(F.sum(F.when(of(t), field_tf(f))), F.lit(0)).alias(name) for (t, f), name in tf.items()]
    columns += [F.first(F.when(of(t), field_positions(f)), ignorenulls=True).alias(name) for (t, f), name in positions.items()]  # a document has a row for a term
    needed = ["term", "doc_id", "tf", "titled", "doc_len"] + ["positions"] * bool(positions)  # positions are read for phrases alone
    return index.postings.where(F.col("term").isin(terms)).select(*needed).groupBy("doc_id").agg(F.max("doc_len").alias("doc_len"), *columns)


@dataclass(frozen=True)
class Evaluated:
    """Matching documents (doc_id, doc_len, tf_0, tf_1, ...) and the terms of those columns.
    The length is null where a document has none of the terms."""

    rows: DataFrame
    terms: list[tuple[str, str | None]]
    weights: list[int]  # how often the query has each term
    combined: bool = False  # as_coded: a column tf is the clauses' sum


def no_documents(index: Index) -> DataFrame:
    return index.docs.select("doc_id", "doc_len").where(F.lit(False))


def evaluate(index: Index, text: str) -> Evaluated:
    """The documents that match by the intended semantics."""
    tree = resolve(Q.parse(text), index.config)
    if tree is None:
        return Evaluated(no_documents(index), [], [])
    wanted = scoring_terms(tree)
    terms = list(dict.fromkeys(wanted))
    tf = {t: f"tf_{i}" for i, t in enumerate(terms)}
    positions: dict = {}
    for leaf in leaves(tree):
        for _, t in leaf.terms:
            if len(leaf.terms) > 1:
                positions.setdefault((t, leaf.field), f"pos_{len(positions)}")
            else:
                tf.setdefault((t, leaf.field), f"tf_{len(tf)}")

    def has(leaf: Leaf) -> Column:
        if len(leaf.terms) == 1:
            return F.coalesce(F.col(tf[leaf.terms[0][1], leaf.field]) > 0, F.lit(False))
        parts = [(F.col(positions[t, leaf.field]), gap) for gap, t in leaf.terms]
        return F.coalesce(F.size(phrase_positions(parts)) > 0, F.lit(False))

    gathered = _gathered(index, tf, positions)
    if matches(tree, lambda leaf: False, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a):
        gathered = index.docs.select("doc_id").join(gathered, "doc_id", "left")  # documents without any of the terms can match
    rows = gathered.where(matches(tree, has)).select("doc_id", "doc_len", *[F.coalesce(F.col(tf[t]), F.lit(0)).alias(f"tf_{i}") for i, t in enumerate(terms)])
    return Evaluated(rows, terms, [wanted.count(t) for t in terms])


def evaluate_as_coded(index: Index, text: str, segment: bool = False) -> Evaluated:
    """The documents that match as coded, with the summed frequency. A ``segment`` keeps no
    positions, so that no phrase of two kept words matches on it."""
    tree = Q.parse(text)
    analyze = lambda w: [t for _, t in analyze_text(w, index.config)]

    def words(node) -> list[str]:
        if isinstance(node, Q.Term):
            return [node.word]
        if isinstance(node, Q.Phrase):
            return list(node.words)
        return [w for c in (getattr(node, "children", None) or ([node.child] if hasattr(node, "child") else [])) for w in words(c)]

    every = sorted({t for w in words(tree) for t in analyze(w)})
    known = {r["term"] for r in index.term_stats.where(F.col("term").isin(every)).select("term").collect()} if every else set()
    tf: dict = {}
    positions: dict = {}

    def frequency(t: str) -> Column:
        return F.col(tf.setdefault((t, None), f"t_{len(tf)}"))

    def places(t: str) -> Column:
        return F.col(positions.setdefault((t, None), f"pos_{len(positions)}"))

    def of(node) -> tuple[Column, Column] | None:
        """(matches, frequency), or None if the clause fails."""
        if isinstance(node, Q.Field):
            return of(node.child)
        if isinstance(node, Q.Term):
            first = analyze(node.word)[:1]
            return (frequency(first[0]) > 0, frequency(first[0])) if first and first[0] in known else None
        if isinstance(node, Q.Phrase):
            kept = [(i, a[0]) for i, a in enumerate(map(analyze, node.words)) if a]
            if not kept or kept[0][0] or any(t not in known for _, t in kept):
                return None
            if len(kept) == 1:
                return frequency(kept[0][1]) > 0, frequency(kept[0][1])
            if segment or len(kept) > 2:
                return F.lit(False), F.lit(0).cast("long")
            (_, a), (gap, b) = kept
            return F.arrays_overlap(places(a), shifted(places(b), gap)), F.lit(1).cast("long")
        if isinstance(node, Q.And):
            parts = [of(c) for c in node.children]
            if not parts or any(p is None for p in parts):
                return None
            match, total = parts[0]
            for m, f in parts[1:]:
                match, total = match & m, total + f
            return match, total
        if isinstance(node, Q.Or):
            parts = [of(c) for c in node.children]
            if parts[0] is None:
                return None
            known_parts = [p for p in parts if p is not None]
            match, total = F.lit(False), F.lit(0).cast("long")
            for m, f in known_parts:
                match, total = match | m, total + F.when(m, f).otherwise(0)
            return match, total
        return None

    found = of(tree)

    def scored(node) -> list[str]:
        if isinstance(node, Q.Not):
            return []
        if isinstance(node, (Q.Term, Q.Phrase)):
            return [t for w in words(node) for t in analyze(w)]
        return [t for c in (getattr(node, "children", None) or (node.child,)) for t in scored(c)] if node != Q.And(()) else []

    wanted = [t for t in scored(tree) if t in known]
    terms = [(t, None) for t in dict.fromkeys(wanted)]
    if found is None:
        return Evaluated(no_documents(index).withColumn("tf", F.lit(0).cast("long")), [], [], True)
    rows = _gathered(index, tf, positions) if tf or positions else no_documents(index)
    rows = rows.where(found[0]).select("doc_id", "doc_len", found[1].alias("tf"))
    return Evaluated(rows, terms, [wanted.count(t) for t, _ in terms], True)
