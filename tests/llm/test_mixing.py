import re
from collections import Counter, defaultdict

import pytest
from llm_rows import docs_of
from pyspark.sql import functions as F

from lexaspark.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        room = total - sum(fixed.values())
        over = {s: cap * sizes[s] for s in free if room * w[s] / sum(w[x] for x in free) > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return fixed | {s: room * w[s] / sum(w[x] for x in free) for s in free}
        fixed |= over


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def checked(rows, got):
    sizes = defaultdict(int)
    for r in rows:
        if size(r["text"]):
            sizes[r["source"]] += size(r["text"])
    targets, taken = brute_targets(sizes) if sizes else {}, defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes.get(r["source"], 0) and r["target"] == pytest.approx(targets.get(r["source"], 0))
        assert 0 <= r["taken"] <= 3 * r["size"] and abs(r["taken"] - r["copies"] * r["size"]) <= r["size"] / 2
        taken[r["source"]] += r["taken"]
    assert all(t - 1 <= taken[s] <= t + 1e-3 for s, t in targets.items())
    return taken


def test_sources_come_to_their_targets(spark, documents):
    rows = documents.collect()
    got = mixing.mix_sources(documents).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r["doc_id"], size(r["text"])) for r in rows)
    checked(rows, got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(documents.repartition(7)).collect()))  # reruns agree


def brute_queue(rows, place, repeats=3):
    """doc -> (taken words, where its first copy begins) by serving all queues word by word until time 1."""
    sizes = defaultdict(int)
    for i, t, _, s in rows:
        sizes[s] += size(t)
    targets, served = brute_targets(sizes), []
    for s in sizes:
        ids = sorted((r for r in rows if r[3] == s and size(r[1])), key=lambda r: ((place[r[0]] >> 20) % mixing.SEGMENTS, place[r[0]]))
        at = 0
        for epoch in range(repeats):
            for r in ids:
                n = min(size(r[1]), int(targets[s] + 1e-6) - at)
                at += size(r[1])
                if n > 0:
                    served.append((min(1.0, at / targets[s]), s, epoch, (place[r[0]] >> 20) % mixing.SEGMENTS, place[r[0]], r[0], n))
    taken, starts, run = Counter(), {}, 0
    for *_, i, n in sorted(served):
        taken[i] += n
        starts.setdefault(i, run)
        run += n
    return {r[0]: (taken[r[0]], starts.get(r[0])) for r in rows}


def test_queue_order_by_brute_force(spark):
    rows = [(i, "w " * (1 + i % 4), "en", f"s{i % 3}") for i in range(60)]
    docs = docs_of(spark, rows)
    place = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text")).collect()}
    got = {r["doc_id"]: (r["taken"], r["mix_start"]) for r in mixing.mix_sources(docs).collect()}
    assert got == brute_queue(rows, place)


def kept(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def planned(docs):
    out = Counter()
    for r in mixing.mix_sources(docs).collect():
        out[r["doc_id"], r["size"]] += r["copies"]
    return out


def test_repeated_rows_at_the_cut(spark):
    """Copies of one row share what the mix takes of them: 14 of 12 rows, whichever."""
    rows = [(1, "ten words are in this text that is written twelve", "en", "a")] * 12 + [(2, "b " * 40, "en", "b")] + [(3, f"{'c ' * 7}{i}", "en", "c") for i in range(40)]
    docs = docs_of(spark, rows)
    got, want = mixing.mix_sources(docs).collect(), planned(docs)
    checked([dict(doc_id=r[0], text=r[1], source=r[3]) for r in rows], got)
    mine = [r["taken"] for r in got if r["doc_id"] == 1]
    assert len(mine) == 12 and max(mine) - min(mine) <= 10
    out = kept(mixing.mixed_documents(docs))
    by = Counter()
    for (i, t), n in out.items():
        by[i, size(t)] += n
    assert by == +want


def test_mixed_documents_are_the_plan(spark, documents, monkeypatch):
    for few in (10**5, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
        got = Counter(r["doc_id"] for r in mixing.mixed_documents(documents).collect())
        assert got == +Counter({r["doc_id"]: r["copies"] for r in mixing.mix_sources(documents).collect()})


def test_odd_rows(spark, odd, nothing):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count()
    checked(odd.collect(), got)
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert out.where("doc_id = 5").count() == sum(r["copies"] for r in got if r["doc_id"] == 5)
    assert out.where("text IS NULL OR doc_id IN (2, 3)").count() == 4  # rows without words, once each


def test_one_source_and_no_words(spark):
    got = mixing.mix_sources(docs_of(spark, [(i, "a b c") for i in range(5)])).collect()
    assert all(r["copies"] == 1 and r["target"] == 15 for r in got)
    none = docs_of(spark, [(1, None), (2, " ")])
    assert all(r["taken"] == 0 and r["mix_start"] is None for r in mixing.mix_sources(none).collect())
    assert mixing.mixed_documents(none).count() == 2
