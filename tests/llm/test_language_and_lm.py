import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import docs_of

from lexaspark.llm import language_id, lm_scoring, shingles


@pytest.fixture(scope="module")
def models(documents):
    return language_id.train(documents.where(~language_id.held_out()))


def test_held_out_accuracy(spark, models):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = [r for r in language_id.identify(docs, models).collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["accepted"] for r in got]) > 0.99  # clean documents are kept


def test_odd_texts(spark, models, odd, nothing):
    got = language_id.identify(odd, models).collect()
    assert len(got) == odd.count()
    for r, text in zip(got, [r["text"] for r in odd.collect()]):
        some = any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == (not some) and (some or (r["score"] == 0 and not r["accepted"]))
    assert language_id.identify(nothing, models).count() == 0
    none = language_id.train(nothing)
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}
    kept = language_id.accepted_documents(odd, models)
    assert kept.columns == odd.columns and kept.where("text IS NULL OR text = ''").count() == 0


def test_junk_is_rejected(models):
    lang, score, ok = models.predict(["zqxjk vvkqz xxwqj qqqzj kkxvw jjqzx " * 20, None])
    assert ok == [False, False] and lang[1] == "und"


def plain_kneser_ney(words, order=4):
    """P(sign | signs before it in the word), by dictionaries; contexts don't reach beyond the word's start."""
    counts = [Counter() for _ in range(order + 1)]
    before = [{} for _ in range(order + 1)]
    for word, weight in words.items():
        signs = "^" + word + "$"
        for at in range(1, len(signs)):
            for n in range(1, order + 1):
                if n <= at + 1:
                    gram = signs[at + 1 - n : at + 1]
                    longer = signs[at - n : at + 1] if n <= at else None
                    if n == order or longer is None:
                        counts[n][gram] += weight
                    else:
                        before[n].setdefault(gram, set()).add(longer)
    for n in range(1, order):
        for gram, longer in before[n].items():
            counts[n][gram] += len(longer)
    floor = 1 / (len({c for w in words for c in w} | {""}) + 2)
    discount = []
    for n in range(order + 1):
        once, twice = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        discount.append(min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5)

    def p(history, sign):
        out = floor
        for n in range(1, order + 1):
            if n - 1 > len(history):
                break
            context = history[len(history) - n + 1 :]
            followers = {g: c for g, c in counts[n].items() if g[:-1] == context}
            if followers:
                total = sum(followers.values())
                out = max(counts[n][context + sign] - discount[n], 0) / total + discount[n] * len(followers) / total * out
        return out

    return p


def test_kneser_ney_agrees_with_a_plain_one(documents):
    rows = [r["text"] for r in documents.where("lang = 'de'").limit(8).collect()]
    for words in ({"ab": 3, "aab": 1, "ba": 2, "b": 4, "abb": 1}, dict(Counter(w for t in rows for w in language_id.words_of(t)).most_common(150))):
        model, p = language_id.LanguageModels({"x": words}), plain_kneser_ney(words)
        for word in [*list(words)[:25], "unseen", "zzz", "aabab"]:
            got = 2 ** model.log2(*language_id._grams([word], language_id.ORDER)[:2])[:, 0]
            signs = "^" + word + "$"
            assert got == pytest.approx([p(signs[:at], signs[at]) for at in range(1, len(signs))], rel=1e-9)
        for history in ("^", "^a", "^ab", "^bb"):
            total = sum(p(history, c) for c in {c for w in words for c in w} | {"$"})
            assert 0.9 < total <= 1 + 1e-9  # the rest is for letters never seen


def test_only_letters_have_a_language(models):
    lang, score, ok = models.predict(["½ ²", "Ⅷ ③ _ 12", "x²y½", "²" + "the and of " * 5])
    assert lang[:2] == ["und", "und"] and score[:2] == [0, 0] and ok[:2] == [False, False] and "und" not in lang[2:]
    assert language_id.words_of("X²y ½ Ünï") == Counter(["x", "y", "ünï"])


def test_every_language_has_a_model(spark):
    """Seventy languages of their own letters; a sample of few rows, one language with most of all, one id for many rows."""
    letters = [chr(0x4E00 + 5 * k) + chr(0x4E01 + 5 * k) for k in range(70)]
    rows = [(i, f"{letters[k]}{letters[k][::-1]} {letters[k][0]}", f"l{k:02}") for k in range(70) for i in range(100 * k, 100 * k + 3)]
    rows += [(7000 + i, f"{letters[0]} {letters[0][0]}", "l00") for i in range(900)] + [(None, letters[1], "l01")] * 300 + [(1, None, "l00"), (2, "x", None)]
    models = language_id.train(docs_of(spark, rows, extra=False), 40)
    assert models.languages == [f"l{k:02}" for k in range(70)]
    assert models.predict(letters)[0] == models.languages


def test_rejection_rate_is_what_was_asked_for():
    words = {"a": {f"{x}{y}{z}": 3 for x in "abcdef" for y in "aeiou" for z in "lmnrst"}}
    model = language_id.LanguageModels(words)
    rnd = np.random.default_rng(0)
    names = sorted(words["a"])
    texts = [" ".join(rnd.choice(names, rnd.integers(1, 40))) for _ in range(6000)]
    for share in (0.05, 0.01):
        model.calibrate(texts[:2000], ["a"] * 2000, share)
        rejected = 1 - np.mean(model.predict(texts[2000:])[2])
        assert rejected <= 2.5 * share + 0.002
    model.calibrate(texts[:5], ["a"] * 5)
    assert all(model.predict(texts[5:50])[2])  # too few to reject by


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_scores(rows, target):
    texts = [words_of(t) for _, t in rows]
    known = {w for ws in texts for w in ws}
    uni, bi, ctx = ({False: Counter(), True: Counter()} for _ in range(3))
    for (i, _), ws in zip(rows, texts):
        for both in {False, i in target and i is not None} | {False}:
            if both and i not in target:
                continue
            for a, b in zip(["<s>", *ws], ws):
                uni[both][b] += 1
                bi[both][a, b] += 1
                ctx[both][a] += 1
    out = []
    for (i, _), ws in zip(rows, texts):
        bits = []
        for m in (True, False):
            total = sum(uni[m].values()) + 0.5 * (len(known) + 2)
            loss = 0.0
            for a, b in zip(["<s>", *ws], ws):
                kept = {p: c for p, c in bi[m].items() if p[0] == a}
                n = max(1, ctx[m][a])
                back = 1 - sum(max(c - 0.75, 0) / n for c in kept.values())
                loss -= math.log2(max(bi[m][a, b] - 0.75, 0) / n + back * (uni[m][b] + 0.5) / total)
            bits.append(loss / len(ws) if ws else None)
        out.append((i, len(ws), bits[0], bits[1]))
    return out


def test_scores_by_brute_force(spark):
    rows = [(1, "a b a c"), (2, "a b b"), (3, None), (4, "c c A, b!"), (4, "c c A, b!"), (None, "a d"), (6, "")]
    for target in ({1, 4}, set()):
        ids = spark.createDataFrame([(t,) for t in [*target, *target, None]], "doc_id long")
        got = lm_scoring.lm_scores(docs_of(spark, rows), ids).collect()
        want = brute_scores(rows, target)
        key = lambda x: (x[0] is None, x[0] or 0)
        for r, (i, n, t, b) in zip(sorted(got, key=key), sorted(want, key=key)):
            assert (r["doc_id"], r["n_tokens"]) == (i, n)
            assert r["target_bits"] == (None if t is None else pytest.approx(t)) and r["background_bits"] == (None if b is None else pytest.approx(b))
            assert r["score"] is None if n == 0 else r["score"] == pytest.approx(t - b)


def test_joined_targets_agree(spark, documents, monkeypatch):
    ids = documents.select("doc_id").where("doc_id % 3 = 0")
    a = sorted(map(tuple, lm_scoring.lm_scores(documents, ids).collect()))
    monkeypatch.setattr(lm_scoring, "BROADCAST_IDS", 1)
    monkeypatch.setattr(lm_scoring, "HELD", 1000)
    b = sorted(map(tuple, lm_scoring.lm_scores(documents, ids).collect()))
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[5] for x in a], [x[5] for x in b])


def test_rare_bigrams_are_kept_in_a_large_corpus(spark):
    """A word and a bigram that occur twice in over two million tokens; many blocks and buckets."""
    filler = [(i, " ".join(f"w{j}" for j in range(1000))) for i in range(2200)]
    rows = [*filler, (5000, "rare pair"), (5001, "rare pair"), (5002, "pair rare")]
    ids = spark.createDataFrame([(5000,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_scoring.lm_scores(docs_of(spark, rows, extra=False).repartition(3), ids).where("doc_id >= 5000").collect()}
    v, total, starts = 1002, 2_200_006, 2203
    word = lambda n, of: (n + 0.5) / (of + 0.5 * (v + 2))
    first = 1.25 / starts + 0.75 * 3 / starts * word(3, total)
    second = 1.25 / 2 + 0.75 / 2 * word(3, total)  # "rare" goes on twice, always with "pair"
    assert got[5000]["background_bits"] == got[5001]["background_bits"] == pytest.approx(-(math.log2(first) + math.log2(second)) / 2)
    assert got[5002]["background_bits"] > got[5001]["background_bits"] and got[5001]["score"] < got[5002]["score"]


def test_odd_lm_rows(spark, odd, nothing):
    ids = odd.select("doc_id")
    got = lm_scoring.lm_scores(odd, ids).collect()
    assert len(got) == odd.count() and all((r["score"] is None) == (r["n_tokens"] == 0) for r in got)
    assert lm_scoring.lm_scores(nothing, ids).count() == 0


def test_word_hashes():
    texts = ["The cat, the CAT.", None, "", "cat\x00dog ümlaut", "..", "the"]
    h, at = shingles.word_hashes(texts)
    per = [h[a:b].tolist() for a, b in zip(at, at[1:])]
    assert [len(p) for p in per] == [len(words_of(t)) for t in texts]
    assert per[0][0] == per[0][2] == per[5][0] and per[0][1] == per[0][3] == per[3][0] and per[3][0] != per[3][1]
    names = {}
    for t, p in zip(texts, per):
        for w, x in zip(words_of(t), p):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
