"""Language ID by interpolated Kneser-Ney character models.

Each language has a model of the letters of its words (lower-cased, with a
start and an end sign). N-grams are hashed to 64 bits and stored in sorted
arrays with their probabilities, contexts with their back-off weights. A text
gets, for each language, the cross-entropy per letter over all of its words;
the lowest wins. Training rows that the models have not counted calibrate them:
a temperature turns differences into a score, and the tail of what such rows
show gives each language the cross-entropy above which a text is rejected, for
a stated share of false rejections.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexaspark.llm import common as C

ORDER = 4
#: Rows of each language that are used for fitting (lowest hash of the id first); every lang value has a model and all
#: words of these rows count. Of them, every so-manieth is kept from the models and calibrates them.
TRAINING_ROWS, CALIBRATION_PART = 700, 4
#: Share of texts of a known language that calibration lets be rejected; the tail beyond a quantile of what
#: calibration rows show is taken for exponential. With fewer rows than ``TAIL_ROWS`` nothing is rejected.
FALSE_REJECTION, TAIL, TAIL_ROWS = 1e-5, 0.1, 20
CACHE_BYTES = 48 << 20
UND = "und"
#: Runs of letters and of number signs that aren't digits; and the letters in them.
RUNS, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
MULT = np.uint64(0x9E3779B97F4A7C15)


def letters_of(run: str) -> list[str]:
    """The runs of Unicode letters in a run of word characters."""
    return [run] if run.isascii() else LETTERS.findall(run)


def words_of(text: str | None) -> Counter:
    """How often each run of letters stands in the lower-cased text."""
    out: Counter = Counter()
    for run, n in Counter(RUNS.findall((text or "").lower())).items():
        for word in letters_of(run):
            out[word] += n
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _grams(words: list[str], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For every letter and end sign of the words: hashes of its n-grams and of
    their contexts for n = 1..order (0 where it would begin before the start
    sign), and the word it is of."""
    text = "".join("\x02" + w + "\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = codes == 2
    since = np.arange(len(codes)) - np.maximum.accumulate(np.where(start, np.arange(len(codes)), 0))
    keep = np.flatnonzero(~start)
    word = np.cumsum(start)[keep] - 1
    whole, context = [], []
    for n in range(1, order + 1):
        h = np.full(len(keep), n, np.uint64)
        for back in range(n - 1, -1, -1):
            if back == 0:
                context.append(np.where(since[keep] >= n - 1, _mixed(h), 0).astype(np.uint64))
            h = _mixed(h * MULT + codes[np.maximum(keep - back, 0)] + np.uint64(1))
        whole.append(np.where(since[keep] >= n - 1, h, 0).astype(np.uint64))
    return whole, context, word


class KneserNey:
    """One language's model: for each order, sorted hashes and their values."""

    def __init__(self, words: dict[str, int], order: int = ORDER):
        names = sorted(words)
        whole, context, word = _grams(names, order)
        weight = np.array([words[w] for w in names], np.float64)[word] if names else np.zeros(0)
        self.order, self.grams, self.contexts = order, [], []
        self.floor = 1.0 / (1 + len({c for w in names for c in w} | {""}) + 1)  # an equal share for a letter never seen
        count: np.ndarray | None = None
        tables = []
        for n in range(order, 0, -1):
            ok = whole[n - 1] != 0
            g, first, inverse = np.unique(whole[n - 1][ok], return_index=True, return_inverse=True)
            if n == order:
                count = np.bincount(inverse, weight[ok], len(g))
            else:  # continuation: how many different letters stand before; those at a word's start keep their counts
                longer = np.unique(np.stack([whole[n][ok], whole[n - 1][ok]]), axis=1)
                has = longer[0] != 0
                count = np.bincount(np.searchsorted(g, longer[1][has]), minlength=len(g)).astype(np.float64)
                at_start = np.bincount(inverse, np.where(whole[n][ok] == 0, weight[ok], 0.0), len(g))
                count = np.where(count > 0, count, 0) + at_start
            tables.append((n, g, count, context[n - 1][ok][first]))
        lower = None
        for n, g, count, ctx in reversed(tables):
            c, inverse = np.unique(ctx, return_inverse=True)
            total = np.bincount(inverse, count, len(c))
            kinds = np.bincount(inverse, minlength=len(c))
            once, twice = (count == 1).sum(), (count == 2).sum()
            d = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
            back = d * kinds / total
            share = np.maximum(count - d, 0) / total[inverse]
            if n == 1:
                low = np.full(len(g), self.floor)
            else:  # the same letter one order down: by the n-gram without its first letter
                short = dict_lookup(whole, n, g)
                low = lower[np.searchsorted(self.grams[-1][0], short)]
            p = share + back[inverse] * low
            self.grams.append((g, p))
            self.contexts.append((c, back))
            lower = p


def dict_lookup(whole: list[np.ndarray], n: int, grams: np.ndarray) -> np.ndarray:
    """The (n-1)-gram at the end of each of the n-grams."""
    g, first = np.unique(whole[n - 1], return_index=True)
    return whole[n - 2][first[np.searchsorted(g, grams)]]


class Columns:
    """Values by hash and language: for each hash, in sorted order, the languages that
    have it and their values, one after the other."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]]):
        hashes = np.concatenate([h for h, _ in tables])
        language = np.repeat(np.arange(len(tables), dtype=np.int32), [len(h) for h, _ in tables])
        order = np.lexsort((language, hashes))
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.starts = np.append(first, len(hashes)).astype(np.int64)
        self.languages, self.values = language[order], np.concatenate([v for _, v in tables])[order]

    def at(self, wanted: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, language, value) of every hit of the wanted hashes."""
        none = np.zeros(0, np.int64)
        if not len(self.hashes):
            return none, none, np.zeros(0)
        to = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        place = np.flatnonzero((self.hashes[to] == wanted) & ok)
        n = self.starts[to[place] + 1] - self.starts[to[place]]
        at = np.repeat(self.starts[to[place]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(place, n), self.languages[at], self.values[at]


class LanguageModels:
    """Models of all languages, the score's temperature, and the cross-entropy that each
    language's texts may have: a mean and how far above it, for 100 letters or more."""

    def __init__(self, words: dict[str, dict[str, int]]):
        self.languages = sorted(words)
        models = [KneserNey(words[x]) for x in self.languages]
        self.floors = np.array([m.floor for m in models])
        self.grams = [Columns([m.grams[n] for m in models]) for n in range(ORDER)] if models else []
        self.contexts = [Columns([m.contexts[n] for m in models]) for n in range(ORDER)] if models else []
        self.temperature = 1.0
        self.mean, self.above = np.zeros(len(models)), np.full(len(models), math.inf)
        self._reset()

    def _reset(self) -> None:
        self._known: dict[str, int] = {}
        self._bits = np.zeros((0, len(self.languages) + 1))
        self._size = 0

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_bits": self._bits[:0], "_size": 0}

    def log2(self, whole: list[np.ndarray], context: list[np.ndarray]) -> np.ndarray:
        """log2 probability at each place (places x languages)."""
        p = np.tile(self.floors, (len(whole[0]), 1))
        for n in range(ORDER):
            place, language, back = self.contexts[n].at(context[n], whole[n] != 0)
            p[place, language] *= back
            place, language, found = self.grams[n].at(whole[n], whole[n] != 0)
            p[place, language] = found
        return np.log2(p)

    def _add(self, runs: list[str]) -> None:
        """Bits (by language) and signs of new runs; of their letters, as words."""
        step = max(1, 80_000 // len(self.languages))
        parts = [self._bits]
        for lo in range(0, len(runs), step):
            some = runs[lo : lo + step]
            words = [letters_of(r) for r in some]
            owner = np.repeat(np.arange(len(some)), [len(w) for w in words])
            whole, context, word = _grams([x for w in words for x in w], ORDER)
            of = owner[word] if len(word) else word
            bits = -self.log2(whole, context)
            parts.append(np.stack([np.bincount(of, b, len(some)) for b in bits.T] + [np.bincount(of, minlength=len(some)).astype(float)], axis=1))
        self._known.update(zip(runs, range(len(self._bits), len(self._bits) + len(runs))))
        self._bits = np.concatenate(parts)
        self._size += sum(map(len, runs)) + (150 + 8 * self._bits.shape[1]) * len(runs)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per letter (texts x languages), and the signs of each text (letters and
        ends of words; 0 without a letter)."""
        counted = [Counter(RUNS.findall((t or "").lower())) for t in texts]
        if self._size > CACHE_BYTES:
            self._reset()
        new = list(set().union(*counted).difference(self._known)) if counted else []
        if new:
            self._add(new)
        out = np.zeros((len(texts), len(self.languages) + 1))
        known = self._known.__getitem__
        for k, c in enumerate(counted):
            if c:
                out[k] = np.fromiter(c.values(), np.float64, len(c)) @ self._bits[np.fromiter(map(known, c), np.int64, len(c))]
        n = out[:, -1]
        return out[:, :-1] / np.maximum(n, 1)[:, None], n

    def calibrate(self, texts: list[str], languages: list[str], false_rejection: float = FALSE_REJECTION) -> None:
        """Fits temperature and rejection on texts that the models have not counted. How far
        a text's best cross-entropy is above its language's mean, in shares of what its
        length allows, has a tail that is taken for exponential beyond its ``TAIL``
        quantile; the bound leaves ``false_rejection`` of it out. A language with
        fewer than ``TAIL_ROWS`` rows gets the bound of all of them."""
        at = {x: k for k, x in enumerate(self.languages)}
        pairs = [(t, at[x]) for t, x in zip(texts, languages) if x in at]
        ce, n = self.entropies([t for t, _ in pairs])
        ok = n > 0
        ce, n, truth = ce[ok], n[ok], np.array([k for _, k in pairs], np.int64)[ok]
        if not len(ce):
            return
        self.temperature = min((_loss(ce, n, truth, t), t) for t in 2.0 ** np.arange(-4, 7))[1]
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(ce)), best]
        everywhere = float(np.average(low, weights=n))
        for k in range(len(self.languages)):
            own = best == k
            self.mean[k] = np.average(low[own], weights=n[own]) if own.any() else everywhere
        far = (low - self.mean[best]) * _weight(n)
        pooled = _tail_bound(far, false_rejection)
        for k in range(len(self.languages)):
            own = far[best == k]
            self.above[k] = _tail_bound(own, false_rejection) if len(own) >= TAIL_ROWS else pooled

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether the calibration accepts it."""
        if not self.languages:
            return [UND] * len(texts), [0.0] * len(texts), [False] * len(texts)
        ce, n = self.entropies(texts)
        best = ce.argmin(axis=1)
        rows = np.arange(len(ce))
        score = _posterior(ce, n, self.temperature)[rows, best]
        fit = (ce[rows, best] - self.mean[best]) * _weight(n) <= self.above[best]
        some = n > 0
        return [self.languages[b] if s else UND for b, s in zip(best, some)], np.where(some, score, 0.0).tolist(), (some & fit).tolist()


def _weight(n: np.ndarray) -> np.ndarray:
    """Deviations fall with the square root of the letters, up to a hundred; beyond,
    what a text is about counts more than chance."""
    return np.sqrt(np.clip(n, 1, 100))


def _tail_bound(far: np.ndarray, share: float) -> float:
    """What ``share`` of values like these are above, if their tail is exponential."""
    if len(far) < TAIL_ROWS:
        return math.inf
    edge = float(np.quantile(far, 1 - TAIL))
    beyond = far[far > edge] - edge
    return edge + (float(beyond.mean()) if len(beyond) else 0.0) * math.log(TAIL / share)


def _posterior(ce: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
    x = -(ce - ce.min(axis=1, keepdims=True)) * math.log(2) * (np.sqrt(np.maximum(n, 1)) / temperature)[:, None]
    e = np.exp(x)
    return e / e.sum(axis=1, keepdims=True)


def _loss(ce, n, truth, t) -> float:
    return float(-np.log(np.maximum(_posterior(ce, n, t)[np.arange(len(ce)), truth], 1e-12)).mean())


def train(rows: DataFrame, training_rows: int = TRAINING_ROWS) -> LanguageModels:
    """Fits the models on ``rows`` (doc_id, text, lang): on a sample of at most
    ``training_rows`` of each language, by the hash of the id; rows without text or
    lang are left out, other columns are ignored, repeated rows count as often
    as they are in the sample. No usable row gives no model. What the driver gets, and what
    is broadcast, is bounded by the sample: it grows with the number of languages, not of rows.

    The count of each language gives a hash threshold that some more rows than wanted
    pass, so that the window which makes the bound exact gets no language whole.
    """
    spark = rows.sparkSession
    usable = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("_h"))
    sizes = usable.groupBy("lang").count().select(F.col("lang").alias("_l"), F.least(F.lit(1.0), (1.3 * training_rows + 30) / F.col("count")).alias("_share"))
    place = F.pmod(F.col("_h"), F.lit(1 << 30)) / float(1 << 30)
    passed = usable.join(F.broadcast(sizes), F.col("lang") == F.col("_l")).where(place <= F.col("_share"))  # a row for each language
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", F.xxhash64("text")))  # repeated ids share a hash; the bound holds for them too
    ranked = passed.select("lang", "text", "_h", "doc_id").withColumn("_k", first).where(F.col("_k") <= training_rows)
    sample = C.saved(ranked.select("lang", "text", (F.col("_k") % CALIBRATION_PART == 0).alias("_apart")), "language_sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                for word, n in words_of(text).items():
                    found[lang, word] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    counts = sample.where("NOT _apart").select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words: dict[str, dict[str, int]] = {}
    for r in counts.toLocalIterator():  # the words of the sample
        words.setdefault(r["lang"], {})[r["word"]] = r["n"]
    models = LanguageModels(words)
    apart = sample.where("_apart").select("lang", "text").collect()  # a part of the sample
    if models.languages:
        models.calibrate([r["text"] for r in apart], [r["lang"] for r in apart])
        models._reset()
    return models


def held_out() -> "F.Column":
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sent(docs: DataFrame, models: LanguageModels):
    return docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred,
    score, accepted. Every text is read whole; null, empty and letterless texts
    are ``und`` with score 0 and rejected. Repeated rows each get a row; other
    columns are neither used nor returned. Equal cross-entropies go to the language that is first by name.
    Without any model all is ``und``; an empty table gives no row.
    """
    sent = _sent(docs, models)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                lang, score, ok = m.predict(some["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])
        m._reset()
        C.released()

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def accepted_documents(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected: null,
    empty and letterless texts go, and all rows if there is no model. Repeated rows
    are judged alike; an empty table stays empty."""
    sent = _sent(docs, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                yield some.filter(pa.array(m.predict(some.column(at).to_pylist())[2], pa.bool_()))
        m._reset()
        C.released()

    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``identify`` of all ``documents`` by models of those that aren't held out."""
    docs = C.table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(~held_out())))
