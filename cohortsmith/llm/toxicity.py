"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed to embeddings; filters of several widths slide over them; each filter keeps
its maximum over the text; a logistic layer weighs the maxima. A text's language, guessed from
its words alone, picks the threshold; scores are bent so that every threshold lies at one value.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import running_totals
from ..session import durable, noted, release
from .common import CHUNK, FORGET, byte_chunks, encoded, keep_rows, map_batches, ship
from .contamination import words_of

BUCKETS = 1 << 17
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
EMBEDDING_RATE = 0.5
#: Labelled rows, and words of a text, that `training_sample` brings to the driver; the queries learn from all.
SAMPLE = 8_000
SAMPLE_WORDS = 4_000
#: Texts and words of one step of the descent.
BATCH_TEXTS, BATCH_WORDS = 64, 1 << 20
#: Training texts, about, that descend together before the parts' networks are averaged.
PART_TEXTS = 4_000
#: Texts' worth of the common rate that a bucket's rate of toxic texts starts from.
PRIOR = 20
#: Texts that a bucket needs for an embedding; the others' is zero and stays so.
LEAST_TEXTS = 5
#: Cells for each labelled id, and at most, by which documents without a label are left where they are.
CELLS_EACH, CELLS = 16, 1 << 25
#: Where the thresholds of all languages lie on the score.
CUT = 0.3
#: Positives a language needs in the calibration part for a threshold of its own.
OWN_THRESHOLD = 40


class _Hashed(dict):
    """Bucket of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        at = self[word] = zlib.crc32(word) % BUCKETS
        return at


_hashed = _Hashed()
FORGET.append(_hashed.clear)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words in a row, and where each text begins."""
    lists = [words_of(t) for t in texts]
    get = _hashed.__getitem__
    flat = np.fromiter((get(w) for ws in lists for w in ws), np.int32, sum(map(len, lists)))
    return flat, np.cumsum([0, *map(len, lists)])


class Network(NamedTuple):
    embedding: np.ndarray  # buckets x dim
    filters: list[np.ndarray]  # width x dim x filters, one array a width
    bias: np.ndarray  # filters of all widths
    weight: np.ndarray
    offset: float


def _pooled(net: Network, ids: np.ndarray, bounds: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of every filter over every text, 0 at least, and where it stands (-1: nowhere).

    The product of each bucket's embedding with each filter row is looked up in `tables`.
    """
    n, k = len(bounds) - 1, len(net.bias)
    best, where = np.zeros((n, k), np.float32), np.full((n, k), -1, np.int64)
    for j, (width, table) in enumerate(zip(WIDTHS, tables)):
        cols = slice(j * FILTERS, (j + 1) * FILTERS)
        if len(ids) < width:
            continue
        m = len(ids) - width + 1
        z = table[0][ids[:m]]
        for o in range(1, width):
            z += table[o][ids[o : m + o]]
        z += net.bias[cols]
        for i in range(n):
            a, b = bounds[i], bounds[i + 1] - width + 1
            if b > a:
                top = z[a:b].argmax(axis=0)
                value = z[a + top, np.arange(FILTERS)]
                on = value > 0
                best[i, cols] = np.where(on, value, 0)
                where[i, cols] = np.where(on, a + top, -1)
    return best, where


def _tables(net: Network) -> list[list[np.ndarray]]:
    return [[net.embedding @ f[o] for o in range(len(f))] for f in net.filters]


def _pooled_max(net: Network, ids: np.ndarray, bounds: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """The maxima alone, over all texts at once."""
    n = len(bounds) - 1
    best = np.zeros((n, len(net.bias)), np.float32)
    sizes = np.diff(bounds)
    for j, (width, table) in enumerate(zip(WIDTHS, tables)):
        full = np.flatnonzero(sizes >= width)
        if not len(full):
            continue
        m = len(ids) - width + 1
        z = table[0][ids[:m]]
        for o in range(1, width):
            z += table[o][ids[o : m + o]]
        # Segments alternate: the places of a text, then those that reach into the next.
        edges = np.stack([bounds[full], bounds[full + 1] - width + 1], axis=1).ravel()
        top = np.maximum.reduceat(z, edges[:-1] if edges[-1] >= m else edges, axis=0)[::2]
        best[full, j * FILTERS : (j + 1) * FILTERS] = np.maximum(top + net.bias[j * FILTERS : (j + 1) * FILTERS], 0)
    return best


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _odds(seen: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket, the smoothed log odds of its texts against the common share; and how many it has.
    `seen`: texts by label and bucket. Buckets of fewer than LEAST_TEXTS are left at 0."""
    total = seen.sum(axis=0)
    rate = (seen[1] + PRIOR * share) / (total + PRIOR)
    odds = np.clip(np.log(rate / (1 - rate)) - np.log(share / (1 - share)), -3, 3)
    return np.where(total < LEAST_TEXTS, 0, odds), total


def texts_with_bucket(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Texts by label and bucket."""
    seen = np.zeros((2, BUCKETS))
    for t, label in zip(texts, labels):
        seen[int(label), np.unique(t)] += 1
    return seen


class Training(NamedTuple):
    """Where the training stands: parameters by name, Adam's moments of all but the embedding, steps taken."""

    p: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    step: int

    def network(self) -> Network:
        p = self.p
        return Network(p["embedding"], [p[f"filter{j}"] for j in range(len(WIDTHS))], p["bias"], p["weight"], p["offset"][0])

    def packed(self) -> np.ndarray:
        """All but the embedding as one row of numbers."""
        return np.concatenate([part[n].ravel() for part in (self.p, self.first, self.second) for n in self.first])

    def unpacked(self, numbers: np.ndarray, embedding: np.ndarray, step: int) -> Training:
        parts, at = [], 0
        for _ in range(3):
            part = {}
            for n, like in self.first.items():
                part[n] = numbers[at : at + like.size].reshape(like.shape)
                at += like.size
            parts.append(part)
        return Training({"embedding": embedding, **parts[0]}, parts[1], parts[2], step)


def begin(odds: np.ndarray, texts_with: np.ndarray, share: float, rng: np.random.Generator) -> Training:
    """The first embedding axis begins as log odds, the rest as small noise."""
    embedding = rng.normal(0, 0.02, (BUCKETS, DIM))
    embedding[:, 0] = odds
    embedding[texts_with < LEAST_TEXTS] = 0
    filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] = np.abs(f[0, 0, : FILTERS // 2]) + 0.3
    k = FILTERS * len(WIDTHS)
    p = {"embedding": embedding, "bias": np.zeros(k), "weight": rng.normal(0, 0.2, k), "offset": np.array([np.log(share / (1 - share))])}
    p |= {f"filter{j}": f for j, f in enumerate(filters)}
    return Training(p, *({n: np.zeros_like(v) for n, v in p.items() if n != "embedding"} for _ in range(2)), 0)


def _batches(order: np.ndarray, texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Up to BATCH_TEXTS texts of about BATCH_WORDS words; a longer text stands alone."""
    lo, words = 0, 0
    for at, i in enumerate(order):
        if at > lo and (at - lo == BATCH_TEXTS or words + len(texts[i]) > BATCH_WORDS):
            yield order[lo:at]
            lo, words = at, 0
        words += len(texts[i])
    if lo < len(order):
        yield order[lo:]


def epoch(now: Training, texts: list[np.ndarray], y: np.ndarray, learnable: np.ndarray, order: np.ndarray) -> Training:
    """One pass of gradient descent on the log loss over the texts in `order`: Adam for the layers, plain
    steps for the embeddings that won a maximum, so that a bucket moves as far as texts agree on it."""
    p, first, second, step = dict(now.p), dict(now.first), dict(now.second), now.step
    p["embedding"] = p["embedding"].copy()
    for rows in _batches(order, texts):
        ids = np.concatenate([texts[i] for i in rows])
        bounds = np.cumsum([0, *(len(texts[i]) for i in rows)])
        net = Training(p, first, second, step).network()
        words, back = np.unique(ids, return_inverse=True)
        small = [[(p["embedding"][words] @ f[o]).astype(np.float32) for o in range(len(f))] for f in net.filters]
        h, where = _pooled(net, back, bounds, small)
        error = (_sigmoid(h @ p["weight"] + p["offset"]) - y[rows]) / len(rows)
        grad = {"weight": h.T @ error + 1e-4 * p["weight"], "offset": np.array([error.sum()])}
        dh = np.where(where >= 0, error[:, None] * p["weight"], 0)
        grad["bias"] = dh.sum(axis=0)
        moved = np.zeros((len(words), DIM))
        for j, width in enumerate(WIDTHS):
            cols = slice(j * FILTERS, (j + 1) * FILTERS)
            doc, filt = np.nonzero(where[:, cols] >= 0)
            at, d = where[:, cols][doc, filt], dh[:, cols][doc, filt]
            g = np.zeros_like(p[f"filter{j}"])
            for o in range(width):
                np.add.at(g[o].T, filt, d[:, None] * p["embedding"][ids[at + o]])
                np.add.at(moved, back[at + o], d[:, None] * p[f"filter{j}"][o][:, filt].T)
            grad[f"filter{j}"] = g
        step += 1
        won = np.flatnonzero(moved.any(axis=1) & learnable[words])
        p["embedding"][words[won]] -= EMBEDDING_RATE * moved[won]
        for n, g in grad.items():
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.99 * second[n] + 0.01 * g * g
            p[n] = p[n] - 0.01 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
    return Training(p, first, second, step)


def _finished(now: Training, more_odds: np.ndarray) -> Network:
    """The trained network, its log odds moved by `more_odds`, as it is kept."""
    net = now.network()
    embedding = net.embedding.copy()
    embedding[:, 0] += more_odds
    return Network(
        embedding.astype(np.float32), [f.astype(np.float32) for f in net.filters], net.bias.astype(np.float32), net.weight, float(net.offset)
    )


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """One half of the texts gives the log odds and the other trains the network, so no text sees its
    own label in them; in the end the odds of all texts take the place of the half's."""
    rng = np.random.default_rng(seed)
    y = labels.astype(np.float64)
    share, half = y.mean(), np.arange(len(texts)) % 2
    odds, texts_with = _odds(texts_with_bucket([t for t, h in zip(texts, half) if not h], labels[half == 0]), share)
    now = begin(odds, texts_with, share, rng)
    for _ in range(epochs):
        now = epoch(now, texts, y, texts_with >= LEAST_TEXTS, rng.permutation(np.flatnonzero(half)))
    return _finished(now, _odds(texts_with_bucket(texts, labels), share)[0] - odds)


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap below the cut with the best F-measure, precision counting double;
    ties go to the lowest. A cut must be right more often than not; without one, the
    threshold lies above all scores."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    f = 1.25 * np.cumsum(y) / (np.arange(1, len(y) + 1) + 0.25 * max(1, y.sum()))
    f[2 * np.cumsum(y) <= np.arange(1, len(y) + 1)] = -1
    f[:-1][s[:-1] == s[1:]] = -1  # equal scores stay together
    if f.max(initial=-1) < 0:
        return float((s.max(initial=0.5) + 1) / 2)
    at = len(f) - 1 - int(f[::-1].argmax())
    below = s[at + 1] if at + 1 < len(s) else 0.0
    return float((s[at] + below) / 2)


class Classifier(NamedTuple):
    network: Network
    thresholds: np.ndarray  # a language each, in the order of words_by_language
    words_by_language: np.ndarray  # buckets x languages: log probability

    def score(self, ids: np.ndarray, bounds: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        guessed, raw = self.raw(ids, bounds, tables)
        t = self.thresholds[guessed]
        return np.where(raw < t, CUT * raw / t, CUT + (1 - CUT) * (raw - t) / (1 - t))

    def raw(self, ids: np.ndarray, bounds: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Guessed language, and score before any threshold, of each text."""
        h = _pooled_max(self.network, ids, bounds, tables)
        return self.languages(ids, bounds), _sigmoid(h @ self.network.weight + self.network.offset)

    def languages(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Index of the likeliest language of each text by its words; 0 for a text without words."""
        sums = np.zeros((len(bounds) - 1, self.words_by_language.shape[1]), np.float32)
        full = np.flatnonzero(np.diff(bounds) > 0)
        if len(full):
            sums[full] = np.add.reduceat(self.words_by_language[ids], bounds[full], axis=0)
        return sums.argmax(axis=1)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, toxic of the rows with a text and a label, toxic if any label says so."""
    own = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.filter(F.col("text").isNotNull()).select("doc_id", "lang").join(own, "doc_id")


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """At most `sample` labelled rows, the classes as frequent as they are: the lowest by a hash of
    the id, texts of up to SAMPLE_WORDS words, one row of those that repeat an id, toxic if any
    label says so. Documents that are not in the sample send no text anywhere."""
    own = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text = F.col("text")
    length = F.length(text) - F.length(F.translate(text, " ", "")) + 1
    fit = docs.filter(text.isNotNull() & (length <= SAMPLE_WORDS))
    known = fit.select("doc_id").join(own, "doc_id").distinct().withColumn("draw", F.xxhash64("doc_id"))
    chosen = known.orderBy("draw", "doc_id").limit(sample)
    texts = fit.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "toxic", "draw").agg(F.min(F.struct("text", "lang")).alias("one"))
    return one.select("doc_id", "toxic", "draw", "one.*").toPandas().sort_values(["draw", "doc_id"], ignore_index=True)


def calibration_scores(docs: DataFrame, labels: DataFrame, sample: pd.DataFrame, each: int | None = None) -> Callable[[Classifier], pd.DataFrame]:
    """Scores the labelled rows that are not in the sample, all or of each language about `each`: guessed
    language, raw score, toxic. They are scored where the text is; no text reaches the driver."""

    def scores(model: Classifier) -> pd.DataFrame:
        none = pd.DataFrame({"guessed": np.zeros(0, np.int64), "raw": np.zeros(0), "toxic": np.zeros(0, np.int64)})
        if not len(sample):
            return none
        known = labelled(docs, labels).join(F.broadcast(docs.sparkSession.createDataFrame(sample[["doc_id"]])), "doc_id", "left_anti")
        known = durable(known.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("lang", F.lit(""))).alias("lang")))
        sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
        if not sizes:
            return none
        share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, each / n) if each else 1.0)])
        place = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        chosen = known.filter(place < share[F.col("lang")]).select("doc_id", "toxic")
        texts = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables = _tables(shared.value.network)
            for d in batches:
                raw = encoded(d["text"])
                for a, b in byte_chunks(raw):
                    guessed, got = shared.value.raw(*hash_words(raw[a:b]), tables)
                    yield pd.DataFrame({"guessed": guessed, "raw": got, "toxic": d["toxic"].iloc[a:b].to_numpy()})

        return map_batches(texts.select("text", "toxic"), score, "guessed long, raw double, toxic int").toPandas()

    return scores


def _constant(toxic: bool, words: np.ndarray) -> Classifier:
    """A network that scores every text alike."""
    k = FILTERS * len(WIDTHS)
    flat = [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS]
    net = Network(np.zeros((BUCKETS, DIM), np.float32), flat, np.zeros(k, np.float32), np.zeros(k), 4.0 if toxic else -4.0)
    return Classifier(net, np.full(words.shape[1], 0.5), words)


def fit_classifier(sample: pd.DataFrame, more: Callable[[Classifier], pd.DataFrame] | None = None) -> Classifier:
    """Four fifths of the sample train the network; the rest, and what `more` scores with it,
    calibrates a threshold for each language with OWN_THRESHOLD positives there; the others
    share one. Labels of one class
    only, or none, give a network that scores every text alike."""
    ids = [hash_words([t])[0] for t in encoded(sample["text"])] if len(sample) else []
    y = sample["toxic"].to_numpy() if len(sample) else np.zeros(0)
    lang = sample["lang"].fillna("").to_numpy() if len(sample) else np.zeros(0, object)
    names = sorted(set(lang)) or [""]
    words = np.ones((BUCKETS, len(names)))
    for t, name in zip(ids, lang):
        words[:, names.index(name)] += np.bincount(t, minlength=BUCKETS)
    words = np.log(words / words.sum(axis=0)).astype(np.float32)
    part = np.arange(len(y)) % 5 == 4
    if len(set(y[~part])) < 2:
        return _constant(bool(len(y) and y.all()), words)
    net = train([t for t, p in zip(ids, part) if not p], y[~part])
    model = Classifier(net, np.full(len(names), 0.5), words)
    rest = [t for t, p in zip(ids, part) if p]
    flat, bounds = (np.concatenate(rest), np.cumsum([0, *map(len, rest)])) if rest else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    guessed, raw = model.raw(flat, bounds, _tables(net))
    y_rest = y[part]
    if more is not None:
        d = more(model)
        guessed, raw, y_rest = (np.concatenate(x) for x in zip((guessed, raw, y_rest), (d["guessed"], d["raw"], d["toxic"])))
    common = best_threshold(raw, y_rest)
    cuts = [best_threshold(raw[m], y_rest[m]) if y_rest[m := guessed == i].sum() >= OWN_THRESHOLD else common for i in range(len(names))]
    return Classifier(net, np.clip(cuts, 0.01, 1 - 1e-6), words)


def _cell(doc_id: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(cells))


def _label_cells(labels: DataFrame) -> tuple[int, np.ndarray]:
    """How many cells there are, and a bit a cell: whether a label's id falls into it. A document whose id falls
    into none has no label; one in CELLS_EACH of these is not told, or more beyond CELLS / CELLS_EACH labels. The
    bits are never more than CELLS, and what they let through is joined to the labels."""
    cells = min(CELLS, max(64, 64 * -(-labels.count() * CELLS_EACH // 64)))
    at = _cell(F.col("doc_id"), cells)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    found = labels.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(cells // 64, "<i8")
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return cells, bits.view(np.uint8)


def _in_cells(place: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, toxic, role, draw, ids of every labelled id with a text: the buckets of all its words, in order.
    Of rows that repeat an id one counts, toxic if any label says so. The role follows from the id: 0
    calibrates (a fifth), 1 gives the log odds and 2 trains the network (two fifths each).

    Words are hashed where the text is, of hardly more than the labelled rows, and only the buckets are joined to
    the labels."""
    own = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    cells, bits = _label_cells(own)
    texts = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text", _cell(F.col("doc_id"), cells).alias("place"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            d = d[_in_cells(d["place"].to_numpy().astype(np.int64), shared.value)]
            raw = encoded(d["text"])
            for a, b in byte_chunks(raw):
                ids, bounds = hash_words(raw[a:b])
                part = d.iloc[a:b][["doc_id", "lang"]].reset_index(drop=True)
                yield part.assign(ids=[ids[x:y] for x, y in zip(bounds[:-1], bounds[1:])])

    rows = map_batches(texts, hashed, "doc_id long, lang string, ids array<int>").join(own, "doc_id")
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("ids", F.coalesce("lang", F.lit("")).alias("lang"))).alias("one"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("role")), F.lit(5))
    role = F.when(place == 0, 0).when(place <= 2, 1).otherwise(2).alias("role")
    return durable(one.select("one.lang", "toxic", role, F.xxhash64("doc_id").alias("draw"), "one.ids"))


def _text_counts(rows: DataFrame) -> np.ndarray:
    """Texts by role (1, 2), label and bucket; BUCKETS rows at most reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((4, BUCKETS), np.int64)
        for d in batches:
            for r, t, ids in zip(d["role"], d["toxic"], d["ids"]):
                seen[2 * (r - 1) + t, np.unique(ids)] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"bucket": some, **{f"n{i}": seen[i, some] for i in range(4)}})

    counted = map_batches(rows.filter("role > 0").select("role", "toxic", "ids"), count, "bucket int, n0 long, n1 long, n2 long, n3 long")
    d = counted.groupBy("bucket").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(4)]).toArrow().to_pandas()
    out = np.zeros((4, BUCKETS))
    out[:, d["bucket"].to_numpy()] = d[[f"n{i}" for i in range(4)]].to_numpy().T
    return out.reshape(2, 2, BUCKETS)


def _language_words(rows: DataFrame, names: list[str]) -> np.ndarray:
    """Log probability by bucket and language; BUCKETS rows a language at most reach the driver."""
    at = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((len(at), BUCKETS), np.int64)
        for d in batches:
            for name, ids in zip(d["lang"], d["ids"]):
                n[at[name]] += np.bincount(ids, minlength=BUCKETS) if len(ids) > BUCKETS // 8 else 0
                if len(ids) <= BUCKETS // 8:
                    np.add.at(n[at[name]], ids, 1)
        i, bucket = np.nonzero(n)
        yield pd.DataFrame({"i": i, "bucket": bucket, "n": n[i, bucket]})

    d = map_batches(rows.select("lang", "ids"), count, "i int, bucket int, n long").groupBy("i", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    words = np.ones((BUCKETS, len(names)))
    words[d["bucket"].to_numpy(), d["i"].to_numpy()] += d["n"].to_numpy()
    return np.log(words / words.sum(axis=0)).astype(np.float32)


def _spread_epoch(parts: DataFrame, now: Training, learnable: np.ndarray, turn: int) -> Training:
    """One pass over all training texts: every part descends from the present network by itself, then
    the layers are the mean of the parts', and a bucket's embedding that of the parts that moved it. Only
    the embeddings that may move travel; what was sent and written for the pass goes when it ends."""
    spark = parts.sparkSession
    ship(spark)
    rows, blank = np.flatnonzero(learnable), np.zeros((0, DIM))
    shared = spark.sparkContext.broadcast((now._replace(p={**now.p, "embedding": blank}), rows, now.p["embedding"][rows]))

    def descend(d: pd.DataFrame) -> pd.DataFrame:
        now, rows, own = shared.value
        embedding, learnable = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS, bool)
        embedding[rows], learnable[rows] = own, True
        d = d.sort_values("draw", kind="stable")
        order = np.random.default_rng([turn, int(d["part"].iloc[0])]).permutation(len(d))
        then = epoch(now._replace(p={**now.p, "embedding": embedding}), d["ids"].tolist(), d["toxic"].to_numpy().astype(np.float64), learnable, order)
        change = then.p["embedding"] - embedding
        moved = np.flatnonzero(change.any(axis=1))
        layers = pd.DataFrame({"bucket": [-1], "v": [then.packed()], "step": [then.step]})
        return pd.concat([layers, pd.DataFrame({"bucket": moved, "v": list(change[moved]), "step": 0})], ignore_index=True)

    with noted() as written:
        found = durable(parts.groupBy("part").applyInPandas(descend, "bucket int, v array<double>, step int"))
    layers = found.filter("bucket = -1").agg(Summarizer.mean(array_to_vector("v")).alias("v"), F.max("step").alias("step")).first()
    by_bucket = found.filter("bucket >= 0").groupBy("bucket").agg(*[F.avg(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)]).toArrow().to_pandas()
    release(spark, written)
    shared.destroy()
    embedding = now.p["embedding"].copy()
    embedding[by_bucket["bucket"].to_numpy()] += by_bucket[[f"v{i}" for i in range(DIM)]].to_numpy()
    return now.unpacked(layers["v"].toArray(), embedding, layers["step"])


def best_thresholds(scores: DataFrame) -> dict[int, tuple[float, int]]:
    """`best_threshold` and the positives of each guessed language, and of all rows under -1, counted over the
    distinct scores where they are: guessed, raw, toxic of any number of rows."""
    whole = scores.unionByName(scores.withColumn("guessed", F.lit(-1).cast("long")))
    points = durable(whole.groupBy("guessed", "raw").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")))
    run = running_totals(points, "raw", ["pos", "n"], by=["guessed"], descending=True)
    f = F.col("run_pos") * F.lit(1.25) / (F.col("run_n") + F.lit(0.25) * F.greatest(F.lit(1), F.col("tot_pos")))
    best = run.select("guessed", "raw", "tot_pos", F.when(2 * F.col("run_pos") > F.col("run_n"), f).alias("f"))
    # The best cut; of equals the lowest.
    cut = F.max(F.when(F.col("f").isNotNull(), F.struct(F.col("f"), (-F.col("raw")).alias("low"))))
    cuts = durable(best.groupBy("guessed").agg(cut.alias("cut"), F.max("raw").alias("top"), F.max("tot_pos").alias("positives")))
    under = points.join(cuts, "guessed").filter(F.col("raw") < -F.col("cut.low")).groupBy("guessed").agg(F.max("raw").alias("below"))
    out = {-1: (best_threshold(np.zeros(0), np.zeros(0)), 0)}
    for r in cuts.join(under, "guessed", "left").collect():  # one row a language
        at = (r["top"] + 1) / 2 if r["cut"] is None else (-r["cut"]["low"] + (r["below"] or 0.0)) / 2
        out[r["guessed"]] = (float(at), int(r["positives"]))
    return out


def fit_on_all(docs: DataFrame, labels: DataFrame, part_texts: int = PART_TEXTS, seed: int = 7) -> Classifier:
    """The classifier of `fit_classifier`, learnt from every labelled text, whole, where the texts are. The
    driver holds the model and counts by bucket, which do not grow with the rows."""
    rows = learning_rows(docs, labels)
    sizes = rows.groupBy("lang", "role", "toxic").agg(F.count(F.lit(1)).alias("n")).toPandas()
    names = sorted(set(sizes["lang"])) or [""]
    words = _language_words(rows, names)
    learn = sizes[sizes["role"] > 0]
    n, toxic = int(learn["n"].sum()), int(learn.loc[learn["toxic"] == 1, "n"].sum())
    if not 0 < toxic < n:
        return _constant(bool(n and toxic == n), words)
    seen, share = _text_counts(rows), toxic / n
    odds, texts_with = _odds(seen[0], share)
    now = begin(odds, texts_with, share, np.random.default_rng(seed))
    here = int(learn.loc[learn["role"] == 2, "n"].sum())
    if here:
        part = F.pmod(F.xxhash64("draw"), F.lit(-(-here // part_texts))).cast("int").alias("part")
        parts = rows.filter("role = 2").select(part, "draw", "toxic", "ids")
        for turn in range(EPOCHS):
            now = _spread_epoch(parts, now, texts_with >= LEAST_TEXTS, turn)
    model = Classifier(_finished(now, _odds(seen.sum(axis=0), share)[0] - odds), np.full(len(names), 0.5), words)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _tables(shared.value.network)
        for d in batches:
            lists = d["ids"].tolist()
            for a, b in byte_chunks(lists, CHUNK // 8):
                guessed, raw = shared.value.raw(np.concatenate(lists[a:b]).astype(np.int32), np.cumsum([0, *map(len, lists[a:b])]), tables)
                yield pd.DataFrame({"guessed": guessed, "raw": raw, "toxic": d["toxic"].iloc[a:b].to_numpy()})

    cuts = best_thresholds(durable(map_batches(rows.filter("role = 0").select("ids", "toxic"), score, "guessed long, raw double, toxic int")))
    own = [cuts[i if cuts.get(i, (0, 0))[1] >= OWN_THRESHOLD else -1][0] for i in range(len(names))]
    return model._replace(thresholds=np.clip(own, 0.01, 1 - 1e-6))


def score_toxicity(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns in `keep` (doc_id alone if none), score and predicted (score >= CUT) of every row.

    A null or empty text is scored by the network's offset. The model (10 MB) goes to each task;
    a score depends on the text alone, so repeated rows score alike.
    """
    extra = keep or {"doc_id": F.col(f"`{id_col}`")}
    chosen = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(extra.values())], F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        tables = _tables(model.network)
        for d in batches:
            raw = encoded(d["text"])
            out = d.drop(columns="text")
            parts = [model.score(*hash_words(raw[a:b]), tables) for a, b in byte_chunks(raw)]
            out["score"] = np.concatenate(parts) if parts else np.zeros(0)
            out["predicted"] = (out["score"] >= CUT).astype(np.int32)
            yield out

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.drop("text").schema)
    scored = map_batches(chosen, score, f"{head}, score double, predicted int")
    return scored.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(extra)], "score", "predicted")


def drop_toxic(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(texts: list) -> np.ndarray:
        raw, tables = encoded(texts), _tables(shared.value.network)
        return np.concatenate([shared.value.score(*hash_words(raw[a:b]), tables) for a, b in byte_chunks(raw)]) < CUT

    return keep_rows(docs, decide, text_col)
