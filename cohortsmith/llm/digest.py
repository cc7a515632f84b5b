"""Document fingerprints: an improbable-feature digest.

Every window of 32 bytes has an entropy; how rare its entropy is over all documents ranks it.
Of each run of neighbouring windows the rarest gets a vote, and windows with enough votes are the
document's features. Features go into a chain of Bloom filters, 160 to a filter. Two digests are
alike by the bits their filters share, beyond what filters of that many bits share by chance.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable, task_count
from .common import byte_chunks, map_batches, mix64

WINDOW = 32
#: Neighbouring windows that vote for their rarest, and votes that make a feature.
VOTERS, VOTES = 32, 8
#: Texts of fewer bytes have too few windows to choose from: all their windows of SMALL bytes count.
SHORT, SMALL = 128, 8
LEVELS = 1001
#: Below this entropy level a window says little; it ranks after all others.
WEAK = 100
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5

#: Most parts of the rows of one id; beyond that a part grows.
PARTS = 1 << 20

_PART = np.array([0, *(round(c * np.log2(c) * 4096) for c in range(1, WINDOW + 1))], np.int32)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy of the window at every start, 0 to 1000.

    A sliding sum: a byte that enters or leaves changes the sum of c log c by a step that
    depends on how often it stands in the window, which lagged comparisons count.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    enter, leave = np.ones(n, np.uint8), np.ones(n, np.uint8)
    step = 1 << 16
    for s in range(0, n, step):  # slices that stay in the cache
        for lag in range(1, WINDOW):
            lo = max(s, lag)
            hi = min(s + step, n)
            if lo < hi:
                same = data[lo:hi] == data[lo - lag : hi - lag]
                enter[lo:hi] += same
                leave[lo - lag : hi - lag] += same
    change = (_PART[1:] - _PART[:-1])[enter - 1]
    change[WINDOW:] -= (_PART[1:] - _PART[:-1])[leave[:-WINDOW] - 1]
    total = np.cumsum(change, dtype=np.int32)[WINDOW - 1 :]
    return (LEVELS - 1) - (total.astype(np.int64) * (LEVELS - 1) // int(_PART[WINDOW])).astype(np.int32)


def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _own_windows(bounds: np.ndarray, n: int, width: int) -> np.ndarray:
    """Starts at which `width` bytes lie in one text."""
    inside = np.zeros(n + 1, np.int32)
    has = np.diff(bounds) >= width
    np.add.at(inside, bounds[:-1][has], 1)
    np.add.at(inside, bounds[1:][has] - width + 1, -1)
    return np.cumsum(inside[:-1]) > 0


def level_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all documents have each level: LEVELS sums, whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LEVELS, np.int64)
        for d in batches:
            raw = [t.encode() for t in d["text"]]
            for a, b in byte_chunks(raw):
                data, bounds = _joined(raw[a:b])
                levels = entropy_levels(data)
                total += np.bincount(levels[_own_windows(bounds, len(data), WINDOW)[: len(levels)]], minlength=LEVELS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"level": at, "n": total[at]})

    out = np.zeros(LEVELS, np.int64)
    for r in map_batches(docs.select("text"), count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[r["level"]] = r["n"]
    return out


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, the rarest first, weak levels last; ties to the lower level."""
    weak = np.arange(LEVELS) < WEAK
    order = np.lexsort((np.arange(LEVELS), counts, weak))
    ranks = np.empty(LEVELS, np.int64)
    ranks[order] = np.arange(LEVELS)
    return ranks


def _features(data: np.ndarray, bounds: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the features, in order, of texts that are not short."""
    levels = entropy_levels(data)
    if not len(levels):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = ranks[levels] << 32 | np.arange(len(levels))
    run, width = key, 1
    while width < VOTERS:  # smallest of 2, 4, 8 ... neighbours
        run = np.minimum(run[:-width], run[width:])
        width *= 2
    winners = run[_own_windows(bounds, len(data), WINDOW + VOTERS - 1)[: len(run)]] & 0xFFFFFFFF
    at, votes = np.unique(winners, return_counts=True)
    text = np.searchsorted(bounds, at, "right") - 1
    most = np.zeros(len(bounds) - 1, np.int64)
    np.maximum.at(most, text, votes)
    keep = (votes >= np.minimum(VOTES, most[text])) & (np.diff(bounds)[text] >= SHORT)
    return text[keep], at[keep]


def fingerprints(texts: list[bytes], ranks: np.ndarray) -> list[str]:
    """The digest of each text: base64 of one byte for the features in the last filter, and the
    filters in order. A text shorter than a window is one feature; an empty one has none and
    the digest ''. Equal texts have equal digests."""
    data, bounds = _joined(texts)
    text, at = _features(data, bounds, ranks)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    cells = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    own, of_text = [cells[at]], [text]
    for i in (i for i, t in enumerate(texts) if 0 < len(t) < SHORT):
        small = np.lib.stride_tricks.sliding_window_view(np.frombuffer(texts[i].ljust(SMALL, b"\0"), np.uint8), SMALL)
        own.append(np.pad(small, ((0, 0), (0, WINDOW - SMALL))))
        of_text.append(np.full(len(small), i))
    words = np.ascontiguousarray(np.concatenate(own)).view(np.uint64)
    text = np.concatenate(of_text)
    hashes = np.zeros(len(words), np.uint64)
    for c in range(words.shape[1]):
        hashes = mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + words[:, c])
    # A feature that a text repeats counts where it stands first.
    _, first = np.unique(mix64(hashes + mix64(text)), return_index=True)
    first.sort()
    text, hashes = text[first], hashes[first]
    order = np.argsort(text, kind="stable")
    text, hashes = text[order], hashes[order]
    counts = np.bincount(text, minlength=len(texts))
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    filters = -(-counts // FILTER_FEATURES)
    before = np.cumsum(filters) - filters
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    row = before[text] + nth // FILTER_FEATURES
    for h in range(HASHES):
        bits[row, (hashes >> np.uint64(11 * h) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    out = []
    for n, f, b in zip(counts.tolist(), filters.tolist(), before.tolist()):
        last = n - (f - 1) * FILTER_FEATURES
        out.append(base64.b64encode(bytes([last]) + packed[b : b + f].tobytes()).decode() if n else "")
    return out


def _filters(digest: str) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words of each filter, features in each)."""
    data = base64.b64decode(digest)
    words = np.frombuffer(data, np.uint8, offset=1).view(np.uint8).reshape(-1, FILTER_BITS // 8)
    sizes = np.full(len(words), FILTER_FEATURES)
    sizes[-1] = data[0]
    return np.ascontiguousarray(words).view(np.uint64), sizes


def likeness(x: str, y: str) -> float:
    """0 to 1: each filter of the shorter chain takes its best match in the other; a match is the
    share of possible common bits beyond chance; the mean is weighted by features. Two empty
    digests are alike, an empty one is unlike any other."""
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    (a, n_a), (b, n_b) = sorted((_filters(x), _filters(y)), key=lambda f: (len(f[0]), f[1].sum()))
    bits_a, bits_b = np.bitwise_count(a).sum(axis=1).astype(float), np.bitwise_count(b).sum(axis=1).astype(float)
    best = np.zeros(len(a))
    for i in range(len(a)):
        common = np.bitwise_count(b & a[i]).sum(axis=1)
        chance, most = bits_a[i] * bits_b / FILTER_BITS, np.minimum(bits_a[i], bits_b)
        best[i] = ((common - chance) / np.maximum(most - chance, 1e-9)).max()
    return float(np.clip((np.clip(best, 0, 1) * n_a).sum() / n_a.sum(), 0, 1))


def _buckets(docs: DataFrame, count: int) -> DataFrame:
    """The rows with `bucket`: ranges of ids between approximate quantiles, ascending. Rows without an
    id come first. An id that fills several quantiles has its own range, which is cut again by `tie`."""
    ids = docs.select(F.col("doc_id").cast("double").alias("i")).dropna()
    found = ids.approxQuantile("i", [k / count for k in range(1, count)], 1 / (4 * count))
    cuts = sorted({*found, *(math.nextafter(c, math.inf) for c, d in zip(found, found[1:]) if c == d)})
    rows = docs.withColumn("i", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="i", outputCol="bucket")
    rows = cut.transform(rows) if cuts else rows.withColumn("bucket", F.lit(0.0))
    wide = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("bucket")).cast("long")
    rows = rows.select(wide.alias("bucket"), "doc_id", "text", F.xxhash64("text").alias("tie"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    # A range of one id is in the order of the ties, so it may be cut where ties are.
    parts = F.when(F.col("least").eqNullSafe(F.col("most")), F.ceil(F.col("n") * count / total)).otherwise(1)
    parts = durable(sizes.select("bucket", F.least(parts, F.lit(PARTS)).cast("long").alias("parts")))
    share = (F.col("tie").cast("double") / 2.0**64 + 0.5) * F.col("parts")
    part = F.least(F.greatest(F.floor(share), F.lit(0)), F.col("parts") - 1)
    return rows.join(parts, "bucket").select((F.col("bucket") * PARTS + part).alias("bucket"), "doc_id", "text", "tie")


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, last, doc_id, text, dealt and sorted so that in a task each row is followed by the
    next document (descending id, null ids last, ties by a hash of the text); after a bucket's
    rows comes one with last = 1, a copy of the first row of the bucket that follows.

    The texts are shuffled once. What is compared across buckets are ids, never rounded.
    """
    spark = docs.sparkSession
    tasks = task_count(spark)
    rows = _buckets(docs, 4 * tasks)
    tops = durable(rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("top")))
    named = tops.select("bucket", F.col("top.doc_id").alias("top_id"), F.col("top.tie").alias("tie"))
    firsts = rows.join(named, ["bucket", "tie"]).filter(F.col("doc_id").eqNullSafe(F.col("top_id")))
    firsts = durable(firsts.groupBy("bucket").agg(F.min("text").alias("text")))
    filled = sorted((r["bucket"] for r in tops.select("bucket").collect()), reverse=True)
    above = spark.createDataFrame([(x, filled[k - 1]) for k, x in enumerate(filled)], "bucket long, above long")
    tails = firsts.join(above, "bucket").select(F.col("above").alias("bucket"), F.lit(1).alias("last"), F.lit(None).cast("long").alias("doc_id"), "text")
    both = rows.select("bucket", F.lit(0).alias("last"), "doc_id", "text").unionByName(tails).withColumn("tie", F.xxhash64("text"))
    order = ["bucket", "last", F.desc_nulls_last("doc_id"), F.desc("tie"), "text"]
    return both.repartition(tasks, "bucket").sortWithinPartitions(*order).drop("tie")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of
    every row. The edited text has its last third replaced by as much of the next document.

    A null text counts as empty; a single row is its own next document; repeated rows follow
    each other. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ranks = rarity_ranks(level_counts(rows))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for d in batches:
            found = held + list(zip(d["last"], d["doc_id"], d["text"]))
            sizes = [3 * len(r[2]) for r in found]
            for a, b in byte_chunks([range(s) for s in sizes]):
                part = found[a : b + 1]  # and the row after, which is the last one's next
                texts = [r[2] for r in part]
                edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, texts[1:])]
                raw = [t.encode() for t in edited]
                prints = fingerprints([t.encode() for t in texts] + raw, ranks)
                rows = []
                for k, (last, doc_id, text) in enumerate(part[:-1]):
                    if not last:
                        own, changed = prints[k], prints[len(part) + k]
                        rows.append((doc_id, len(text), hashlib.sha256(raw[k]).hexdigest(), own, changed, likeness(own, changed), likeness(own, prints[k + 1])))
                yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            held = found[-1:]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_batches(with_next(rows), pairs, schema)
