"""Benchmark decontamination by a prefix-filtered set join.

A window (13 words of an item, or a shorter item whole) is a set of word shingles. A document
that contains the window contains all of them, so the containment threshold is 1 and the
necessary prefix is one token: the shingle that is rarest over all documents. Documents are
joined on those prefix shingles. The shingle's position in the window gives where the window
must begin and end (positional and length bound); what is left is compared word for word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .common import byte_chunks, encoded, map_batches

WINDOW = 13
#: Words of a shingle; a window of fewer words is one shingle.
SHINGLE = 3
#: Items, and bytes of their texts, that are matched in one pass over the documents.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 64 << 20

# A-Z in lower case, digits, a-z and all bytes of non-ASCII signs as they are, the rest blank.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII signs, A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


def shingle_codes(ids: np.ndarray, n: int) -> np.ndarray:
    """One positive integer per n consecutive word ids; 0 where a word is unknown (0). Below 2^21
    words the codes of three are distinct; beyond, some share one, which costs comparisons only."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    parts = [ids[i : len(ids) - n + 1 + i] for i in range(n)]
    code, known = parts[0].astype(np.int64), parts[0] > 0
    for p in parts[1:]:
        code, known = (code << 21) + p, known & (p > 0)
    return np.where(known, np.maximum(code & ((1 << 63) - 1), 1), 0)


class Windows(NamedTuple):
    """The distinct windows of a block of items."""

    vocabulary: dict[bytes, int]
    flat: np.ndarray  # word ids of all windows in a row
    first: np.ndarray  # where each window begins in flat, and the end
    items: list[list[int]]  # of each window
    names: list[str]  # item ids as text

    def each(self) -> Iterator[np.ndarray]:
        return (self.flat[a:b] for a, b in zip(self.first[:-1], self.first[1:]))


def item_windows(rows: list[tuple[object, str | None]], window: int = WINDOW, nameless: bool = False) -> Windows:
    """With `nameless`, items without an id have windows too, which name no item."""
    vocabulary: dict[bytes, int] = {}
    found: dict[bytes, int] = {}
    words: list[np.ndarray] = []
    items: list[list[int]] = []
    names: dict[str, int] = {}
    for item_id, text in rows:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of((text or "").encode())], np.int32)
        if not len(ids) or item_id is None and not nameless:
            continue
        item = None if item_id is None else names.setdefault(str(item_id), len(names))
        for i in range(max(1, len(ids) - window + 1)):
            w = ids[i : i + window]
            k = found.setdefault(w.tobytes(), len(words))
            if k == len(words):
                words.append(w)
                items.append([])
            if item is not None and item not in items[k][-1:]:
                items[k].append(item)
    flat = np.concatenate(words) if words else np.zeros(0, np.int32)
    return Windows(vocabulary, flat, np.cumsum([0, *map(len, words)]), items, list(names))


def _ids(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of several texts in a row, each closed by a 0, and where each begins."""
    get, parts, sizes = vocabulary.get, [], []
    for t in texts:
        w = words_of(t)
        parts.append(np.fromiter((get(x, 0) for x in w), np.int32, len(w)))
        parts.append(np.zeros(1, np.int32))
        sizes.append(len(w) + 1)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def _own_codes(words: np.ndarray) -> np.ndarray:
    return shingle_codes(words, min(SHINGLE, len(words)))


def shingle_frequency(texts: DataFrame, windows: Windows, shared) -> dict[int, dict[int, int]]:
    """Occurrences of the block's shingles in all documents, by shingle size; bounded by the block."""
    own: dict[int, list[np.ndarray]] = {}
    for w in windows.each():
        own.setdefault(min(SHINGLE, len(w)), []).append(_own_codes(w))
    codes = {n: np.unique(np.concatenate(c)) for n, c in own.items()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = shared.value.vocabulary
        totals = {n: np.zeros(len(c), np.int64) for n, c in codes.items()}
        for d in batches:
            raw = encoded(d["text"])
            for a, b in byte_chunks(raw):
                ids, _ = _ids(raw[a:b], vocabulary)
                for n, known in codes.items():
                    got = shingle_codes(ids, n)
                    got = got[got > 0]
                    spot = np.minimum(np.searchsorted(known, got), len(known) - 1)
                    totals[n] += np.bincount(spot[known[spot] == got], minlength=len(known))
        for n, t in totals.items():
            hit = np.flatnonzero(t)
            yield pd.DataFrame({"size": n, "code": codes[n][hit], "n": t[hit]})

    rows = map_batches(texts.select("text"), count, "size int, code long, n long").groupBy("size", "code").agg(F.sum("n").alias("n")).collect()
    out: dict[int, dict[int, int]] = {n: dict.fromkeys(c.tolist(), 0) for n, c in codes.items()}
    for r in rows:
        out[r["size"]][r["code"]] = r["n"]
    return out


def prefixes(windows: Windows, frequency: dict[int, dict[int, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By shingle size, sorted by code: prefix code, its window and its place in the window.
    A window with a shingle that no document has is left out: it occurs nowhere."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for k, w in enumerate(windows.each()):
        size = min(SHINGLE, len(w))
        own = _own_codes(w).tolist()
        count, code, at = min((frequency[size][c], c, i) for i, c in enumerate(own))
        if count:
            found.setdefault(size, []).append((code, k, at))
    return {n: tuple(np.array(x, np.int64) for x in zip(*sorted(rows))) for n, rows in found.items()}


def match_texts(raw: list[bytes], windows: Windows, prefix) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(words, hit word positions, items) of each text."""
    ids, begins = _ids(raw, windows.vocabulary)
    flat, first = windows.flat, windows.first
    lengths = np.diff(first)
    starts, which = [], []
    for n, (codes, window, at) in prefix.items():
        got = shingle_codes(ids, n)
        lo, hi = np.searchsorted(codes, got, "left"), np.searchsorted(codes, got, "right")
        hit = np.flatnonzero((hi > lo) & (got > 0))
        many = (hi - lo)[hit]
        pair = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, w = np.repeat(hit, many) - at[pair], window[pair]
        doc = np.searchsorted(begins, np.repeat(hit, many), "right") - 1
        inside = (start >= begins[doc]) & (start + lengths[w] < begins[doc + 1])  # positional and length bounds
        start, w = start[inside], w[inside]
        for size in np.unique(lengths[w]):
            s, k = start[lengths[w] == size], w[lengths[w] == size]
            for c in range(0, len(s), 1 << 16):  # the comparison in slices of bounded size
                span = np.arange(size)
                same = (ids[s[c : c + 65536, None] + span] == flat[first[k[c : c + 65536], None] + span]).all(axis=1)
                starts.append(s[c : c + 65536][same])
                which.append(k[c : c + 65536][same])
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    w = np.concatenate(which) if which else np.zeros(0, np.int64)
    delta = np.zeros(len(ids) + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, start + lengths[w], -1)
    hit_words = np.flatnonzero(np.cumsum(delta) > 0)
    doc = np.searchsorted(begins, start, "right") - 1
    order = np.argsort(doc, kind="stable")
    doc, w = doc[order], w[order]
    cuts = np.searchsorted(doc, np.arange(len(raw) + 1))
    hits = np.searchsorted(hit_words, begins)
    for i in range(len(raw)):
        items = sorted({x for k in set(w[cuts[i] : cuts[i + 1]].tolist()) for x in windows.items[k]})
        yield int(begins[i + 1] - begins[i] - 1), hit_words[hits[i] : hits[i + 1]] - begins[i], items


def _runs(at: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions as runs: first and one past the last."""
    if not len(at):
        return [], []
    cut = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + 1).tolist()


def _covered(starts, ends) -> int:
    total, upto = 0, 0
    for a, b in sorted(zip(starts, ends)):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


def find_overlap(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_items: int = BLOCK_ITEMS,
    block_bytes: int = BLOCK_BYTES,
    nameless: bool = False,
) -> DataFrame:
    """doc_id, n_words, hit_starts, hit_ends (runs of hit words), items (ids as text) of every row.

    The documents are matched against all items, a block of about `block_items` or `block_bytes`
    at a time, so what goes to a task is bounded however large the benchmark is; a row's blocks
    are then put together. A null or empty text has no words, a null or empty item no windows;
    an item without an id has some if `nameless`, but is not listed. Repeated
    rows each get their row, an item id that occurs twice counts once. Other columns are not
    read.
    """
    if not 1 <= window:
        raise ValueError("window must be positive")
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    n_items, n_bytes = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n_items // block_items), min(n_items, -(-n_bytes // block_bytes)))
    if blocks > 1:
        items = durable(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
        texts = durable(texts.withColumn("row", F.monotonically_increasing_id()))
    kind = texts.schema["doc_id"].dataType.simpleString()
    own = ["doc_id", "row"] if blocks > 1 else ["doc_id"]
    head = f"doc_id {kind}, " + ("row long, " if blocks > 1 else "")
    out = None
    for b in range(blocks):
        part = items.filter(F.col("block") == b) if blocks > 1 else items
        windows = item_windows([(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()], window, nameless)
        shared = spark.sparkContext.broadcast(windows)
        prefix = prefixes(windows, shingle_frequency(texts, windows, shared)) if windows.items else {}

        def match(batches: Iterator[pd.DataFrame], shared=shared, prefix=prefix) -> Iterator[pd.DataFrame]:
            for d in batches:
                raw, rows = encoded(d["text"]), []
                for a, b in byte_chunks(raw):
                    for n, at, found in match_texts(raw[a:b], shared.value, prefix):
                        rows.append((n, *_runs(at), [shared.value.names[x] for x in found]))
                got = pd.DataFrame(rows, columns=["n_words", "hit_starts", "hit_ends", "items"], index=d.index)
                yield pd.concat([d[own], got], axis=1)

        one = map_batches(texts, match, head + "n_words long, hit_starts array<long>, hit_ends array<long>, items array<string>")
        out = one if out is None else out.unionByName(one)
    if blocks == 1:
        return out
    joined = [F.flatten(F.collect_list(c)).alias(c) for c in ("hit_starts", "hit_ends")]
    whole = out.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), *joined, F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return whole.drop("row")


def contamination(overlap: DataFrame, one_in: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: at least one word in `one_in` hit."""
    kind = overlap.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            hit = [_covered(a, b) for a, b in zip(d["hit_starts"], d["hit_ends"])]
            names = [sorted(x) for x in d["items"]]
            out = d[["doc_id", "n_words"]].copy()
            out["n_hit"] = hit
            out["n_items"] = [len(x) for x in names]
            out["items_sha256"] = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            out["contaminated"] = [h > 0 and one_in * h >= n for h, n in zip(hit, d["n_words"])]
            yield out

    return map_batches(overlap, digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
