"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A keyed permutation of 0..n-1 sends each row number to a place; place mod shards is the
shard, place div shards the slot. Nobody stores the permutation: where a row went, and
which row stands in a slot, are both computed. Shard sizes differ by one row at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix64, row_numbers

ROUNDS = 6


def _round_value(half: np.ndarray, i: int, key: int) -> np.ndarray:
    salt = (key * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) & (2**64 - 1)
    return mix64(half ^ mix64(np.array([salt], np.uint64)))


def _pass(x: np.ndarray, a: int, b: int, key: int, inverse: bool) -> np.ndarray:
    left, right = x // np.uint64(b), x % np.uint64(b)
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        if i % 2:
            step = _round_value(left, i, key) % np.uint64(b)
            right = (right + (np.uint64(b) - step if inverse else step)) % np.uint64(b)
        else:
            step = _round_value(right, i, key) % np.uint64(a)
            left = (left + (np.uint64(a) - step if inverse else step)) % np.uint64(a)
    return left * np.uint64(b) + right


def permute(rows: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Place of every row number under the keyed permutation of 0..n-1, or the reverse.

    The Feistel network works on a grid of a x b >= n cells, a and b near the root of n.
    A value that lands beyond n-1 goes round again until it is inside; fewer than a cells
    are outside, so walks are short.
    """
    x = np.asarray(rows, np.uint64)
    if not n or not len(x):
        return x
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    x = _pass(x, a, b, key, inverse)
    while len(out := np.flatnonzero(x >= n)):
        x[out] = _pass(x[out], a, b, key, inverse)
    return x


def row_at(shard: int, slot: int, n: int, shards: int, key: int) -> int:
    """The row number that stands in a slot of a shard."""
    place = slot * shards + shard
    if not (0 <= shard < shards and 0 <= place < n):
        raise IndexError((shard, slot))
    return int(permute(np.array([place]), n, key, inverse=True)[0])


def feistel_shards(docs: DataFrame, shards: int, key: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot of every row.

    Rows are numbered by (id, checksum, size), nulls first, so equal input gives equal
    shards however it is stored; rows equal in all three can stand for each other. A null
    text has size 16 and checksum 0. Other columns are not looked at; an empty table gives
    no rows. Only these three numbers of a document are shuffled, never its text.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    facts = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = row_numbers(facts, ["doc_id", "text_crc32", "size"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            at = permute(d["row"].to_numpy(), n, key)
            d["shard"] = (at % np.uint64(shards)).astype(np.int32)
            d["slot"] = (at // np.uint64(shards)).astype(np.int64)
            yield d

    kind = facts.schema["doc_id"].dataType.simpleString()
    return map_batches(numbered, place, f"doc_id {kind}, size long, text_crc32 long, row long, shard int, slot long")
