"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams (1 to 3) in rank order, counted
over every learning document. A document is given the language whose profile its own most
frequent n-grams are least out of place in: an n-gram costs the distance of its two ranks,
or the profile's length where the language's profile lacks it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CHUNK, byte_chunks, map_batches

#: Length of a profile.
PROFILE = 400
UNKNOWN = "und"
_ABSENT = np.int64((1 << 21) - 1)


@cache
def _letters() -> np.ndarray:
    """For every code point: is it a letter."""
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def gram_counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-gram, count) arrays of each text, n-grams as three 21-bit code points.

    Text is lower-cased; everything between words counts as one boundary sign (0), which
    opens and closes each word. No n-gram spans a boundary.
    """
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[codes]
    sym = np.where(letter, codes, 0).astype(np.int64)
    edges = np.cumsum([0, *map(len, low)])
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first sign after a word
    keep[edges[:-1]] = True  # the blank before the first word
    bounds = np.concatenate([[0], np.cumsum(keep)])[edges]
    sym = sym[keep]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        s = sym[a:b]
        one = s[s != 0] | (_ABSENT << 21) | (_ABSENT << 42)
        two = (s[:-1] << 21 | s[1:] | _ABSENT << 42)[(s[:-1] | s[1:]) != 0]
        three = (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[s[1:-1] != 0]
        out.append(np.unique(np.concatenate([one, two, three]), return_counts=True))
    return out


def top_grams(grams: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent, ties in the order of their code points."""
    return grams[np.argsort(-counts, kind="stable")[:k]]


def fit_profiles(docs: DataFrame, k: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, gram: the profiles, from all rows with a language and a text.

    Tasks count before anything is shuffled, so a language that holds most of the rows
    sends no more than its distinct n-grams.
    """
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).dropna()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts):
            grams, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for d in batches:
            texts, langs = d["text"].tolist(), d["lang"].tolist()
            for a, b in byte_chunks(texts):
                for lang, got in zip(langs[a:b], gram_counts(texts[a:b])):
                    held.setdefault(lang, []).append(got)
                    size += len(got[0])
                if size > 8 * CHUNK:
                    held = {lang: [merged(parts)] for lang, parts in held.items()}
                    size = 0
        for lang, parts in held.items():
            grams, counts = merged(parts)
            yield pd.DataFrame({"lang": lang, "gram": grams, "n": counts})

    grams = map_batches(rows, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return grams.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < k).drop("n")


def identify(docs: DataFrame, profiles: DataFrame, k: int = PROFILE, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, lang_pred, score of every row, and the columns in `keep`.

    A text that is null or has no letter, or a table learned from nothing, gives 'und' and
    score 0. The score is 1 minus the mean distance over the profile's length. Ties go to
    the language first in the alphabet. Only k ranks a language go to the driver.
    """
    rows = profiles.collect()
    langs = sorted({r["lang"] for r in rows})
    at = {lang: i for i, lang in enumerate(langs)}
    known = np.unique(np.array([r["gram"] for r in rows], np.int64))
    ranks = np.full((len(langs), len(known) + 1), -1, np.int32)  # the last column: in no profile
    for r in rows:
        ranks[at[r["lang"]], np.searchsorted(known, r["gram"])] = r["rank"]
    extra = keep or {}
    chosen = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[c.alias(n) for n, c in extra.items()], F.col(f"`{text_col}`").alias("text"))

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            texts = d["text"].where(d["text"].notna(), "").tolist()
            names, scores = [], []
            for a, b in byte_chunks(texts):
                for grams, counts in gram_counts(texts[a:b]):
                    if not len(grams) or not langs:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    mine = top_grams(grams, counts, k)
                    spot = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    spot = np.where(known[spot] == mine, spot, len(known))
                    theirs = ranks[:, spot]
                    cost = np.where(theirs < 0, k, np.abs(theirs - np.arange(len(mine), dtype=np.int32)))
                    mean = cost.mean(axis=1) / k
                    best = int(mean.argmin())
                    names.append(langs[best])
                    scores.append(float(1 - mean[best]))
            out = d.drop(columns="text")
            out["lang_pred"], out["score"] = names, scores
            yield out

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.drop("text").schema)
    return map_batches(chosen, guess, f"{head}, lang_pred string, score double")
