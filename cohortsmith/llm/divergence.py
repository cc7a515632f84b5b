"""Source divergence audit: in which words each source of a language departs from the others.

One bytes.translate lowers letters and blanks every separator, bytes.split yields the words, and a
Counter per document gives counts and document frequencies. What is shuffled is sparse: a row
for each language, source and word that a task has seen. Shares are whole billionths, so all sums are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import durable, task_count
from .common import map_batches, ship

UNIT = 1_000_000_000
LEAST_DOCUMENTS, TOP_TERMS = 10, 10
#: Counts a task holds before it hands them on, and cells of the tables that it compares at once.
HELD, CELLS = 500_000, 1 << 21
A_DOCUMENT = 1 << 40
#: Sources compared with as many at once.
TILE = 64

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The runs of letters and bytes beyond ASCII, A-Z in lower case."""
    return text.translate(_WORDS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each word of each group, as the
    tasks counted them: a word of a group may have several rows. docs: lang, source, text."""
    schema = T.StructType.fromDDL("lang string, source string, term string, n long, docs long")
    kind = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}  # a document counts as A_DOCUMENT
        size = seen = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in held.items():
                if own:
                    both = np.fromiter(own.values(), np.int64, len(own))
                    terms = pa.array(list(own), pa.binary()).cast(pa.string())
                    names = [pa.repeat(pa.scalar(x, pa.string()), len(own)) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*names, terms, pa.array(both & A_DOCUMENT - 1), pa.array(both >> 40)], schema=kind)
            held.clear()

        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                own = held.setdefault((lang, source), {})
                before, get = len(own), own.get
                for term, n in Counter(words_of(text)).items():
                    own[term] = get(term, 0) + (A_DOCUMENT | n)
                size, seen = size + len(own) - before, seen + 1
                if size > HELD or seen == HELD:
                    yield from flush()
                    size = seen = 0
        yield from flush()

    ship(docs.sparkSession)
    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(count, schema)


def kept_words(counted: DataFrame, least_documents: int) -> DataFrame:
    """lang, term, n, own: the words of enough documents, with the count of each source that has
    them. Dealt out once by language and word; sums run before anything is collected."""
    dealt = counted.repartition(task_count(counted.sparkSession), "lang", "term")
    sums = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    words = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("own"))
    return words.filter(F.col("docs") >= least_documents).drop("docs")


def _share(count: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), exact beyond 64 bits; null where no word is kept."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, (F.col("total") + 2 * F.col("kept")).cast("decimal(20,0)")) + 1


def _departure(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(words: DataFrame) -> DataFrame:
    """lang, a, b, value: the departures of each two sources (positions a < b), summed over words.

    words: lang, base (share of each source of the language in a word it lacks), at and share
    (positions and shares of the sources that have the word). A task compares tiles of sources, so that neither
    many words nor many sources fill it; sums of the words of a task combine before the shuffle.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for lang, part in d.groupby("lang", sort=False):
                base = np.asarray(part["base"].iloc[0], np.int64)
                step = max(1, CELLS // len(base))
                for i in range(0, len(part), step):
                    share = np.repeat(base[None, :], len(part[i : i + step]), axis=0)
                    for row, at, own in zip(share, part["at"].iloc[i : i + step], part["share"].iloc[i : i + step]):
                        row[at] = own
                    yield from tiles(lang, share)

    def tiles(lang: str, share: np.ndarray) -> Iterator[pd.DataFrame]:
        n = share.shape[1]
        for a0 in range(0, n, TILE):
            for b0 in range(a0, n, TILE):
                p, q = share[:, a0 : a0 + TILE], share[:, b0 : b0 + TILE]
                total = np.zeros((p.shape[1], q.shape[1]), np.int64)
                for k in range(p.shape[1]):
                    gap, both = p[:, k, None] - q, p[:, k, None] + q
                    total[k] = (gap * gap // both).sum(axis=0)
                a, b = np.indices(total.shape)
                a, b = a.ravel() + a0, b.ravel() + b0
                yield pd.DataFrame({"lang": lang, "a": a, "b": b, "value": total.ravel()})[a < b]

    sums = map_batches(words.select("lang", "base", "at", "share"), compare, "lang string, a int, b int, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS
) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its distance to every
    other one (part `pair`), and the `top` words it favours over the language (part `term`).

    A word counts if it stands in `least_documents` documents of the language. Null language,
    source and text are ''. Repeated rows are documents each; a group without words still has its
    pairs, of value 0 where the language keeps no word; a language with one source has no pair; an
    empty table gives no rows. Texts are read whole, whatever their length, and other columns not
    at all. The result has a row for every two sources of a language, and so has what a task hands on.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    groups = rows.select("lang", "source").distinct()
    words = durable(kept_words(term_counts(rows), least_documents))
    own = words.select("lang", "term", F.col("n").alias("lang_n"), F.explode("own").alias("x")).select("lang", "x.source", "term", "x.n", "lang_n")

    langs = words.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    sources = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    sources = durable(sources.select("lang", "source", place.alias("at"), "total", "kept", "lang_total"))

    shares = own.join(sources, ["lang", "source"])
    of_lang = F.struct(F.col("lang_total").alias("total"), "kept").alias("of_lang")
    shares = durable(
        shares.select("lang", "source", "term", "at", "lang_n", of_lang, _share(F.col("n")).alias("p"))
        .select("*", F.col("of_lang.total").alias("total"), F.col("of_lang.kept").alias("kept"))
        .select("lang", "source", "term", "at", "p", _share(F.col("lang_n")).alias("q"))
    )
    favoured = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _departure(F.col("p"), F.col("q")).alias("value"))

    base = sources.filter(F.col("kept") > 0).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", _share(F.lit(0)).alias("p0")))).alias("all"))
    base = base.select("lang", F.transform("all", lambda x: x["p0"]).alias("base"))
    per_word = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p")).alias("own"))
    per_word = per_word.select("lang", F.col("own.at").alias("at"), F.col("own.p").alias("share"))
    sums = durable(pair_sums(per_word.join(base, "lang")))

    one, other = (sources.select("lang", F.col("at").alias(k), F.col("source").alias(f"source_{k}"), "kept") for k in ("a", "b"))
    wordless = one.filter(F.col("kept") == 0).join(other.drop("kept"), "lang").filter(F.col("a") < F.col("b"))
    wordless = wordless.select("lang", "source_a", "source_b", F.lit(0).cast("long").alias("value"))
    named = sums.join(one.drop("kept"), ["lang", "a"]).join(other.drop("kept"), ["lang", "b"]).select("lang", "source_a", "source_b", "value").unionByName(wordless)
    both = F.explode(F.array(F.struct(F.col("source_a").alias("s"), F.col("source_b").alias("o")), F.struct(F.col("source_b").alias("s"), F.col("source_a").alias("o")))).alias("x")
    pairs = named.select("lang", both, "value").select("lang", F.col("x.s").alias("source"), F.lit("pair").alias("part"), F.col("x.o").alias("item"), "value")

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = [d.withColumn("rank", F.row_number().over(order)) for d in (pairs, favoured)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def divergence_sql(least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> str:
    return rf"""
with d as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
),
w as (select row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n, count(distinct row) as docs from w group by all),
k as (select lang, term, sum(n) as n from c group by all having sum(docs) >= {least_documents}),
v as (select lang, count(*) as kept, sum(n) as total from k group by lang),
g as (
  select g.lang, g.source, coalesce(max(v.kept), 0) as kept, coalesce(sum(c.n), 0) as total
  from (select distinct lang, source from d) g left join k on k.lang = g.lang
    left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join v on v.lang = g.lang
  group by g.lang, g.source
),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)::hugeint) // (g.total + 2 * g.kept)::hugeint as p,
    1 + (1000000000::hugeint * (k.n + 2)::hugeint) // (v.total + 2 * v.kept)::hugeint as q
  from g join k on k.lang = g.lang join v on v.lang = g.lang
    left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item,
    coalesce((select sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) from p x join p y on y.lang = x.lang and y.term = x.term
      where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from p where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms)
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from ranked where part = 'pair' or rank <= {top}"""
