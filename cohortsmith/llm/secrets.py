"""Secret scan by corpus-wide ownership frequency.

Keyed values, access keys and long hexadecimal runs are spans wherever they stand. A run of token
characters that no keyword announces is only a candidate: it becomes a span if its hash belongs to
one owner in the whole corpus, since an example from a manual is copied by many owners and a live
credential is not. The same counts tell copied from owner-specific values among the other spans.
Everything here is a DataFrame expression; values leave the scan as hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable


def either_case(words: str) -> str:
    """The pattern with each letter in either case: ASCII letters alone, in every engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: Fixed patterns, in the order that ties of a start follow. Runs of a single class are maximal, so
#: their least length stands in the pattern: a run that is too short holds no longer one.
PATTERNS = {
    "assign": f"({either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "[0-9a-f]{32,}",
    "opaque": "[A-Za-z0-9_-]{20,}",
}
LEAST_ASSIGNED = 8
#: Different characters that an unannounced run must have to look like a credential, beside a digit and a letter.
VARIETY = 10
#: Owners from which a value counts as a widely copied example.
COPIED_OWNERS = 3

_FOUND = "array<struct<start:int,end:int,kind:string,hash:string>>"


def _looks_live(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= VARIETY)


def spans_of(text: Column, kind: str) -> Column:
    """start, end (code points, end exclusive), kind, hash of the leftmost non-overlapping matches
    that pass. Where they stand follows from the lengths of the pieces between them."""
    pattern = PATTERNS[kind]
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("n"), h.alias("hit")),
    )

    def step(acc: Column, x: Column) -> Column:
        value = F.regexp_extract(x["hit"], pattern, 2) if kind == "assign" else x["hit"]
        ok = {"assign": F.length(value) >= LEAST_ASSIGNED, "opaque": _looks_live(value)}.get(kind, x["hit"].isNotNull())
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["n"], F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.sha2(value, 256).alias("hash"))
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    none = F.array().cast(_FOUND)
    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]
    return F.when(text.rlike(pattern), found).otherwise(none)


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """row, doc_id, owner, repo, base, extra of every row, written once: no text goes further.

    `extra` holds the candidates that need the corpus to judge them: opaque runs apart from all
    base spans. A null text is empty; a null owner or repository is one of its own.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(f"`{repo_col}`").cast("string"), F.lit("")).alias("repo"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    found = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "owner",
        "repo",
        F.concat(*[spans_of(F.col("text"), k) for k in PATTERNS if k != "opaque"]).alias("base"),
        spans_of(F.col("text"), "opaque").alias("opaque"),
    )
    apart = F.filter("opaque", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (b["end"] > o["start"])))
    return durable(found.select("row", "doc_id", "owner", "repo", "base", apart.alias("extra")))


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repos: in how many owners and repositories (one owner's) each value stands.

    Counted in steps that each combine before they shuffle, so a value that stands in a third of
    all rows arrives as one row a task.
    """
    each = found.select("owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("base", "extra"), lambda x: x["hash"]))).alias("hash"))
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repos"))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    copied_owners: int = COPIED_OWNERS,
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_opaque, n_copied, n_owned, base_sha256, spans of every row.

    `spans` lists kind:start:end of the base spans and of the owner-specific opaque runs;
    base_sha256 is the digest of the base ones' list. n_copied and n_owned count spans whose value
    stands with at least `copied_owners` owners, or with one alone. Null and empty texts have no
    span; rows that repeat are judged each by itself, and count as one repository if owner and
    repository agree; an empty table gives no rows. Texts are scanned whole, of any length; only the
    four columns named are read, so other columns may have any name.
    """
    found = scan(docs, id_col, text_col, owner_col, repo_col)
    owned = durable(ownership(found))
    each = found.select("row", F.explode(F.concat("base", "extra")).alias("s")).select("row", "s.*")
    judged = each.join(owned, "hash").groupBy("row").agg(
        F.collect_list(F.when((F.col("kind") == "opaque") & (F.col("owners") == 1), F.struct("start", "end", "kind"))).alias("added"),
        F.count(F.when((F.col("kind") != "opaque") & (F.col("owners") >= copied_owners), 1)).alias("n_copied"),
        F.count(F.when(F.col("owners") == 1, 1)).alias("n_owned"),
    )
    rows = found.join(judged, "row", "left")
    rank = {k: i for i, k in enumerate(PATTERNS)}

    def listed(spans: Column) -> Column:
        """kind:start:end by start, then kind in the order of PATTERNS."""
        place = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
        keyed = F.transform(spans, lambda x: F.struct(x["start"], place[x["kind"]], x["end"], x["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.transform("base", lambda x: F.struct(x["start"], x["end"], x["kind"]))
    added = F.coalesce("added", F.array().cast("array<struct<start:int,end:int,kind:string>>"))

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id",
        *[of_kind(k) for k in PATTERNS if k != "opaque"],
        F.size(added).cast("long").alias("n_opaque"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
        F.coalesce("n_owned", F.lit(0)).cast("long").alias("n_owned"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.concat(base, added)).alias("spans"),
    )


def secrets_sql(copied_owners: int = COPIED_OWNERS) -> str:
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    passes = {
        "assign": f"len(regexp_extract(hit, '{quoted['assign']}', 2)) >= {LEAST_ASSIGNED}",
        "opaque": f"regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[A-Za-z]') and len(list_distinct(string_split(hit, ''))) >= {VARIETY}",
    }
    scans = " union all ".join(
        f"""select row, '{k}' as kind, {i} as place, start, start + length(hit) as finish,
  {f"regexp_extract(hit, '{quoted[k]}', 2)" if k == "assign" else "hit"} as value
from (select row, hits[i] as hit,
        coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as start
      from (select row, gaps, hits, unnest(generate_series(1, len(hits))) as i
            from (select row, string_split_regex(text, '{quoted[k]}') as gaps, regexp_extract_all(text, '{quoted[k]}') as hits
                  from d where regexp_matches(text, '{quoted[k]}'))))
where {passes.get(k, "true")}"""
        for i, k in enumerate(PATTERNS)
    )
    item = "kind || ':' || cast(cast(start as bigint) as varchar) || ':' || cast(cast(finish as bigint) as varchar)"
    return f"""
with d as (
  select row_number() over () as row, doc_id, coalesce(source, '') as owner,
         coalesce(cast(doc_id as varchar), '') as repo, coalesce(text, '') as text from documents
),
found as ({scans}),
apart as (
  select f.* from found f where kind <> 'opaque' or not exists (
    select 1 from found b where b.row = f.row and b.kind <> 'opaque' and b.start < f.finish and b.finish > f.start)
),
owned as (select value, count(distinct owner) as owners from apart join d using (row) group by value),
judged as (select row, kind, place, start, finish, owners from apart join owned using (value)),
listed as (
  select row, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
    count(*) filter (where kind = 'hex') as n_hex, count(*) filter (where kind = 'opaque' and owners = 1) as n_opaque,
    count(*) filter (where kind <> 'opaque' and owners >= {copied_owners}) as n_copied,
    count(*) filter (where owners = 1) as n_owned,
    string_agg({item}, ',' order by start, place) filter (where kind <> 'opaque') as base,
    string_agg({item}, ',' order by start, place) filter (where kind <> 'opaque' or owners = 1) as spans
  from judged group by row
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  coalesce(n_opaque, 0) as n_opaque, coalesce(n_copied, 0) as n_copied, coalesce(n_owned, 0) as n_owned,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join listed using (row)"""
