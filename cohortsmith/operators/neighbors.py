"""k nearest rows by squared Euclidean distance, exact or by random projections, without a cross join.

Both methods put points into cells, decide which cells a query row must look into, and compare the
pairs of a cell in numpy blocks inside cogrouped tasks. What decides travels as (query, cell) alone;
vectors are joined to the blocks that compare them, and only ids and distances of the k best of a
block leave a task. Blocks are compared in rounds that shuffle a few vectors for each row, however many
pairs there are; the k best so far are written after each round, whose shuffle files go. A product of
matrices tells which pairs of a block can be among the k best, and those alone are computed exactly.
Identical rows are collapsed first, so a large group of copies costs what k+1 of them cost.

exact: cells lie around pivots. A row first searches its own cell; the distance found there and the
triangle inequality tell which pages of cells can still hold a nearer row. In many dimensions without
clusters few can be ruled out, and the cost nears that of all pairs.
lsh: cells are the sides of random hyperplanes through the middle of the data, in several tables; a
query also looks across the planes that it lies closest to. Near rows can be missed: `recall` says
how many. A query that finds too few rows is answered exactly.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import digest, hash_int
from ..session import durable, fresh_folder, join_on, release, task_count
from .ranking import top_k

# Tasks receive these functions by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points and queries of a block at most, distances held at once inside a task.
POINTS, QUERIES, BLOCK_CELLS = 32_768, 32_768, 4_000_000
#: Rows of a block that are not worth a task of their own.
LEAST_BLOCK = 1_024
#: Vectors that a round shuffles, for each query and point; fewer than the second number are one round.
ROUND_SHARE, ROUND_ROWS = 2, 1 << 20
#: Pairs of a tile of distances.
TILE_ROWS, TILE_COLUMNS = 16, 4_096
#: Vectors by which the hyperplanes are laid through the middle of the data.
SAMPLE = 10_000


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differences first, one dimension after the other: no cancellation, fixed order. A tile of
    pairs goes through all dimensions while it is in the processor's cache."""
    d = np.zeros((len(a), len(b)))
    columns = np.ascontiguousarray(b.T)
    spare = np.empty((TILE_ROWS, TILE_COLUMNS))
    for lo in range(0, len(a), TILE_ROWS):
        for left in range(0, len(b), TILE_COLUMNS):
            tile = d[lo : lo + TILE_ROWS, left : left + TILE_COLUMNS]
            step = spare[: tile.shape[0], : tile.shape[1]]
            for j in range(a.shape[1]):
                np.subtract(a[lo : lo + TILE_ROWS, j, None], columns[None, j, left : left + TILE_COLUMNS], out=step)
                np.multiply(step, step, out=step)
                tile += step
    return d


def first_k(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least of each row, by value and then by column; not-a-numbers come last."""
    if d.shape[1] <= k:
        best = np.argsort(d, axis=1, kind="stable")
        return np.repeat(np.arange(len(d)), best.shape[1]), best.ravel()
    last = np.partition(d, k - 1, axis=1)[:, k - 1, None]
    row, column = np.nonzero(~(d > last))  # those as good as the k-th, in the order of row and column
    order = np.lexsort((column, d[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _paired(a: np.ndarray, b: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """squared_distances of single pairs: the same numbers, in the same order."""
    d = np.zeros(len(row))
    for j in range(a.shape[1]):
        step = a[row, j] - b[column, j]
        d += step * step
    return d


def nearest_of(a: np.ndarray, b: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and squared distance of the k columns of b nearest to each row of a, by distance and
    then by column; parts of the rows at a time.

    |a|^2 + |b|^2 - 2ab in single precision is off by less than `slack`, so whatever lies beyond the
    k-th least of its minima over groups of columns by more than twice that is none of the k best.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        centre = b.mean(axis=0) if len(b) else np.zeros(a.shape[1])
        near, far = (a - centre).astype("float32"), (b - centre).astype("float32")
        own, other = np.square(near, dtype="float64").sum(axis=1), np.square(far, dtype="float64").sum(axis=1)
    most = own.max(initial=0) + other.max(initial=0)
    if len(b) <= 4 * k or not 1e-30 < most < 1e30:  # few columns, not-a-numbers, or beyond single precision
        for part in _slices(len(a), len(b)):
            d = squared_distances(a[part], b)
            row, column = first_k(d, k)
            yield row + part.start, column, d[row, column]
        return
    slack = 2.0**-24 * (a.shape[1] + 16) * (np.sqrt(own) + np.sqrt(other.max())) ** 2
    minus, beyond = np.ascontiguousarray(-2 * far.T), other.astype("float32")
    groups = np.arange(0, len(b), max(1, len(b) // max(256, 4 * k)))
    for part in _slices(len(a), len(b)):
        d = near[part] @ minus
        d += beyond
        least = np.partition(np.minimum.reduceat(d, groups, axis=1), k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero(d <= np.nextafter((least + 2 * slack[part]).astype("float32"), np.float32(np.inf))[:, None])
        exact = _paired(a[part], b, row, column)
        order = np.lexsort((column, exact, row))
        row, column, exact = row[order], column[order], exact[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield row[kept] + part.start, column[kept], exact[kept]


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype="float64").reshape(len(col), -1)


def _slices(rows: int, width: int) -> Iterator[slice]:
    """Parts of the rows whose distances to `width` others fit a block."""
    step = max(1, BLOCK_CELLS // max(1, width))
    return (slice(lo, lo + step) for lo in range(0, rows, step))


def _best_of_block(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Cogroup function: the k best points of a block for each of its queries, ties by id."""

    def run(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(s):
            s = s.sort_values("id", kind="stable")
            ids, sv, qv = s["id"].to_numpy(), _matrix(s["vec"]), _matrix(q["qvec"])
            # Points are in the order of their ids, so ties are too.
            for row, column, dist2 in nearest_of(qv, sv, k):
                out.append(pd.DataFrame({"qid": q["qid"].to_numpy()[row], "dist2": dist2, "id": ids[column]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": [], "dist2": [], "id": []})

    return run


def _search(requests: DataFrame, queries: DataFrame, members: DataFrame, points: DataFrame, k: int, once: bool = True) -> DataFrame:
    """qid, dist2, id: the k best points of the cells that each query asks for, written.

    requests: qid, cell. members: id, cell; `once` says that a query meets a point in one cell alone.
    queries: qid, qvec. points: id, vec. A cell is cut on both sides by a table of its sizes, so no task
    holds more than one block of each. Pairs of blocks are dealt over rounds.
    """
    spark = points.sparkSession
    rows, fair = queries.count() + points.count(), _fair(queries)
    asked = requests.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    held = members.groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
    n_q, n_s = (F.ceil(F.col(c) / min(most, fair)).cast("int") for c, most in (("asked", QUERIES), ("held", POINTS)))
    vectors = F.col("asked") * n_s + F.col("held") * n_q
    cuts = durable(asked.join(held, "cell").select("cell", n_q.alias("n_q"), n_s.alias("n_s"), vectors.alias("vectors")))
    total = cuts.agg(F.sum("vectors")).first()[0] or 0
    rounds = max(1, math.ceil(total / max(ROUND_ROWS, ROUND_SHARE * rows)))
    cuts = cuts.drop("vectors")
    keys, tasks = ["cell", "sc", "qc"], 4 * task_count(spark)

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one_of(n: str, salt: str, col: str):
        return (hash_int(salt, F.col(col)) % F.col(n)).cast("int")

    schema = T.StructType(
        [T.StructField("qid", queries.schema["qid"].dataType), T.StructField("dist2", T.DoubleType()), T.StructField("id", points.schema["id"].dataType)]
    )
    best, before = None, None
    for r in range(rounds):
        now = F.pmod(F.xxhash64("cell", "sc"), F.lit(rounds)) == r
        q = requests.join(cuts, "cell").withColumn("sc", every("n_s")).filter(now).withColumn("qc", one_of("n_q", "q", "qid")).select(*keys, "qid")
        s = members.join(cuts, "cell").withColumn("sc", one_of("n_s", "s", "id")).filter(now).withColumn("qc", every("n_q")).select(*keys, "id")
        q = join_on(q, queries, ["qid"]).repartition(tasks, *keys)
        s = join_on(s, points.select("id", "vec"), ["id"]).repartition(tasks, *keys)
        found = q.groupBy(*keys).cogroup(s.groupBy(*keys)).applyInPandas(_best_of_block(k), schema)
        found = found if best is None else found.unionByName(best)
        folder = fresh_folder(spark)
        best = durable(_best(found if once else found.groupBy("qid", "id").agg(F.min("dist2").alias("dist2")), k).select("qid", "dist2", "id"), folder)
        if before:
            release(spark, [before])
        before = folder
    return best


def _fair(queries: DataFrame) -> int:
    """Rows of a block that leave pairs of blocks for all tasks."""
    return max(LEAST_BLOCK, math.ceil(queries.count() / (2 * math.ceil(math.sqrt(task_count(queries.sparkSession))))))


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, k, [F.asc("dist2"), F.asc("id")], ["qid"]).drop("rank")


def _placed(rows: DataFrame, id_col: str, vec_col: str, pivots: np.ndarray) -> DataFrame:
    """id, cell, radius: the nearest pivot of each row and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"])
            for part in _slices(len(b), len(pivots)):
                d = squared_distances(x[part], pivots)
                cell = d.argmin(axis=1)
                yield pd.DataFrame({id_col: b[id_col].to_numpy()[part], "cell": cell, "radius": np.sqrt(d[np.arange(len(d)), cell])})

    fields = [rows.schema[id_col], T.StructField("cell", T.LongType()), T.StructField("radius", T.DoubleType())]
    return rows.select(id_col, F.col(vec_col).alias("v")).mapInPandas(run, T.StructType(fields))


def _open_cells(queries: DataFrame, pivots: np.ndarray, stats: pd.DataFrame, pages: np.ndarray | None = None) -> DataFrame:
    """qid, cell: cells that may still hold a row within `reach` of the query, its own left out. With
    the first cell of each page of neighbouring cells: qid and page, where any cell or its own is open."""
    cells = stats["cell"].to_numpy()
    far, near = stats["far"].to_numpy(), stats["near"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, ids = _matrix(b["qvec"]), b["qid"].to_numpy()
            own_cell, reaches = b["cell"].to_numpy(), b["reach"].to_numpy()
            for part in _slices(len(b), 4 * len(pivots)):
                own = own_cell[part]
                d = np.sqrt(squared_distances(x[part], pivots))
                at = d[:, cells]
                low = np.maximum(at - far, near - at)
                # Points of a cell lie on its side of the plane between the two pivots.
                gap = np.sqrt(squared_distances(pivots[own], pivots[cells]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (at**2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * gap)
                low = np.maximum(low, np.where(gap > 0, plane, 0.0))
                reach = reaches[part][:, None]
                ok, home = low <= reach * (1 + 1e-9) + 1e-12, cells[None, :] == own[:, None]
                i, j = np.nonzero(ok & ~home if pages is None else np.logical_or.reduceat(ok | home, pages, axis=1))
                yield pd.DataFrame({"qid": ids[part][i], "cell": cells[j] if pages is None else j})

    return queries.mapInPandas(run, T.StructType([queries.schema["qid"], T.StructField("cell", T.LongType())]))


def _paged(placed: DataFrame, stats: pd.DataFrame, pages: np.ndarray) -> DataFrame:
    """id, cell: the page of each point's cell."""
    number = np.zeros(int(stats["cell"].max()) + 1, dtype="int64")
    number[stats["cell"].to_numpy()] = np.searchsorted(pages, np.arange(len(stats)), "right") - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=number[b["cell"].to_numpy()])

    members = placed.select("id", "cell")
    return members.mapInPandas(run, members.schema)


def page_starts(sizes: np.ndarray, most: int) -> np.ndarray:
    """Where each page begins: cells in their order, as many as hold `most` rows, one at least."""
    starts, held = [], most
    for i, n in enumerate(sizes.tolist()):
        if held + n > most:
            starts.append(i)
            held = 0
        held += n
    return np.array(starts, dtype="int64")


def _homes(queries: DataFrame, points: DataFrame, k: int, pivots: int | None) -> tuple[np.ndarray, DataFrame, pd.DataFrame, DataFrame, DataFrame]:
    """Pivots; cell of each point; size and radii of each cell; the k best of each query's own cell;
    and the queries with their cell and the distance within which nearer rows can lie.

    As many pivots as the square root of the points, a quarter of it: that many vectors are on the
    driver and in every task.
    """
    n = points.count()
    wanted = pivots or max(1, math.isqrt(n) // 4)
    picked = points.orderBy(digest("pivot", F.col("id"))).select("vec").limit(wanted).collect()
    centre = np.unique(np.array([r[0] for r in picked], dtype="float64").reshape(len(picked), -1), axis=0)
    placed = durable(_placed(points, "id", "vec", centre))
    radii = placed.groupBy("cell").agg(F.min("radius").alias("near"), F.max("radius").alias("far"), F.count(F.lit(1)).alias("n"))
    stats = radii.orderBy("cell").toPandas()  # one row per pivot
    home = durable(_placed(queries, "qid", "qvec", centre))
    found = _search(home.select("qid", "cell"), queries, placed.select("id", "cell"), points, k)
    # A cell with too few rows bounds nothing: every cell stays open for those queries.
    far = found.groupBy("qid").agg(F.when(F.count(F.lit(1)) == k, F.sqrt(F.max("dist2"))).otherwise(F.lit(float("inf"))).alias("reach"))
    bounded = join_on(home, far, ["qid"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    return centre, placed, stats, found, join_on(bounded, queries, ["qid"])


def pivot_requests(queries: DataFrame, points: DataFrame, k: int, pivots: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, found, requests) of the exact search: the cell of each point, the k best of each
    query's own cell, and the other cells that each query must still look into."""
    centre, placed, stats, found, bounded = _homes(queries, points, k, pivots)
    return placed.select("id", "cell"), found, durable(_open_cells(bounded, centre, stats))


def _exact(queries: DataFrame, points: DataFrame, k: int, pivots: int | None) -> DataFrame:
    if points.isEmpty():
        return queries.limit(0).select("qid", F.lit(0.0).alias("dist2"), F.col("qid").alias("id"))
    centre, placed, stats, _, bounded = _homes(queries, points, k, pivots)
    # Pages of cells: a query's vector goes to a page once, however many of its cells are open.
    pages = page_starts(stats["n"].to_numpy(), min(POINTS, _fair(queries)))
    folder = fresh_folder(points.sparkSession)
    requests = durable(_open_cells(bounded, centre, stats, pages), folder)
    best = _search(requests, queries, durable(_paged(placed, stats, pages)), points, k)
    release(points.sparkSession, [folder])
    return best


def _projected_cells(rows: DataFrame, id_col: str, vec_col: str, planes: np.ndarray, middle: np.ndarray, probes: int) -> DataFrame:
    """id, cell: the side of each table's planes a row lies on, and the sides across the `probes`
    planes nearest to it. planes: tables x bits x dimensions."""
    tables, bits, _ = planes.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"])
            ids, cells = [], []
            for t in range(tables):
                margin = x @ planes[t].T - middle[t]
                code = ((margin > 0) << np.arange(bits)).sum(axis=1).astype(np.int64) | t << 40
                ids.append(b[id_col].to_numpy())
                cells.append(code)
                for flip in np.argsort(np.abs(margin), axis=1)[:, :probes].T:
                    ids.append(b[id_col].to_numpy())
                    cells.append(code ^ (1 << flip.astype(np.int64)))
            yield pd.DataFrame({id_col: np.concatenate(ids), "cell": np.concatenate(cells)})

    return rows.select(id_col, F.col(vec_col).alias("v")).mapInPandas(run, T.StructType([rows.schema[id_col], T.StructField("cell", T.LongType())]))


def _lsh(queries: DataFrame, points: DataFrame, k: int, tables: int, bucket_rows: int, probes: int, seed: int) -> DataFrame:
    n = points.count()
    if not n:
        return _exact(queries, points, k, None)
    bits = max(0, math.ceil(math.log2(max(1, n / bucket_rows))))
    # A bounded sample lays the planes; every point is in a cell of each table.
    sample = np.array([r[0] for r in points.orderBy(digest("plane", F.col("id"))).select("vec").limit(SAMPLE).collect()], dtype="float64")
    planes = np.random.default_rng(seed).normal(size=(tables, bits, sample.shape[1]))
    middle = np.median(np.einsum("nd,tbd->tbn", sample, planes), axis=2)
    folders = [fresh_folder(points.sparkSession) for _ in range(2)]
    members = durable(_projected_cells(points, "id", "vec", planes, middle, 0), folders[0])
    requests = durable(_projected_cells(queries, "qid", "qvec", planes, middle, probes).distinct(), folders[1])
    best = _search(requests, queries, members, points, k, once=False)
    release(points.sparkSession, folders)
    enough = best.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, n)).select("qid")
    short = durable(join_on(queries, enough, ["qid"], "left_anti"))
    if short.isEmpty():
        return best
    return join_on(best, enough, ["qid"], "left_semi").unionByName(_exact(short, points, k, None).select("qid", "dist2", "id").select(*best.columns))


def nearest_rows(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    id_col: str,
    vec_col: str,
    tag_col: str | None = None,
    method: str = "exact",
    pivots: int | None = None,
    tables: int = 10,
    bucket_rows: int = 1_000,
    probes: int = 2,
    seed: int = 7,
    vectors: bool = True,
) -> DataFrame:
    """The k nearest points of every query row, itself left out: id, nb_id, nb_rank,
    dist2, nb_vec (without `vectors` left out) and the point's tag. Ties go to the lower id. `method`
    is 'exact', or 'lsh' for random projections (tables, bucket_rows, probes, seed)."""
    if method not in ("exact", "lsh"):
        raise ValueError("method must be 'exact' or 'lsh'")
    # Single precision travels as it is; tasks compute in double precision.
    kinds = [d.schema[vec_col].dataType for d in (queries, points)]
    single = all(isinstance(t, T.ArrayType) and isinstance(t.elementType, T.FloatType) for t in kinds)
    vec = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    tag = (F.col(tag_col) if tag_col else F.lit(0)).cast("int")
    base = points.select(F.col(id_col).alias("id"), vec.alias("vec"), tag.alias("tag"))
    # One row more than k, because a query row may meet itself.
    kept = durable(top_k(base, k + 1, [F.asc("id")], ["vec"]).drop("rank"))
    asked = queries.select(F.col(id_col).alias("qid"), vec.alias("qvec"))
    distinct = durable(top_k(asked, 1, [F.asc("qid")], ["qvec"]).drop("rank"))
    if method == "exact":
        best = _exact(distinct, kept, k + 1, pivots)
    else:
        best = _lsh(distinct, kept, k + 1, tables, bucket_rows, probes, seed)
    best = durable(best)  # the search is the costly part, and its result is small
    shown = ["id", "tag", *(["vec"] if vectors else [])]
    named = join_on(best, kept.select(*shown), ["id"])
    near = named.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("dist2", *shown))).alias("_near"))
    per_vec = join_on(distinct, near, ["qid"]).select("qvec", "_near")
    rows = join_on(asked, per_vec, ["qvec"])
    others = F.slice(F.filter("_near", lambda x: x["id"] != F.col("qid")), 1, k)
    return rows.select(F.col("qid").alias("id"), F.posexplode(others).alias("_pos", "_n")).select(
        "id",
        F.col("_n.id").alias("nb_id"),
        (F.col("_pos") + 1).alias("nb_rank"),
        F.col("_n.dist2").alias("dist2"),
        *([F.col("_n.vec").cast("array<double>").alias("nb_vec")] if vectors else []),
        F.col("_n.tag").alias("nb_tag"),
    )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """wanted, hit, recall: how many of the exact neighbours an approximate search found. A row at
    the distance of the last neighbour counts, whichever of equals it is."""
    last = exact.groupBy("id").agg(F.max("dist2").alias("reach"), F.count(F.lit(1)).alias("wanted"))
    within = join_on(found.select("id", "dist2"), last.select("id", "reach"), ["id"]).filter(F.col("dist2") <= F.col("reach"))
    hits = within.groupBy("id").agg(F.count(F.lit(1)).alias("hit"))
    every = join_on(last, hits, ["id"], "left")
    hit, wanted = F.sum(F.least(F.coalesce("hit", F.lit(0)), F.col("wanted"))), F.sum("wanted")
    return every.agg(wanted.alias("wanted"), hit.alias("hit"), (hit / wanted).alias("recall"))
