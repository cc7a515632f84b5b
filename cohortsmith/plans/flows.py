"""The three studies: hold-out with cross-validation, leave-one-out, nested search.

Input rows carry an id, a 0/1 label and one array column of features (null or NaN means
missing). Wide tables become that form with F.array over the kept columns.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import resample as RS
from ..operators.folds import assign_folds, assign_holdout, fold_audit, fold_validity
from ..operators.labels import require_two_classes
from ..operators.models import COEFFICIENT_FLOOR, coefficient_importance, feature_importance, narrowed, projected, run_parallel, score, select_l1_or_fallback
from ..operators.multifit import Fit, Fitted, fit_many, leave_one_out, recipe_of, score_many, weigh
from ..operators.ranking import hash_rank
from ..operators.reduce import fit_pca, project, width
from ..operators.report import best_model, stack_folds, summarize_folds
from ..operators.select import FALLBACK_RULES, anova_f, select_k_best
from ..operators.shape import explode_features
from ..operators.treefit import DEFAULTS, TreeFit, fits_a_task, score_trees
from ..operators.tuning import (
    fit_named,
    fold_auc,
    inner_score,
    out_of_fold,
    param_grid,
    pick_best,
    sample_params,
)
from ..operators.weights import weigh_for_fit
from ..session import durable, join_on
from .recipes import FOLD, apply_recipe, fold_recipes, recipe_rows

ID = "row_id"
#: Rule for the features kept by F where an L1 stage keeps none.
FALLBACK = "at_most_25"


@dataclass
class Study:
    """Results of a flow."""

    scores: DataFrame
    records: DataFrame
    selected: DataFrame | None = None
    best: DataFrame | None = None
    errors: dict = field(default_factory=dict)


def _standard(df: DataFrame, id_col: str, array_col: str, label: str) -> DataFrame:
    return df.select(
        F.col(id_col).alias(ID), F.col(label).cast("int").alias("label"), F.col(array_col).cast("array<double>").alias("x")
    ).filter(F.col("label").isNotNull())


def _long(tagged: DataFrame) -> DataFrame:
    return explode_features(tagged, [ID, "label", *FOLD], "x")


def resampled(train: DataFrame, method: str | None, k: int = 5, seed: int = 42) -> DataFrame:
    """Training rows plus synthetic ones; with fewer than two minority rows, as they are."""
    if method is None:
        return train
    flat = train.select(ID, "label", vector_to_array("features").alias("x"))
    make = {"smote": RS.smote, "borderline": RS.borderline_smote, "adasyn": RS.adasyn}[method]
    made = make(flat, ID, "x", k=k, seed=seed)
    both = durable(RS.with_synthetic(flat, made, ID, "x"))
    return both.select(ID, "label", array_to_vector("features").alias("features"))


def _keep_positions(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    cells = vector_to_array("features")
    return df.withColumn("features", array_to_vector(F.array(*[cells[i] for i in positions])))


def _records(scores: DataFrame, thresholds: DataFrame | None, by: list[str]) -> DataFrame:
    """Counts and rates at the threshold, AUC and average precision per group."""
    cut = thresholds if thresholds is not None else scores.select(*by).distinct().withColumn("threshold", F.lit(0.5))
    rates = M.with_rates(M.confusion(M.apply_threshold(scores, cut, by), by))
    points = M.score_points(scores, by)
    rates = join_on(rates, M.roc_auc(points, by), by, "left")
    rates = join_on(rates, M.average_precision(points, by), by, "left")
    return join_on(rates, cut.select(*by, "threshold"), by, "left")


def holdout_study(
    df: DataFrame,
    id_col: str,
    array_col: str,
    label: str = "label",
    models: dict[str, dict] | None = None,
    top: int = 100,
    k: int = 5,
    test_size: float = 0.2,
    seed: int = 42,
    parallelism: int = 4,
) -> Study:
    """Several models on one hold-out split and on k folds; top features by F on training rows.

    Records: one row per model with hold-out rates, and mean and deviation of the fold AUCs. A fit
    that fails raises: no row of the records stands on scores that no model gave.
    """
    models = models or {"RandomForest": {}, "LogisticRegression": {"l1": True, "c": 1.0}, "GradientBoosting": {"rounds": 100}}
    rows = durable(_standard(df, id_col, array_col, label))
    require_two_classes(rows)
    # The hold-out is fold 0 of a plan with two folds: 0 is the test part.
    split = assign_holdout(rows, ID, test_size=test_size, seed=seed)
    once = split.select("*", F.lit(0).alias("repeat"), F.when(F.col("role") == "test", 0).otherwise(1).alias("fold")).drop("role")
    folds = assign_folds(rows, ID, k=k, seed=seed)
    once, folds = durable(once), durable(folds)
    recipe_once = recipe_rows(fold_recipes(_long(once), 2, top))
    recipe_folds = recipe_rows(fold_recipes(_long(folds), k, top))
    keep = [ID, "label", *FOLD]
    hold, cross = [], []
    for name, params in models.items():

        def fit(train, name=name, params=params):
            return fit_named(name, train, params, ID, seed, parallelism)

        def prep(recipes):
            return lambda d, r, f: apply_recipe(d, recipes[(r, f)], keep, "x")

        a = out_of_fold(once, fit, keep, [(0, 0)], prep(recipe_once), 1, must_fit=True)
        b = out_of_fold(folds, fit, keep, [(0, f) for f in range(k)], prep(recipe_folds), parallelism, must_fit=True)
        hold.append(a.scores.withColumn("model", F.lit(name)))
        cross.append(b.scores.withColumn("model", F.lit(name)))
    hold_scores = reduce(DataFrame.unionByName, hold)
    cross_scores = reduce(DataFrame.unionByName, cross)
    auc = fold_auc(cross_scores, ["model", *FOLD]).groupBy("model").agg(
        F.avg("roc_auc").alias("cv_auc_mean"), F.stddev_pop("roc_auc").alias("cv_auc_std")
    )
    records = join_on(_records(hold_scores, None, ["model"]), auc, ["model"], "left")
    order = F.create_map(*[F.lit(v) for i, m in enumerate(models) for v in (m, i)])
    records = durable(records.withColumn("position", F.element_at(order, F.col("model"))))
    return Study(hold_scores, records, best=best_model(records, "cv_auc_mean"))


def leave_one_out_study(
    df: DataFrame,
    id_col: str,
    array_col: str,
    label: str = "label",
    models: dict[str, dict] | None = None,
    l1_c: float | None = 0.1,
    fallback_k: int = 25,
    top: int = 100,
    seed: int = 42,
    parallelism: int = 4,
) -> Study:
    """One fit per row and model, as many as that is: for small cohorts. Elsewhere
    loo_centroid_scores (one pass) or repeated folds say as much."""
    models = models or {"LogisticRegression": {"c": 0.5}}
    rows = durable(_standard(df, id_col, array_col, label))
    require_two_classes(rows)
    n = rows.count()
    numbered = hash_rank(rows, ID, seed, out="_no")
    tagged = durable(numbered.select("*", F.lit(0).alias("repeat"), (F.col("_no") - 1).cast("int").alias("fold")).drop("_no"))
    recipes = recipe_rows(fold_recipes(_long(tagged), n, top))
    keep = [ID, "label", *FOLD]
    parts, errors = [], {}
    for name, params in models.items():

        def fit(train, name=name, params=params):
            kept = select_l1_or_fallback(weigh_for_fit(train)[0], range(width(train)), l1_c, fallback_k)[0] if l1_c else None
            sub = _keep_positions(train, kept) if kept else train
            model = fit_named(name, sub, params, ID, seed, 1)
            return narrowed(model, kept) if kept else model

        got = out_of_fold(tagged, fit, keep, [(0, f) for f in range(n)], lambda d, r, f: apply_recipe(d, recipes[(r, f)], keep, "x"), parallelism)
        errors.update({(name, *x): e for x, e in got.errors.items()})
        parts.append(got.scores.withColumn("model", F.lit(name)))
    scores = reduce(DataFrame.unionByName, parts)
    return Study(scores, _records(scores, None, ["model"]), errors=errors)


def _components(pca, df: DataFrame) -> DataFrame:
    return project(pca, df).drop("features").withColumnRenamed("components", "features")


def _fit_candidate(
    name: str,
    train: DataFrame,
    params: dict,
    seed: int,
    parallelism: int,
    resampler: str | None = None,
    pre_pca: int | None = None,
    l1_c: float | None = None,
    kept: Sequence[int] | None = None,
    fallback: str = FALLBACK,
):
    """Project, keep the best components, resample, choose by L1 at the candidate's C or else at
    `l1_c` (None: no such stage), and fit. `kept` are positions that an L1 stage chose already.
    Returns the model and the positions in use; components come from all of them."""
    chosen = list(range(params["k"]))
    if pre_pca is not None:
        pca = fit_pca(train, pre_pca)
        train = durable(_components(pca, train))
        best = best_components(train, params["k"])
        inner = {**params, "k": len(best)}
        model, _ = _fit_candidate(name, _keep_positions(train, best), inner, seed, parallelism, resampler, l1_c=l1_c, fallback=fallback)
        return projected(narrowed(model, best), pca), chosen
    train = resampled(train, resampler, k=params.get("smote_k", 5), seed=seed)
    c = params.get("l1_c", l1_c)
    if kept is None and c is not None:
        kept, _ = select_l1_or_fallback(weigh_for_fit(train)[0], range(width(train)), c, fallback)
    if kept is not None:
        train = _keep_positions(train, kept)
    model = fit_named(name, train, params, ID, seed, parallelism)
    return (narrowed(model, kept) if kept is not None else model), (kept if kept is not None else chosen)


def best_components(train: DataFrame, k: int) -> list[int]:
    """Positions of the k components with the largest F on these rows, in the order of F."""
    long = explode_features(train.select(ID, "label", vector_to_array("features").alias("x")), [ID, "label"], "x")
    return [r["feature"] for r in select_k_best(anova_f(long), k).orderBy("rank").select("feature").collect()]


@dataclass
class _Plan:
    """What all fits of a nested search share: rows with their views, and the recipe of each view
    and inner fold (-1: the whole training part of the view)."""

    rows: DataFrame
    recipes: dict[tuple[int, int], list[dict]]


def _nested_plan(tagged: DataFrame, k_outer: int, repeats: int, k_inner: int, widest: int, search: bool, seed: int) -> _Plan:
    """Folds of all views, and all recipes, each in one pass. A view is an outer test fold of a repeat."""
    outer = recipe_rows(fold_recipes(_long(tagged), k_outer, widest))
    recipes = {(r * k_outer + f, -1): rows for (r, f), rows in outer.items()}
    own = F.col("repeat") * k_outer
    narrow = tagged.select(ID, "label", F.explode(F.sequence(own.cast("int"), (own + k_outer - 1).cast("int"))).alias("view"), (own + F.col("fold")).alias("_test"))
    inner = assign_folds(narrow.filter("view <> _test").drop("_test"), ID, k=k_inner, seed=seed, by=["view"])
    lists = inner.groupBy(ID).agg(F.map_from_entries(F.collect_list(F.struct("view", "fold"))).alias("_inner"))
    once = tagged.filter("repeat = 0").select(ID, "label", "x")
    at = F.transform(F.sequence(F.lit(0), F.lit(repeats * k_outer - 1)), lambda v: F.coalesce(F.try_element_at("_inner", v), F.lit(-1)))
    rows = durable(join_on(once, lists, [ID]).select(ID, "label", "x", at.alias("views")))
    if search:
        views = rows.select(ID, "label", "x", F.posexplode("views").alias("repeat", "fold")).filter("fold >= 0")
        recipes.update(recipe_rows(fold_recipes(_long(views), k_inner, widest)))
    return _Plan(rows, recipes)


Job = tuple[int, int, int]  # view, inner fold or -1, candidate


def _l1_positions(
    plan: _Plan, jobs: Sequence[Job], candidates: Sequence[dict], l1_c: float | None, fallback: str = FALLBACK
) -> dict[Job, list[int]]:
    """Survivors of each job's L1 stage, or the leading ones by F; all jobs in shared passes."""
    wanted: dict[tuple, list[Job]] = {}
    for v, g, i in jobs:
        c = candidates[i].get("l1_c", l1_c)
        if c is not None:
            wanted.setdefault((v, g, candidates[i]["k"], c), []).append((v, g, i))
    fits = [Fit(v, g, recipe_of(plan.recipes[(v, g)]).first(k), c, l1=True) for v, g, k, c in wanted]
    out: dict[Job, list[int]] = {}
    for key, done in zip(wanted, fit_many(plan.rows, weigh(plan.rows, fits)) if fits else []):
        kept = [j for j, w in enumerate(done.coefficients[:-1]) if abs(w) >= COEFFICIENT_FLOOR]
        kept = kept or list(range(FALLBACK_RULES[fallback](len(done.coefficients) - 1)))
        out.update({job: kept for job in wanted[key]})
    return out


def _joint(plan: _Plan, jobs: Sequence[Job], candidates: Sequence[dict], kept: dict[Job, list[int]]) -> list[Fitted]:
    """The logistic models of all jobs in shared passes."""
    fits = []
    for v, g, i in jobs:
        recipe = recipe_of(plan.recipes[(v, g)]).first(candidates[i]["k"])
        fits.append(Fit(v, g, recipe.only(kept[(v, g, i)]) if (v, g, i) in kept else recipe, candidates[i].get("c", 1.0)))
    return fit_many(plan.rows, weigh(plan.rows, fits))


def _trees(plan: _Plan, model: str, jobs: Sequence[Job], candidates: Sequence[dict], kept: dict[Job, list[int]], seed: int, trained: bool = False) -> tuple[DataFrame, dict[int, str]]:
    """Scores of all jobs' tree models, each grown in a task, and the errors of those that failed."""
    fits = []
    for job in jobs:
        v, g, i = job
        recipe = recipe_of(plan.recipes[(v, g)]).first(candidates[i]["k"])
        own = tuple(sorted((c, x) for c, x in candidates[i].items() if c not in ("k", "l1_c")))
        fits.append(TreeFit(v, g, recipe.only(kept[job]) if job in kept else recipe, own))
    return score_trees(plan.rows, model, fits, ID, trained, seed)


def _job_scores(scored: DataFrame, jobs: Sequence[Job]) -> DataFrame:
    """Scores of fits with the view, inner fold and candidate of each; one row a job on the driver."""
    table = scored.sparkSession.createDataFrame([(n, *job) for n, job in enumerate(jobs)], "fit int, view int, fold int, candidate int")
    return scored.join(table, "fit").drop("fit")


def nested_study(
    df: DataFrame,
    id_col: str,
    array_col: str,
    model: str = "LogisticRegression",
    label: str = "label",
    k_outer: int = 5,
    repeats: int = 3,
    k_inner: int = 3,
    n_iter: int = 20,
    grid: dict[str, Sequence] | None = None,
    scorer: str = "roc_auc",
    tune_on: str = "train",
    resampler: str | None = None,
    pre_pca: int | None = None,
    l1_c: float | None = 0.1,
    fallback: str = FALLBACK,
    seed: int = 42,
    parallelism: int = 4,
) -> Study:
    """Repeated outer folds; inside each a random search over inner folds; the threshold
    with the best F1 on the outer training scores ('test' tunes on the test fold, which
    is optimistic). Every model has an L1 stage after the choice by F; a grid that names l1_c
    tunes it, otherwise it stays at the argument. `fallback` names the rule for how many features
    stay where that stage keeps none.

    Every fitted number, selection included, comes from the training rows of its fold. Folds, recipes,
    L1 stages and logistic models of all folds and candidates are made in shared passes over the
    rows; tree models of a table that fits a task are grown in tasks, a fit in each, and others one by
    one by Spark ML, on what those passes prepared. A fold whose search fails
    is fitted with the model's defaults: its row in `records` says so in `status`.
    """
    if tune_on not in ("train", "test"):
        raise ValueError("tune_on must be 'train' or 'test'")
    rows = durable(_standard(df, id_col, array_col, label))
    require_two_classes(rows)
    p = len(rows.select("x").first()[0])
    candidates = sample_params(grid or param_grid(model, p), n_iter, seed)
    widest = max(c["k"] for c in candidates)
    tagged = durable(assign_folds(rows, ID, k=k_outer, repeats=repeats, seed=seed))
    search = len(candidates) > 1
    plan = _nested_plan(tagged, k_outer, repeats, k_inner, widest, search, seed)
    views = range(repeats * k_outer)
    shared = resampler is None and pre_pca is None
    joint = shared and model == "LogisticRegression" and all(set(c) <= {"k", "c", "l1_c"} for c in candidates)
    grown = shared and model in DEFAULTS and all(set(c) <= {"k", "l1_c", *DEFAULTS[model]} for c in candidates) and fits_a_task(plan.rows, p)
    keep = [ID, "label"]
    errors: dict = {}

    def ready(v: int, g: int, k: int) -> DataFrame:
        """Rows of a view with prepared features: `seen` for training, the others for scoring."""
        fold = F.col("views")[v]
        here = plan.rows if g == -1 else plan.rows.filter(fold != -1)
        return apply_recipe(here.withColumn("seen", (fold != -1) & (fold != g)), plan.recipes[(v, g)][:k], [ID, "label", "seen"], "x")

    def single(job: Job, params: dict, kept: Sequence[int] | None) -> tuple[DataFrame, list[int]]:
        v, g, _ = job
        d = ready(v, g, params["k"])
        fitted, used = _fit_candidate(model, d.filter("seen").drop("seen"), params, seed, 1, resampler, pre_pca, l1_c, kept, fallback)
        todo = d if g == -1 else d.filter("not seen")
        return score(fitted, todo, [*keep, "seen"]), used

    def tables(jobs: Sequence[Job]) -> tuple[DataFrame | None, set[Job]]:
        """Scores of the rows that each job's model left out, and the jobs that failed."""
        if joint:
            return _job_scores(score_many(plan.rows, _joint(plan, jobs, candidates, _l1_positions(plan, jobs, candidates, l1_c, fallback)), [ID]), jobs), set()
        kept = _l1_positions(plan, jobs, candidates, l1_c, fallback) if shared else {}
        failed: set[Job] = set()
        if grown:
            scored, lost = _trees(plan, model, jobs, candidates, kept, seed)
            for n, e in lost.items():
                job = jobs[n]
                errors[(*divmod(job[0], k_outer), *job[1:])] = e
                failed.add(job)
            return _job_scores(scored, jobs), failed

        def attempt(job: Job) -> DataFrame | None:
            try:
                scored, _ = single(job, candidates[job[2]], kept.get(job))
            except Exception as e:  # recorded for the caller
                errors[(*divmod(job[0], k_outer), *job[1:])] = str(e)
                failed.add(job)
                return None
            return scored.select("label", "prob", *[F.lit(x).alias(c) for x, c in zip(job, ("view", "fold", "candidate"))])

        parts: list[DataFrame] = []
        for v in sorted({j[0] for j in jobs}):  # one written table a view
            done = [d for d in run_parallel([lambda j=j: attempt(j) for j in jobs if j[0] == v], parallelism) if d is not None]
            if done:
                parts.append(durable(reduce(DataFrame.unionByName, done)))
        return (reduce(DataFrame.unionByName, parts) if parts else None), failed

    chosen, status = {v: 0 for v in views}, {v: "single" for v in views}
    if search:
        jobs = [(v, g, i) for v in views for g in range(k_inner) for i in range(len(candidates))]
        found: dict[int, list[tuple[int, float | None]]] = {}
        try:
            inner, failed = tables(jobs)
            lost = {(v, i) for v, _, i in failed}  # a candidate is judged on all inner folds or not at all
            for t in inner_score(inner, scorer, ["view"]).collect() if inner is not None else []:
                if (t["view"], t["candidate"]) not in lost:
                    found.setdefault(t["view"], []).append((t["candidate"], t["score"]))
        except Exception as e:  # recorded; every fold goes on with the defaults
            errors["search"] = str(e)
        for v in views:
            usable = [(i, s) for i, s in sorted(found.get(v, [])) if s is not None]
            status[v] = "search" if usable else "fallback"
            chosen[v] = pick_best(usable) if usable else -1
    # A last candidate stands for the defaults of a failed search.
    params_of = [*candidates, {"k": widest}]
    last = [(v, -1, chosen[v] % len(params_of)) for v in views]
    kept = _l1_positions(plan, last, params_of, l1_c, fallback) if shared else {}
    if joint:
        scored = score_many(plan.rows, _joint(plan, last, params_of, kept), [ID], trained=True)
        every = durable(_job_scores(scored, last).select(ID, "label", "view", "role", "prob"))
        used = [kept.get(job, list(range(params_of[job[2]]["k"]))) for job in last]
    elif grown:
        scored, lost = _trees(plan, model, last, params_of, kept, seed, trained=True)
        if lost:
            raise RuntimeError(f"no model of {len(lost)} outer folds: {next(iter(lost.values()))}")
        every = durable(_job_scores(scored, last).select(ID, "label", "view", "role", "prob"))
        used = [kept.get(job, list(range(params_of[job[2]]["k"]))) for job in last]
    else:

        def one(job: Job) -> tuple[DataFrame, list[int]]:
            done, positions = single(job, params_of[job[2]], kept.get(job))
            role = F.when(F.col("seen"), "train").otherwise("test").alias("role")
            return durable(done.select(ID, "label", F.lit(job[0]).alias("view"), role, "prob")), positions

        outcome = run_parallel([lambda j=j: one(j) for j in last], parallelism)
        every, used = reduce(DataFrame.unionByName, [o[0] for o in outcome]), [o[1] for o in outcome]
    outer = [F.floor(F.col("view") / k_outer).cast("int").alias("repeat"), (F.col("view") % k_outer).cast("int").alias("fold")]
    every = every.select(ID, "label", *outer, "role", "prob")
    meta_rows = []
    for (v, _, i), positions in zip(last, used):
        recipe = plan.recipes[(v, -1)][: params_of[i]["k"]]
        names = [str(recipe[j]["feature"]) for j in positions if j < len(recipe)]
        meta_rows.append((*divmod(v, k_outer), len(recipe), len(names), json.dumps(params_of[i]), status[v], names))
    test, train = every.filter("role = 'test'").drop("role"), every.filter("role = 'train'").drop("role")
    tuned = M.score_points(M.clip_unit(train if tune_on == "train" else test), FOLD)
    thresholds = M.threshold_max_f1(tuned, FOLD).select(*FOLD, "threshold")
    schema = "repeat int, fold int, n_features_train int, n_selected int, best_params string, status string, features array<string>"
    meta = df.sparkSession.createDataFrame(meta_rows, schema)
    named = tagged.select(ID, "label", *FOLD)
    records = _records(test, thresholds, FOLD)
    for extra in (fold_audit(named), fold_validity(named), meta.drop("features")):
        records = join_on(records, extra, FOLD)
    selected = meta.select(*FOLD, F.explode("features").alias("feature"))
    return Study(test, durable(records.withColumn("model", F.lit(model))), selected, errors=errors)


def logistic_leave_one_out(
    df: DataFrame, id_col: str, array_col: str, label: str = "label", c: float = 0.5, top: int = 100, seed: int = 42
) -> DataFrame:
    """row_id, label, prob: leave-one-out scores of an L2 logistic model from a single fit, each
    corrected for its own row; see multifit.leave_one_out for the error. Features are chosen, filled
    and scaled on all rows, as in final_fit."""
    rows = durable(_standard(df, id_col, array_col, label))
    require_two_classes(rows)
    tagged = durable(rows.select("*", F.lit(0).alias("repeat"), F.lit(1).alias("fold")))
    recipe = recipe_of(recipe_rows(fold_recipes(_long(tagged), 2, top))[(0, 0)])
    whole = tagged.select(ID, "label", "x", F.array(F.lit(0)).alias("views"))
    fitted = fit_many(whole, weigh(whole, [Fit(0, -1, recipe, c)]))[0]
    return leave_one_out(whole, fitted, [ID])


def final_fit(
    df: DataFrame,
    id_col: str,
    array_col: str,
    model: str = "RandomForest",
    label: str = "label",
    params: dict | None = None,
    top: int = 50,
    seed: int = 42,
) -> tuple[object, DataFrame]:
    """A last fit on all rows with the best `top` features by F: the model, and feature and
    importance (for a logistic model the absolute coefficient), highest first."""
    rows = _standard(df, id_col, array_col, label)
    # All rows are the training part of a plan of two folds whose first is empty.
    tagged = durable(rows.select("*", F.lit(0).alias("repeat"), F.lit(1).alias("fold")))
    recipe = recipe_rows(fold_recipes(_long(tagged), 2, top))[(0, 0)]
    fitted = fit_named(model, apply_recipe(tagged, recipe, [ID, "label"], "x"), params or {}, ID, seed)
    names = [str(r["feature"]) for r in recipe]
    if model == "LogisticRegression":
        return fitted, coefficient_importance(fitted, names, df.sparkSession).select("feature", "importance")
    return fitted, feature_importance(fitted, names, df.sparkSession)


def interval_summary(records: DataFrame, by: Sequence[str], metrics: Sequence[str] = ("accuracy", "roc_auc", "f1"), draws: int = 2_000) -> DataFrame:
    """Fold means and deviations per group, and the bootstrap interval of each metric's mean."""
    keyed = durable(records.withColumn("_row", F.concat_ws("-", *by, *FOLD)))
    out = summarize_folds(keyed, by, metrics)
    for m in metrics:
        ci = M.bootstrap_ci(keyed, "_row", m, by, draws).select(*by, F.col("ci_low").alias(f"{m}_ci_low"), F.col("ci_high").alias(f"{m}_ci_high"))
        out = join_on(out, ci, by, "left")
    return out


def grid_study(
    df: DataFrame,
    id_col: str,
    array_col: str,
    resamplers: Sequence[str | None],
    models: Sequence[str],
    pca: Sequence[int | None] = (None,),
    **nested,
) -> Study:
    """A nested study per resampler x model x PCA size; records are stacked with their
    configuration, ready for summarize_folds and leaderboard."""
    parts, tests, errors = [], [], {}
    for r, m, p in product(resamplers, models, pca):
        combo = f"{r or 'none'}__{m}"
        one = nested_study(df, id_col, array_col, model=m, resampler=r, pre_pca=p, **nested)
        tag = {"combo": F.lit(combo), "pre_pca": F.lit(p).cast("int")}
        parts.append(one.records.withColumns(tag))
        tests.append(one.scores.withColumns(tag))
        errors.update({(combo, p, *x): e for x, e in one.errors.items()})
    return Study(stack_folds(tests), stack_folds(parts), errors=errors)
