"""Evaluation sweeps: task evaluator, block sizes, penalties, interpolation, buffers, distances, variograms."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encoders, geo
from ..operators import folds as FO
from ..operators import fold_ladder, metrics, models, stats
from ..operators import neighbours as NB
from ..operators.clean import finite, valid_rows
from ..operators.primitives import hash_rank, hash_uniform
from ..operators.summary import category
from ..session import cut_lineage

# Sweep grids.
CELL_SIZES = (0.0, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 40.0)
PENALTY_CELLS = (0.0, 2.0, 10.0, 40.0)
DISTANCE_CELLS = (0.0, 2.0, 10.0)
RADII_KM = (0.0, 10.0, 25.0, 50.0, 100.0, 200.0, 400.0)
MIN_TRAIN_ROWS = 30
LAGS_KM = tuple(float(x) for x in np.geomspace(0.01, 8000.0, 48))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def with_folds(df: DataFrame, cell_deg: float, *, id_col: str = "id", folds: int = 5, seed: int = 0, order: str = "hash") -> DataFrame:
    """Fold and inner bucket columns; cell size 0 means random folds (row order modulo for seed 0)."""
    if cell_deg == 0:
        f = FO.modulo_folds(df, id_col, folds=folds) if seed == 0 else FO.random_folds(df, id_col, folds=folds, seed=seed)
    else:
        f = FO.spatial_folds(df, folds=folds, cell_deg=cell_deg, seed=seed, order=order)
    return FO.inner_buckets(f, id_col, buckets=folds, seed=seed)


def median_train_km(df: DataFrame, id_col: str = "id", max_rows: int | None = None) -> DataFrame:
    """Mean over folds of the median distance to the nearest training row.

    ``max_rows`` gives the sampled estimator (that many held-out and training rows per fold); the
    default measures every row.
    """
    if max_rows is None:
        return metrics.fold_median_km(NB.nearest_train_km(df, id_col=id_col), id_col)
    present = [r["fold"] for r in df.select("fold").distinct().collect()]
    test = FO.fixed_sample(df, max_rows, [id_col], group=["fold"], seed=1)
    train = df.withColumn("to", F.explode(F.array(*[F.lit(f).cast("int") for f in present]))).where("to != fold")
    train = FO.fixed_sample(train, max_rows, [id_col], group=["to"], seed=2)
    hits = NB.nearest(NB._sphere(test, id_col, "qid", "lat", "lon", F.col("fold")),
                      NB._sphere(train, id_col, "tid", "lat", "lon", F.col("to")), k=1, mode="same")
    km = test.select(id_col, "fold").join(hits.select(F.col("qid").alias(id_col), geo.chord_to_km("dist").alias("km")), id_col)
    return metrics.fold_median_km(km, id_col)


def evaluate_tasks(df: DataFrame, features: str, tasks: Sequence[str], *, task_type: str = "regression", probe: str = "ridge",
                   spatial: bool = False, test_flag: str | None = None, id_col: str = "id", seed: int = 0, folds: int = 5,
                   cell_deg: float = 10.0, alphas=models.RIDGE_ALPHAS, select: str = "inner") -> DataFrame:
    """(task, score) and the MEAN row. Logistic and neighbour probes apply to random classification
    folds only (``select`` says how the logistic one chooses its penalty); every other case falls back to ridge. An official test flag overrides folds. Spatial folds are drawn
    once over all rows, so that every task has the same ones; a task then uses its valid rows."""
    plain_class = task_type == "classification" and probe in ("logistic", "knn") and test_flag is None and not spatial
    parts = []
    if spatial and test_flag is None:
        df = cut_lineage(with_folds(df, cell_deg, id_col=id_col, folds=folds, seed=seed), "folds")
    for task in tasks:
        valid = df.where(valid_rows(task, features, numeric=task_type == "regression"))
        if task_type == "regression":
            coded, n = valid, 0
        else:
            coded, n = models.class_codes(valid, task, "__cls")
        if plain_class:
            d = FO.stratified_folds(coded, id_col, "__cls", folds=folds, seed=seed)
            if probe == "knn":
                s = models.knn_scores(d, features, id_col, "__cls")
            else:
                d = FO.random_folds(d, id_col, folds=folds, seed=seed, stream=7, group=["fold", "__cls"], out="bucket")
                s = models.logistic_path(d, features, "__cls", n, buckets=folds, select=select)
            parts.append(s.agg(F.avg("accuracy").alias("score")).select(F.lit(task).alias("task"), "score"))
            continue
        if test_flag is not None:  # outer fold 1 is the official test set; only that fit counts
            d = FO.inner_buckets(coded.withColumn("fold", F.col(test_flag).cast("int")), id_col, buckets=folds, seed=seed)
        else:
            d = coded if spatial else with_folds(coded, 0.0, id_col=id_col, folds=folds, seed=seed)
        kw = dict(targets=[task]) if task_type == "regression" else dict(cls="__cls", n_classes=n)
        ch, _, _ = models.nested_score(d, features, alphas=alphas, inner="spatial" if spatial and not test_flag else "random",
                                       buckets=folds, **kw)
        if test_flag is not None:
            ch = ch.where(F.col("outer") == 1)
        models.warn_at_edge(ch, alphas)
        parts.append(ch.agg(F.avg("score").alias("score")).select(F.lit(task).alias("task"), "score"))
    scores = cut_lineage(union(parts), "tasks")
    return scores.unionByName(scores.agg(F.avg("score").alias("score")).select(F.lit("MEAN").alias("task"), "score"))


def _facts(d: DataFrame, max_rows: int | None) -> tuple[int, float, int]:
    """Rows, median nearest-training distance and nonempty folds of one fold assignment."""
    km = median_train_km(d, max_rows=max_rows).first()
    return d.count(), float(km["median_nn_km"]) if km["median_nn_km"] is not None else float("nan"), int(km["n_folds"])


def _rows(scores: DataFrame, facts: tuple[int, float, int], benchmark: str, tasks: Sequence[str], cell: float, **extra) -> DataFrame:
    """Scores (encoder/config, target, score) as result rows."""
    names = F.array(*[F.lit(t) for t in tasks])
    n, km, n_folds = facts
    cols = {k: F.lit(v) for k, v in extra.items()}
    return scores.withColumns({
        "n": F.lit(n).cast("long"), "benchmark": F.lit(benchmark), "family": category(F.lit(benchmark)), "task": F.get(names, F.col("target")),
        "cell_deg": F.lit(float(cell)), "median_nn_train_km": F.round(F.lit(km), 2),
        "n_folds_nonempty": F.lit(0 if cell == 0 else n_folds), **cols}).drop("target")


def block_size_sweep(df: DataFrame, features: str, targets: Sequence[str], *, benchmark: str, widths: Sequence[int],
                     cells: Sequence[float] = CELL_SIZES, tag: str = "emb", seed: int = 0, alphas=models.RIDGE_ALPHAS,
                     order: str = "hash", max_rows: int | None = None, task_type: str = "regression", test_flag: str | None = None) -> DataFrame:
    """Prefix widths by cell size. All widths of a cell size come from one set of cross products.

    ``targets`` are label columns of one ``task_type``. With ``test_flag`` the scores are those of the official test rows, whatever the
    cell size, which then only sets the distances.
    """
    parts = []
    for cell in cells:
        d = cut_lineage(with_folds(df, cell, seed=seed, order=order), "folds")
        facts = _facts(d, max_rows)
        profiles = [models.Profile(f"ridge_w{w}", w) for w in widths]
        how = dict(profiles=profiles, alphas=alphas, rule="probe")
        if test_flag is None:
            ch, means, _ = models.nested_tasks(d, features, targets, task_type, inner="spatial" if cell else "random", **how)
        else:
            ch, means = _official(df, features, targets, task_type, test_flag, seed, **how)
        models.warn_at_edge(ch, alphas)
        lab = means.select(F.concat(F.lit(f"{tag}_"), F.substring("config", 8, 9)).alias("encoder"),
                           F.substring("config", 8, 9).cast("int").alias("width"), "target", F.round("score", 5).alias("score"))
        parts.append(_rows(lab, facts, benchmark, targets, cell, task_type=task_type))
    return union(parts).select("benchmark", "family", "task", "task_type", "n", "encoder", "width", "cell_deg",
                               "median_nn_train_km", "n_folds_nonempty", "score")


def _official(df: DataFrame, features: str, targets: Sequence[str], task_type: str, test_flag: str, seed: int, **how) -> tuple[DataFrame, DataFrame]:
    """(choices, means) of the official test rows; penalties are chosen inside the others."""
    d = FO.inner_buckets(df.withColumn("fold", F.col(test_flag).cast("int")), "id", seed=seed)
    ch = models.nested_tasks(d, features, targets, task_type, inner="random", **how)[0].where(F.col("outer") == 1)
    return ch, ch.groupBy("config", "target").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_folds"))


def penalty_sweep(df: DataFrame, features: str, targets: Sequence[str], *, benchmark: str, widths: Sequence[int], starts: Sequence[int],
                  betas=models.CHUNK_BETAS, powers=models.POWER_EXPONENTS, cells: Sequence[float] = PENALTY_CELLS, seed: int = 0,
                  alphas=models.RIDGE_ALPHAS, order: str = "hash", max_rows: int | None = None, task_type: str = "regression") -> tuple[DataFrame, DataFrame]:
    """(results, choices) for every profile and family under the rules selected, nested, nested_spatial."""
    dim = df.select(F.size(features)).first()[0]
    profiles = models.make_profiles(dim, widths, betas, powers, starts)
    fams = models.make_families(profiles, dim)
    pools = {p.name: [i] for i, p in enumerate(profiles)} | fams
    results, choices = [], []
    for cell in cells:
        d = cut_lineage(with_folds(df, cell, seed=seed, order=order), "folds")
        facts = _facts(d, max_rows)
        for rule, inner in [("nested", "random")] + ([("nested_spatial", "spatial")] if cell and facts[2] >= 3 else []):
            ch, means, grid = models.nested_tasks(d, features, targets, task_type, profiles=profiles, families=fams, alphas=alphas,
                                                  rule="clamp", inner=inner)
            picks = [(rule, means)] + ([("selected", models.selected(grid, pools))] if rule == "nested" else [])
            for name, m in picks:
                results.append(_rows(m.select("config", "target", F.round("score", 5).alias("score")), facts, benchmark, targets, cell,
                                     rule=name, task_type=task_type))
            prof, alph = F.array(*[F.lit(p.name) for p in profiles]), F.array(*[F.lit(float(a)) for a in alphas])
            choices.append(ch.select(
                F.lit(benchmark).alias("benchmark"), F.get(F.array(*[F.lit(t) for t in targets]), F.col("target")).alias("task"),
                F.lit(float(cell)).alias("cell_deg"), "config", F.lit(rule).alias("rule"), F.col("outer").alias("fold"),
                F.get(prof, F.col("profile")).alias("profile"), F.get(alph, F.col("alpha")).alias("alpha")))
    return union(results), union(choices)


def interpolation_sweep(df: DataFrame, target: str, *, benchmark: str, ks: Sequence[int], cells: Sequence[float], task_type: str = "regression",
                        seed: int = 0, id_col: str = "id", order: str = "hash") -> DataFrame:
    """Unrounded score per cell size and k: for a number one neighbour search over all cell sizes, for a class one per cell size, at the largest k.

    Folds are drawn over all rows; rows without a valid label then neither train nor count.
    """
    label = [F.lit(benchmark).alias("benchmark"), category(F.lit(benchmark)).alias("family"), F.lit(target).alias("task"), F.lit(task_type).alias("task_type")]
    if task_type == "regression":
        names = [f"__f{i}" for i in range(len(cells))]
        d = _ladder_folds(df.select(id_col, "lat", "lon", target), cells, names, id_col=id_col, seed=seed, order=order).where(valid_rows(target))
        by = metrics.r2_columns(fold_ladder.idw_ladder(d, names, ks, target, id_col=id_col), ["grid", "fold"], ks)
        cell = F.get(F.array(*[F.lit(float(c)) for c in cells]), F.col("grid")).alias("cell_deg")
        return by.where(~F.isnan("score")).groupBy("grid", "k").agg(F.avg("score").alias("score")).select(*label, cell, "k", "score")
    parts = []
    for cell in cells:
        d = with_folds(df, cell, seed=seed, order=order).where(valid_rows(target, numeric=False))
        pred = metrics.idw(NB.sphere_knn(d, k=max(ks), payload=(target,), id_col=id_col), ks, target, task_type)
        by = metrics.accuracy_by(pred.join(d.select(F.col(id_col).alias("qid"), "fold", F.col(target).alias("truth")), "qid"), ["fold", "k"])
        parts.append(by.where(~F.isnan("score")).groupBy("k").agg(F.avg("score").alias("score")).select(
            *label, F.lit(float(cell)).alias("cell_deg"), "k", "score"))
    return union(parts)


def _ladder_folds(df: DataFrame, cells: Sequence[float], names: Sequence[str], *, id_col: str, seed: int, order: str) -> DataFrame:
    """The fold columns of ``with_folds`` for every cell size. The grid cells of all sizes are ranked together and written once."""
    out, sized = df, [(c, name) for c, name in zip(cells, names) if c]
    for cell, name in zip(cells, names):  # random folds first: they shuffle the rows, the others join small tables
        if cell == 0:
            out = FO.modulo_folds(out, id_col, out=name) if seed == 0 else FO.random_folds(out, id_col, seed=seed, out=name)
    sides = cut_lineage(FO.cell_folds(df, [c for c, _ in sized], seed=seed, order=order), "grid_cells") if sized else None
    for at, (cell, name) in enumerate(sized):
        side = sides.where(F.col("__at") == at).select("__cla", "__clo", F.col("fold").alias(name))
        out = FO.with_cells(out, cell).join(FO.bounded_cells(side, cell), ["__cla", "__clo"]).drop("__cla", "__clo")
    return out


# --------------------------------------------------------------------------- buffers

def retention_levels(df: DataFrame, radii: Sequence[float], *, folds: int = 5, seed: int = 0, id_col: str = "id") -> DataFrame:
    """(id, target, mode, level): a training row of held-out fold ``target`` stays for the first ``level`` radii.

    Buffers grow with the radius, and the random control drops by one fixed hash rank, so both kept
    sets shrink monotonically and one number per row describes every radius.
    """
    rs = sorted(radii)
    km = cut_lineage(NB.held_out_km(df, folds, max(rs), id_col=id_col).withColumnRenamed("fold", "target"), "buffer")
    level = sum([F.when(F.col("km").isNull() | (F.col("km") >= r), 1).otherwise(0) for r in rs], F.lit(0))
    buffer = km.select(id_col, "target", F.lit("buffer").alias("mode"), level.alias("level"))
    gone = buffer.groupBy("target").agg(*[F.count_if(F.col("level") <= j).alias(f"g{j}") for j in range(len(rs))])
    ranked = hash_rank(km.select(id_col, "target"), [id_col], group=["target"], seed=seed, stream=8, out="r").join(F.broadcast(gone), "target")
    keep = sum([F.when(F.col("r") >= F.col(f"g{j}"), 1).otherwise(0) for j in range(len(rs))], F.lit(0))
    return buffer.unionByName(ranked.select(id_col, "target", F.lit("random_drop").alias("mode"), keep.alias("level")))


def buffered_sweep(df: DataFrame, features: str, targets: Sequence[str], *, benchmark: str, radii: Sequence[float] = RADII_KM,
                   folds: int = 5, seed: int = 0, profiles: Sequence[models.Profile], families: dict[str, list[int]] | None = None,
                   alphas=models.RIDGE_ALPHAS, idw_k: int | None = None, min_train: int = MIN_TRAIN_ROWS, tag: str = "emb",
                   task_type: str = "regression") -> DataFrame:
    """Scores per radius, mode and config with fixed held-out folds and shrinking training sets.

    Regression targets with the same valid rows share a run over these rows, a class target has a run of its own. Every radius, mode, config and task has a row; the score is null
    where some fold keeps fewer than ``min_train`` training rows, and a fold without any counts as 0 in the means.
    """
    n = df.count()
    parts = []
    how = dict(benchmark=benchmark, radii=radii, folds=folds, seed=seed, profiles=profiles, families=families, alphas=alphas, idw_k=idw_k,
               min_train=min_train, tag=tag)
    placed = finite("lat") & finite("lon")
    if task_type == "classification":
        for name in targets:
            coded, n_classes = models.class_codes(df.where(valid_rows(name, features, numeric=False) & placed), name, "__cls")
            parts.append(_buffered(coded.withColumn(name, F.col("__cls")), features, [name], n, n_classes=n_classes, **how))
        return union(parts)
    for at in models.target_groups(df, features, targets):
        names = [targets[i] for i in at]
        parts.append(_buffered(df.where(valid_rows(names[0], features) & placed), features, names, n, **how))
    return union(parts)


def _buffered(df: DataFrame, features: str, targets: Sequence[str], n: int, *, benchmark: str, radii, folds: int, seed: int, profiles, families,
              alphas, idw_k: int | None, min_train: int, tag: str, n_classes: int = 0) -> DataFrame:
    """One run of the buffered sweep on valid rows.

    Each row enters the cross products once per held-out fold and mode, under its retention level;
    the training matrix of a radius is the sum over higher levels. Vectors are not exploded by radius.
    """
    rs = sorted(radii)
    d = cut_lineage(with_folds(df, 0.0, seed=seed, folds=folds), "folds")
    lv = cut_lineage(retention_levels(d, rs, folds=folds, seed=seed), "levels")
    modes = ("buffer", "random_drop")
    per_id = lv.groupBy("id").agg(F.collect_list(F.struct("target", "mode", "level")).alias("where"))  # folds x modes entries
    own = F.transform(F.array(*[F.lit(m) for m in modes]), lambda m: F.struct(F.col("fold").alias("target"), m.alias("mode"), F.lit(-1).alias("level")))
    placed = d.join(per_id, "id", "left").withColumn("w", F.explode(F.concat(own, F.coalesce(F.col("where").cast(
        "array<struct<target:int,mode:string,level:int>>"), F.array().cast("array<struct<target:int,mode:string,level:int>>")))))
    placed = placed.select(features, *targets, "bucket", F.col("w.target").alias("target"),
                           F.when(F.col("w.mode") == "buffer", 0).otherwise(1).alias("mode"), F.col("w.level").alias("level"))
    task_type, labels = ("classification", []) if n_classes else ("regression", targets)
    group = ["mode", "target", "level", "bucket"]
    shift = stats.feature_shift(placed, features, labels)
    dim = len(shift) - len(labels)
    blocks, _ = stats.gram_stats(placed, features, labels, group, shift)
    if n_classes:
        blocks = blocks.unionByName(models.class_sums(placed, features, targets[0], shift, group))
    fits = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i")) for j in range(len(rs)) for i in (-1, *range(folds))])).alias("f")
    x = blocks.select("*", fits).select("*", "f.j", F.col("f.i").alias("inner")).drop("f")
    x = x.where(~((F.col("mode") == 1) & F.lit(rs[0] == 0.0) & (F.col("j") == 0)))  # no control at radius zero
    test = F.col("level") == -1
    kept = F.col("level") > F.col("j")
    role = F.when(F.col("inner") == -1, F.when(test, 1).when(kept, 0)).when(kept, F.when(F.col("bucket") == F.col("inner"), 1).otherwise(0))
    code = ((F.col("mode") * folds + F.col("target")) * len(rs) + F.col("j")).alias("outer")
    roles = x.select("*", role.alias("role"), code).where("role is not null").drop("mode", "target", "level", "bucket", "j")
    grid = models.solve_fits(roles, shift, dim, profiles, alphas, "clamp", weights=n_classes > 0, n_classes=n_classes)
    if n_classes:
        def tests(values, outer, inner):
            j, target, mode = outer % len(rs), outer // len(rs) % folds, outer // len(rs) // folds
            mine = (values["mode"] == mode) & (values["target"] == target)
            return mine & ((values["level"] == -1) if inner == -1 else (values["level"] > j) & (values["bucket"] == inner))

        grid = models.accuracy_grid(placed, features, targets[0], n_classes, grid, group, tests)
    grid = cut_lineage(grid, "grid")
    pools = {p.name: [i] for i, p in enumerate(profiles)} | (families or {})
    ch = models.choose(grid, pools)
    per = ch.select("outer", "config", "target", "score")
    hits, held = _kept_neighbours(d, lv, rs, targets, idw_k or 1, folds)
    if idw_k:
        per = per.unionByName(_interpolated(hits, held, targets, idw_k, task_type).select("outer", "config", "target", "score"))
    j, m = (F.col("outer") % len(rs)).cast("int").alias("j"), F.floor(F.col("outer") / (len(rs) * folds)).cast("int").alias("m")
    scores = per.groupBy(j, m, "config", "target").agg(F.avg("score").alias("score"))
    near = hits.where("rank = 1").select(F.col("qid.outer").alias("outer"), F.col("qid.id").alias("id"), "km")
    med = stats.percentiles(near, "km", "id", [0.5], group=["outer"]).groupBy(j, m).agg(F.avg("value").alias("med"))

    # kept rows of every held-out fold from the counts of levels: folds x modes x levels numbers
    sizes = {r["fold"]: r["n"] for r in d.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    levels: dict[tuple, int] = {(r["mode"], r["target"], r["level"]): r["n"] for r in lv.groupBy("mode", "target", "level").agg(F.count(F.lit(1)).alias("n")).collect()}
    valid = sum(sizes.values())
    encoders_ = [(tag, c) for c in pools] + ([("coord_idw", f"idw_k{idw_k}")] if idw_k else [])
    rows = []
    for mi, mode in enumerate(modes):
        for ri, radius in enumerate(rs):
            if mi == 1 and radius == 0.0:  # no control at radius zero
                continue
            kept = [sum(c for (a, f, level), c in levels.items() if a == mode and f == fold and level > ri) for fold in sizes]
            share = [k / max(valid - c, 1) for k, c in zip(kept, sizes.values())]
            facts = (float(radius), mode, len(sizes), int(np.mean(kept)) if kept else 0, round(float(np.mean(share)), 4) if kept else 0.0)
            ok = bool(kept) and min(kept) >= min_train
            rows += [(mi, ri, t, name, e, c, *facts, ok) for e, c in encoders_ for t, name in enumerate(targets)]
    every = d.sparkSession.createDataFrame(rows, "m int, j int, target int, task string, encoder string, config string, radius_km double, mode string, "
                                                 "n_folds int, n_train_kept long, frac_kept double, ok boolean")
    return every.join(scores, ["m", "j", "config", "target"], "left").join(med, ["m", "j"], "left").select(
        F.lit(benchmark).alias("benchmark"), category(F.lit(benchmark)).alias("family"), "task", F.lit(task_type).alias("task_type"),
        F.lit(n).cast("long").alias("n"), F.lit(valid).cast("long").alias("n_valid"), "encoder", "config", "radius_km", "mode",
        F.lit(seed).alias("fold_seed"), "n_folds", "n_train_kept", "frac_kept", F.round("med", 2).alias("median_nn_km"),
        F.when(F.col("ok"), F.round("score", 5)).alias("score"))


def _kept_neighbours(d: DataFrame, lv: DataFrame, rs: Sequence[float], targets: Sequence[str], k: int, folds: int) -> tuple[DataFrame, DataFrame]:
    """Nearest retained training rows of every held-out row under every radius and mode, and those rows."""
    held = d.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(rs) - 1)))).select(
        "id", "lat", "lon", *targets, _code("m", "fold", "j", rs, folds).alias("outer"))
    return neighbour_ladder(d, lv, rs, targets, k, folds)[0], held


def _code(mode: str, target: str, j: str, rs: Sequence[float], folds: int):
    return ((F.col(mode) * folds + F.col(target)) * len(rs) + F.col(j)).cast("int")


def neighbour_ladder(d: DataFrame, lv: DataFrame, rs: Sequence[float], payload: Sequence[str], k: int, folds: int) -> tuple[DataFrame, list[int]]:
    """(hits, searched queries of every round): the ``k`` nearest retained rows of every held-out row, radius and mode.

    Retained rows only become fewer as the radius grows. So each query keeps a list of its nearest rows, a few more than k, with
    their retention levels: the list serves every radius at which k of its members are left, and only a query whose list has run short is
    searched again, among the rows retained at that radius. The first search serves both modes.
    """
    long, n_radii = 2 * k + 8, len(rs)
    rows = d.select("id", "lat", "lon", F.col("fold").alias("target"), *payload)
    levels = lv.select(F.col("id").alias("tid"), "target", F.when(F.col("mode") == "buffer", 0).otherwise(1).alias("m"), "level")
    top = levels.groupBy("target", "m").agg(F.max("level").alias("top"))  # no row is left from this radius on; folds x modes rows
    member = F.struct("dist", "tid", "level", *payload)

    def lists(hits: DataFrame) -> DataFrame:
        """Hits (id, target, m, start, tid, dist) as one sorted list a query, and the first radius at which it is short."""
        got = hits.join(levels, ["tid", "target", "m"]).groupBy("id", "target", "m", "start").agg(F.sort_array(F.collect_list(member)).alias("list"))
        kth = F.element_at(F.sort_array(F.transform("list", lambda x: x["level"]), False), k)
        return cut_lineage(got.withColumn("short", F.when(F.size("list") < long, n_radii).otherwise(kth)), "lists")

    first = NB.nearest(NB._sphere(rows.withColumn("qid", F.struct("id", "target")), "qid", "qid", "lat", "lon", F.col("target")),
                       NB._sphere(rows, "id", "tid", "lat", "lon", F.col("target"), tuple(payload)), k=long, mode="other", payload=tuple(payload))
    both = first.select("qid.id", "qid.target", "tid", "dist", *payload, F.explode(F.array(F.lit(0), F.lit(1))).alias("m"), F.lit(0).alias("start"))
    parts, searched = [lists(both)], [d.count()]
    while True:
        ask = parts[-1].where(F.col("short") < n_radii).join(F.broadcast(top), ["target", "m"]).where(F.col("short") < F.col("top")).select(
            "id", "target", "m", F.col("short").alias("start"))
        count = ask.count()
        if not count:
            break
        searched.append(count)
        groups = ask.select("target", "m", "start").distinct()  # at most folds x modes x radii
        left = levels.join(F.broadcast(groups), ["target", "m"]).where(F.col("level") > F.col("start")).select(
            F.col("tid").alias("id"), _code("m", "target", "start", rs, folds).alias("outer"))
        train = rows.drop("target").join(left, "id")
        q = ask.join(rows.select("id", "lat", "lon"), "id").withColumn("qid", F.struct("id", "target", "m", "start"))
        again = NB.nearest(NB._sphere(q, "qid", "qid", "lat", "lon", _code("m", "target", "start", rs, folds)),
                           NB._sphere(train, "id", "tid", "lat", "lon", F.col("outer"), tuple(payload)), k=long, mode="same", payload=tuple(payload))
        parts.append(lists(again.select("qid.*", "tid", "dist", *payload)))
    served = union(parts).where(F.col("short") > F.col("start")).withColumn("j", F.explode(F.sequence(F.col("start"), F.col("short") - 1)))
    near = F.slice(F.filter("list", lambda x: x["level"] > F.col("j")), 1, k)
    hits = served.select(F.struct("id", _code("m", "target", "j", rs, folds).alias("outer")).alias("qid"), F.posexplode(near).alias("at", "x")).select(
        "qid", "x.tid", (F.col("at") + 1).alias("rank"), geo.chord_to_km("x.dist").alias("km"), *[F.col(f"x.{c}").alias(c) for c in payload])
    return cut_lineage(hits, "kept"), searched


def _interpolated(hits: DataFrame, held: DataFrame, targets: Sequence[str], k: int, task_type: str) -> DataFrame:
    """Interpolation scores per (outer code, target)."""
    parts = []
    for t, name in enumerate(targets):
        pred = metrics.idw(hits, [k], name, task_type).withColumn("id", F.col("qid.id")).withColumn("outer", F.col("qid.outer"))
        j = pred.join(held.select("id", "outer", F.col(name).alias("truth")), ["id", "outer"])
        score = metrics.r2_by(j, ["outer"]) if task_type == "regression" else metrics.accuracy_by(j, ["outer"])
        parts.append(score.select("outer", F.lit(f"idw_k{k}").alias("config"), F.lit(t).alias("target"), "score"))
    return union(parts)


def distance_error_sweep(df: DataFrame, encoders_: dict[str, str], target: str, *, cells: Sequence[float] = DISTANCE_CELLS,
                         seed: int = 0, alphas=models.RIDGE_ALPHAS, order: str = "hash", task_type: str = "regression") -> DataFrame:
    """Distance-binned skill per encoder (label -> vector column) and cell size; the skill of a class target is accuracy."""
    parts, numeric, label = [], task_type == "regression", dict(target=target)
    if not numeric:
        df, n_classes = models.class_codes(df, target, "__cls")
        label = dict(cls="__cls", n_classes=n_classes)
    for cell in cells:
        d = cut_lineage(with_folds(df, cell, seed=seed, order=order), "folds")
        ok = [valid_rows(target, vec, numeric=numeric) for vec in encoders_.values()]
        differ = d.agg(*[F.count_if(~x.eqNullSafe(ok[0])) for x in ok]).first()
        km = None
        for i, (name, vec) in enumerate(encoders_.items()):
            if km is None or differ[i] or differ[i - 1]:  # distances among the valid rows; equal masks share them
                km = cut_lineage(NB.nearest_train_km(d.where(ok[i])).select("id", "km"), "km")
            p = models.fold_predictions(d, vec, "id", alphas=alphas, **label).join(km, "id")
            parts.append(metrics.binned_skill(p, task_type=task_type).select(F.lit(name).alias("encoder"), F.lit(float(cell)).alias("cell_deg"),
                                                        "bin", "lo_km", "hi_km", "n", F.round("skill", 5).alias("skill")))
    return union(parts)


def variogram(anchors: DataFrame, weights: encoders.Weights, *, polygons: DataFrame | None = None, widths: Sequence[int],
              lags: Sequence[float] = LAGS_KM, pairs_per_lag: int | None = 4096, seed: int = 0, dim: int | None = None, tag: str = "emb",
              id_col: str = "id") -> DataFrame:
    """Semivariance by lag and prefix with sill and half-sill distances.

    ``anchors``: id, lat, lon. Every lag takes its own random pairs (``pairs_per_lag`` of them, or all
    anchors when None). With polygons, bearings are redrawn until the far end is on land.
    """
    base = cut_lineage(encoders.embed(anchors.select(id_col, "lat", "lon"), weights, dim=dim, out="va"), "anchors")
    p = base.drop("va").withColumn("li", F.explode(F.sequence(F.lit(0), F.lit(len(lags) - 1))))
    if pairs_per_lag:
        p = hash_rank(p, [id_col, "li"], group=["li"], seed=seed, stream=60, out="r").where(F.col("r") < pairs_per_lag).drop("r")
    p = p.withColumn("lag_km", F.get(F.array(*[F.lit(x) for x in lags]), F.col("li"))).withColumn("pair", F.xxhash64(id_col, "li"))
    if polygons is None:
        la, lo = geo.geodesic_offset("lat", "lon", F.col("lag_km"), hash_uniform("pair", seed=seed, stream=61) * F.lit(2 * np.pi))
        moved = p.select("pair", id_col, "lag_km", la.alias("lat2"), lo.alias("lon2"))
    else:
        off = FO.land_offsets(p, "pair", polygons, seed=seed).select("pair", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
        moved = p.select("pair", id_col, "lag_km").join(off, "pair")
    # the anchors' vectors join before the far ends are embedded, so that no pair's vectors are shuffled
    near = moved.join(base.select(id_col, "va"), id_col)
    pairs = encoders.embed(near, weights, dim=dim, out="vb", lat="lat2", lon="lon2").select("lag_km", "va", "vb")
    curve = cut_lineage(metrics.semivariance(pairs, widths), "curve")
    return curve.join(metrics.half_sill(curve), "width").withColumn("encoder", F.concat(F.lit(f"{tag}_"), F.col("width").cast("string")))
