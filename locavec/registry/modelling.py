"""Queries for models and sweeps. Sweeps run their whole input on the parameter grids of their operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import folds, joins, metrics, models, stats
from ..plans import normalize, sweeps
from ..session import cut_lineage, shared_dir
from ..sources import files
from .core import PTS, R, VECS, W, query, r

PROFILES = models.make_profiles(X.DIM, X.WIDTHS, models.CHUNK_BETAS, models.POWER_EXPONENTS, X.STARTS)
FAMILIES = models.make_families(PROFILES, X.DIM)
KS = (1, 5, 20)


def blocked(spark, sf, cell=10.0):
    """Vectors with spatial folds and inner buckets, written once."""
    return cut_lineage(sweeps.with_folds(X.vectors(spark, sf), cell, order="lex"), "folds")


def _alpha(alphas):
    return F.get(F.array(*[F.lit(float(a)) for a in alphas]), F.col("alpha")).alias("alpha")


def _profile(profiles=PROFILES):
    return F.get(F.array(*[F.lit(p.name) for p in profiles]), F.col("profile")).alias("profile")


# --------------------------------------------------------------------------- ridge on one channel, in SQL
# r (id, fold, x, y or c) -> every fit (outer o, inner i, -1 the outer fit itself) at every penalty

_MOD = "r AS (SELECT id, (row_number() OVER (ORDER BY id)-1)%5 AS fold, v[1] AS x, y, cls AS c, lat, lon FROM vecs)"
_LEX = ("cl AS (SELECT a, b, (row_number() OVER (ORDER BY a, b)-1)%5 AS fold FROM (SELECT DISTINCT floor(lat/10) AS a, floor(lon/10) AS b FROM vecs)), "
        "r AS (SELECT id, fold, v[1] AS x, y, cls AS c, lat, lon FROM vecs JOIN cl ON floor(lat/10)=a AND floor(lon/10)=b)")
_FITS = ("ft AS (SELECT o, i FROM (SELECT DISTINCT fold AS o FROM r), (SELECT -1 AS i UNION SELECT DISTINCT fold FROM r) WHERE i<>o), "
         "al AS (SELECT range::INT AS ai, pow(10.0,(range-8)/2.0) AS alpha FROM range(21)), "
         "tr AS (SELECT o, i, r.* FROM ft JOIN r ON fold<>o AND fold<>i), te AS (SELECT o, i, r.* FROM ft JOIN r ON fold=CASE WHEN i=-1 THEN o ELSE i END), "
         "st AS (SELECT o, i, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x)*count(*) AS sxx, covar_pop(x,y)*count(*) AS sxy, stddev_samp(x) AS sd FROM tr GROUP BY 1,2)")
_CLASSES = ("cs AS (SELECT o, i, c, count(*) AS nc, sum(x) AS sx FROM tr GROUP BY 1,2,3), "
            "pr AS (SELECT te.o, te.i, ai, te.id, te.fold, any_value(te.c) AS c, arg_max(cs.c, (nc/n::DOUBLE+(x-mx)*(sx-nc*mx)/(sd*sd)/(sxx/(sd*sd)+alpha), -cs.c)) AS p "
            "FROM te JOIN st USING (o,i) JOIN cs USING (o,i), al GROUP BY 1,2,3,4,5), "
            "g AS (SELECT o, i, ai, avg(CASE WHEN p=c THEN 1.0::DOUBLE ELSE 0 END) AS score, count(*) AS n FROM pr GROUP BY 1,2,3)")
_NUMBERS = ("g AS (SELECT rule, o, i, ai, 1-sum((te.y-my-(x-mx)*b)*(te.y-my-(x-mx)*b))/greatest(var_pop(te.y)*count(*),1e-12) AS score, count(*) AS n FROM te JOIN "
            "(SELECT st.*, ai, rule, CASE WHEN rule='none' THEN sxy/(sxx+alpha) ELSE sxy/(sd*sd)/(sxx/(sd*sd)+alpha) END AS b FROM st, al, (VALUES ('none'),('probe')) t(rule)) USING (o,i) GROUP BY 1,2,3,4)")
_PICK = ("m AS (SELECT o, ai, round(avg(score),12) AS s FROM g WHERE i>=0 GROUP BY 1,2), pk AS (SELECT o, arg_max(ai, (s,-ai)) AS ai FROM m GROUP BY 1), "
         "ch AS (SELECT pk.o, pk.ai, g.score FROM pk JOIN g ON g.o=pk.o AND g.ai=pk.ai AND g.i=-1)")


def _channel(spark, sf, cell=0.0, n=1):
    """The first channels of the vectors, folds by row order or cell order."""
    d = X.vectors(spark, sf).withColumn("v", F.slice("v", 1, n))
    return cut_lineage(sweeps.with_folds(d, cell, order="lex"), "folds")


@query("mdl1_ridge_grid", W(VECS, _MOD, _FITS, _NUMBERS) + f"SELECT rule, o::INT AS outer_fold, i::INT AS inner_fold, ai AS alpha, n::DOUBLE AS n_test, {r('score')} AS score FROM g")
def mdl1_grid(spark, sf):
    """Held-out R^2 of every fit at every penalty, with and without standardization."""
    d, parts = _channel(spark, sf), []
    for rule in ("probe", "none"):
        g, _ = models.score_grid(d, "v", targets=["y"], rule=rule, inner="spatial")
        parts.append(g.select(F.lit(rule).alias("rule"), F.col("outer").cast("int").alias("outer_fold"), F.col("inner").cast("int").alias("inner_fold"), "alpha", "n_test", R("score").alias("score")))
    return sweeps.union(parts)


@query("mdl3_alpha_choice", W(VECS, _LEX, _FITS, _NUMBERS.replace(", (VALUES ('none'),('probe')) t(rule)", ", (VALUES ('probe')) t(rule)"), _PICK) + f"SELECT o::INT AS fold, ai AS alpha, {r('score')} AS score FROM ch")
def mdl3_choice(spark, sf):
    """Penalty of every spatial fold by spatial inner folds, and its held-out R^2."""
    ch, _, _ = models.nested_score(_channel(spark, sf, 10.0), "v", targets=["y"], inner="spatial")
    return ch.select(F.col("outer").cast("int").alias("fold"), "alpha", R("score").alias("score"))


@query("mdl5_classification_grid", W(VECS, _MOD, _FITS, _CLASSES) + f"SELECT o::INT AS outer_fold, i::INT AS inner_fold, ai AS alpha, n::DOUBLE AS n_test, {r('score')} AS score FROM g")
def mdl5_grid(spark, sf):
    """Accuracy of the arg-max class of every fit at every penalty."""
    d, n = models.class_codes(_channel(spark, sf), "cls")
    g, _ = models.score_grid(d, "v", cls="cls_code", n_classes=n, inner="spatial")
    return g.select(F.col("outer").cast("int").alias("outer_fold"), F.col("inner").cast("int").alias("inner_fold"), "alpha", "n_test", R("score").alias("score"))


@query("mdl12_classification", W(VECS, _LEX, _FITS, _CLASSES, _PICK) + f"SELECT 'emb_1' AS encoder, 10.0::DOUBLE AS cell_deg, 'cls' AS task, 'classification' AS task_type, (SELECT count(*) FROM r) AS n, {r('avg(score)', 5)} AS score FROM ch")
def mdl12_classes(spark, sf):
    d = X.vectors(spark, sf)
    out = sweeps.block_size_sweep(d, "v", ["cls"], benchmark="vectors", widths=(1,), cells=(10.0,), order="lex", task_type="classification")
    return out.select("encoder", "cell_deg", "task", "task_type", "n", "score")


@query("mdl13_classification", W(VECS, _LEX, _FITS, _CLASSES, _PICK) + f"SELECT config, 'nested_spatial' AS rule, {r('s', 5)} AS score FROM (SELECT avg(score) AS s FROM ch), (VALUES ('ridge_w1'),('cv_width'),('cv_all'),('cv_chunk'),('cv_pow')) t(config) "
       f"UNION ALL SELECT config, 'selected', {r('s', 5)} FROM (SELECT max(s) AS s FROM (SELECT avg(score) AS s FROM g WHERE i=-1 GROUP BY ai)), (VALUES ('ridge_w1'),('cv_width'),('cv_all'),('cv_chunk'),('cv_pow')) t(config)")
def mdl13_classes(spark, sf):
    """The rules with spatial inner folds and with the best outer mean, on one channel (where every pool is the plain profile)."""
    d = X.vectors(spark, sf).withColumn("v", F.slice("v", 1, 1))
    res, _ = sweeps.penalty_sweep(d, "v", ["cls"], benchmark="vectors", widths=(1,), starts=(), betas=(), powers=(), cells=(10.0,), order="lex", task_type="classification")
    return res.where("rule <> 'nested'").select("config", "rule", "score")


@query("mdl15_classification")
def mdl15_classes(spark, sf):
    """Every radius and mode on the class labels; inner buckets follow hashes, which SQL does not have."""
    pr = [models.Profile(f"ridge_w{w}", w) for w in X.WIDTHS]
    return sweeps.buffered_sweep(X.vectors(spark, sf), "v", ["cls"], benchmark="vectors", profiles=pr, families={"cv_width": list(range(len(pr)))}, idw_k=5,
                                 task_type="classification")


_FAR = ("xy AS (SELECT *, cos(radians(lat))*cos(radians(lon)) AS a, cos(radians(lat))*sin(radians(lon)) AS b, sin(radians(lat)) AS z FROM r), "
        "nn AS (SELECT p.id, min(2*6371.0*asin(least(1.0,sqrt((p.a-q.a)*(p.a-q.a)+(p.b-q.b)*(p.b-q.b)+(p.z-q.z)*(p.z-q.z))/2))) AS km FROM xy p JOIN xy q ON p.fold<>q.fold GROUP BY 1)")


_BINS = ", ".join(f"count(*) FILTER ({w}) AS n_{k}, CASE WHEN count(*) FILTER ({w})>={metrics.MIN_BIN_ROWS} THEN {r(f'avg(CASE WHEN p=c THEN 1.0::DOUBLE ELSE 0 END) FILTER ({w})', 5)} END AS skill_{k}"
                  for k, w in enumerate(f"km>={lo} AND km<{hi}" for lo, hi in zip(metrics.BIN_EDGES_KM, (*metrics.BIN_EDGES_KM[1:-1], 1e12))))


@query("mdl16_classification", W(VECS, _MOD, _FITS, _CLASSES, _FAR) + f"SELECT {_BINS} FROM pr JOIN nn USING (id) WHERE i=-1 AND ai=8")
def mdl16_classes(spark, sf):
    """Accuracy by distance to the nearest training row at one penalty, one column a distance bin."""
    d = X.vectors(spark, sf).withColumn("v1", F.slice("v", 1, 1))
    out = sweeps.distance_error_sweep(d, {"emb_1": "v1"}, "cls", cells=(0.0,), alphas=(1.0,), task_type="classification")
    bins = range(len(metrics.BIN_EDGES_KM) - 1)
    at = lambda k, c: F.max(F.when(F.col("bin") == k, F.col(c)))
    return out.agg(*[x for k in bins for x in (at(k, "n").alias(f"n_{k}"), (at(k, "skill") + F.lit(0.0)).alias(f"skill_{k}"))])


@query("mdl1_ridge_eval")
def mdl1(spark, sf):
    """Held-out R^2 per spatial fold at one penalty, with and without standardization."""
    d, out = blocked(spark, sf), None
    for rule in ("probe", "none"):
        g, _ = models.score_grid(d, "v", targets=["y"], alphas=(1.0,), rule=rule, inner="none")
        part = g.select(F.lit(rule).alias("rule"), F.col("outer").alias("fold"), R("score").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("mdl2_chunk_ridge")
def mdl2(spark, sf):
    d = X.vectors(spark, sf)
    m = models.fit_chunk_ridge(d, "v", ["y", "lat"], alpha=2.0, beta=3.0, boundaries=X.STARTS)
    return models.predict_ridge(d, "v", m).select("id", R(F.col("pred")[0]).alias("y"), R(F.col("pred")[1], 4).alias("lat"))


@query("mdl3_alpha_path")
def mdl3(spark, sf):
    """Spatial folds, one cross-product pass, every penalty, spatial inner selection, R^2 per fold."""
    v = X.vectors(spark, sf)
    d = folds.spatial_folds(v, cell_deg=10.0, order="lex").withColumn("bucket", F.lit(0))
    grams = models.fold_grams(d, "v", ["y"], shift=stats.feature_shift(v, "v", ["y"]))
    g, _ = models.score_grid(d, "v", targets=["y"], rule="probe", inner="spatial", grams=grams)
    return models.choose(cut_lineage(g, "grid"), {"ridge_w64": [0]}).select(
        F.col("outer").alias("fold"), _alpha(models.RIDGE_ALPHAS), R("inner_score").alias("inner_score"), R("score").alias("score"))


@query("mdl4_profiles")
def mdl4(spark, sf):
    """Best outer-fold mean of every profile and family."""
    g, _ = models.score_grid(blocked(spark, sf), "v", targets=["y"], profiles=PROFILES, rule="clamp", inner="none")
    return models.selected(g, {p.name: [i] for i, p in enumerate(PROFILES)} | FAMILIES).select("config", R("score").alias("score"))


@query("mdl5_nested_selection")
def mdl5(spark, sf):
    """Per-fold (profile, penalty) of every pool under random and spatial inner folds."""
    d, out = blocked(spark, sf), None
    for rule, inner in (("nested", "random"), ("nested_spatial", "spatial")):
        ch, _, _ = models.nested_score(d, "v", targets=["y"], profiles=PROFILES, families=FAMILIES, rule="clamp", inner=inner)
        part = ch.select("config", F.lit(rule).alias("rule"), F.col("outer").alias("fold"), _profile(), _alpha(models.RIDGE_ALPHAS), R("score").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("mdl5_nested_classification")
def mdl5b(spark, sf):
    d, n = models.class_codes(blocked(spark, sf), "cls")
    ch, _, _ = models.nested_score(d, "v", cls="cls_code", n_classes=n, inner="spatial")
    return ch.select(F.col("outer").alias("fold"), _alpha(models.RIDGE_ALPHAS), R("inner_score").alias("inner_score"), R("score").alias("score"))


@query("mdl6_fold_predictions")
def mdl6(spark, sf):
    p = models.fold_predictions(blocked(spark, sf), "v", "id", target="y")
    return p.select("id", "fold", R("truth").alias("truth"), R("pred").alias("pred"))


@query("mdl6_channel_predictions", W(VECS, _MOD, _FITS) + f"SELECT te.id, te.fold::INT AS fold, {r('te.y')} AS truth, {r('my+(x-mx)*sxy/(sd*sd)/(sxx/(sd*sd)+1)')} AS pred FROM te JOIN st USING (o,i) WHERE i=-1")
def mdl6_channel(spark, sf):
    """Out-of-fold predictions on one channel at one penalty."""
    p = models.fold_predictions(_channel(spark, sf), "v", "id", target="y", alphas=(1.0,))
    return p.select("id", F.col("fold").cast("int").alias("fold"), R("truth").alias("truth"), R("pred").alias("pred"))


@query("mdl7_logistic")
def mdl7(spark, sf):
    d = folds.stratified_folds(X.vectors(spark, sf), "id", "cls", seed=0)
    return models.logistic_scores(cut_lineage(d, "folds"), "v", "cls").select("fold", "c", R("accuracy").alias("accuracy"))


def _stratified(spark, sf):
    """Vectors with class-stratified folds, and inner folds stratified by class inside each."""
    d = folds.stratified_folds(X.vectors(spark, sf), "id", "cls", seed=0)
    d = folds.random_folds(d, "id", seed=0, stream=7, group=["fold", "cls"], out="bucket")
    return models.class_codes(cut_lineage(d, "folds"), "cls")


@query("mdl7_logistic_inner_choice")
def mdl7_inner(spark, sf):
    """Penalty of every fold by inner cross-validation, and the held-out accuracy at it."""
    d, n = _stratified(spark, sf)
    return models.logistic_path(d, "v", "cls_code", n).select("fold", R("c").alias("c"), R("accuracy").alias("accuracy"))


@query("mdl7_logistic_c_sweep")
def mdl7b(spark, sf):
    """Best accuracy over the penalty grid, chosen on the held-out fold as the original does."""
    d, n = _stratified(spark, sf)
    return models.logistic_path(d, "v", "cls_code", n, select="test").select("fold", R("accuracy").alias("accuracy"))


@query("mdl8_knn_probe")
def mdl8(spark, sf):
    d = folds.stratified_folds(X.vectors(spark, sf), "id", "cls", seed=0)
    return models.knn_scores(cut_lineage(d, "folds"), "v", "id", "cls").select("fold", R("accuracy").alias("accuracy"), "n")


_VOTES = ("w AS (SELECT id, (row_number() OVER (ORDER BY id)-1)%5 AS fold, v[1] AS a, v[2] AS b, cls AS c FROM vecs), "
          "s AS (SELECT f.fold AS o, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM w JOIN (SELECT DISTINCT fold FROM w) f ON w.fold<>f.fold GROUP BY 1), "
          "n AS (SELECT q.id, q.fold, q.c AS truth, t.c, row_number() OVER (PARTITION BY q.id ORDER BY pow((q.a-t.a)/sa,2)+pow((q.b-t.b)/sb,2), t.id) AS k FROM w q JOIN s ON q.fold=o JOIN w t ON t.fold<>q.fold), "
          "v AS (SELECT id, fold, truth, c, count(*) AS v FROM n WHERE k<=10 GROUP BY 1,2,3,4), p AS (SELECT id, fold, truth, arg_max(c,(v,-c)) AS p FROM v GROUP BY 1,2,3)")


@query("mdl8_knn_two_channels", W(VECS, _VOTES) + f"SELECT fold::BIGINT AS fold, {r('avg(CASE WHEN p=truth THEN 1.0::DOUBLE ELSE 0 END)')} AS accuracy, count(*)::BIGINT AS n FROM p GROUP BY 1")
def mdl8_channels(spark, sf):
    """The ten-neighbour vote on two standardized channels."""
    return models.knn_scores(_channel(spark, sf, n=2), "v", "id", "cls").select("fold", R("accuracy").alias("accuracy"), "n")


@query("mdl9_principal_scores")
def mdl9(spark, sf):
    """Three scores of the full vector, a prefix on its own basis, and a band on the shared one."""
    p = models.PrincipalScores(X.vectors(spark, sf).select("id", "v"), "v")
    full = p.heavy_tail_positive(p.own(0, 64), "id")
    parts = {"full": full, "prefix_own_16": p.align(p.own(0, 16), full), "prefix_shared_16": p.cut(full, 0, 16), "band_own_16_32": p.align(p.own(16, 32), full)}
    out = None
    for name, basis in parts.items():
        s = p.scores(basis).select("id", F.lit(name).alias("part"), *[R(F.col("pc")[i], 5).alias(f"pc{i + 1}") for i in range(3)])
        out = s if out is None else out.unionByName(s)
    return out


_LOO = ("ft AS (SELECT DISTINCT fold AS o FROM r), al AS (SELECT range::INT AS ai, pow(10.0,(range-8)/2.0) AS alpha FROM range(21)), tr AS (SELECT o, r.* FROM ft JOIN r ON fold<>o), "
        "st AS (SELECT o, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x)*count(*) AS sxx, covar_pop(x,y)*count(*) AS sxy, var_pop(x) AS v FROM tr GROUP BY 1), "
        "b AS (SELECT o, ai, alpha, n, mx, my, v, sxy/v/(sxx/v+alpha) AS b, sxx/v+alpha AS d FROM st, al), "
        "s AS (SELECT o, ai, any_value(alpha) AS alpha, any_value(b) AS b, any_value(mx) AS mx, any_value(my) AS my, sum(pow((y-my-(x-mx)*b)/(1-1.0/n-(x-mx)*(x-mx)/v/d),2)) AS sse FROM tr JOIN b USING (o) GROUP BY 1,2), "
        "c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY o ORDER BY sse, ai)=1)")


@query("mdl10_leave_one_out_choice", W(VECS, _MOD, _LOO) + f"SELECT o::BIGINT AS fold, {r('any_value(alpha)')} AS alpha, {r('1-sum(pow(r.y-my-(x-c.mx)*b,2))/(var_pop(r.y)*count(*))')} AS r2 FROM c JOIN r ON r.fold=o GROUP BY 1")
def mdl10_choice(spark, sf):
    """Leave-one-out choice and held-out R^2 on one channel."""
    return models.loo_ridge_r2(_channel(spark, sf), "v", "y").select("fold", R("alpha").alias("alpha"), R("r2").alias("r2"))


@query("mdl10_leave_one_out_ridge")
def mdl10(spark, sf):
    return models.loo_ridge_r2(blocked(spark, sf, 0.0), "v", "y").select("fold", "alpha", R("r2").alias("r2"))


@query("mdl11_evaluate_tasks")
def mdl11(spark, sf):
    """Two regression tasks under spatial folds, with the mean row."""
    d = X.vectors(spark, sf).withColumn("lat_task", F.col("lat"))
    return sweeps.evaluate_tasks(d, "v", ["y", "lat_task"], spatial=True).select("task", R("score").alias("score"))


@query("mdl11_class_probes")
def mdl11_classes(spark, sf):
    """The class task under the three probes (random folds) and under ridge with spatial folds and with an official split."""
    d = X.vectors(spark, sf).withColumn("official", F.col("id") % 4 == 0)
    run = lambda name, **kw: sweeps.evaluate_tasks(d, "v", ["cls"], task_type="classification", **kw).where("task <> 'MEAN'").select(F.lit(name).alias("probe"), R("score").alias("score"))
    return sweeps.union([run("ridge"), run("knn", probe="knn"), run("logistic", probe="logistic", select="test"), run("ridge_spatial", spatial=True), run("ridge_official", test_flag="official")])


@query("mdl12_block_size_sweep")
def mdl12(spark, sf):
    return sweeps.block_size_sweep(X.vectors(spark, sf), "v", ["y"], benchmark="vectors", widths=X.WIDTHS, order="lex")


@query("mdl13_penalty_sweep")
def mdl13(spark, sf):
    res, _ = sweeps.penalty_sweep(X.vectors(spark, sf), "v", ["y"], benchmark="vectors", widths=X.WIDTHS, starts=X.STARTS, order="lex")
    return res.select("config", "rule", "cell_deg", "task", "n", "median_nn_train_km", "n_folds_nonempty", "score")


_XYZ = "xyz AS (SELECT *, cos(radians(lat))*cos(radians(lon)) AS x, cos(radians(lat))*sin(radians(lon)) AS yy, sin(radians(lat)) AS z FROM f)"
_FOLD = ("c AS (SELECT 10.0::DOUBLE AS cell, a, b, (row_number() OVER (ORDER BY a, b)-1)%5 AS fold FROM (SELECT DISTINCT floor(lat/10) AS a, floor(lon/10) AS b FROM pts)), "
         "f AS (SELECT 0.0::DOUBLE AS cell, id, lat, lon, y, (row_number() OVER (ORDER BY id)-1)%5 AS fold FROM pts UNION ALL "
         "SELECT cell, id, lat, lon, y, fold FROM pts JOIN c ON floor(lat/10)=a AND floor(lon/10)=b)")
_CH = "sqrt((a.x-b.x)*(a.x-b.x)+(a.yy-b.yy)*(a.yy-b.yy)+(a.z-b.z)*(a.z-b.z))"
_NB = (f"n AS (SELECT a.cell, a.fold, a.id, a.y AS truth, b.y, greatest(2*6371.0*asin(least(1.0,{_CH}/2)),0.01) AS km, row_number() OVER (PARTITION BY a.cell, a.id ORDER BY {_CH}, b.id) AS rank "
       "FROM xyz a JOIN xyz b ON a.cell=b.cell AND a.fold<>b.fold)")
_PR = "p AS (SELECT cell, fold, k, id, any_value(truth) AS truth, sum(y/km)/sum(1/km) AS pred FROM n, (VALUES (1),(5),(20)) t(k) WHERE rank<=k GROUP BY 1,2,3,4)"


@query("mdl14_interpolation_sweep", W(PTS, _FOLD, _XYZ, _NB, _PR) + f"SELECT cell AS cell_deg, k::INT AS k, {r('avg(s)', 4)} AS score FROM "
       "(SELECT cell, fold, k, 1-sum((truth-pred)*(truth-pred))/(var_pop(truth)*count(*)) AS s FROM p GROUP BY 1,2,3) GROUP BY 1,2")
def mdl14(spark, sf):
    """The two cell sizes of the SQL; mdl14_interpolation_ladder has all."""
    return _interpolation(spark, sf, (0.0, 10.0))


@query("mdl14_interpolation_ladder")
def mdl14b(spark, sf):
    return _interpolation(spark, sf, sweeps.CELL_SIZES)


def _interpolation(spark, sf, cells):
    out = sweeps.interpolation_sweep(X.points(spark, sf).select("id", "lat", "lon", "y"), "y", benchmark="points", ks=KS, cells=cells, order="lex")
    return out.select("cell_deg", "k", R("score", 4).alias("score"))


_KEPT = ("xy AS (SELECT *, cos(radians(lat))*cos(radians(lon)) AS a, cos(radians(lat))*sin(radians(lon)) AS b, sin(radians(lat)) AS z FROM r), "
         "nn AS (SELECT p.id, q.fold AS target, min(2*6371.0*asin(least(1.0,sqrt((p.a-q.a)*(p.a-q.a)+(p.b-q.b)*(p.b-q.b)+(p.z-q.z)*(p.z-q.z))/2))) AS km FROM xy p JOIN xy q ON p.fold<>q.fold GROUP BY 1,2)")


@query("mdl15_retained_rows", W(VECS, _MOD, _KEPT) + "SELECT mode, target::INT AS target, radius::DOUBLE AS radius_km, count(*) FILTER (NOT km<radius)::BIGINT AS n_kept FROM nn, (VALUES "
       + ", ".join(f"({x})" for x in sweeps.RADII_KM) + ") t(radius), (VALUES ('buffer'),('random_drop')) m(mode) GROUP BY 1,2,3")
def mdl15_kept(spark, sf):
    """Training rows left of every held-out fold at every radius, under the buffer and its random control."""
    d = cut_lineage(sweeps.with_folds(X.vectors(spark, sf).select("id", "lat", "lon"), 0.0), "folds")
    lv = sweeps.retention_levels(d, sweeps.RADII_KM)
    at = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(x).alias("radius_km")) for j, x in enumerate(sweeps.RADII_KM)])).alias("r")
    return lv.select("mode", F.col("target").cast("int").alias("target"), "level", at).groupBy("mode", "target", F.col("r.radius_km").alias("radius_km")).agg(
        F.count_if(F.col("level") > F.col("r.j")).alias("n_kept"))


@query("mdl15_buffered_exclusion")
def mdl15(spark, sf):
    pr = [models.Profile(f"ridge_w{w}", w) for w in X.WIDTHS]
    return sweeps.buffered_sweep(X.vectors(spark, sf), "v", ["y"], benchmark="vectors", profiles=pr, families={"cv_width": list(range(len(pr)))}, idw_k=5)


@query("mdl16_distance_error")
def mdl16(spark, sf):
    d = X.vectors(spark, sf).withColumn("v8", F.slice("v", 1, 8))
    out = sweeps.distance_error_sweep(d, {"emb_8": "v8", "emb_64": "v"}, "y", order="lex")
    return out.select("encoder", "cell_deg", "bin", "lo_km", "hi_km", "n", "skill")


@query("mdl17_variogram_sweep")
def mdl17(spark, sf):
    """Two networks over the points on land, every point at every lag: half-sill distance per prefix."""
    land = X.polygons(spark)
    a = cut_lineage(joins.on_land(X.points(spark, sf), land).select("id", "lat", "lon"), "land")
    parts = []
    for tag, depth in (("deep", 3), ("shallow", 1)):
        v = sweeps.variogram(a, X.demo_weights(depth=depth), polygons=land, widths=X.WIDTHS, pairs_per_lag=None, dim=64, tag=tag)
        parts.append(v.groupBy("encoder", "width").agg(R(F.max("sill")).alias("sill"), R(F.max("half_sill_km"), 3).alias("half_sill_km"), F.sum("n_pairs").alias("n_pairs")))
    return sweeps.union(parts)


def _raw_family(spark, sf):
    """Raw files shaped like four source families, derived from the customers."""
    root, p = shared_dir(spark, "raw"), X.points(spark, sf)
    put = lambda d, name: d.write.option("header", True).csv(f"{root}/{name}")
    put(p.select(F.col("lon").alias("Longitude"), F.col("lat").alias("Latitude"), F.col("y").alias("MedHouseVal")), "california_housing/california_housing.csv")
    pt = F.concat(F.lit("POINT ("), F.format_string("%.2f", "lon"), F.lit(" "), F.format_string("%.2f", "lat"), F.lit(")"))
    put(p.select(F.col("id").alias("ZCTA5"), pt.alias("Geolocation"), F.col("y").alias("PHLTH_CrudePrev")), "cdc_places/cdc_places_zcta_2023.csv")
    for name, part in (("trainval", p.where(F.col("id") % 4 != 0)), ("test", p.where(F.col("id") % 4 == 0))):
        put(part.select(F.col("id").alias("DHSID_EA"), "lat", "lon", "year", F.col("y").alias("asset_index")), f"sustainbench/dhs_{name}_labels.csv")
    for k in catalog_labels():
        d = p.select(F.col("id").alias("ID"), "lat", "lon", F.col("y").alias(k))
        put(d.drop("lat", "lon") if k in ("income", "housing") else d.where(F.col("id") % 10 != 0), f"usavars/usavars_{k}.csv")
    return root


def catalog_labels():
    from ..sources.catalog import USAVARS_LABELS

    return USAVARS_LABELS


@query("mdl19_normalize_sources", W(PTS) + f"""SELECT config, count(*)::BIGINT AS n, {r('sum(lon)', 3)} AS lon, {r('sum(lat)', 3)} AS lat, count(ts)::BIGINT AS stamped,
 count(DISTINCT split)::BIGINT AS splits, count(ident)::BIGINT AS ids FROM (
 SELECT 'california_housing' AS config, lon, lat, NULL AS ts, NULL AS split, NULL AS ident FROM pts UNION ALL SELECT 'cdc_places', lon, lat, NULL, NULL, NULL FROM pts
 UNION ALL SELECT 'sustainbench', lon, lat, 1, CASE WHEN id%4=0 THEN 'test' ELSE 'trainval' END, id FROM pts
 UNION ALL SELECT 'usavars_'||k, lon, lat, NULL, NULL, id FROM pts, (VALUES ('treecover'),('elevation'),('population'),('nightlights'),('income'),('roads'),('housing')) t(k) WHERE id%10<>0) GROUP BY 1""")
def mdl19(spark, sf):
    root, out, parts = _raw_family(spark, sf), shared_dir(spark, "normalized"), []
    for family in ("california_housing", "cdc_places", "sustainbench", "usavars"):
        for config in normalize.normalize_family(spark, root, out, family):
            d = files.read_canonical(spark, out, config)
            parts.append(d.agg(F.count(F.lit(1)).alias("n"), R(F.sum("lon"), 3).alias("lon"), R(F.sum("lat"), 3).alias("lat"), F.count("timestamp").alias("stamped"),
                               F.count_distinct("split").alias("splits"), F.count("id").alias("ids")).withColumn("config", F.lit(config)))
    return sweeps.union(parts)


@query("mdl19_check_sources", W(PTS) + "SELECT 'california_housing' AS config, 'MedHouseVal' AS \"column\", count(DISTINCT (lat,lon))::BIGINT AS coordinates, 0::BIGINT AS missing, 0::BIGINT AS bad FROM pts")
def mdl19b(spark, sf):
    root, out = _raw_family(spark, sf), shared_dir(spark, "normalized")
    normalize.normalize_family(spark, root, out, "california_housing")
    return normalize.check_family(spark, root, out, "california_housing")
