"""Preprocessing, oversampling and model fits."""

from __future__ import annotations

from checks.fixtures import CONFIG, KNN_SQL, LOG2_SQL, LOW_SQL, SCALE_SQL, SQL, STANDARD_ID, Fixtures
from checks import fit_sql
from checks.registry import query
from checks.stats import EMBED_SQL, one_against_rest
from peaklake.functions.vectors import has_gap, linear_decision
from peaklake.functions.vectors import linear_predict as sign_of
from peaklake.operators.columns import train_rows
from peaklake.config import STANDARD_PAIRS
from peaklake.operators.matrix import Matrix, feature_axis, keyed_matrix, row_vectors
from peaklake.operators.neighbors import borderline_smote as smote
from peaklake.operators.neighbors import knn_impute as impute
from peaklake.operators.neighbors import nearest_donor_values, nearest_rows
from peaklake.operators.neighbors import resample as resample_rows
from peaklake.operators import preprocess as P
from peaklake.operators.missing import filter_groupwise_missingness as groupwise
from peaklake.operators.matrix import keep_features
from peaklake.operators.solver import fit_linear, model_spec, score_models
from peaklake.operators import svm_terms as V
from peaklake.operators.metrics import metric_columns, METRICS
from peaklake.plans.dataset import make_dataset as build_dataset
from peaklake.plans.dataset import pair_membership
from peaklake.workspace import Workspace
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cells(matrix: Matrix) -> DataFrame:
    return matrix.cells().withColumn("value", F.round("value", 6))


def _logged(fx: Fixtures) -> Matrix:
    matrix = fx.keyed()
    return P.apply_log2(matrix, P.fit_log2(matrix, CONFIG.fallback_eps))


def _filled(fx: Fixtures, stage=None) -> Matrix:
    logged = _logged(fx)
    filled = P.apply_low_value(logged, P.fit_low_value(logged, CONFIG.nan_threshold), CONFIG.noise_scale, CONFIG.seed)
    return filled if stage is None else filled.with_rows(stage(filled.rows, "filled"))


@query(SQL + "SELECT sample_id, feature_id, round(value, 9) AS value FROM normalized WHERE value IS NOT NULL")
def normalize(fx):
    cells = fx.abundances.withColumnRenamed("area", "value")
    out = P.normalize_cells(cells, fx.samples, STANDARD_ID)
    return out.withColumn("value", F.round("value", 9))


@query(LOG2_SQL + "SELECT pair, sample_id, feature_id, round(value, 6) AS value FROM logged")
def log2_pseudocount(fx):
    return _cells(_logged(fx))


@query(LOW_SQL + "SELECT pair, sample_id, feature_id, round(value, 6) AS value FROM filled")
def low_value_impute(fx):
    return _cells(_filled(fx))


@query(KNN_SQL + "SELECT pair, sample_id, feature_id, rank, donor_id, round(dist, 6) AS dist FROM ranked WHERE rank <= 4")
def knn_top_k(fx):
    matrix = _filled(fx, Workspace(fx.spark, "knn").stage)
    keys = list(matrix.keys)
    near = nearest_donor_values(matrix.rows.where(has_gap(F.col("x"))), matrix.rows.where(train_rows()), keys, 4)
    named = near.join(matrix.positions(), [*keys, "pos"])
    return named.select(*keys, "sample_id", "feature_id", F.col("rank").cast("bigint").alias("rank"), "donor_id", F.round("dist", 6).alias("dist"))


@query(KNN_SQL + """
SELECT pair, feature_id, count(*) AS n_neighbours, round(sum(dist), 3) AS total FROM ranked WHERE rank <= 4 GROUP BY 1, 2
""")
def knn_cross_join(fx):
    """The same search with small blocks, so that every query meets several donor blocks."""
    matrix = _filled(fx, Workspace(fx.spark, "knn").stage)
    keys = list(matrix.keys)
    near = nearest_donor_values(
        matrix.rows.where(has_gap(F.col("x"))), matrix.rows.where(train_rows()), keys, 4, block_rows=200
    )
    return near.join(matrix.positions(), [*keys, "pos"]).groupBy(*keys, "feature_id").agg(
        F.count(F.lit(1)).alias("n_neighbours"), F.round(F.sum("dist"), 3).alias("total")
    )


@query(KNN_SQL + "SELECT pair, sample_id, feature_id, round(value, 6) AS value FROM complete")
def knn_impute(fx):
    return _cells(impute(_filled(fx, Workspace(fx.spark, "knn").stage), 4))


@query(LOG2_SQL + """,
moments AS (SELECT pair, feature_id, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(value) END AS sd
            FROM logged WHERE NOT test_split GROUP BY 1, 2)
SELECT k.pair, k.sample_id, k.feature_id, round((value - mean) / sd, 6) AS value
FROM logged k JOIN moments m ON m.pair = k.pair AND m.feature_id = k.feature_id
""")
def standard_scale(fx):
    matrix = _logged(fx)
    return _cells(P.apply_scale(matrix, P.fit_scale(matrix)))


@query(SCALE_SQL + "SELECT pair, sample_id, feature_id, round(value, 6) AS value FROM scaled")
def preprocess_all_steps(fx):
    return _cells(P.preprocess(fx.keyed(), CONFIG, Workspace(fx.spark, "preprocess").stage))


@query(SQL + """
SELECT s.sample_id, s.condition AS label, a.feature_id, a.area AS value FROM fx_samples s JOIN fx_abundances a ON a.sample_id = s.sample_id
WHERE s.condition IN ('control', 'activated') AND s.symptomatic IN ('+', 'unknown') AND NOT s.test_split
""")
def make_dataset(fx):
    cells, samples = build_dataset(fx.star, ["control", "activated"], ["+", "unknown"], "train")
    return cells.join(samples.select("sample_id", "label"), "sample_id")


@query(LOG2_SQL.replace("keyed AS (", "unfiltered AS (").replace("eps AS (", """kept AS (
  SELECT pair, feature_id FROM (
    SELECT pair, feature_id, condition, count(*) AS n, 1 - (1 - count(value) / count(*)::DOUBLE) AS share
    FROM unfiltered WHERE NOT test_split GROUP BY 1, 2, 3)
  WHERE n >= 3 GROUP BY 1, 2 HAVING bool_and(share >= 0.6::DOUBLE)),
keyed AS (SELECT u.* FROM unfiltered u JOIN kept k ON k.pair = u.pair AND k.feature_id = u.feature_id),
eps AS (""") + """
SELECT pair, condition, feature_id, count(*) AS n, count(value) AS n_observed, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd
FROM logged WHERE NOT test_split GROUP BY 1, 2, 3
""")
def study_profile(fx):
    """The flagship: query, densify, filter by group, normalise, log, and describe every feature per condition."""
    matrix = fx.keyed()
    kept = keep_features(matrix, groupwise(matrix, ["condition"], 0.6, 3, True, where=train_rows()))
    logged = P.apply_log2(kept, P.fit_log2(kept, CONFIG.fallback_eps))
    stats = logged.exploded("condition", where=train_rows()).groupBy("pair", "condition", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_observed"),
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"),
    )
    return logged.positions().join(stats, ["pair", "pos"]).drop("pos")


# ---- oversampling -------------------------------------------------------------------------------------------

SMOTE_SQL = EMBED_SQL + """,
info AS (
  SELECT pair, CASE WHEN count(*) FILTER (y = 1) <= count(*) FILTER (y = 0) THEN 1 ELSE 0 END AS minority,
         abs(count(*) FILTER (y = 1) - count(*) FILTER (y = 0)) AS n_new FROM emb GROUP BY 1),
vecs AS (SELECT lpad(CAST(vec_id AS VARCHAR), 6, '0') AS sample_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
dists AS (
  SELECT a.sample_id AS a, b.sample_id AS b,
         round(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 9) AS dist
  FROM vecs a JOIN vecs b ON a.sample_id <> b.sample_id),
mino AS (SELECT e.pair, e.sample_id FROM emb e JOIN info i ON i.pair = e.pair AND e.y = i.minority),
around AS (
  SELECT m.pair, m.sample_id, e.y <> i.minority AS other,
         row_number() OVER (PARTITION BY m.pair, m.sample_id ORDER BY d.dist, d.b) AS r
  FROM mino m JOIN dists d ON d.a = m.sample_id JOIN emb e ON e.pair = m.pair AND e.sample_id = d.b JOIN info i ON i.pair = m.pair),
danger AS (
  SELECT pair, sample_id, row_number() OVER (PARTITION BY pair ORDER BY md5(concat('42|', sample_id)), sample_id) AS d,
         count(*) OVER (PARTITION BY pair) AS n_danger
  FROM (SELECT pair, sample_id, count(*) FILTER (other) AS n FROM around WHERE r <= 10 GROUP BY 1, 2)
  WHERE n * 2 >= 10 AND n < 10),
kin AS (
  SELECT * FROM (SELECT g.pair, g.sample_id, d.b AS kin_id, row_number() OVER (PARTITION BY g.pair, g.sample_id ORDER BY d.dist, d.b) AS k
    FROM danger g JOIN dists d ON d.a = g.sample_id JOIN mino m ON m.pair = g.pair AND m.sample_id = d.b) WHERE k <= 5),
sizes AS (SELECT DISTINCT d.pair, d.n_danger, i.n_new, i.minority FROM danger d JOIN info i ON i.pair = d.pair),
draws AS (
  SELECT pair, minority, g,
         CAST(concat('0x', substr(md5(concat('42|', pair, '|', g, '|row')), 1, 8)) AS BIGINT) % n_danger + 1 AS d,
         CAST(concat('0x', substr(md5(concat('42|', pair, '|', g, '|kin')), 1, 8)) AS BIGINT) % 5 + 1 AS k,
         CAST(concat('0x', substr(md5(concat('42|', pair, '|', g, '|gap')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM (SELECT *, unnest(range(n_new)) AS g FROM sizes))
SELECT w.pair, 'synthetic-' || w.g AS row_id, CAST(w.minority AS INT) AS y,
       round(list_sum(list_transform(list_zip(p.x, q.x), lambda t: t[1] + w.u * (t[2] - t[1]))), 6) AS total,
       round(p.x[1] + w.u * (q.x[1] - p.x[1]), 6) AS first
FROM draws w JOIN danger g ON g.pair = w.pair AND g.d = w.d JOIN kin n ON n.pair = w.pair AND n.sample_id = g.sample_id AND n.k = w.k
JOIN vecs p ON p.sample_id = g.sample_id JOIN vecs q ON q.sample_id = n.kin_id
"""


def _row_sums(rows: DataFrame) -> DataFrame:
    total = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v)
    return rows.select("pair", "row_id", "y", F.round(total, 6).alias("total"), F.round(F.get("x", F.lit(0)), 6).alias("first"))


def _labelled(fx: Fixtures) -> DataFrame:
    return Workspace(fx.spark, "labels").stage(one_against_rest(fx).withColumnRenamed("sample_id", "row_id"), "rows")


@query(SMOTE_SQL)
def borderline_smote(fx):
    return _row_sums(smote(_labelled(fx), ["pair"], stage=Workspace(fx.spark, "smote").stage))


# SMOTE on the rows that under-sampling keeps, beside these rows themselves.
RESAMPLE_SQL = (
    EMBED_SQL + """,
taken AS (SELECT pair, sample_id, y, embedding FROM (
  SELECT *, row_number() OVER (PARTITION BY pair, y ORDER BY md5(concat('42|', pair, '|', sample_id)), sample_id) AS r FROM sized)
  WHERE n <= 5 * n_other OR r <= round_even(5.0::DOUBLE * n_other, 0))"""
    + SMOTE_SQL.removeprefix(EMBED_SQL).replace(" emb ", " taken ") + """
UNION ALL SELECT pair, sample_id, y, round(list_sum(CAST(embedding AS DOUBLE[])), 6), round(CAST(embedding[1] AS DOUBLE), 6) FROM taken"""
)


@query(RESAMPLE_SQL)
def resample(fx):
    """Under-sample to 5:1, then balance with synthetic rows."""
    stage = Workspace(fx.spark, "resample").stage
    return _row_sums(resample_rows(_labelled(fx), ["pair"], True, True, stage=stage))


@query(EMBED_SQL + """,
vecs AS (SELECT lpad(CAST(vec_id AS VARCHAR), 6, '0') AS sample_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT row_id, donor_id, rank, round(dist, 6) AS dist FROM (
  SELECT a.sample_id AS row_id, b.sample_id AS donor_id, d AS dist,
         row_number() OVER (PARTITION BY a.sample_id ORDER BY d, b.sample_id) AS rank
  FROM vecs a JOIN vecs b ON a.sample_id <> b.sample_id,
       LATERAL (SELECT round(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 9) AS d))
WHERE rank <= 10
""", name="nearest_rows")
def nearest(fx):
    """The neighbour search behind the oversampling, over all embeddings."""
    rows = fx.table("embeddings").select(
        F.lit("all").alias("pair"), F.lpad(F.col("vec_id").cast("string"), 6, "0").alias("row_id"),
        F.col("label").cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("x"),
    )
    near = nearest_rows(rows, rows, ["pair"], 10)
    return near.select("row_id", "donor_id", F.col("rank").cast("bigint").alias("rank"), F.round("dist", 6).alias("dist"))


# ---- linear models ------------------------------------------------------------------------------------------

SVM_SQL = EMBED_SQL + """,
rows AS (SELECT pair, sample_id, 2 * y - 1 AS s, CAST(embedding AS DOUBLE[]) AS x FROM emb),
steps AS (SELECT pair, 1.0::DOUBLE / (2.0::DOUBLE * max(list_sum(list_transform(x, lambda v: v * v))) + 1e-12::DOUBLE) AS step, count(*) AS n FROM rows GROUP BY 1),
longform AS (SELECT pair, sample_id, s, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM rows),
g0 AS (SELECT pair, i, avg(-2.0::DOUBLE * s * v) AS g FROM longform GROUP BY 1, 2),
b0 AS (SELECT pair, avg(-2.0::DOUBLE * s) AS g FROM rows GROUP BY 1),
w1 AS (SELECT g0.pair, i, sign(-step * g) * greatest(abs(step * g) - step * 0.001::DOUBLE, 0) AS w FROM g0 JOIN steps ON steps.pair = g0.pair),
b1 AS (SELECT b0.pair, -step * g AS b FROM b0 JOIN steps ON steps.pair = b0.pair),
slack AS (
  SELECT l.pair, l.sample_id, l.s, greatest(0, 1 - l.s * (sum(l.v * w) + max(b))) AS gap
  FROM longform l JOIN w1 ON w1.pair = l.pair AND w1.i = l.i JOIN b1 ON b1.pair = l.pair GROUP BY 1, 2, 3),
g1 AS (SELECT l.pair, l.i, avg(-2.0::DOUBLE * l.s * k.gap * l.v) AS g FROM longform l JOIN slack k ON k.pair = l.pair AND k.sample_id = l.sample_id GROUP BY 1, 2),
gb1 AS (SELECT pair, avg(-2.0::DOUBLE * s * gap) AS g FROM slack GROUP BY 1)
"""
LAMBDA = 0.001


def _first_step(fx: Fixtures):
    stage = Workspace(fx.spark, "svm").stage
    rows = stage(one_against_rest(fx), "rows")
    steps = stage(V.default_step(rows, ["pair"]), "steps")
    weights = V.proximal_step(rows, V.zero_weights(rows, ["pair"]), steps, ["pair"], LAMBDA)
    return rows, steps, stage(weights, "weights")


def _listed(weights: DataFrame, column: str) -> DataFrame:
    return weights.select("pair", F.posexplode(column).alias("i", "w")).select(
        "pair", (F.col("i") + 1).cast("bigint").alias("i"), F.round("w", 9).alias("w")
    )


@query(SVM_SQL + "SELECT pair, CAST(i AS BIGINT) AS i, round(g, 9) AS w FROM g1 UNION ALL SELECT pair, 65, round(g, 9) FROM gb1")
def svm_gradient(fx):
    """Slope after the first step; entry 65 is the intercept."""
    rows, _, weights = _first_step(fx)
    slope = V.svm_gradient(rows, weights, ["pair"])
    return _listed(slope.withColumn("all", F.concat("gw", F.array("gb"))), "all")


@query(SVM_SQL + """
SELECT k.pair, round(avg(gap * gap) + max(p), 9) AS objective FROM slack k
JOIN (SELECT pair, 0.001::DOUBLE * sum(abs(w)) AS p FROM w1 GROUP BY 1) q ON q.pair = k.pair GROUP BY 1
""")
def svm_objective(fx):
    rows, _, weights = _first_step(fx)
    return V.svm_objective(rows, weights, ["pair"], LAMBDA).withColumn("objective", F.round("objective", 9))


@query(SVM_SQL + """
SELECT g1.pair, CAST(g1.i AS BIGINT) AS i, round(sign(w - step * g) * greatest(abs(w - step * g) - step * 0.001::DOUBLE, 0), 9) AS w
FROM g1 JOIN w1 ON w1.pair = g1.pair AND w1.i = g1.i JOIN steps ON steps.pair = g1.pair
""")
def svm_two_steps(fx):
    """The solver's own plain steps, two of them."""
    rows = Workspace(fx.spark, "svm").stage(one_against_rest(fx), "rows")
    spec = model_spec("l1_svm", lam=LAMBDA, accelerate=False, max_iter=2)
    models = rows.select("pair").distinct().select("pair", F.lit("m").alias("model"), F.lit(None).cast("array<int>").alias("positions"), *spec)
    return _listed(fit_linear(rows, models, ["pair"]), "coef")


@query(SVM_SQL + "SELECT l.pair, l.sample_id, round(sum(v * w) + max(b), 9) AS decision FROM longform l JOIN w1 ON w1.pair = l.pair AND w1.i = l.i "
       "JOIN b1 ON b1.pair = l.pair GROUP BY 1, 2", name="linear_decision")
def decision(fx):
    rows, _, weights = _first_step(fx)
    value = linear_decision(F.col("x"), F.col("w"), F.col("b"))
    return rows.join(weights, "pair").select("pair", "sample_id", F.round(value, 9).alias("decision"))


@query(SVM_SQL + "SELECT l.pair, l.sample_id, CASE WHEN sum(v * w) >= 0 THEN 1 ELSE -1 END AS pred FROM longform l JOIN w1 ON w1.pair = l.pair AND w1.i = l.i "
       "GROUP BY 1, 2")
def linear_predict(fx):
    """Signs of the decision without intercept."""
    rows, _, weights = _first_step(fx)
    pred = sign_of(linear_decision(F.col("x"), F.col("w"), F.lit(0.0)))
    return rows.join(weights, "pair").select("pair", "sample_id", pred.alias("pred"))


def _one_per_label(fx: Fixtures, kind: str, **options) -> DataFrame:
    """All ten one-against-rest models in one fit, with their train metrics."""
    stage = Workspace(fx.spark, kind).stage
    rows = stage(one_against_rest(fx).withColumn("role", F.lit("train")), "rows")
    models = rows.select("pair").distinct().select(
        "pair", F.lit(kind).alias("model"), F.lit(None).cast("array<int>").alias("positions"), *model_spec(kind, **options)
    )
    fits = stage(fit_linear(rows, models, ["pair"]), "fits")
    scores = score_models(rows, fits, ["pair"]).select("pair", *metric_columns())
    nonzero = F.size(F.filter("coef", lambda v: F.abs(v) > 1e-6))
    return fits.join(scores, "pair").select(
        "pair", F.round("intercept", 4).alias("intercept"), nonzero.alias("n_nonzero"), "converged",
        *[F.round(m, 6).alias(m) for m in METRICS],
    )


TIGHT = 1e-9  # of the fits that are compared by value


def _one_per_label_sql(loss: str, l1: str, l2: str, balanced: bool = True) -> str:
    return EMBED_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""",
train AS (SELECT pair AS model, sample_id AS id, y, CAST(embedding AS DOUBLE[]) AS x FROM emb),{fit_sql.fits(loss, l1, l2, balanced)}
SELECT f.model AS pair, round(w[-1], 4) AS intercept, CAST(len(list_filter(w[:-2], lambda v: abs(v) > 1e-6)) AS INT) AS n_nonzero,
       off <= {TIGHT}::DOUBLE AS converged, {fit_sql.METRICS}
FROM fitted f JOIN (SELECT model, {fit_sql.COUNTS} FROM decided GROUP BY 1) c ON c.model = f.model
"""


@query(_one_per_label_sql("sq_hinge", f"{LAMBDA}::DOUBLE", "0.0::DOUBLE", balanced=False))
def l1_squared_hinge_svm(fx):
    return _one_per_label(fx, "l1_svm", lam=LAMBDA, tol=TIGHT)


@query(_one_per_label_sql("logistic", "0.9::DOUBLE / n", "0.1::DOUBLE / n"))
def elastic_net_logistic(fx):
    return _one_per_label(fx, "elastic_net", C=1.0, l1_ratio=0.9, tol=TIGHT)


@query(_one_per_label_sql("logistic", "0.0::DOUBLE", "1.0::DOUBLE / n"))
def l2_logistic(fx):
    return _one_per_label(fx, "logistic", C=1.0)


@query()
def linear_svc(fx):
    return _one_per_label(fx, "svc", C=1.0)


def wide_rows(fx: Fixtures) -> DataFrame:
    """pair, sample_id, y, x of all comparisons over brand x size: far more features than samples of a class."""
    cells = fx.abundances_by(fx.brand * 100 + F.col("p_size")).select(
        "sample_id", "feature_id", F.log2(1.0 + F.col("area")).alias("value")
    )
    stage = Workspace(fx.spark, "wide-rows").stage
    axis = stage(feature_axis(cells.select("feature_id").distinct()), "axis")
    vectors = row_vectors(stage(cells, "cells"), fx.samples.select("sample_id"), axis)
    members = pair_membership(fx.samples, STANDARD_PAIRS).select("pair", "sample_id", "y", "condition", "test_split")
    rows = keyed_matrix(vectors, axis, members, ["pair"]).rows.where(~F.col("test_split"))
    return stage(rows.select("pair", "sample_id", "y", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))).alias("x")), "rows")


def _wide(fx: Fixtures, kind: str) -> DataFrame:
    rows = wide_rows(fx).withColumn("role", F.lit("train"))
    models = rows.select("pair").distinct().select(
        "pair", F.lit(kind).alias("model"), F.lit(None).cast("array<int>").alias("positions"), *model_spec(kind, C=0.001)
    )
    fits = Workspace(fx.spark, f"wide-{kind}").stage(fit_linear(rows, models, ["pair"]), "fits")
    scores = score_models(rows, fits, ["pair"]).select("pair", *metric_columns())
    return fits.join(scores, "pair").select(
        "pair", F.size("coef").alias("n_features"), "converged", F.round("intercept", 4).alias("intercept"), *[F.round(m, 6).alias(m) for m in METRICS]
    )


@query()
def l2_logistic_wide(fx):
    return _wide(fx, "logistic")


@query()
def linear_svc_wide(fx):
    return _wide(fx, "svc")
