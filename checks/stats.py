"""Joins, aggregates, filters, splits, folds, draws, metrics and set operations."""

from __future__ import annotations

from checks.fixtures import CONFIG, KNN_SQL, LOG2_SQL, SQL, STANDARD_ID, Fixtures
from checks.ingest import SUPPLIER_SQL, supplier_wide
from checks.registry import query
from peaklake.config import EXCLUDED_SAMPLE_IDS, STANDARD_PAIRS
from peaklake.functions.hashing import draw_unit
from peaklake.functions.scalars import zfill
from peaklake.functions.vectors import sq_norm
from peaklake.operators import joins as J
from peaklake.operators import metrics as M
from peaklake.operators import sampling as A
from peaklake.operators.columns import column_stats, min_positive, missing_share, train_rows
from peaklake.operators.matrix import Matrix, feature_axis, keyed_matrix, row_vectors
from peaklake.operators.missing import filter_groupwise_missingness as groupwise
from peaklake.operators.missing import filter_overall_missingness as overall
from peaklake.operators.preprocess import apply_log2, fit_log2
from peaklake.plans.dataset import make_dataset as build_dataset
from peaklake.plans.dataset import pair_membership
from peaklake.sources import results as R
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUSTKEY = "lpad(CAST(c_custkey AS VARCHAR), 6, '0')"


# ---- joins --------------------------------------------------------------------------------------------------


@query(SUPPLIER_SQL + """
SELECT u.id, u.flag, u."column", m.measure, u.value
FROM (SELECT * FROM wide UNPIVOT INCLUDE NULLS (value FOR "column" IN (q, price, tax))) u
LEFT JOIN (VALUES ('q', 'rt'), ('price', 'area')) m("column", measure) ON m."column" = u."column"
""")
def join_column_map(fx):
    from peaklake.sources.peaklist import melt

    names = fx.spark.createDataFrame([("q", "rt"), ("price", "area")], "column string, measure string")
    return melt(supplier_wide(fx), ["id", "flag"], ["q", "price", "tax"]).join(names, "column", "left")


@query(SUPPLIER_SQL + """
SELECT coalesce(a.id, b.id) AS id, coalesce(a.flag, b.flag) AS flag, a.q, b.price
FROM (SELECT id, flag, q FROM wide WHERE flag <> 'R') a FULL JOIN (SELECT id, flag, price FROM wide WHERE flag <> 'A') b ON a.id = b.id AND a.flag = b.flag
""")
def join_full_outer_measures(fx):
    wide = supplier_wide(fx)
    left = wide.where(F.col("flag") != "R").select("id", "flag", "q")
    right = wide.where(F.col("flag") != "A").select("id", "flag", "price")
    return left.join(right, ["id", "flag"], "full")


@query(SQL + """
SELECT sample_id, feature_id, area FROM fx_abundances
WHERE sample_id IN (SELECT sample_id FROM fx_samples WHERE condition <> 'unknown')
""")
def semi_valid_samples(fx):
    valid = fx.samples.where(F.col("condition") != "unknown").select("sample_id")
    return fx.abundances.join(valid, "sample_id", "left_semi").select("sample_id", "feature_id", "area")


@query(SQL + """
SELECT p.p_partkey AS feature_id, coalesce(n, 0) AS n_obs FROM part p
LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) c ON c.l_partkey = p.p_partkey
""")
def join_feature_counts(fx):
    lines = fx.table("lineitem")
    counts = lines.groupBy(F.col("l_partkey").alias("feature_id")).agg(F.count(F.lit(1)).alias("n_obs"))
    return J.join_feature_counts(fx.table("part").select(F.col("p_partkey").alias("feature_id")), counts)


@query(SQL + """
SELECT a.sample_id, a.feature_id, s.condition, s.mean_osmolality FROM fx_abundances a
LEFT JOIN fx_samples s ON s.sample_id = a.sample_id
""")
def align_sample_metadata(fx):
    return fx.abundances.join(fx.samples, "sample_id", "left").select(
        "sample_id", "feature_id", "condition", "mean_osmolality"
    )


@query(SQL + """
SELECT s.sample_id, s.condition AS label, count(a.area) AS n_observed FROM fx_samples s
LEFT JOIN fx_abundances a ON a.sample_id = s.sample_id
WHERE s.condition IN ('control', 'activated') AND NOT s.test_split GROUP BY 1, 2
""")
def align_labels(fx):
    cells, samples = build_dataset(fx.star, ["control", "activated"], split="train")
    vectors = row_vectors(cells, samples, feature_axis(fx.features))
    observed = F.size(F.filter("x", lambda v: v.isNotNull())).cast("bigint")
    return vectors.select("sample_id", "label", observed.alias("n_observed"))


@query(SQL + """
SELECT count(DISTINCT sample_id) AS n_missing FROM fx_abundances
WHERE sample_id NOT IN (SELECT sample_id FROM fx_samples WHERE condition <> 'prevalent')
""")
def anti_missing_samples(fx):
    return J.missing_sample_count(fx.abundances, fx.samples.where(F.col("condition") != "prevalent"))


# ---- aggregates ---------------------------------------------------------------------------------------------


@query(SQL + "SELECT feature_id, count(area) AS n_obs FROM fx_abundances GROUP BY 1")
def n_obs_per_feature(fx):
    return J.n_obs_per_feature(fx.abundances)


@query(SQL + "SELECT pair, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, "
       "least(count(*) FILTER (y = 1), count(*) FILTER (y = 0)) AS n_min, greatest(count(*) FILTER (y = 1), count(*) FILTER (y = 0)) AS n_maj, "
       "CASE WHEN count(*) FILTER (y = 1) <= count(*) FILTER (y = 0) THEN 1 ELSE 0 END AS minority FROM members GROUP BY 1")
def class_counts(fx):
    return A.class_counts(pair_membership(fx.samples, STANDARD_PAIRS), ["pair"])


@query(SQL + "SELECT DISTINCT sample_id FROM fx_abundances")
def distinct_ids(fx):
    return fx.abundances.select("sample_id").distinct()


RAW_SQL = SQL + """,
raw AS (SELECT m.pair, m.condition, m.symptomatic, m.sample_id, m.test_split, d.feature_id, d.value
        FROM members m JOIN dense d ON d.sample_id = m.sample_id)
"""


@query(RAW_SQL + "SELECT pair, feature_id FROM raw GROUP BY 1, 2 HAVING 1 - count(value) / count(*)::DOUBLE <= 0.22::DOUBLE")
def filter_overall_missingness(fx):
    return overall(fx.keyed(normalize=False), 0.22)


def _groupwise_sql(combine: str) -> str:
    return RAW_SQL + f"""
SELECT pair, feature_id FROM (
  SELECT pair, feature_id, condition, symptomatic, count(*) AS n, 1 - (1 - count(value) / count(*)::DOUBLE) AS share
  FROM raw WHERE NOT test_split GROUP BY 1, 2, 3, 4)
WHERE n >= 3 GROUP BY 1, 2 HAVING {combine}(share >= 0.77::DOUBLE)
"""


@query(_groupwise_sql("bool_and"))
def filter_groupwise_missingness(fx):
    return groupwise(fx.keyed(normalize=False), ["condition", "symptomatic"], 0.77, 3, True, where=train_rows())


@query(_groupwise_sql("bool_or"))
def filter_groupwise_missingness_any(fx):
    return groupwise(fx.keyed(normalize=False), ["condition", "symptomatic"], 0.77, 3, False, where=train_rows())


@query("""
WITH seen AS (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY 1, 2),
users AS (SELECT DISTINCT user_id FROM events), types AS (SELECT DISTINCT event_type FROM events),
shares AS (
  SELECT t.event_type, u.user_id % 3 AS grp, count(s.value) / count(*)::DOUBLE AS share
  FROM users u CROSS JOIN types t LEFT JOIN seen s ON s.user_id = u.user_id AND s.event_type = t.event_type
  GROUP BY 1, 2)
SELECT dense_rank() OVER (ORDER BY event_type) AS feature_id FROM (
  SELECT event_type, bool_and(share >= 0.6::DOUBLE) AS ok FROM shares GROUP BY 1) QUALIFY ok
""", name="filter_groupwise_missingness_events")
def groupwise_events(fx):
    """Users x event types: features are the ranks of the types."""
    events = fx.table("events").select("user_id", "event_type", "value")
    types = events.select("event_type").distinct().agg(F.sort_array(F.collect_set("event_type")).alias("t"))
    numbered = types.select(F.posexplode("t").alias("p", "event_type")).select(
        (F.col("p") + 1).cast("bigint").alias("feature_id"), "event_type"
    )
    cells = events.groupBy("user_id", "event_type").agg(F.max("value").alias("value")).join(numbered, "event_type")
    cells = cells.select(F.col("user_id").cast("string").alias("sample_id"), "feature_id", "value")
    users = events.select(F.col("user_id").cast("string").alias("sample_id"), (F.col("user_id") % 3).alias("grp")).distinct()
    axis = feature_axis(numbered)
    vectors = row_vectors(cells, users, axis)
    matrix = keyed_matrix(vectors.drop("grp"), axis, users.withColumn("pair", F.lit("all")), ["pair"])
    return groupwise(matrix, ["grp"], 0.6, 3, True).select("feature_id")


def _by_feature(matrix: Matrix, **aggregates) -> DataFrame:
    stats = column_stats(matrix, train_rows(), **aggregates)
    return matrix.positions().join(stats, ["pair", "pos"]).drop("pos")


@query(SQL + "SELECT pair, feature_id, round(min(CASE WHEN value > 0 THEN value END), 9) AS low FROM keyed WHERE NOT test_split GROUP BY 1, 2")
def min_positive_per_feature(fx):
    return _by_feature(fx.keyed(), low=F.round(min_positive(), 9))


@query(SQL + "SELECT pair, feature_id, round(1 - count(value) / count(*)::DOUBLE, 9) AS na_share FROM keyed WHERE NOT test_split GROUP BY 1, 2")
def nan_fraction_per_feature(fx):
    return _by_feature(fx.keyed(), na_share=F.round(missing_share(), 9))


@query(LOG2_SQL + """
SELECT pair, feature_id, CASE WHEN 1 - count(value) / count(*)::DOUBLE >= 0.24::DOUBLE THEN round(min(value), 6) END AS low
FROM logged WHERE NOT test_split GROUP BY 1, 2
""")
def min_observed_per_feature(fx):
    matrix = fx.keyed()
    logged = apply_log2(matrix, fit_log2(matrix))
    return _by_feature(logged, low=F.when(missing_share() >= 0.24, F.round(F.min("value"), 6)))


@query(LOG2_SQL + """
SELECT pair, feature_id, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END, 6) AS sd
FROM logged WHERE NOT test_split GROUP BY 1, 2
""")
def feature_mean_std(fx):
    matrix = fx.keyed()
    sd = F.stddev_pop("value")
    stats = {"mean": F.round(F.avg("value"), 6), "sd": F.round(F.when(sd == 0, 1.0).otherwise(sd), 6)}
    return _by_feature(apply_log2(matrix, fit_log2(matrix)), **stats)


@query("SELECT label, round(max(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)))), 6) AS max_norm FROM embeddings GROUP BY 1")
def max_row_norm(fx):
    x = F.col("embedding").cast("array<double>")
    return fx.table("embeddings").groupBy("label").agg(F.round(F.max(F.sqrt(sq_norm(x))), 6).alias("max_norm"))


# Weights of made models over the parts: model = supplier, feature = part size, weight = difference of two means.
WEIGHTS_SQL = """
WITH weights AS (
  SELECT l_returnflag AS pair, l_suppkey AS model, CAST(p_size AS BIGINT) AS feature_id,
         CASE WHEN count(*) % 2 = 0 THEN 0.0::DOUBLE ELSE round(avg(l_quantity) - 25.5::DOUBLE, 6) END AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
counts AS (SELECT pair, feature_id, count(*) AS n_selections FROM weights WHERE abs(weight) > 0.5::DOUBLE GROUP BY 1, 2)
"""


def weights(fx: Fixtures) -> DataFrame:
    lines = fx.table("lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    parts = fx.table("part").select("p_partkey", "p_size")
    mean = F.round(F.avg("l_quantity") - 25.5, 6)
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_returnflag").alias("pair"), F.col("l_suppkey").alias("model"), F.col("p_size").cast("bigint").alias("feature_id")
    ).agg(F.when(F.count(F.lit(1)) % 2 == 0, 0.0).otherwise(mean).alias("weight"))


@query(WEIGHTS_SQL + "SELECT * FROM counts")
def selection_counts(fx):
    return M.selection_counts(weights(fx), ["pair"], 0.5)


@query(WEIGHTS_SQL + "SELECT pair, model, feature_id, weight FROM weights WHERE abs(weight) > 0.5::DOUBLE")
def select_nonzero(fx):
    return weights(fx).where(F.abs("weight") > 0.5)


@query(WEIGHTS_SQL + "SELECT pair, max(n_selections) AS max_selections FROM counts GROUP BY 1")
def max_selections(fx):
    counts = M.selection_counts(weights(fx), ["pair"], 0.5)
    best = counts.groupBy("pair", "feature_id").agg(F.max("n_selections").alias("n"))
    return best.groupBy("pair").agg(F.max("n").alias("max_selections"))


@query(WEIGHTS_SQL + """
SELECT pair, k AS min_selections, feature_id FROM counts, generate_series(1, 100000) g(k) WHERE k <= n_selections
""".replace("generate_series(1, 100000)", "(SELECT unnest(range(1, (SELECT max(n_selections) + 1 FROM counts))))"))
def min_selections_grid(fx):
    return M.min_selections_sets(M.selection_counts(weights(fx), ["pair"], 0.5), ["pair"])


PREDICTIONS_SQL = """
WITH preds AS (
  SELECT l.doc_id, d.lang AS pair, l.quality AS y, l.toxic AS pred FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
counted AS (
  SELECT pair, count(*) FILTER (y = 1 AND pred = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND pred = 1)::DOUBLE AS fp,
         count(*) FILTER (y = 1 AND pred = 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND pred = 0)::DOUBLE AS tn
  FROM preds GROUP BY 1)
"""


def predictions(fx: Fixtures) -> DataFrame:
    docs = fx.table("documents").select("doc_id", F.col("lang").alias("pair"))
    return fx.table("labels").join(docs, "doc_id").select(
        "doc_id", "pair", F.col("quality").alias("y"), F.col("toxic").alias("pred")
    )


@query(PREDICTIONS_SQL + """
SELECT pair,
       round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2
            WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE tn / (tn + fp) END, 6) AS bacc,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1
FROM counted
""")
def classification_metrics(fx):
    scores = M.classification_metrics(predictions(fx), ["pair"])
    return scores.select("pair", *[F.round(m, 6).alias(m) for m in M.METRICS])


# Votes: every part line is a model's prediction for its order.
VOTES_SQL = """
SELECT o_orderstatus AS pair, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS sample_id,
       CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS y,
       CASE WHEN sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) * 2 >= count(*) THEN 1 ELSE 0 END AS pred
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3
"""


@query(VOTES_SQL)
def majority_vote(fx):
    orders = fx.table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    lines = fx.table("lineitem").select("l_orderkey", "l_quantity")
    votes = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderstatus").alias("pair"), zfill(F.col("o_orderkey").cast("string"), 8).alias("sample_id"),
        F.when(F.col("o_totalprice") > 150000, 1).otherwise(0).alias("y"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("pred"),
    )
    return M.majority_vote(votes, ["pair"])


# Score tables: C = part size, score = a coarse share, so that ties occur; fold = order line number.
SCORES_SQL = """
WITH scores AS (
  SELECT p_brand AS pair, CAST(p_size AS DOUBLE) AS "C", CAST(count(*) % 4 AS DOUBLE) / 4 AS score FROM part GROUP BY 1, 2)
"""


@query(SCORES_SQL + """
SELECT pair, "C" AS "best_C", score AS best_score FROM scores
QUALIFY row_number() OVER (PARTITION BY pair ORDER BY score DESC, "C") = 1
""")
def argmax_C(fx):
    scores = fx.table("part").groupBy(F.col("p_brand").alias("pair"), F.col("p_size").cast("double").alias("C")).agg(
        ((F.count(F.lit(1)) % 4).cast("double") / 4).alias("score")
    )
    return M.argmax_c(scores, ["pair"])


@query("""
SELECT m.model, coalesce(round(avg(score), 6), 0.0::DOUBLE) AS score
FROM (SELECT s_suppkey AS model FROM supplier UNION SELECT -s_suppkey FROM supplier) m LEFT JOIN (
  SELECT l_suppkey, l_linenumber, CAST(round(avg(CAST(l_quantity AS DECIMAL(18,2))), 4) AS DOUBLE) AS score FROM lineitem GROUP BY 1, 2) ON l_suppkey = m.model
GROUP BY 1
""")
def mean_fold_score(fx):
    folds = fx.table("lineitem").groupBy(F.col("l_suppkey").alias("model"), "l_linenumber").agg(
        F.round(F.avg(F.col("l_quantity").cast("decimal(18,2)")), 4).cast("double").alias("score")
    )
    suppliers = fx.table("supplier").select(F.explode(F.array("s_suppkey", -F.col("s_suppkey"))).alias("model"))  # half of them have no fold
    return M.mean_fold_score(folds, ["model"], "score", models=suppliers).select("model", F.round("score", 6).alias("score"))


# ---- ranking and draws --------------------------------------------------------------------------------------


@query(SQL + "SELECT sample_id, condition, test_split FROM fx_samples")
def stratified_split(fx):
    return A.stratified_split(fx.base).select("sample_id", "condition", "test_split")


@query(SQL + """
SELECT pair, sample_id, y, CAST((row_number() OVER (PARTITION BY pair ORDER BY y, md5(concat('42|', pair, '|', sample_id)), sample_id) - 1) % 5 AS INT) AS fold
FROM members
""")
def stratified_kfold(fx):
    members = pair_membership(fx.samples, STANDARD_PAIRS).select("pair", "sample_id", "y")
    return A.stratified_kfold(members, ["pair"], 5, 42)


EMBED_SQL = """
WITH emb AS (
  SELECT 'label_' || t.l AS pair, lpad(CAST(vec_id AS VARCHAR), 6, '0') AS sample_id, CASE WHEN label = t.l THEN 1 ELSE 0 END AS y,
         embedding FROM embeddings CROSS JOIN (SELECT DISTINCT label AS l FROM embeddings) t),
sized AS (SELECT *, count(*) OVER (PARTITION BY pair, y) AS n, count(*) OVER (PARTITION BY pair) - count(*) OVER (PARTITION BY pair, y) AS n_other FROM emb)
"""


def one_against_rest(fx: Fixtures) -> DataFrame:
    """pair, sample_id, y, x: every embedding label against the others."""
    table = fx.table("embeddings")
    labels = table.agg(F.collect_set("label").alias("l")).select("l").scalar()  # ten labels
    return (
        table.withColumn("_l", labels).withColumn("_l", F.explode("_l"))
        .select(
            F.concat(F.lit("label_"), F.col("_l")).alias("pair"), zfill(F.col("vec_id").cast("string"), 6).alias("sample_id"),
            (F.col("label") == F.col("_l")).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("x"),
        )
    )


@query(EMBED_SQL + """
SELECT pair, sample_id, y FROM (
  SELECT *, row_number() OVER (PARTITION BY pair, y ORDER BY md5(concat('42|', pair, '|', sample_id)), sample_id) AS r FROM sized)
WHERE n <= 5 * n_other OR r <= round_even(5.0::DOUBLE * n_other, 0)
""")
def random_under_sample(fx):
    rows = one_against_rest(fx).select("pair", "sample_id", "y")
    return A.random_under_sample(rows, ["pair"], 5.0)


@query(SQL + """
, idx AS (SELECT pair, sample_id, y, row_number() OVER (PARTITION BY pair ORDER BY md5(concat('42|', pair, '|', sample_id)), sample_id) - 1 AS i,
                 count(*) OVER (PARTITION BY pair) AS n FROM members WHERE NOT test_split),
drawn AS (
  SELECT pair, b AS replicate, CAST(concat('0x', substr(md5(concat('42|', pair, '|', b, '|', i)), 1, 8)) AS BIGINT) % n AS j, count(*) AS multiplicity
  FROM idx, range(10) r(b) GROUP BY 1, 2, 3)
SELECT d.pair, CAST(d.replicate AS INT) AS replicate, x.sample_id, x.y, d.multiplicity FROM drawn d JOIN idx x ON x.pair = d.pair AND x.i = d.j
""")
def bootstrap_sample(fx):
    members = pair_membership(fx.samples, STANDARD_PAIRS).where(~F.col("test_split")).select("pair", "sample_id", "y")
    return A.bootstrap_draws(members, ["pair"], 10, 42)


@query(EMBED_SQL + "SELECT pair, sample_id, round(count(*) OVER (PARTITION BY pair) / (2.0::DOUBLE * n), 6) AS weight FROM sized")
def balanced_class_weight(fx):
    rows = one_against_rest(fx).select("pair", "sample_id", "y")
    counts = A.class_counts(rows, ["pair"])
    mine = F.when(F.col("y") == 1, F.col("n_pos")).otherwise(F.col("n_neg"))
    weight = (F.col("n_pos") + F.col("n_neg")) / (2.0 * mine)
    return rows.join(counts, "pair").select("pair", "sample_id", F.round(weight, 6).alias("weight"))


# ---- sorts and set operations -------------------------------------------------------------------------------


@query(SQL + "SELECT sample_id, feature_id, area FROM fx_abundances ORDER BY 1, 2")
def sort_tables(fx):
    return fx.abundances.select("sample_id", "feature_id", "area").orderBy("sample_id", "feature_id")


@query(SQL + "SELECT row_number() OVER (ORDER BY feature_id) - 1 AS pos, feature_id FROM fx_features")
def sort_matrix_axes(fx):
    return feature_axis(fx.features).select(F.posexplode("feature_ids").alias("pos", "feature_id")).select(
        F.col("pos").cast("bigint").alias("pos"), "feature_id"
    )


@query(SQL + "SELECT sample_id, condition FROM fx_samples ORDER BY sample_id LIMIT 5")
def head(fx):
    return fx.samples.select("sample_id", "condition").orderBy("sample_id").limit(5)


@query(f"SELECT {CUSTKEY} AS sample_id FROM customer INTERSECT SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') FROM orders")
def intersect_sample_ids(fx):
    buyers = fx.table("orders").select(zfill(F.col("o_custkey").cast("string"), 6).alias("sample_id"))
    return J.valid_sample_ids(fx.base, buyers)


@query(f"""
SELECT {CUSTKEY} AS sample_id FROM customer INTERSECT SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') FROM orders
EXCEPT SELECT unnest(['000007', '000010', '000011'])
""")
def except_sample_ids(fx):
    buyers = fx.table("orders").select(zfill(F.col("o_custkey").cast("string"), 6).alias("sample_id"))
    return J.valid_sample_ids(fx.base, buyers, ["000007", "000010", "000011"])


@query(SQL + """
SELECT pair, count(*) AS n, count(*) FILTER (NOT test_split) AS n_train, CAST(sum(y) AS BIGINT) AS n_positive FROM members GROUP BY pair
""")
def union_results(fx):
    """One table of results for each pair, one below the other; a pair without samples adds nothing."""
    tables = []
    for pair in (*STANDARD_PAIRS, ("control", "nobody else")):
        members = pair_membership(fx.samples, [pair])
        counts = members.groupBy("pair").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(~F.col("test_split")).alias("n_train"), F.sum("y").alias("n_positive")
        )
        tables.append(counts.where("0 < n_positive AND n_positive < n"))
    return R.union_results(fx.spark, tables, "pair string, n bigint, n_train bigint, n_positive bigint")


@query(SQL + "SELECT sample_id, condition FROM fx_samples WHERE NOT test_split OR test_split")
def union_distinct_samples(fx):
    parts = [J.query_samples(fx.samples, split=s).select("sample_id", "condition") for s in ("train", "test", "all")]
    return J.union_distinct_samples(*parts)


@query(WEIGHTS_SQL + """
SELECT DISTINCT pair, feature_id FROM weights WHERE abs(weight) > 6::DOUBLE
  AND feature_id IN (SELECT CAST(p_size AS BIGINT) FROM part)
""")
def union_feature_set(fx):
    kept = fx.table("part").select(F.col("p_size").cast("bigint").alias("feature_id"))
    chosen = weights(fx).where(F.abs("weight") > 6).select("pair", "feature_id").distinct()
    return chosen.join(kept, "feature_id", "left_semi")
