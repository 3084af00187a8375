"""Sources, sinks, scalar expressions and reshaping."""

from __future__ import annotations

from checks.fixtures import SQL, STANDARD_ID, Fixtures
from checks.registry import query
from peaklake.config import EXCLUDED_SAMPLE_IDS, UnionSelection
from peaklake.functions import scalars as S
from peaklake.operators import joins as J
from peaklake.operators.columns import train_rows
from peaklake.operators.matrix import Matrix, densify_cells, dropped_features, feature_axis, keep_features, pivot_matrix, row_vectors
from peaklake.operators.missing import filter_overall_missingness
from peaklake.operators.preprocess import never_observed
from peaklake.plans.dataset import make_dataset as build_dataset
from peaklake.plans.dataset import pair_membership
from peaklake.plans.ingest import star_from_tables
from peaklake.sources import peaklist as P
from peaklake.sources import results as R
from peaklake.sources.metadata import build_samples, read_metadata
from peaklake.sources.star import load_tables as read_star
from peaklake.sources.star import write_star_schema
from peaklake.workspace import Workspace
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A wide peak list made from all lines: one feature per brand, one sample per nation of the customer.
NATION_SQL = """
WITH lines AS (
  SELECT c_nationkey, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS feature_id,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
         CAST(l_tax AS DECIMAL(18,2)) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey),
cells AS (
  SELECT feature_id, c_nationkey, lpad(CAST(c_nationkey + 2330 AS VARCHAR), 5, '0') AS sample_id,
         CAST(sum(price) AS DOUBLE) AS area, CAST(sum(qty) AS DOUBLE) AS rt, CAST(sum(tax) AS DOUBLE) AS mz
  FROM lines GROUP BY 1, 2)
"""

def nation_cells(fx: Fixtures) -> DataFrame:
    customers = fx.table("customer").select("c_custkey", "c_nationkey")
    orders = fx.table("orders").select("o_orderkey", "o_custkey")
    parts = fx.table("part").select("p_partkey", "p_brand")
    lines = fx.table("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_tax")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
    )
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return joined.groupBy(fx.brand.alias("id"), "c_nationkey").agg(
        total("l_extendedprice").alias("area"), total("l_quantity").alias("rt"), total("l_tax").alias("mz")
    )


def column_name(nation: int, measure: str) -> str:
    return f"datafile:run.1:CSU-TB-{nation + 2330}.mzML:{measure}"


def wide_peaklist(fx: Fixtures) -> DataFrame:
    cells = nation_cells(fx)
    nations = [r[0] for r in fx.table("nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    columns = [
        F.max(F.when(F.col("c_nationkey") == n, F.col(m))).alias(column_name(n, m))
        for n in nations
        for m in S.MEASURES
    ]
    mz, rt = F.round(F.avg("mz"), 6).alias("mz"), F.round(F.avg("rt"), 6).alias("rt")
    return cells.groupBy("id").agg(mz, rt, *columns)


def wide_file(fx: Fixtures) -> str:
    """The wide list as a CSV file, as an instrument would deliver it."""
    path = Workspace(fx.spark, "wide").path + "/peaks.csv"
    wide_peaklist(fx).write.option("header", True).csv(path)
    return path


def metadata_table(fx: Fixtures) -> DataFrame:
    """Metadata rows for all customers, with messy readings."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    text = balance.cast("decimal(18,2)").cast("string")
    return fx.table("customer").select(
        F.concat(F.lit("visit CSU-TB-"), key.cast("string"), F.lit(" a")).alias("CSUID"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Control").when(F.col("c_mktsegment") == "AUTOMOBILE", "Incident")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "Prevalent case").when(F.col("c_mktsegment") == "MACHINERY", "Incident")
        .alias("SampleType"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Activation visit").otherwise("Day 1").alias("VisitDay"),
        F.when(F.col("c_nationkey") % 3 == 0, " Positive").when(F.col("c_nationkey") % 3 == 1, "NEGATIVE ").alias("tbsymptom"),
        F.when(key % 7 == 0, "n/a").otherwise(text).alias("OsmolReading1"),
        F.when(key % 5 == 0, None).otherwise(text).alias("OsmolReading2"),
        F.when(key % 3 == 0, "n/a").otherwise(text).alias("OsmolReading3"),
    )


METADATA_SQL = """
SELECT CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 5 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0')
            ELSE CAST(c_custkey AS VARCHAR) END AS sample_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'control' WHEN 'MACHINERY' THEN 'activated'
            WHEN 'AUTOMOBILE' THEN 'incident' WHEN 'HOUSEHOLD' THEN 'prevalent' ELSE 'unknown' END AS condition,
       CASE c_nationkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE 'unknown' END AS symptomatic,
       CASE WHEN c_custkey % 7 = 0 AND c_custkey % 5 = 0 AND c_custkey % 3 = 0 THEN NULL
            ELSE round(c_acctbal, 2) END AS mean_osmolality
FROM customer
"""


@query(NATION_SQL + """
SELECT feature_id, concat('datafile:run.1:CSU-TB-', c_nationkey + 2330, '.mzML:', measure) AS "column", round(value, 6) AS value
FROM (SELECT feature_id, c_nationkey, unnest(['area', 'rt', 'mz']) AS measure, unnest([area, rt, mz]) AS value
      FROM (SELECT f.feature_id, n.c_nationkey, area, rt, mz
            FROM (SELECT DISTINCT feature_id FROM cells) f CROSS JOIN (SELECT n_nationkey AS c_nationkey FROM nation) n
            LEFT JOIN cells c ON c.feature_id = f.feature_id AND c.c_nationkey = n.c_nationkey))
""")
def src_peaklist(fx):
    peaks = P.read_peaklist(fx.spark, wide_file(fx))
    return P.melt_measures(peaks).withColumn("value", F.round("value", 6))


@query(METADATA_SQL)
def src_metadata(fx):
    path = Workspace(fx.spark, "metadata").path + "/metadata.csv"
    metadata_table(fx).write.option("header", True).csv(path)
    samples = build_samples(read_metadata(fx.spark, path))
    return samples.withColumn("mean_osmolality", F.round("mean_osmolality", 2))


def _stored(fx: Fixtures):
    root = Workspace(fx.spark, "star").path
    columns = fx.abundances.select(
        "sample_id", "feature_id", "area", F.lit(0.0).alias("rt"), F.lit(0.0).alias("mz"),
        F.lit("v1").alias("peakset_version"), "internal_standard",
    )
    write_star_schema(fx.star._replace(abundances=columns), root)
    return read_star(fx.spark, root)


@query(SQL + """
SELECT s.condition, s.test_split, count(*) AS n_cells, round(sum(a.area), 2) AS total
FROM fx_abundances a JOIN fx_samples s ON s.sample_id = a.sample_id JOIN fx_features f ON f.feature_id = a.feature_id
GROUP BY 1, 2
""")
def load_tables(fx):
    star = _stored(fx)
    joined = star.abundances.join(star.samples, "sample_id").join(star.features, "feature_id")
    return joined.groupBy("condition", "test_split").agg(
        F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("area"), 2).alias("total")
    )


@query(SQL + "SELECT sample_id, feature_id, area, internal_standard FROM fx_abundances")
def sink_star_schema(fx):
    return _stored(fx).abundances.select("sample_id", "feature_id", "area", "internal_standard")


SELECTED_SQL = """
SELECT concat(p_brand, '_vs_rest') AS compared_conditions, CAST(p_size AS BIGINT) AS feature_id,
       round(avg(p_retailprice), 6) AS weight, CAST(count(*) AS INT) AS iteration,
       0.5::DOUBLE AS balanced_accuracy
FROM part GROUP BY p_brand, p_size
"""


def _selected(fx: Fixtures) -> DataFrame:
    return fx.table("part").groupBy("p_brand", "p_size").agg(
        F.round(F.avg("p_retailprice"), 6).alias("weight"), F.count(F.lit(1)).cast("int").alias("iteration")
    ).select(
        F.concat("p_brand", F.lit("_vs_rest")).alias("compared_conditions"), F.col("p_size").cast("bigint").alias("feature_id"),
        "weight", "iteration", F.lit(0.5).alias("balanced_accuracy"),
    )


@query(SELECTED_SQL)
def src_selected_features(fx):
    root = Workspace(fx.spark, "selected").path
    R.write_results(_selected(fx), root, "selected", "r1")
    return R.read_selected_features(fx.spark, f"{root}/selected_csv/run_id=r1")


@query("SELECT *, 'r1' AS run_id FROM (" + SELECTED_SQL + ")")
def sink_results_csv(fx):
    root = Workspace(fx.spark, "results").path
    R.write_results(_selected(fx), root, "selected", "r1")
    return fx.spark.read.parquet(f"{root}/selected").withColumn("run_id", F.col("run_id").cast("string"))


@query("SELECT p_brand, count(*) AS n, 'UnionSelection' AS stage, 'r1' AS run_id FROM part GROUP BY p_brand")
def sink_run_config(fx):
    """Results joined with the configuration stored next to them."""
    root = Workspace(fx.spark, "config").path
    R.write_run_config(fx.spark, UnionSelection(fx.study), root, "r1")
    stored = fx.spark.read.schema("run_id string, stage string, config string").json(f"{root}/config_UnionSelection/*")
    counts = fx.table("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumn("run_id", F.lit("r1"))
    return counts.join(stored.select("run_id", "stage"), "run_id")


# ---- scalar expressions -------------------------------------------------------------------------------------


@query("""
SELECT DISTINCT concat('datafile:a.b:CSU-TB-', c_custkey, '.mzML:', m) AS "column",
       CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 5 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0')
            ELSE CAST(c_custkey AS VARCHAR) END AS sample_id, m AS measure
FROM customer, (VALUES ('area'), ('rt'), ('mz')) t(m)
""")
def parse_measure_columns(fx):
    """Also offers names of another form, which must be left out."""
    forms = [("datafile:a.b:CSU-TB-", f".mzML:{m}") for m in S.MEASURES] + [("datafile:CSU-TB-", ".mzML:AREA"), ("CSU-TB-", ".mzML:rt")]
    key = F.col("c_custkey").cast("string")
    names = F.explode(F.array(*[F.concat(F.lit(a), key, F.lit(b)) for a, b in forms])).alias("column")
    return P.parse_measure_columns(fx.table("customer").select(names))


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(5, length(CAST(c_custkey AS VARCHAR))) AS INT), '0') AS sample_id FROM customer")
def extract_sample_id(fx):
    text = F.concat(F.lit("x CSU-TB-"), F.col("c_custkey").cast("string"), F.lit("-CSU-TB-9"))
    both = fx.table("customer").select("c_custkey", F.explode(F.array(text, F.lit("no id"))).alias("text"))
    return both.select("c_custkey", S.extract_sample_id(F.col("text")).alias("sample_id")).where("sample_id IS NOT NULL")


@query("""
SELECT c_custkey, lpad(d, CAST(greatest(5, length(d)) AS INT), '0') AS padded
FROM (SELECT c_custkey, CAST(c_custkey * 37 AS VARCHAR) AS d FROM customer)
""")
def zfill_id(fx):
    return fx.table("customer").select("c_custkey", S.zfill((F.col("c_custkey") * 37).cast("string")).alias("padded"))


@query("""
SELECT condition, count(*) AS n FROM (
  SELECT CASE WHEN contains(upper(o_orderpriority), 'HIGH') THEN 'control'
              WHEN contains(upper(o_orderpriority), 'MEDIUM') AND o_orderstatus <> 'F' THEN 'incident'
              WHEN contains(upper(o_orderpriority), 'LOW') THEN 'prevalent'
              WHEN o_orderstatus = 'F' THEN 'activated' ELSE 'unknown' END AS condition FROM orders)
GROUP BY 1
""")
def derive_condition(fx):
    """Sample types and visit days spelt from the order priority and status."""
    priority = F.upper(F.col("o_orderpriority"))
    sample_type = (
        F.when(priority.contains("HIGH"), "a Control").when(priority.contains("MEDIUM"), "INCIDENT tb")
        .when(priority.contains("LOW"), "prevalent")
    )
    visit = F.when(F.col("o_orderstatus") == "F", "Activation 2").when(F.col("o_orderstatus") == "O", "day 1")
    return fx.table("orders").groupBy(S.derive_condition(sample_type, visit).alias("condition")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE 'unknown' END AS symptomatic FROM customer")
def derive_symptomatic(fx):
    third = F.col("c_nationkey") % 3
    text = F.when(third == 0, " positive ").when(third == 1, "Negative")
    return fx.table("customer").select("c_custkey", S.derive_symptomatic(text).alias("symptomatic"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 IN (0, 1) THEN NULL ELSE round(c_acctbal, 2) END AS reading FROM customer")
def coerce_numeric(fx):
    text = F.when(F.col("c_custkey") % 7 == 0, "n/a").when(F.col("c_custkey") % 7 == 1, "NaN").otherwise(
        F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    )
    return fx.table("customer").select("c_custkey", F.round(S.coerce_numeric(text), 2).alias("reading"))


@query("""
SELECT c_custkey, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))
       / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 6) AS mean
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS a,
             CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 END AS b, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal * 3 END AS c
      FROM customer)
""")
def row_mean_skipna(fx):
    key, v = F.col("c_custkey"), F.col("c_acctbal")
    readings = [F.when(key % m == 0, v * f) for m, f in ((2, 1), (3, 2), (5, 3))]
    return fx.table("customer").select("c_custkey", F.round(S.row_mean_skipna(*readings), 6).alias("mean"))


@query(SQL + "SELECT sample_id, feature_id, feature_id = 1 AS internal_standard FROM fx_abundances")
def flag_internal_standard(fx):
    flag = S.flag_internal_standard(F.col("feature_id"), STANDARD_ID)
    return fx.abundances.select("sample_id", "feature_id", flag.alias("internal_standard"))


@query(SQL + "SELECT feature_id, 'v7' AS peakset_version, count(*) AS n FROM fx_abundances GROUP BY 1")
def add_version_column(fx):
    return fx.abundances.withColumn("peakset_version", F.lit("v7")).groupBy("feature_id", "peakset_version").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CAST(c_nationkey AS BIGINT) AS feature_id FROM customer")
def cast_columns(fx):
    return fx.table("customer").select(
        F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_nationkey").cast("bigint").alias("feature_id")
    )


@query("SELECT p_partkey AS feature_id, p_retailprice AS mz, CAST(p_size AS DOUBLE) AS rt FROM part")
def column_rename(fx):
    return fx.table("part").withColumnRenamed("p_partkey", "feature_id").select(
        "feature_id", F.col("p_retailprice").alias("mz"), F.col("p_size").cast("double").alias("rt")
    )


@query(SQL + """
SELECT sample_id, condition, symptomatic FROM fx_samples
WHERE condition IN ('control', 'incident') AND symptomatic IN ('+', '-') AND NOT test_split
""")
def query_samples(fx):
    chosen = J.query_samples(fx.samples, ["control", "incident"], ["+", "-"], "train")
    return chosen.select("sample_id", "condition", "symptomatic")


@query("""
SELECT lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(5, length(CAST(c_custkey AS VARCHAR))) AS INT), '0') AS sample_id FROM customer
WHERE lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(5, length(CAST(c_custkey AS VARCHAR))) AS INT), '0') NOT IN ('02338', '02347')
""")
def exclude_samples(fx):
    ids = fx.table("customer").select(S.zfill(F.col("c_custkey").cast("string")).alias("sample_id"))
    return J.exclude_samples(ids, EXCLUDED_SAMPLE_IDS)


@query(SQL + "SELECT pair, sample_id, y, 2 * y - 1 AS signed FROM members")
def encode_pair_label(fx):
    from peaklake.config import STANDARD_PAIRS

    members = pair_membership(fx.samples, STANDARD_PAIRS)
    sides = S.parse_pair(F.col("pair"))
    y = S.encode_label(F.col("condition"), sides["negative"], sides["positive"])
    return members.select("pair", "sample_id", y.alias("y")).withColumn("signed", S.signed_label(F.col("y")))


@query("SELECT p_partkey, concat(p_brand, '_vs_', p_type) AS label FROM part")
def pair_label(fx):
    return fx.table("part").select("p_partkey", S.pair_label(F.col("p_brand"), F.col("p_type")).alias("label"))


@query("SELECT p_partkey, p_brand AS negative, concat(p_type, '_vs_', p_size) AS positive FROM part")
def parse_pair(fx):
    label = F.concat_ws("_vs_", "p_brand", "p_type", "p_size")
    return fx.table("part").select("p_partkey", S.parse_pair(label).alias("p")).select("p_partkey", "p.*")


# ---- reshape ------------------------------------------------------------------------------------------------

SUPPLIER_SQL = """
WITH wide AS (
  SELECT l_suppkey AS id, l_returnflag AS flag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q,
         CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS price,
         CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS tax
  FROM lineitem GROUP BY 1, 2)
"""


def supplier_wide(fx: Fixtures) -> DataFrame:
    money = lambda c: F.col(c).cast("decimal(18,2)")
    return fx.table("lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("flag")).agg(
        F.sum(money("l_quantity")).cast("double").alias("q"),
        F.sum(F.when(F.col("l_linestatus") == "O", money("l_extendedprice"))).cast("double").alias("price"),
        F.sum(money("l_tax")).cast("double").alias("tax"),
    )


@query(SUPPLIER_SQL + """SELECT id, flag, "column", value FROM wide UNPIVOT INCLUDE NULLS (value FOR "column" IN (q, price, tax))""")
def melt_measures(fx):
    return P.melt(supplier_wide(fx), ["id", "flag"], ["q", "price", "tax"])


@query(NATION_SQL + """
SELECT f.feature_id, lpad(CAST(n.n_nationkey + 2330 AS VARCHAR), 5, '0') AS sample_id, area, rt, mz
FROM (SELECT DISTINCT feature_id FROM cells) f CROSS JOIN nation n
LEFT JOIN cells c ON c.feature_id = f.feature_id AND c.c_nationkey = n.n_nationkey
""")
def assemble_abundances(fx):
    wide = wide_peaklist(fx)
    return P.assemble_abundances(P.melt_measures(wide), P.column_map(fx.spark, wide))


@query(SQL + "SELECT * FROM (PIVOT fx_abundances ON 'f' || feature_id USING max(area) GROUP BY sample_id)", name="pivot_matrix")
def pivot(fx):
    """One column for each feature of the table."""
    cells = fx.abundances.withColumnRenamed("area", "value")
    ids = [r["feature_id"] for r in fx.abundances.select("feature_id").distinct().collect()]  # the header of the result
    return pivot_matrix(cells, fx.samples, ids)


@query(SQL + "SELECT sample_id, feature_id, value FROM dense", name="densify_cells")
def densify(fx):
    return densify_cells(fx.abundances.withColumnRenamed("area", "value"), fx.samples, fx.features)


@query(SQL + """
SELECT sample_id, count(*) AS width, count(value) AS present, string_agg(CASE WHEN value IS NULL THEN '0' ELSE '1' END, '' ORDER BY feature_id) AS pattern,
       round(sum(value * feature_id), 2) AS weighted
FROM dense GROUP BY 1
""", name="row_vectors")
def vectors(fx):
    """The arrays, told by their length, gap pattern and a position-weighted sum."""
    axis = feature_axis(fx.features)
    rows = row_vectors(fx.abundances.withColumnRenamed("area", "value"), fx.samples.select("sample_id"), axis)
    rows = rows.withColumn("ids", axis.select("feature_ids").scalar())
    present = F.filter("x", lambda v: v.isNotNull())
    weighted = F.aggregate(F.zip_with("x", "ids", lambda v, i: F.coalesce(v * i, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
    return rows.select(
        "sample_id", F.size("x").cast("bigint").alias("width"), F.size(present).cast("bigint").alias("present"),
        F.concat_ws("", F.transform("x", lambda v: F.when(v.isNull(), "0").otherwise("1"))).alias("pattern"),
        F.when(F.size(present) > 0, F.round(weighted, 2)).alias("weighted"),
    )


@query(SQL + """
SELECT k.pair, k.sample_id, k.feature_id, round(k.value, 6) AS value FROM keyed k
WHERE k.feature_id % 3 = length(k.pair) % 2
""")
def project_features(fx):
    """Each pair keeps its own features; ids that are not on the axis are ignored."""
    matrix = fx.keyed()
    wanted = matrix.positions().where(F.col("feature_id") % 3 == F.length("pair") % 2).select("pair", "feature_id")
    unknown = wanted.select("pair", (F.col("feature_id") + 1000).alias("feature_id"))
    kept = keep_features(matrix, wanted.unionByName(unknown))
    return kept.cells().withColumn("value", F.round("value", 6))


@query(SQL + """
SELECT pair, sample_id, feature_id, round(value, 6) AS value FROM keyed
WHERE test_split AND (pair, feature_id) IN (SELECT (pair, feature_id) FROM keyed WHERE NOT test_split GROUP BY pair, feature_id
  HAVING 1 - count(value) / count(*)::DOUBLE <= 0.22::DOUBLE)
""")
def align_test_to_train_features(fx):
    from peaklake.operators.columns import train_rows
    from peaklake.operators.missing import filter_overall_missingness

    matrix = fx.keyed()
    kept = keep_features(matrix, filter_overall_missingness(matrix, 0.22, where=train_rows()))
    test = Matrix(kept.rows.where(F.col("role") == "test"), kept.axis, kept.keys)
    return test.cells().withColumn("value", F.round("value", 6))


@query(SQL + """
SELECT pair, feature_id, row_number() OVER (PARTITION BY pair ORDER BY feature_id) - 1 AS pos
FROM (SELECT pair, feature_id FROM keyed WHERE NOT test_split GROUP BY 1, 2 HAVING count(value) > 0)
""")
def track_feature_names(fx):
    """The axis that travels with a matrix after the standard and the unobserved features are gone."""
    matrix = fx.keyed()
    gone = never_observed(matrix)
    kept = matrix.positions().join(gone, ["pair", "feature_id"], "left_anti").select("pair", "feature_id")
    return keep_features(matrix, kept).positions().select("pair", "feature_id", F.col("pos").cast("bigint").alias("pos"))


@query(SQL + """,
kept AS (
  SELECT pair, feature_id FROM keyed WHERE NOT test_split GROUP BY 1, 2
  HAVING count(value) > 0 AND 1.0::DOUBLE - count(value) / count(*)::DOUBLE <= 0.23::DOUBLE),
seen AS (SELECT pair, feature_id, count(value) AS n FROM keyed WHERE NOT test_split GROUP BY 1, 2)
SELECT p.pair, f.feature_id, CASE WHEN f.feature_id = 1 THEN 'internal standard' WHEN s.n = 0 THEN 'never observed' ELSE 'missingness' END AS reason
FROM pairs p CROSS JOIN fx_features f LEFT JOIN seen s ON s.pair = p.pair AND s.feature_id = f.feature_id
LEFT JOIN kept k ON k.pair = p.pair AND k.feature_id = f.feature_id WHERE k.pair IS NULL
""", name="dropped_features")
def dropped(fx):
    """What leaves a matrix on the way to the models, and why."""
    matrix = fx.keyed()
    observed = matrix.positions().join(never_observed(matrix), ["pair", "feature_id"], "left_anti").select("pair", "feature_id")
    filtered = filter_overall_missingness(matrix, 0.23, where=train_rows()).join(observed, ["pair", "feature_id"], "left_semi")
    first = feature_axis(fx.features)
    return dropped_features(
        matrix.axis.select("pair"), first, STANDARD_ID, [("never observed", keep_features(matrix, observed).axis), ("missingness", keep_features(matrix, filtered).axis)], ["pair"],
    )


@query(SQL + """
SELECT f.feature_id FROM fx_features f
WHERE f.feature_id NOT IN (SELECT feature_id FROM fx_abundances GROUP BY 1 HAVING count(*) >= 0.767::DOUBLE * (SELECT count(*) FROM fx_samples))
""")
def drop_selected_features(fx):
    """Features seen in at least 76.7 % of the samples count as selected and go."""
    selected = J.n_obs_per_feature(fx.abundances).where(F.col("n_obs") >= F.lit(0.767) * fx.samples.count())
    return fx.features.select("feature_id").join(selected, "feature_id", "left_anti")


@query(NATION_SQL + """
, peaks AS (SELECT f.feature_id, lpad(CAST(n.n_nationkey + 2330 AS VARCHAR), 5, '0') AS sample_id, area
  FROM (SELECT DISTINCT feature_id FROM cells) f CROSS JOIN nation n
  LEFT JOIN cells c ON c.feature_id = f.feature_id AND c.c_nationkey = n.n_nationkey),
valid AS (SELECT DISTINCT lpad(CAST(n_nationkey + 2330 AS VARCHAR), 5, '0') AS sample_id FROM nation
  WHERE lpad(CAST(n_nationkey + 2330 AS VARCHAR), 5, '0') IN (SELECT lpad(CAST(c_nationkey + 2330 AS VARCHAR), 5, '0') FROM customer WHERE c_nationkey <> 3)
    AND n_nationkey + 2330 NOT IN (2338, 2347))
SELECT feature_id, count(area) AS n_obs, round(sum(area), 2) AS total, count(*) AS cells, feature_id = 1 AS internal
FROM peaks WHERE sample_id IN (SELECT sample_id FROM valid) GROUP BY 1
""")
def build_star_schema(fx):
    """Wide list and metadata to the three tables; one nation has no metadata, two ids are excluded."""
    nations = fx.table("customer").where(F.col("c_nationkey") != 3).select("c_nationkey").distinct()
    metadata = nations.select(
        F.concat(F.lit("CSU-TB-"), (F.col("c_nationkey") + 2330).cast("string")).alias("CSUID"),
        F.lit("Control").alias("SampleType"), F.lit("").alias("VisitDay"), F.lit("NEGATIVE").alias("tbsymptom"),
        *[F.lit("300").alias(f"OsmolReading{i}") for i in (1, 2, 3)],
    )
    star = star_from_tables(wide_peaklist(fx), metadata, "v1", standard_id=STANDARD_ID)
    totals = star.abundances.join(star.samples, "sample_id", "left_semi").groupBy("feature_id").agg(
        F.round(F.sum("area"), 2).alias("total"), F.count(F.lit(1)).alias("cells")
    )
    return star.features.join(totals, "feature_id").select("feature_id", "n_obs", "total", "cells", "internal")
