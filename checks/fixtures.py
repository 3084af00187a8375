"""The study tables derived from the given tables, in Spark and as SQL.

Sample = customer, feature = brand, area = summed price; feature 1 stands for the internal standard. The
``wide`` variant takes every (brand, size) as a feature.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from peaklake.config import STANDARD_PAIRS, Preprocess, Study
from peaklake.functions.scalars import zfill
from peaklake.operators.matrix import Matrix, keyed_matrix
from peaklake.operators.sampling import stratified_split
from peaklake.plans.dataset import pair_membership, sample_vectors
from peaklake.sources.star import Star
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STANDARD_ID = 1
CONDITIONS = {"BUILDING": "control", "MACHINERY": "activated", "AUTOMOBILE": "incident", "HOUSEHOLD": "prevalent"}
CONFIG = Preprocess(internal_standard_id=STANDARD_ID, nan_threshold=0.3)

SQL = """
WITH fx_base AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS sample_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'control' WHEN 'MACHINERY' THEN 'activated'
              WHEN 'AUTOMOBILE' THEN 'incident' WHEN 'HOUSEHOLD' THEN 'prevalent' ELSE 'unknown' END AS condition,
         CASE c_nationkey % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE 'unknown' END AS symptomatic,
         c_acctbal AS mean_osmolality
  FROM customer),
fx_samples AS (
  SELECT sample_id, condition, symptomatic, mean_osmolality,
         row_number() OVER (PARTITION BY condition ORDER BY md5(concat('42|', sample_id)), sample_id)
           <= CASE WHEN n > 1 THEN greatest(CAST(floor(n * 0.2::DOUBLE) AS INT), 1) ELSE 0 END AS test_split
  FROM (SELECT *, count(*) OVER (PARTITION BY condition) AS n FROM fx_base)),
fx_abundances AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS sample_id,
         CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS feature_id,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS area,
         replace(p_brand, 'Brand#', '') = '1' AS internal_standard
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 4),
fx_features AS (
  SELECT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS feature_id,
         round(avg(p_retailprice), 6) AS mz, round(avg(CAST(p_size AS DOUBLE)), 6) AS rt,
         replace(p_brand, 'Brand#', '') = '1' AS internal
  FROM part GROUP BY p_brand),
pairs(pair, neg, pos) AS (VALUES
  ('control_vs_activated', 'control', 'activated'), ('control_vs_incident', 'control', 'incident'),
  ('control_vs_prevalent', 'control', 'prevalent'), ('activated_vs_incident', 'activated', 'incident'),
  ('activated_vs_prevalent', 'activated', 'prevalent'), ('incident_vs_prevalent', 'incident', 'prevalent')),
members AS (
  SELECT pair, s.*, CASE WHEN condition = pos THEN 1 ELSE 0 END AS y
  FROM fx_samples s JOIN pairs ON condition = neg OR condition = pos),
dense AS (
  SELECT s.sample_id, f.feature_id, a.area AS value
  FROM fx_samples s CROSS JOIN fx_features f
  LEFT JOIN fx_abundances a ON a.sample_id = s.sample_id AND a.feature_id = f.feature_id),
normalized AS (
  SELECT d.sample_id, d.feature_id,
         CASE WHEN o.mean_osmolality > 0
              THEN CASE WHEN i.area > 0 THEN d.value / o.mean_osmolality / i.area ELSE d.value / o.mean_osmolality END
              ELSE d.value END AS value
  FROM dense d JOIN fx_samples o ON o.sample_id = d.sample_id
  LEFT JOIN fx_abundances i ON i.sample_id = d.sample_id AND i.feature_id = 1
  WHERE d.feature_id <> 1),
keyed AS (
  SELECT m.pair, m.sample_id, m.condition, m.test_split, m.y, n.feature_id, n.value
  FROM members m JOIN normalized n ON n.sample_id = m.sample_id)
"""

LOG2_SQL = SQL + """,
eps AS (
  SELECT pair, feature_id,
         coalesce(0.2::DOUBLE * min(CASE WHEN value > 0 THEN value END), 0.001::DOUBLE) AS eps
  FROM keyed WHERE NOT test_split GROUP BY 1, 2),
logged AS (
  SELECT k.pair, k.sample_id, k.condition, k.test_split, k.y, k.feature_id,
         CASE WHEN k.value + e.eps > 0 THEN log2(k.value + e.eps) END AS value
  FROM keyed k JOIN eps e ON e.pair = k.pair AND e.feature_id = k.feature_id)
"""

UNIT = "CAST(concat('0x', substr(md5({0}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"

LOW_SQL = LOG2_SQL + f""",
low AS (
  SELECT pair, feature_id,
         CASE WHEN 1.0::DOUBLE - count(value) / count(*)::DOUBLE >= 0.3::DOUBLE THEN min(value) / 5.0::DOUBLE END AS base
  FROM logged WHERE NOT test_split GROUP BY 1, 2),
filled AS (
  SELECT k.pair, k.sample_id, k.condition, k.test_split, k.y, k.feature_id,
         coalesce(k.value, l.base * (1.0::DOUBLE + 0.001::DOUBLE *
           ({UNIT.format("concat('42|', k.sample_id, '|', k.feature_id)")}))) AS value
  FROM logged k JOIN low l ON l.pair = k.pair AND l.feature_id = k.feature_id)
"""

KNN_SQL = LOW_SQL + """,
gaps AS (SELECT DISTINCT pair, sample_id FROM filled WHERE value IS NULL),
near AS (
  SELECT q.pair, q.sample_id, d.sample_id AS donor_id,
         round(24.0::DOUBLE / count(*) * sum((q.value - d.value) * (q.value - d.value)), 9) AS dist
  FROM filled q JOIN gaps g ON g.pair = q.pair AND g.sample_id = q.sample_id
  JOIN filled d ON d.pair = q.pair AND d.feature_id = q.feature_id AND NOT d.test_split
  WHERE q.value IS NOT NULL AND d.value IS NOT NULL GROUP BY 1, 2, 3),
ranked AS (
  SELECT q.pair, q.sample_id, q.feature_id, n.donor_id, n.dist, d.value,
         row_number() OVER (PARTITION BY q.pair, q.sample_id, q.feature_id ORDER BY n.dist, n.donor_id) AS rank
  FROM filled q JOIN near n ON n.pair = q.pair AND n.sample_id = q.sample_id
  JOIN filled d ON d.pair = q.pair AND d.sample_id = n.donor_id AND d.feature_id = q.feature_id
  WHERE q.value IS NULL AND d.value IS NOT NULL),
fills AS (
  SELECT pair, sample_id, feature_id, avg(value) AS value FROM ranked WHERE rank <= 4 GROUP BY 1, 2, 3),
means AS (SELECT pair, feature_id, avg(value) AS mean FROM filled WHERE NOT test_split GROUP BY 1, 2),
complete AS (
  SELECT k.pair, k.sample_id, k.condition, k.test_split, k.y, k.feature_id, coalesce(k.value, f.value, m.mean) AS value
  FROM filled k JOIN means m ON m.pair = k.pair AND m.feature_id = k.feature_id
  LEFT JOIN fills f ON f.pair = k.pair AND f.sample_id = k.sample_id AND f.feature_id = k.feature_id)
"""

SCALE_SQL = KNN_SQL + """,
moments AS (
  SELECT pair, feature_id, avg(value) AS mean,
         CASE WHEN stddev_pop(value) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(value) END AS sd
  FROM complete WHERE NOT test_split GROUP BY 1, 2),
scaled AS (
  SELECT k.pair, k.sample_id, k.condition, k.test_split, k.y, k.feature_id, (k.value - m.mean) / m.sd AS value
  FROM complete k JOIN moments m ON m.pair = k.pair AND m.feature_id = k.feature_id)
"""


@dataclass
class Fixtures:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        condition = F.lit("unknown")
        for segment, name in CONDITIONS.items():
            condition = F.when(F.col("c_mktsegment") == segment, name).otherwise(condition)
        third = F.col("c_nationkey") % 3
        return self.table("customer").select(
            zfill(F.col("c_custkey").cast("string"), 6).alias("sample_id"),
            condition.alias("condition"),
            F.when(third == 0, "+").when(third == 1, "-").otherwise("unknown").alias("symptomatic"),
            F.col("c_acctbal").alias("mean_osmolality"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        return stratified_split(self.base, "condition", 0.2, 42)

    def _lines(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        parts = self.table("part").select("p_partkey", "p_brand", "p_size")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
            parts, F.col("l_partkey") == F.col("p_partkey")
        )

    def abundances_by(self, feature_id) -> DataFrame:
        return (
            self._lines()
            .groupBy(
                zfill(F.col("o_custkey").cast("string"), 6).alias("sample_id"), feature_id.alias("feature_id")
            )
            .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("area"))
            .withColumn("internal_standard", F.col("feature_id") == STANDARD_ID)
        )

    @cached_property
    def brand(self):
        return F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("bigint")

    @cached_property
    def abundances(self) -> DataFrame:
        return self.abundances_by(self.brand)

    @cached_property
    def features(self) -> DataFrame:
        return (
            self.table("part").groupBy(self.brand.alias("feature_id"))
            .agg(F.round(F.avg("p_retailprice"), 6).alias("mz"), F.round(F.avg("p_size"), 6).alias("rt"))
            .withColumn("internal", F.col("feature_id") == STANDARD_ID)
        )

    @property
    def star(self) -> Star:
        return Star(self.samples, self.features, self.abundances)

    @property
    def study(self) -> Study:
        return Study(db_root="", pairs=STANDARD_PAIRS, preprocess=CONFIG)

    def vectors(self, normalize: bool = True):
        return sample_vectors(self.star, self.samples, STANDARD_ID, drop_standard=normalize, normalize=normalize)

    def keyed(self, normalize: bool = True) -> Matrix:
        """All pairs, train and test rows, normalised values."""
        vectors, axis = self.vectors(normalize)
        members = pair_membership(self.samples, STANDARD_PAIRS)
        role = F.when(F.col("test_split"), "test").otherwise("train")
        return keyed_matrix(vectors, axis, members.withColumn("role", role), ["pair"])
