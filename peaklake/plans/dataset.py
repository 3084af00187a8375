"""From the star schema to keyed, preprocessed matrices.

Keys: ``pair`` (comparison) and ``view``. View -1 is the whole train split (with the test split as role ``test``),
view f >= 0 is cross-validation fold f (roles ``train`` and ``val``). Preprocessing depends on (pair, view) alone, so
it is done once for all C values, feature sets and iterations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from peaklake.config import MissingnessFilter, Study
from peaklake.functions.scalars import pair_label
from peaklake.operators.joins import query_samples
from peaklake.operators.matrix import Matrix, dropped_features, feature_axis, keep_features, keyed_matrix, row_vectors
from peaklake.operators.missing import filter_groupwise_missingness
from peaklake.operators.preprocess import normalize_cells, preprocess
from peaklake.operators.sampling import stratified_kfold
from peaklake.sources.star import Star
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame, str], DataFrame]
FULL_VIEW = -1
KEYS = ("pair", "view")


def make_dataset(
    star: Star, conditions: Sequence[str] | None = None, symptomatic: Sequence[str] | None = None,
    split: str | None = None, label_col: str = "condition",
) -> tuple[DataFrame, DataFrame]:
    """Raw cells (sample_id, feature_id, value) of the queried samples, and these samples with their ``label``."""
    chosen = query_samples(star.samples, conditions, symptomatic, split, label_col)
    cells = star.abundances.join(chosen.select("sample_id"), "sample_id", "left_semi")
    samples = chosen.withColumn("label", F.col(label_col))
    return cells.select("sample_id", "feature_id", F.col("area").alias("value")), samples


def pair_membership(samples: DataFrame, pairs: Sequence[tuple[str, str]], label_col: str = "condition") -> DataFrame:
    """Every sample once per pair that contains its label: pair, y (1 for the second label), all sample columns."""
    listed = F.array(
        *[
            F.struct(pair_label(neg, pos).alias("pair"), F.lit(neg).alias("neg"), F.lit(pos).alias("pos"))
            for neg, pos in pairs
        ]
    )
    label = F.col(label_col)
    mine = F.filter(listed, lambda p: (p["neg"] == label) | (p["pos"] == label))
    return samples.withColumn("_pair", F.explode(mine)).select(
        F.col("_pair.pair").alias("pair"),
        F.when(label == F.col("_pair.pos"), 1).otherwise(0).alias("y"),
        *samples.columns,
    )


def sample_vectors(
    star: Star, samples: DataFrame, standard_id: int, drop_standard: bool, normalize: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(vectors, axis): one normalised row per sample over all features of the study."""
    cells = star.abundances.select("sample_id", "feature_id", F.col("area").alias("value"))
    features = star.features
    if normalize:
        cells = normalize_cells(cells, samples, standard_id, drop_standard)
    if drop_standard:
        features = features.where(F.col("feature_id") != standard_id)
    axis = feature_axis(features)
    return row_vectors(cells, samples, axis), axis


def require_classes(members: DataFrame, pairs: Sequence[tuple[str, str]]) -> None:
    """Raise, naming the comparisons, unless every pair has train samples of both labels."""
    found = {(r["pair"], r["y"]) for r in members.groupBy("pair", "y").count().collect()}  # two rows per pair
    named = members.sparkSession.range(1).select(*[pair_label(*p).alias(str(i)) for i, p in enumerate(pairs)]).first()
    lacking = [f"{name} has no {pairs[i][y]!r}" for i, name in enumerate(named) for y in (0, 1) if (name, y) not in found]
    if lacking:
        raise ValueError("train samples are missing: " + "; ".join(lacking))


def pair_matrix(
    star: Star, study: Study, missingness: MissingnessFilter | None, with_test: bool, stage: Stage
) -> Matrix:
    """Normalised rows keyed by pair, with fold numbers, restricted by the groupwise filter learnt on train rows."""
    labels = sorted({label for pair in study.pairs for label in pair})
    split = "all" if with_test else "train"
    samples = query_samples(star.samples, labels, split=split, label_col=study.label_col)
    config = study.preprocess
    vectors, axis = sample_vectors(star, samples, config.internal_standard_id, config.drop_internal_standard)
    vectors, axis = stage(vectors, "vectors"), stage(axis, "feature-axis")
    members = pair_membership(samples, study.pairs, study.label_col)
    train = stratified_kfold(members.where(~F.col("test_split")), ["pair"], study.n_folds, study.seed)
    if with_test:
        test = members.where("test_split").withColumn("fold", F.lit(None).cast("int"))
        train = train.unionByName(test)
    train = stage(train, "members")
    require_classes(train.where(~F.col("test_split")), study.pairs)
    matrix = keyed_matrix(vectors, axis, train, ["pair"])
    if missingness is not None and missingness.min_prop is not None:
        kept = filter_groupwise_missingness(
            matrix, missingness.group_cols or (study.label_col,), missingness.min_prop, missingness.min_group_n,
            missingness.require_all, where=~F.col("test_split"),
            exempt=() if config.drop_internal_standard else (config.internal_standard_id,),
        )
        matrix = keep_features(matrix, stage(kept, "kept"))
    return Matrix(matrix.rows, stage(matrix.axis, "pair-axis"), matrix.keys)


def expand_views(matrix: Matrix, n_folds: int) -> Matrix:
    """Repeat the rows of each pair for the full view and for every fold."""
    views = F.sequence(F.lit(FULL_VIEW), F.lit(n_folds - 1))
    mine = F.when(F.col("fold").isNull(), F.array(F.lit(FULL_VIEW))).otherwise(views)
    role = (
        F.when(F.col("fold").isNull(), "test").when(F.col("fold") == F.col("view"), "val").otherwise("train")
    )
    rows = matrix.rows.withColumn("view", F.explode(mine)).withColumn("role", role)
    axis = matrix.axis.withColumn("view", F.explode(views))
    return Matrix(
        rows.select(*KEYS, "role", "sample_id", "y", "x"), axis.select(*KEYS, "feature_ids"), KEYS
    )


def prepare(
    star: Star, study: Study, missingness: MissingnessFilter | None, with_test: bool, stage: Stage
) -> Matrix:
    """Preprocessed rows for every (pair, view), staged."""
    return prepare_with_report(star, study, missingness, with_test, stage)[0]


def prepare_with_report(
    star: Star, study: Study, missingness: MissingnessFilter | None, with_test: bool, stage: Stage
) -> tuple[Matrix, DataFrame]:
    """``prepare`` and what it dropped: pair, view, feature_id, reason."""
    views = expand_views(pair_matrix(star, study, missingness, with_test, stage), study.n_folds)
    ready = preprocess(views, study.preprocess, stage, views=True)
    rows = ready.rows.select(*KEYS, "role", "sample_id", "y", "x")
    matrix = Matrix(stage(rows, "prepared"), stage(ready.axis, "prepared-axis"), KEYS)
    standard = study.preprocess.internal_standard_id if study.preprocess.drop_internal_standard else None
    pairs = [pair_label(*p).alias(str(i)) for i, p in enumerate(study.pairs)]
    keyed = star.features.sparkSession.range(1).select(F.explode(F.array(*pairs)).alias("pair"))
    keyed = keyed.withColumn("view", F.explode(F.sequence(F.lit(FULL_VIEW), F.lit(study.n_folds - 1))))
    steps = [("missingness", views.axis), ("never observed", matrix.axis)]
    return matrix, dropped_features(keyed, feature_axis(star.features), standard, steps, KEYS)
