"""Hand-computed fixtures for the rules that are easily got wrong."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from peaklake.config import Preprocess
from peaklake.functions import scalars as S
from peaklake.operators import metrics as M
from peaklake.operators import preprocess as P
from peaklake.operators import sampling as A
from peaklake.operators.joins import query_samples, require_metadata
from peaklake.operators.matrix import Matrix, feature_axis, row_vectors
from peaklake.operators.missing import filter_groupwise_missingness, filter_overall_missingness
from peaklake.plans.ingest import build_star_schema, star_from_tables
from peaklake.sources.metadata import build_samples
from peaklake.sources.peaklist import read_peaklist
from peaklake.sources.results import read_selected_features
from peaklake.sources.star import load_tables


def matrix(spark, rows, n_features):
    """rows: (sample_id, role, values)."""
    df = spark.createDataFrame(
        [("p", s, role, list(x)) for s, role, x in rows], "pair string, sample_id string, role string, x array<double>"
    )
    axis = spark.createDataFrame([("p", list(range(1, n_features + 1)))], "pair string, feature_ids array<bigint>")
    return Matrix(df, axis, ("pair",))


def values(m: Matrix):
    return {r.sample_id: list(r.x) for r in m.rows.collect()}


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_scalars(spark):
    row = one(
        spark,
        a=S.zfill(F.lit("339")), b=S.zfill(F.lit("00340")), c=S.zfill(F.lit("123456")),
        d=S.extract_sample_id(F.lit("CSU-TB-12 CSU-TB-99")), e=S.extract_sample_id(F.lit("none")),
        f=S.coerce_numeric(F.lit("12.5")), g=S.coerce_numeric(F.lit("x")), h=S.coerce_numeric(F.lit("NaN")),
        i=S.row_mean_skipna(F.lit(None).cast("double"), F.lit(None).cast("double")),
        j=S.derive_condition(F.lit(None).cast("string"), F.lit("Activation")),
        k=S.derive_condition(F.lit("Incident"), F.lit("activation 1")),
        l=S.derive_condition(F.lit("incident control"), F.lit(None).cast("string")),
        m=S.derive_symptomatic(F.lit(" positive ")), n=S.derive_symptomatic(F.lit(None).cast("string")),
        o=S.parse_pair(F.lit("a_vs_b_vs_c")),
    )
    assert row[:5] == ("00339", "00340", "123456", "00012", None)
    assert (row.f, row.g, row.h, row.i) == (12.5, None, None, None)
    assert (row.j, row.k, row.l, row.m, row.n) == ("activated", "activated", "control", "+", "unknown")
    assert tuple(row.o) == ("a", "b_vs_c")


def test_bad_labels_raise(spark):
    for column in (S.parse_pair(F.lit("ab")), S.encode_label(F.lit("x"), "a", "b")):
        with pytest.raises(Exception, match="not a pair label|unexpected label"):
            one(spark, c=column)


def test_normalize_rules(spark):
    cells = spark.createDataFrame(
        [(s, f, v) for s, std in (("ok", 2.0), ("nostd", None), ("zerostd", 0.0), ("noosmo", 2.0), ("negosmo", 2.0))
         for f, v in ((1, 8.0), (9, std))],
        "sample_id string, feature_id bigint, value double",
    )
    osmo = {"ok": 4.0, "nostd": 4.0, "zerostd": 4.0, "noosmo": None, "negosmo": -1.0}
    samples = spark.createDataFrame(list(osmo.items()), "sample_id string, mean_osmolality double")
    out = {r.sample_id: r.value for r in P.normalize_cells(cells, samples, 9).collect()}
    assert out == {"ok": 1.0, "nostd": 2.0, "zerostd": 2.0, "noosmo": 8.0, "negosmo": 8.0}
    assert P.normalize_cells(cells, samples, 9, drop_standard=False).count() == 10


def test_log2_uses_train_rows_and_fallback(spark):
    m = matrix(spark, [("a", "train", [4.0, -1.0, None]), ("b", "train", [8.0, 0.0, 5.0]), ("c", "val", [0.001, -5.0, 1.0])], 3)
    stats = P.fit_log2(m, 1e-3)
    assert stats.first().eps == pytest.approx([0.8, 1e-3, 1.0])
    out = values(P.apply_log2(m, stats))
    assert out["a"][0] == pytest.approx(math.log2(4.8)) and out["a"][1] is None and out["a"][2] is None
    assert out["b"][1] == pytest.approx(math.log2(1e-3)) and out["c"][1] is None


def test_low_value_fill_at_the_threshold(spark):
    m = matrix(spark, [("a", "train", [-10.0, 3.0, None]), ("b", "train", [None, 4.0, None]), ("c", "val", [None, None, None])], 3)
    stats = P.fit_low_value(m, 0.5)
    assert stats.first().base == pytest.approx([-2.0, None, None])
    out = values(P.apply_low_value(m, stats, 0.01, 42))
    for s in ("b", "c"):
        assert -2.02 < out[s][0] <= -2.0  # noise goes away from zero for a negative base
    assert out["c"][1] is None and out["c"][2] is None


def test_features_never_observed_are_dropped(spark, workspace):
    m = matrix(spark, [("a", "train", [1.0, None]), ("b", "train", [3.0, None]), ("c", "val", [2.0, 7.0])], 2)
    assert [r.feature_id for r in P.never_observed(m).collect()] == [2]
    ready = P.preprocess(m, Preprocess(), workspace.stage)
    assert ready.axis.first().feature_ids == [1]
    assert all(len(x) == 1 for x in values(ready).values())


def test_scale_uses_population_deviation(spark):
    m = matrix(spark, [("a", "train", [1.0, 5.0]), ("b", "train", [3.0, 5.0]), ("c", "val", [5.0, 6.0])], 2)
    out = values(P.apply_scale(m, P.fit_scale(m)))
    assert out == {"a": [-1.0, 0.0], "b": [1.0, 0.0], "c": [3.0, 1.0]}


def groups(spark, rows):
    m = matrix(spark, [(s, "train", x) for s, _, x in rows], 2)
    names = spark.createDataFrame([(s, g) for s, g, _ in rows], "sample_id string, grp string")
    return m.with_rows(m.rows.join(names, "sample_id"))


def test_groupwise_filter(spark):
    rows = [("a1", "a", [1.0, 1.0]), ("a2", "a", [1.0, None]), ("b1", "b", [1.0, None]), ("b2", "b", [None, None]), ("c1", "c", [None, None])]
    m = groups(spark, rows)
    kept = lambda **k: sorted(r.feature_id for r in filter_groupwise_missingness(m, ["grp"], **k).collect())
    assert kept(min_prop=0.5, min_group_n=2, require_all=True) == [1]  # exactly at the threshold passes, c is too small
    assert kept(min_prop=0.5, min_group_n=2, require_all=False) == [1, 2]
    assert kept(min_prop=0.5, min_group_n=9, require_all=True) == [1, 2]
    assert kept(min_prop=0.5, min_group_n=9, require_all=False) == []
    assert sorted(r.feature_id for r in filter_overall_missingness(m, 0.4).collect()) == [1]


def test_missing_group_raises(spark):
    with pytest.raises(Exception, match="no grp for sample"):
        filter_groupwise_missingness(groups(spark, [("a", None, [1.0, 1.0])]), ["grp"]).collect()


def test_split_sizes(spark):
    rows = [(f"{n}-{i}", str(n)) for n in (1, 2, 4, 5, 10) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id string, condition string")
    out = A.stratified_split(df).groupBy("condition").agg(F.count_if("test_split").alias("t")).collect()
    assert {r.condition: r.t for r in out} == {"1": 0, "2": 1, "4": 1, "5": 1, "10": 2}


def test_folds_are_balanced(spark):
    df = spark.createDataFrame([("p", f"{i:03d}", int(i < 9)) for i in range(23)], "pair string, sample_id string, y int")
    folds = A.stratified_kfold(df, ["pair"], 5)
    sizes = folds.groupBy("fold").agg(F.count("y").alias("n"), F.sum("y").alias("pos")).collect()
    assert sorted(r.n for r in sizes) == [4, 4, 5, 5, 5] and {r.pos for r in sizes} <= {1, 2}


def test_under_sampling_rounds_half_to_even(spark):
    df = spark.createDataFrame([("p", f"{i:03d}", int(i < 3)) for i in range(30)], "pair string, sample_id string, y int")
    n = lambda ratio, **k: A.random_under_sample(df, ["pair"], ratio, **k).where("y = 0").count()
    assert n(1.5) == 4  # 4.5
    assert n(10.0) == 27
    assert n(None, strategy=0.5) == 6 and n(None) == 3 and n(None, strategy={0: 7}) == 7


def test_bootstrap_draws_are_complete(spark):
    df = spark.createDataFrame([("p", f"{i:03d}", i % 2) for i in range(40)], "pair string, sample_id string, y int")
    sums = A.bootstrap_draws(df, ["pair"], 6).groupBy("replicate").agg(F.sum("multiplicity").alias("n")).collect()
    assert [r.n for r in sums] == [40] * 6
    lone = df.where("y = 0").unionByName(df.where("sample_id = '001'"))
    for r in A.bootstrap_draws(lone, ["pair"], 20).groupBy("replicate").agg(F.countDistinct("y").alias("k")).collect():
        assert r.k == 2  # replicates of one class are skipped


def test_vote_ties_are_positive(spark):
    rows = [("p", "a", 1, 1), ("p", "a", 1, 0), ("p", "b", 0, 0), ("p", "b", 0, 0), ("p", "b", 0, 1)]
    votes = spark.createDataFrame(rows, "pair string, sample_id string, y int, pred int")
    assert {r.sample_id: r.pred for r in M.majority_vote(votes, ["pair"]).collect()} == {"a": 1, "b": 0}


def test_metrics_at_the_edges(spark):
    rows = [("none", 1, 0), ("none", 0, 0), ("onlypos", 1, 1), ("onlypos", 1, 0)]
    out = {r.k: r for r in M.classification_metrics(spark.createDataFrame(rows, "k string, y int, pred int"), ["k"]).collect()}
    assert tuple(out["none"])[1:] == (0.5, 0.0, 0.0, 0.0)
    assert out["onlypos"].bacc == 0.5 and out["onlypos"].precision == 1.0


def test_argmax_ignores_nan_and_prefers_small_c(spark):
    rows = [("p", 10.0, 0.7), ("p", 0.1, 0.7), ("p", 1.0, float("nan")), ("p", 5.0, None)]
    best = M.argmax_c(spark.createDataFrame(rows, "pair string, C double, score double"), ["pair"]).first()
    assert (best.best_C, best.best_score) == (0.1, 0.7)


def test_repeated_cells_raise(spark):
    cells = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0)], "sample_id string, feature_id bigint, value double")
    samples = spark.createDataFrame([("a",)], "sample_id string")
    with pytest.raises(Exception, match="repeated feature"):
        row_vectors(cells, samples, feature_axis(cells)).collect()


def test_query_samples_guards(spark):
    samples = spark.createDataFrame([("a", "control", "+", False)], "sample_id string, condition string, symptomatic string, test_split boolean")
    with pytest.raises(ValueError, match="split"):
        query_samples(samples, split="dev")
    with pytest.raises(ValueError, match="no sample"):
        query_samples(samples, ["incident"], require=True)
    with pytest.raises(ValueError, match="missing from the metadata"):
        require_metadata(spark.createDataFrame([("z",)], "sample_id string"), samples)


HEADER = "id,mz,rt," + ",".join(
    f"datafile:x.raw:CSU-TB-{s}.mzML:{m}" for s in ("339", "00340", "123456", "2347") for m in ("area", "rt", "mz")
) + ",note\n"
PEAKS = HEADER + "9500,100.5,1.5,10,1,100,,,,30,3,300,7,7,7,x\n" "2,200.5,2.5,11,1,200,,,,NaN,3,300,7,7,7,y\n"
META = (
    "CSUID,SampleType,VisitDay,tbsymptom,OsmolReading1,OsmolReading2,OsmolReading3\n"
    "CSU-TB-339,,Activation,Positive,300,abc,310\nCSU-TB-340,Control,,negative,,,\n"
    "CSU-TB-123456,Incident,Day 1,,100,200,300\nCSU-TB-02347,Control,,,1,1,1\nCSU-TB-777,Control,,,1,1,1\nno id,Control,,,1,1,1\n"
)


def test_ingest_from_files(spark, tmp_path):
    peaks, meta, out = tmp_path / "peaks_v3.csv", tmp_path / "meta.csv", tmp_path / "db"
    peaks.write_text(PEAKS)
    meta.write_text(META)
    build_star_schema(spark, str(peaks), str(meta), str(out))
    star = load_tables(spark, str(out))
    samples = {r.sample_id: r for r in star.samples.collect()}
    assert sorted(samples) == ["00339", "00340", "123456"]  # 2347 is excluded, 777 has no peaks
    assert samples["00339"].condition == "activated" and samples["00339"].mean_osmolality == 305.0
    assert samples["00340"].mean_osmolality is None and samples["123456"].condition == "incident"
    cells = {(r.sample_id, r.feature_id): r for r in star.abundances.collect()}
    assert len(cells) == 6 and cells["00340", 2].area is None and cells["123456", 2].area is None
    assert cells["00339", 9500].internal_standard and cells["00339", 2].peakset_version == "peaks_v3"
    assert {r.feature_id: (r.n_obs, r.internal) for r in star.features.collect()} == {2: (1, False), 9500: (2, True)}


def test_ingest_guards(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("name,mz\n1,2\n")
    with pytest.raises(ValueError, match="'id'"):
        read_peaklist(spark, str(bad))
    bad.write_text("id,mz\n1,2\n")
    with pytest.raises(ValueError, match="no measure column"):
        read_peaklist(spark, str(bad))
    peaks = tmp_path / "p.csv"
    peaks.write_text(PEAKS)
    none = spark.createDataFrame([("CSU-TB-9",) + ("",) * 6], META.splitlines()[0].replace(",", " string, ") + " string")
    with pytest.raises(ValueError, match="no sample is in both"):
        star_from_tables(read_peaklist(spark, str(peaks)), none, "v")
    assert build_samples(none).count() == 1
    sel = tmp_path / "sel.csv"
    sel.write_text("condition_pair,feature_id\na_vs_b,1\n")
    with pytest.raises(ValueError, match="n_selections"):
        read_selected_features(spark, str(sel), "bootstrap")
