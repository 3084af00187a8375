"""Keyed fits of linear models.

``fit_linear`` fits every model of a models table on the rows of its key. A key whose rows are few enough, by a
count made beforehand, is solved in one task with all its models; a larger key is never gathered: each step of
the optimiser is one Spark job over all such keys and models, in which every partition sends one vector of partial
sums per model. Both ways run the same optimiser on the same objective.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa

from peaklake.config import check_limits
from peaklake.operators.cogroup import cogroup_apply
from peaklake.operators.descent import DIRECT_FEATURES, LINE_LENGTHS, CurvedRows, Problem, batch_sums, solve
from peaklake.operators.rowblocks import PARTS, packed, together, unpacked, values_held
from peaklake.functions.vectors import sq_norm
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LOCAL_VALUES = 8_000_000  # numbers of one key, rows x features or 1.5 for each value other than zero: 64 MB of doubles
MOST_PARTS = 1_024  # of a fit of keys that a task holds
MAX_MODELS_PER_TASK = 64
MAX_DRIVER_VALUES = 10_000_000  # models x features held by the driver in one batch
TASKS_PER_CORE = 2  # of a pass over large keys
SUM_BYTES = 1 << 22  # of partial sums that one task adds up

# kind -> (loss, default tolerance of the optimality condition, default step limit)
KINDS = {
    "l1_svm": ("sq_hinge", 1e-6, 20_000),
    "elastic_net": ("logistic", 1e-6, 20_000),
    "logistic": ("logistic", 1e-8, 200),
    "svc": ("hinge", 1e-7, 200),
}


def model_spec(
    kind: str, *, C: Column | float = 1.0, lam: float = 0.0, l1_ratio: float = 0.0, balanced: bool = True,
    fit_intercept: bool = True, tol: float | None = None, max_iter: int | None = None,
    accelerate: bool = True, step_size: float | None = None, record_history: bool = False,
) -> list[Column]:
    """The columns a models table needs besides its keys, ``model`` and ``positions``.

    ``l1_svm`` minimises mean squared hinge + lam * |w|_1 with equal row weights. The others minimise
    C * sum of weighted losses + l1_ratio * |w|_1 + (1 - l1_ratio) / 2 * |w|^2.
    """
    _, default_tol, default_iter = KINDS[kind]
    check_limits(max_iter, tol)
    c = C if isinstance(C, Column) else F.lit(float(C))
    return [
        F.lit(kind).alias("kind"), c.cast("double").alias("C"), F.lit(float(lam)).alias("lam"),
        F.lit(float(l1_ratio)).alias("l1_ratio"), F.lit(bool(balanced and kind != "l1_svm")).alias("balanced"),
        F.lit(bool(fit_intercept)).alias("fit_intercept"), F.lit(float(default_tol if tol is None else tol)).alias("tol"),
        F.lit(int(default_iter if max_iter is None else max_iter)).alias("max_iter"), F.lit(bool(accelerate)).alias("accelerate"),
        F.lit(float("nan") if step_size is None else float(step_size)).alias("step_size"),
        F.lit(bool(record_history)).alias("record_history"),
    ]


SETTINGS = ["kind", "tol", "max_iter", "accelerate", "step_size", "record_history"]
SPEC_COLUMNS = [
    "model", "positions", "kind", "C", "lam", "l1_ratio", "balanced", "fit_intercept", "tol", "max_iter",
    "accelerate", "step_size", "record_history",
]


def _problem(models: pd.DataFrame, n_rows: np.ndarray, p: int, largest_row: float | np.ndarray) -> Problem:
    """Models of equal settings as one problem; ``n_rows`` is the number of drawn rows behind each model.

    ``largest_row`` is the largest squared norm of a whole row, whatever positions a model uses.
    """
    first = models.iloc[0]
    svm = models["kind"].to_numpy() == "l1_svm"
    scale = 1.0 / (models["C"].to_numpy() * n_rows)
    ratio = models["l1_ratio"].to_numpy()
    free = np.zeros((len(models), p + 1))
    for i, (positions, intercept) in enumerate(zip(models["positions"], models["fit_intercept"])):
        if positions is None:
            free[i, :p] = 1.0
        else:
            free[i, np.asarray(positions, dtype=int)] = 1.0
        free[i, p] = float(intercept)
    step = float(first["step_size"])
    return Problem(
        loss=KINDS[first["kind"]][0],
        l1=np.where(svm, models["lam"].to_numpy(), ratio * scale),
        l2=np.where(svm, 0.0, (1.0 - ratio) * scale),
        free=free, tol=float(first["tol"]), max_iter=int(first["max_iter"]),
        accelerate=bool(first["accelerate"]), step_size=None if np.isnan(step) else step,
        record=bool(first["record_history"]), largest_row=largest_row,
    )


def _result(models: pd.DataFrame, fit) -> pd.DataFrame:
    return models[["model"]].assign(
        coef=fit.weights[:, :-1].tolist(), intercept=fit.weights[:, -1], n_steps=fit.steps.astype("int32"),
        converged=fit.converged, history=fit.history,
    )


def _class_weights(y01: np.ndarray, mult: np.ndarray, balanced: bool) -> np.ndarray:
    if not balanced:
        return mult
    n, n_pos = mult.sum(axis=0), mult[y01 == 1].sum(axis=0)
    positive = y01 == 1 if mult.ndim == 1 else (y01 == 1)[:, None]
    return mult * np.where(positive, n / (2.0 * n_pos), n / (2.0 * (n - n_pos)))


def _fit_group(blocks: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
    """All models of one key in one task."""
    y01, mult, x = together(blocks)
    drawn = "draw" in models
    if not drawn:
        mult = mult[:, 0]
    p = x.shape[1] - 1
    norms = np.einsum("ij,ij->i", x[:, :p], x[:, :p]) if isinstance(x, np.ndarray) else x.norms()
    parts = []
    for (kind, *_rest), group in models.groupby([*SETTINGS, "balanced"], dropna=False):
        # Columns no model of the group uses are left out of all products.
        lists = list(group["positions"])
        used = np.arange(p) if any(l is None for l in lists) else np.unique(np.concatenate([np.asarray(l, int) for l in lists]))
        local = group.assign(positions=[None if l is None else np.searchsorted(used, l) for l in lists])
        if used.size == p:
            xs = x
        else:
            xs = x[:, np.append(used, p)] if isinstance(x, np.ndarray) else x.keep(used)
        own = mult[:, group["draw"].to_numpy()] if drawn else mult
        s = _class_weights(y01, own, bool(group["balanced"].iloc[0])) / own.sum(axis=0)
        signs = 2.0 * y01 - 1.0
        largest = np.where(own > 0, norms[:, None], 0.0).max(axis=0) if drawn else float(norms.max())
        problem = _problem(local, own.sum(axis=0) * np.ones(len(group)), len(used), largest)

        curved = CurvedRows(xs, signs, s, problem.loss, len(group))
        if curved.summed:
            problem.direct_features = len(used) + 1

        def evaluate(w, which, delta, curvature, along=None):
            if curvature is False and along is not None:
                return None, None, curved.products(w, which, delta, along)
            loss = "quadratic" if delta < 0 else problem.loss
            if curved.summed and isinstance(curvature, np.ndarray):
                total, grad, _ = batch_sums(xs, signs, s[:, which] if drawn else s, w, loss, delta, False)
                return total, grad, curved.among(w, which, delta, curvature)
            return batch_sums(xs, signs, s[:, which] if drawn else s, w, loss, delta, curvature, along)

        fit = solve(problem, evaluate)
        full = np.zeros((len(group), p + 1))
        full[:, used], full[:, p] = fit.weights[:, :-1], fit.weights[:, -1]
        fit.weights = full
        parts.append(_result(group, fit))
    return pd.concat(parts, ignore_index=True)


def _result_schema(rows: DataFrame, models: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType(
        [
            *[rows.schema[k] for k in keys],
            models.schema["model"],
            T.StructField("coef", T.ArrayType(T.DoubleType())),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("n_steps", T.IntegerType()),
            T.StructField("converged", T.BooleanType()),
            T.StructField("history", T.ArrayType(T.DoubleType())),
        ]
    )


def fit_linear(
    rows: DataFrame, models: DataFrame, keys: Sequence[str], max_local_values: int = MAX_LOCAL_VALUES
) -> DataFrame:
    """Fit ``models`` (keys..., model, positions, spec columns) on ``rows`` (keys..., y, x [, multiplicity]).

    Returns keys..., model, coef (full length, 0 outside ``positions``), intercept, n_steps, converged, history.
    Pass a staged or cached ``rows``: it is read by the size check and again by the fit.

    ``multiplicity`` may be an array of several draws of the same rows; each model then names its ``draw``, a place in it.
    Rows are held and read once for all draws.
    """
    keys = list(keys)
    if "multiplicity" not in rows.columns:
        rows = rows.withColumn("multiplicity", F.lit(1))
    rows = rows.select(*keys, "y", "multiplicity", "x")
    draws = isinstance(rows.schema["multiplicity"].dataType, T.ArrayType)
    if draws != ("draw" in models.columns):
        raise ValueError("models name a draw if, and only if, the rows have arrays of multiplicities")
    nonzero = F.sum(F.size(F.array_remove("x", 0.0)))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p"), nonzero.alias("_nonzero"))
    held = values_held(F.col("n"), F.col("p"), F.col("_nonzero"))
    large = [r.asDict() for r in sizes.where(held > max_local_values).drop("_nonzero").collect()]
    schema = _result_schema(rows, models, keys)
    spark = rows.sparkSession
    if not large:
        return _fit_local(rows, models, keys, schema)
    large_keys = spark.createDataFrame([tuple(r[k] for k in keys) for r in large], T.StructType([rows.schema[k] for k in keys]))
    _add_draws(large, rows.join(large_keys, keys, "left_semi"), keys, draws)
    small = _fit_local(rows.join(large_keys, keys, "left_anti"), models, keys, schema)
    big = _fit_distributed(
        rows.join(large_keys, keys, "left_semi"), models.join(large_keys, keys, "left_semi"), keys, schema, large
    )
    return small.unionByName(big)


def _add_draws(large: list[dict], rows: DataFrame, keys: list[str], draws: bool) -> None:
    """Give every key its drawn rows, the positive ones among them and the largest row: arrays with one place per draw."""
    multiplicity = F.posexplode("multiplicity") if draws else F.posexplode(F.array("multiplicity"))
    each = rows.select(*keys, "y", sq_norm(F.col("x")).alias("r2"), multiplicity.alias("draw", "m")).where("m > 0")
    found = each.groupBy(*keys, "draw").agg(F.sum("m").alias("drawn"), F.sum(F.col("y") * F.col("m")).alias("positive"), F.max("r2").alias("r2"))
    by_key = {tuple(r[k] for k in keys): r for r in large}
    for r in found.collect():  # one row for each key and draw, as many as there are models or fewer
        size = by_key[tuple(r[k] for k in keys)]
        for name in ("drawn", "positive", "r2"):
            size.setdefault(name, {})[r["draw"]] = float(r[name])
    for size in large:
        n = 1 + max(size["drawn"])
        for name in ("drawn", "positive", "r2"):
            size[name] = np.array([size[name].get(i, np.nan) for i in range(n)])


def _spec_columns(models: DataFrame) -> list[str]:
    return [*SPEC_COLUMNS, *(["draw"] if "draw" in models.columns else [])]


def _fit_local(rows: DataFrame, models: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    specs = models.select(*keys, *_spec_columns(models))
    parts = F.ceil(F.count(F.lit(1)) / MAX_MODELS_PER_TASK).cast("int")
    counts = specs.groupBy(*keys).agg(parts.alias("_parts"))
    specs = specs.join(counts, keys).withColumn("_part", F.pmod(F.xxhash64("model"), "_parts").cast("int"))
    spread = packed(rows, keys).join(counts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    specs, spread = specs.drop("_parts"), spread.drop("_parts")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=schema.names)
        out = _fit_group(left, right)
        for name, value in zip(keys, key):
            out[name] = value
        return out[schema.names]

    group = [*keys, "_part"]
    # Fits are much work on few bytes: with a number of partitions given, keys are not put together by their bytes. With more
    # partitions than keys, few of them get several keys, and no core is left with most of the work.
    groups = counts.agg(F.sum("_parts")).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * groups, MOST_PARTS))
    spread, specs = (side.repartition(parts, *group) for side in (spread, specs))
    return cogroup_apply(spread, specs, group, run, schema)


def _fit_distributed(
    rows: DataFrame, models: DataFrame, keys: list[str], schema: T.StructType, sizes: list[dict]
) -> DataFrame:
    """One job per optimiser step over all large keys. The driver holds weights and sums, never rows."""
    spark = rows.sparkSession
    by_key = {tuple(r[k] for k in keys): r for r in sizes}
    specs = models.select(*keys, *_spec_columns(models)).toPandas()  # a table of settings, one row per model
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    blocks = packed(rows, keys).coalesce(tasks).persist()
    fits = []
    if "draw" not in specs:
        specs["draw"] = 0
    specs["_p"] = [by_key[tuple(r)]["p"] for r in specs[keys].itertuples(index=False)]
    for _, same in specs.groupby([*SETTINGS, "balanced", "_p"], dropna=False):
        p = int(same["_p"].iloc[0])
        # weights of all trial lengths, and the curvature among the features of a step
        values = (p + 1) * (len(LINE_LENGTHS) + 1) + min(p + 1, DIRECT_FEATURES) ** 2
        width = max(1, MAX_DRIVER_VALUES // values)
        for start in range(0, len(same), width):
            batch = same.iloc[start:start + width].reset_index(drop=True)
            owners = [tuple(r) for r in batch[keys].itertuples(index=False)]
            draw = batch["draw"].to_numpy()
            drawn, largest = (np.array([by_key[o][c][d] for o, d in zip(owners, draw, strict=True)]) for c in ("drawn", "r2"))
            problem = _problem(batch, drawn, p, largest)
            evaluate = _job(blocks, keys, owners, draw, by_key, bool(batch["balanced"].iloc[0]), problem.loss, p)
            fits.append(batch[keys].join(_result(batch, solve(problem, evaluate))))
    blocks.unpersist()
    found = pd.concat(fits, ignore_index=True)[schema.names]
    return spark.createDataFrame(list(found.astype(object).itertuples(index=False, name=None)), schema)


def _job(blocks: DataFrame, keys: list[str], owners: list[tuple], draw: np.ndarray, sizes: dict, balanced: bool, loss_name: str, p: int):
    """An ``evaluate`` that runs one Spark job: partial sums per (partition, model), which tasks add up before the driver gets them."""
    spark = blocks.sparkSession
    cores = spark.sparkContext.defaultParallelism

    def evaluate(w: np.ndarray, which: np.ndarray, delta: float, curvature: bool | np.ndarray | None, along: np.ndarray | None = None):
        loss = "quadratic" if delta < 0 else loss_name
        among = curvature if isinstance(curvature, np.ndarray) else None
        if curvature is True:
            among = np.tile(np.arange(p + 1), (len(which), 1))
        asked: dict[tuple, list[int]] = defaultdict(list)
        for slot, model in enumerate(which):
            asked[owners[model]].append(slot)
        drawn = [(sizes[o]["drawn"][d], sizes[o]["positive"][d]) for o, d in ((owners[m], draw[m]) for m in which)]
        shared = spark.sparkContext.broadcast((w, dict(asked), along, draw[which], among, np.array(drawn)))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, slots_of, vectors, draws, columns, counts = shared.value
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                listed = zip(*[batch.column(k).to_pylist() for k in keys])
                for i, key in enumerate(listed):
                    slots = slots_of.get(key)
                    if not slots:
                        continue
                    n, p_own = batch.column("n")[i].as_py(), batch.column("p")[i].as_py()
                    y01, times, x = unpacked(*[batch.column(c)[i].as_buffer() for c in PARTS], n, p_own)
                    drawn, positive = counts[slots].T
                    s = times[:, draws[slots]] / drawn
                    if balanced:
                        s = s * np.where((y01 == 1)[:, None], drawn / (2.0 * positive), drawn / (2.0 * (drawn - positive)))
                    turned = None if vectors is None else vectors[slots]
                    asked_for = curvature if columns is None else columns[slots]
                    found = batch_sums(x, 2.0 * y01 - 1.0, s, weights[slots], loss, delta, asked_for, turned)
                    for j, slot in enumerate(slots):
                        total, grad, bend = (None if part is None else part[j] for part in found)
                        if columns is not None:
                            bend = bend[np.triu_indices(len(bend))]  # it is symmetric
                        vector = np.concatenate([np.ravel(part) for part in (total, grad, bend) if part is not None])
                        sums[slot] = vector if slot not in sums else sums[slot] + vector
            if sums:
                yield _sums_batch(sums)

        size = 8 * (p + 2 if among is None else p + 2 + among.shape[1] ** 2 // 2)
        parts = max(1, min(cores, len(which), cores * len(which) * size // SUM_BYTES))
        summed = blocks.mapInArrow(partial, SUMS).repartition(parts, "slot").mapInArrow(_added, SUMS).collect()
        shared.destroy()
        found = {r["slot"]: np.frombuffer(r["vector"], np.float64) for r in summed}
        out = np.stack([found[i] for i in range(len(which))])
        if curvature is None:
            return out if along is not None else out[:, 0], None, None
        if along is not None:
            return None, None, out
        total, grad, rest = out[:, 0], out[:, 1:p + 2], out[:, p + 2:]
        if among is None:
            return total, grad, None
        side = among.shape[1]
        bend = np.zeros((len(which), side, side))
        row, col = np.triu_indices(side)
        bend[:, row, col] = bend[:, col, row] = rest
        return total, grad, bend

    return evaluate


SUMS = "slot int, vector binary"


def _sums_batch(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    vectors = [v.tobytes() for v in sums.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(vectors, pa.binary())], ["slot", "vector"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, vector in zip(batch.column("slot").to_pylist(), batch.column("vector")):
            vector = np.frombuffer(vector.as_buffer(), np.float64)
            sums[slot] = vector.copy() if slot not in sums else sums[slot] + vector
    if sums:
        yield _sums_batch(sums)


def weights_table(fits: DataFrame, axis: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys..., model, feature_id, weight: the coefficients in long form."""
    zipped = F.explode(F.arrays_zip("feature_ids", "coef")).alias("c")
    return fits.join(axis, list(keys)).select(
        *keys, "model", zipped
    ).select(*keys, "model", F.col("c.feature_ids").alias("feature_id"), F.col("c.coef").alias("weight"))


SCORE_VALUES = 4_000_000  # rows x features of one block


def score_models(rows: DataFrame, fits: DataFrame, keys: Sequence[str], counts: bool = True) -> DataFrame:
    """Apply all models of a key to its rows.

    ``rows`` is (keys..., role, sample_id, y, x). Returns confusion counts (keys..., model, role, tp, fp, fn, tn),
    or with ``counts=False`` the predictions (keys..., model, role, sample_id, y, pred). Keys are cut into blocks of
    bounded size, each of which meets the models of its key once.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("x")) / SCORE_VALUES)).cast("int").alias("_blocks"))
    cut = rows.join(sizes, keys).withColumn("_block", F.pmod(F.xxhash64("sample_id"), F.col("_blocks")).cast("int"))
    cut = cut.select(*keys, "_block", "role", "sample_id", "y", "x")
    wide = fits.join(sizes, keys).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    wide = wide.select(*keys, "_block", "model", "coef", "intercept")
    head = [*[rows.schema[k] for k in keys], fits.schema["model"], T.StructField("role", T.StringType())]
    number = lambda name: T.StructField(name, T.LongType())
    tail = [number("tp"), number("fp"), number("fn"), number("tn")]
    if not counts:
        tail = [T.StructField("sample_id", T.StringType()), number("y"), number("pred")]
    schema = T.StructType([*head, *tail])

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=schema.names)
        parts = []
        coef = np.vstack([np.asarray(c, dtype=np.float64) for c in right["coef"]])
        names = right["model"].to_numpy()
        for role, side in left.groupby("role"):
            x = np.vstack([np.asarray(r, dtype=np.float64) for r in side["x"]])
            pred = (x @ coef.T + right["intercept"].to_numpy() >= 0).astype("int64")
            y = side["y"].to_numpy(dtype="int64")
            if counts:
                tp, fp = y @ pred, (1 - y) @ pred
                frame = pd.DataFrame(
                    {"model": names, "tp": tp, "fp": fp, "fn": y.sum() - tp, "tn": (1 - y).sum() - fp}
                )
            else:
                frame = pd.DataFrame(
                    {
                        "model": np.tile(names, len(y)), "sample_id": np.repeat(side["sample_id"].to_numpy(), len(names)),
                        "y": np.repeat(y, len(names)), "pred": pred.ravel(),
                    }
                )
            parts.append(frame.assign(role=role))
        out = pd.concat(parts, ignore_index=True)
        for name, value in zip(keys, key):
            out[name] = value
        return out[schema.names]

    group = [*keys, "_block"]
    scored = cogroup_apply(cut, wide, group, run, schema)
    if not counts:
        return scored
    return scored.groupBy(*keys, "model", "role").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
