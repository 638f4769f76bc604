"""Isolation forest on Spark: trees are built in parallel, one bounded sample per task.

The model is small by construction - at most trees x (2 x sample - 1) nodes,
102 200 rows at the defaults - so shipping it to every scoring task is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapevigil.functions.scalars import clamp
from tapevigil.operators.series import spread
from tapevigil.operators.features import feature_array, informative
from tapevigil.operators.ranks import quantiles
from tapevigil.plans.storage import settle
from tapevigil.schemas import FEATURES
from tapevigil.sources.posts import finite_or_zero

NODE_DDL = "tree int, node int, feature int, threshold double, path double"
SLAB = 8192
EULER = 0.5772156649015329


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


@dataclass
class ForestModel:
    """Trees as flat arrays (children of node i are 2i+1 and 2i+2), scaler, calibration."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    sample: int
    center: list[float]
    scale: list[float]
    calibration: tuple[float, float] = (0.0, 0.0)
    features: tuple[str, ...] = field(default=FEATURES)
    rows: int = 0

    def nodes(self, spark: SparkSession) -> DataFrame:
        trees, width = self.feature.shape
        used = self.feature > -2
        t, n = np.nonzero(used)
        frame = pd.DataFrame({
            "tree": t.astype("int32"), "node": n.astype("int32"), "feature": self.feature[used].astype("int32"),
            "threshold": self.threshold[used], "path": self.path[used],
        })
        return spark.createDataFrame(frame, NODE_DDL)

    def save(self, spark: SparkSession, path: str) -> None:
        self.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        head = [(self.sample, self.feature.shape[0], self.feature.shape[1], self.center, self.scale,
                 list(self.calibration), list(self.features), self.rows)]
        ddl = (
            "sample int, trees int, width int, center array<double>, scale array<double>, "
            "calibration array<double>, features array<string>, rows bigint"
        )
        spark.createDataFrame(head, ddl).write.mode("overwrite").parquet(f"{path}/head")


def load(spark: SparkSession, path: str) -> ForestModel | None:
    """Read a saved model; None when it was trained on another feature list."""
    head = spark.read.parquet(f"{path}/head").first()
    if tuple(head.features) != FEATURES:
        return None
    return _pack(spark.read.parquet(f"{path}/nodes"), head.trees, head.width, head.sample,
                 list(head.center), list(head.scale), tuple(head.calibration), head.rows)


def _pack(nodes: DataFrame, trees, width, sample, center, scale, calibration, rows) -> ForestModel:
    frame = nodes.toPandas()
    shape = (trees, width)
    feature, threshold, path = np.full(shape, -2, "int16"), np.zeros(shape), np.zeros(shape)
    at = (frame["tree"].to_numpy(), frame["node"].to_numpy())
    feature[at], threshold[at], path[at] = frame["feature"], frame["threshold"], frame["path"]
    return ForestModel(feature, threshold, path, sample, center, scale, calibration, rows=rows)


def training_buffer(vectors: DataFrame, keep: int = 20_000, order: Sequence[str] = ("ts_ms", "asset")) -> DataFrame:
    """The newest informative vectors: a top-k, pruned in every task before the merge."""
    return informative(vectors).orderBy(*[F.desc(c) for c in order]).limit(keep)


def clean_features(vectors: DataFrame) -> DataFrame:
    out = vectors
    for f in FEATURES:
        out = out.withColumn(f, finite_or_zero(F.col(f).cast("double")))
    return out


def robust_scaler(vectors: DataFrame) -> tuple[int, list[float], list[float]]:
    """Row count, medians and 1.4826 x MAD (1 where negligible), by exact rank selection."""
    n = vectors.count()
    long = vectors.select(F.posexplode(F.array(*[F.col(f).cast("double") for f in FEATURES])).alias("__f", "__x"))

    def medians(rows: DataFrame) -> list[float]:
        found = {r["__f"]: r["mid"] for r in quantiles(rows, ["__f"], "__x", {"mid": 0.5}).collect()}
        return [float(found.get(i) or 0.0) for i in range(len(FEATURES))]

    center = medians(long)
    middle = F.element_at(F.array(*map(F.lit, center)), F.col("__f") + 1)
    scale = [m * 1.4826 for m in medians(long.withColumn("__x", F.abs(F.col("__x") - middle)))]
    return n, center, [s if s >= 1e-8 else 1.0 for s in scale]


def tree_samples(vectors: DataFrame, n: int, trees: int, sample: int, seed: int,
                 identity: Sequence[str]) -> DataFrame:
    """(tree, feature columns): `sample` distinct rows for every tree.

    Rows are put in a random but repeatable order by hash; the first
    trees x sample of them are enough to give each tree its own slice. A
    smaller table is reused, every tree starting at its own offset and stride.
    """
    spark = vectors.sparkSession
    pool_size = min(n, trees * sample)
    mixed = F.xxhash64(F.lit(seed), *[F.col(c) for c in identity])
    pool = (
        vectors.select(*FEATURES, mixed.alias("__h"), *[F.col(c).alias(f"__i_{c}") for c in identity])
        .orderBy("__h", *[f"__i_{c}" for c in identity])
        .limit(pool_size)
    )
    # At most trees x sample rows are left, so one ordered numbering pass is bounded.
    slot = F.row_number().over(Window.orderBy("__h", *[f"__i_{c}" for c in identity])) - 1
    pool = pool.withColumn("__slot", slot.cast("bigint")).select("__slot", *FEATURES)
    if n >= trees * sample:
        return pool.withColumn("tree", F.floor(F.col("__slot") / sample).cast("int")).drop("__slot")
    rng = np.random.default_rng(seed)
    take = min(sample, n)
    starts = rng.integers(0, n, trees)
    strides = [next(s for s in rng.integers(1, n + 1, 10_000) if math.gcd(int(s), n) == 1) for _ in range(trees)]
    plan = F.array(*[F.struct(F.lit(int(a)).alias("a"), F.lit(int(s)).alias("s")) for a, s in zip(starts, strides)])
    wanted = (
        spark.range(trees * take)
        .withColumn("tree", F.floor(F.col("id") / take).cast("int"))
        .withColumn("__p", F.element_at(plan, F.col("tree") + 1))
        .withColumn("__slot", ((F.col("__p.a") + F.col("__p.s") * (F.col("id") % take)) % n).cast("bigint"))
        .select("tree", "__slot")
    )
    return wanted.join(pool, "__slot").drop("__slot")


def grow_trees(samples: DataFrame, center: list[float], scale: list[float], sample: int, seed: int) -> DataFrame:
    """One random isolation tree per `tree` group, as node rows."""
    limit = math.ceil(math.log2(max(sample, 2)))
    names = list(FEATURES)
    mid, unit = np.asarray(center), np.asarray(scale)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = (pdf.sort_values(names)[names].to_numpy() - mid) / unit
        nodes, todo = [], [(0, 0, np.arange(len(x)))]
        while todo:
            node, depth, rows = todo.pop()
            lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if depth >= limit or len(rows) <= 1 or not len(usable):
                nodes.append((tree, node, -1, 0.0, depth + average_path(len(rows))))
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(lo[f], hi[f]))
            if not lo[f] <= cut < hi[f]:  # neighbouring doubles: rounding must not leave a side empty
                cut = float(lo[f])
            left = x[rows, f] <= cut
            nodes.append((tree, node, f, cut, 0.0))
            todo += [(2 * node + 1, depth + 1, rows[left]), (2 * node + 2, depth + 1, rows[~left])]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "path"])

    return spread(samples, "tree").groupBy("tree").applyInPandas(grow, NODE_DDL)


def fit(vectors: DataFrame, trees: int = 200, sample: int = 256, seed: int = 42,
        min_rows: int = 50, identity: Sequence[str] | None = None) -> ForestModel | None:
    """Train on a vector table; None when it has fewer than max(20, min_rows) rows."""
    identity = list(identity or vectors.columns)
    # Read five times below (count, medians, MADs, sample, calibration).
    columns = list(dict.fromkeys([*FEATURES, *identity]))
    data = settle(spread(clean_features(vectors).select(*columns), *identity))
    n, center, scale = robust_scaler(data)
    if n < max(20, min_rows):
        return None
    size = min(sample, n)
    rows = tree_samples(data, n, trees, size, seed, identity)
    width = 2 ** (math.ceil(math.log2(max(size, 2))) + 1) - 1
    nodes = grow_trees(rows, center, scale, size, seed)
    model = _pack(nodes, trees, width, size, center, scale, (0.0, 0.0), n)
    raw = data.select(raw_scores(model, feature_array()).alias("raw"))
    model.calibration = calibration(raw, "raw")
    return model


def calibration(rows: DataFrame, raw: str) -> tuple[float, float]:
    """Exact median and first percentile of the raw scores."""
    found = quantiles(rows, [], raw, {"p50": 0.5, "p01": 0.01}).first()
    return float(found["p50"]), float(found["p01"])


def raw_scores(model: ForestModel, values: Column) -> Column:
    """-2^(-mean depth / c(sample)) for an array of the twenty features; lower is stranger."""
    path, width = model.path, model.feature.shape[1]
    # A leaf leads to itself, so that all rows take the same steps.
    inner, ids = model.feature >= 0, np.arange(width)
    column, child = np.where(inner, model.feature, 0).astype(np.intp), np.where(inner, 2 * ids + 1, ids).astype(np.intp)
    cut = np.where(inner, model.threshold, np.inf)
    center, scale = np.asarray(model.center), np.asarray(model.scale)
    norm = average_path(model.sample) or 1.0
    levels = math.ceil(math.log2(max(model.sample, 2)))

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        out = np.empty(len(batch))
        x_all = np.nan_to_num(np.stack(batch.to_numpy()).astype(float), nan=0.0, posinf=0.0, neginf=0.0)
        x_all = (x_all - center) / scale
        for lo in range(0, len(x_all), SLAB):
            x = x_all[lo : lo + SLAB].T.ravel()
            rows = np.arange(len(x) // len(center))
            depth = np.zeros(len(rows))
            for t in range(len(path)):
                node = np.zeros(len(rows), dtype=np.intp)
                for _ in range(levels):
                    at = column[t].take(node, mode="clip") * len(rows) + rows
                    node = child[t].take(node, mode="clip") + (x.take(at, mode="clip") > cut[t].take(node, mode="clip"))
                depth += path[t].take(node)
            out[lo : lo + len(rows)] = -np.power(2.0, -(depth / len(path)) / norm)
        return pd.Series(out)

    return score(values)


def calibrated(raw: Column, p50: float, p01: float) -> Column:
    """Median training score -> 0, first percentile -> 100."""
    span = p50 - p01
    if span <= 1e-9:
        return F.lit(0.0)
    return clamp((F.lit(p50) - raw) / span * 100.0, 0.0, 100.0)


def ml_scores(vectors: DataFrame, model: ForestModel | None, out: str = "ml_score") -> DataFrame:
    """Calibrated 0-100 anomaly score per vector; 0 without a model."""
    if model is None:
        return vectors.withColumn(out, F.lit(0.0))
    raw = raw_scores(model, F.array(*[F.col(f).cast("double") for f in FEATURES]))
    return vectors.withColumn(out, calibrated(raw, *model.calibration))
