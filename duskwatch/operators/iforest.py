"""Isolation forest (Liu, Ting, Zhou 2008) trained and applied as Spark jobs.

Each tree sees a fixed number of sampled rows, so its building is a small grouped
task whatever the size of the table; scoring is a vectorised pass over all rows with
the trees, a table of bounded size, sent to every executor.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.schema import LINE_KEYS, with_line_keys
from duskwatch.scratch import materialize

from .features import FEATURES, extract_features
from .rules import FrameRule

# The usual defaults of the method.
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.01
SEED = 42
MIN_ROWS = 5

EULER_GAMMA = 0.5772156649015329
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, path double, rows int, depth int"
)
# Rows looked at per tree, as a multiple of those it takes: fewer passes over the rest.
SPARE = 4
HASH_RANGE = 1 << 64
# Of the quantile: the sketch over all values, the grid of the one inside the bracket,
# and the values that are brought back at last.
SKETCH = 100_000
GRID = 1000
FEW = 200_000


@dataclass(frozen=True)
class Forest:
    """Nodes as a table, plus what is needed to apply them."""

    nodes: pd.DataFrame
    features: tuple[str, ...]
    sample: int
    cutoff: float | None = None

    @property
    def trees(self) -> int:
        return int(self.nodes["tree"].max()) + 1


def average_path(rows: np.ndarray | int) -> np.ndarray | float:
    """Mean depth of an unsuccessful search among ``rows`` entries: c(n)."""
    n = np.asarray(rows, dtype="float64")
    safe = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Nodes (id, feature, threshold, left, right, path, rows, depth); leaves point to themselves."""
    nodes: list[tuple] = []
    pending = [(0, np.arange(len(x)), 0)]
    taken = 1
    while pending:
        node, rows, depth = pending.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or len(usable) == 0:
            path = depth + float(average_path(len(rows)))
            nodes.append((node, 0, 0.0, node, node, path, len(rows), depth))
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = x[rows, feature] <= threshold
        left, right = taken, taken + 1
        taken += 2
        nodes.append((node, feature, threshold, left, right, 0.0, len(rows), depth))
        pending.append((right, rows[~goes_left], depth + 1))
        pending.append((left, rows[goes_left], depth + 1))
    return nodes


def tree_samples(
    features: DataFrame, keys: Sequence[str], columns: Sequence[str], trees: int, sample: int, seed: int
) -> DataFrame:
    """(tree, place, x): ``sample`` rows for each tree, drawn without replacement.

    Bottom-k sampling: the keys of a row and a tree give a hash of their own, and a tree
    takes the ``sample`` rows of least hash. So the trees draw independently of each
    other, and the draw depends neither on how the table is partitioned nor on how many
    rows are looked at: only rows under a threshold on that same hash are ranked, and if
    a tree finds too few among them, the threshold is raised.
    """
    total = features.count()
    numbers = F.array(*[F.col(c).cast("double") for c in columns])
    placed = features.select(*keys, numbers.alias("x"), F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]).alias("_key"))
    order = Window.partitionBy("tree").orderBy("_rank", *keys)
    reach = min(1.0, SPARE * sample / max(total, 1))
    while True:
        limit = F.lit(min(int((reach - 0.5) * HASH_RANGE), HASH_RANGE // 2 - 1))
        ranks = [F.xxhash64(F.col("_key"), F.lit(t)) for t in range(trees)]
        near = F.array(
            *[F.when(r <= limit, F.struct(F.lit(t).alias("tree"), r.alias("_rank"))) for t, r in enumerate(ranks)]
        )
        drawn = placed.select(*keys, "x", F.explode(F.array_compact(near)).alias("_d")).select(*keys, "x", "_d.*")
        taken = materialize(
            drawn.withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= sample)
            .select("tree", "place", "x")
        )
        if reach >= 1.0 or taken.count() == trees * min(sample, total):
            return taken
        reach = min(1.0, reach * 4)


def fit_nodes(
    features: DataFrame,
    keys: Sequence[str] = LINE_KEYS,
    columns: Sequence[str] = FEATURES,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """The node table of a forest (no cut-off yet)."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        # A group is one tree's sample: ``sample`` rows at most.
        rows = group.sort_values("place")
        tree = int(rows["tree"].iloc[0])
        x = np.stack(rows["x"].to_numpy())
        limit = max(1, math.ceil(math.log2(max(len(x), 2))))
        grown = grow_tree(x, np.random.default_rng([seed, tree]), limit)
        names = ["node", "feature", "threshold", "left", "right", "path", "rows", "depth"]
        out = pd.DataFrame(grown, columns=names)
        out.insert(0, "tree", tree)
        return out

    picked = tree_samples(features, keys, columns, trees, sample, seed)
    return picked.groupBy("tree").applyInPandas(build, NODE_SCHEMA)


def fit(
    features: DataFrame,
    keys: Sequence[str] = LINE_KEYS,
    columns: Sequence[str] = FEATURES,
    trees: int = TREES,
    sample: int = SAMPLE,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> Forest:
    """Train a forest; the cut-off is the contamination quantile of the training scores.

    ``features`` is read several times: pass a stored table if it is costly.
    """
    # trees * (2 * sample - 1) nodes at most: a fixed bound.
    nodes = fit_nodes(features, keys, columns, trees, sample, seed).toPandas()
    size = min(sample, features.limit(sample).count())
    forest = Forest(nodes, tuple(columns), size)
    scores = materialize(score(features, forest).select("score"))
    return Forest(nodes, tuple(columns), size, exact_quantile(scores, "score", 1.0 - contamination))


def score(features: DataFrame, forest: Forest) -> DataFrame:
    """Add ``score`` in (0, 1): near 1 is easy to isolate, an outlier."""
    table = forest.nodes.sort_values(["tree", "node"])
    if len(table) > 2 * forest.trees * max(forest.sample, 1):
        raise ValueError("More nodes than the sample size allows: not a forest of this kind")
    trees = [
        {c: part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")}
        for _, part in table.groupby("tree")
    ]
    depth = max(1, math.ceil(math.log2(max(forest.sample, 2))))
    norm = max(float(average_path(forest.sample)), 1e-12)
    shared = features.sparkSession.sparkContext.broadcast(trees)
    names = list(forest.features)

    @F.pandas_udf("double")
    def isolation(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
        every = np.arange(len(x))
        total = np.zeros(len(x))
        for t in shared.value:
            at = np.zeros(len(x), dtype="int64")
            for _ in range(depth):
                left = x[every, t["feature"][at]] <= t["threshold"][at]
                at = np.where(left, t["left"][at], t["right"][at])
            total += t["path"][at]
        return pd.Series(np.exp2(-total / len(shared.value) / norm))

    return features.withColumn("score", isolation(*[F.col(c).cast("double") for c in names]))


def exact_quantile(df: DataFrame, column: str, q: float) -> float:
    """Exact quantile with linear interpolation; nulls are left out.

    A mergeable sketch of all values brackets the two ranks needed. The next pass counts
    exactly what lies below, at the ends of and inside the bracket, and sketches the
    inside; each leaves less than a three-hundredth of the values, and ties at the ends
    are settled at once. A bracket of few values is read in the last pass: three passes
    for 10^11 values, two for ``FEW``. No task or driver holds more than ``FEW`` values
    and a sketch.
    """
    x = F.col(column)
    margin = 4 / SKETCH
    near = F.percentile_approx(x, [max(0.0, q - margin), min(1.0, q + margin)], SKETCH)
    low, high, total, ends = df.agg(F.min(x), F.max(x), F.count(x), near).first()
    if not total:
        raise ValueError("No values")
    place = q * (total - 1)
    ranks = {math.floor(place), min(math.floor(place) + 1, total - 1)}
    found: dict[int, float] = {}
    below, inside = 0, total
    if total > FEW:
        (low, high), inside = ends, None
    while ranks - found.keys() and (inside is None or inside > FEW):
        within, between = x.between(low, high), (x > low) & (x < high)
        grid = F.percentile_approx(F.when(between, x), [i / GRID for i in range(GRID + 1)], SKETCH)
        below, inside, lows, highs, steps = df.agg(
            F.count_if(x < low), F.count_if(within), F.count_if(x == low), F.count_if(x == high), grid
        ).first()
        wanted = sorted(ranks - found.keys())
        if wanted[0] < below or wanted[-1] >= below + inside:
            raise ArithmeticError(f"The sketch of {column} missed its bound")
        found |= {r: low for r in wanted if r < below + lows}
        found |= {r: high for r in wanted if r >= below + inside - highs}
        wanted = sorted(ranks - found.keys())
        if wanted and inside > FEW:
            middle = inside - lows - highs
            at = [(r - below - lows) / middle * GRID for r in wanted]
            low, high = steps[max(0, math.floor(at[0]) - 1)], steps[min(GRID, math.ceil(at[-1]) + 1)]
    if ranks - found.keys():
        values = sorted(df.where(x.between(low, high)).groupBy(x).count().collect())
        upto = below
        for value, count in values:
            found |= {r: value for r in ranks if upto <= r < upto + count}
            upto += count
    first, last = found[min(ranks)], found[max(ranks)]
    return first + (last - first) * (place - math.floor(place))


def is_outlier(forest: Forest) -> Column:
    if forest.cutoff is None:
        raise ValueError("The forest has no cut-off")
    return F.col("score") > F.lit(forest.cutoff)


def isolation_forest_rule(forest: Forest | None) -> FrameRule:
    """Flags events beyond the cut-off. No model or too few events: no findings."""

    def rows(df: DataFrame) -> DataFrame:
        if forest is None or df.limit(MIN_ROWS).count() < MIN_ROWS:
            return df.limit(0)
        # all columns pass through the features: no join back
        keyed = with_line_keys(df)
        scored = score(extract_features(keyed, keep=keyed.columns), forest)
        return scored.where(is_outlier(forest)).select(keyed.columns)

    return FrameRule(
        "Isolation Forest Anomaly",
        "low",
        ("datetime", "ip_origen", "status"),
        rows=rows,
        reason="Isolation Forest Anomaly",
    )


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    spark.createDataFrame(forest.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/nodes"
    )
    meta = [(list(forest.features), forest.sample, forest.cutoff)]
    spark.createDataFrame(meta, "features array<string>, sample int, cutoff double").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/meta")


def load_forest(spark: SparkSession, path: str) -> Forest:
    meta = spark.read.parquet(f"{path}/meta").first()
    nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
    return Forest(nodes, tuple(meta["features"]), meta["sample"], meta["cutoff"])
