"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. After a rotation that spreads the
differences evenly, vectors are split into blocks of coordinates, and the squared
distance allowed is shared out in proportion to the blocks' widths: of two vectors
within the distance, some block is within its share. Each block is a range join: strips
along its first coordinate, as wide as the block's radius, so that partners are in the
same strip or the next. A pair is counted in the first block in which it is within the
share, and only if its exact cosine reaches the threshold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import by_batch, stored

COSINE = 0.93
BLOCK_WIDTH = 16
# Vectors of one strip that a task compares with as many others at a time.
TILE = 2048
# Room for rounding in the candidate tests; the exact test has none.
SLACK = 1e-6


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_slices(dims: int, width: int = BLOCK_WIDTH) -> list[slice]:
    count = max(1, dims // width)
    edges = np.linspace(0, dims, count + 1).round().astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _valid_rows(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(id, label, v): vectors as bytes of doubles, v null where they link with nothing."""
    kind = vectors.schema[id_column].dataType.simpleString()
    label_kind = vectors.schema[label_column].dataType.simpleString()

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for v, label in zip(batch.column("v"), batch.column("label")):
            x = None
            if v.is_valid and label.is_valid and len(v):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                # nulls come as NaN
                if not np.isfinite(x).all() or not x.any():
                    x = None
            out.append(None if x is None else (x + 0.0).tobytes())  # + 0.0: no negative zeros
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(out, pa.binary())], ["id", "label", "v"]
        )

    rows = vectors.select(
        vectors[id_column].alias("id"), vectors[label_column].alias("label"), vectors[vector_column].alias("v")
    )
    return by_batch(rows, check, f"id {kind}, label {label_kind}, v binary")


def _unit(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, unit vectors)."""
    x = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _strips(sets: DataFrame, cosine: float, width: int) -> DataFrame:
    """(label, dims, block, strip, rep, n, v): every vector once in each block."""
    label_kind = sets.schema["label"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = batch.column("v").to_pylist()
        sizes = np.array([len(v) // 8 for v in data])
        rows, dims, blocks, strips = [], [], [], []
        for d in np.unique(sizes).tolist():
            of = np.flatnonzero(sizes == d)
            turned = _unit([data[i] for i in of])[1] @ rotation(d)
            for b, cols in enumerate(block_slices(d, width)):
                radius = np.sqrt((2 - 2 * cosine) * (cols.stop - cols.start) / d) + SLACK
                rows.append(of)
                dims.append(np.full(len(of), d))
                blocks.append(np.full(len(of), b))
                strips.append(np.floor(turned[:, cols.start] / radius).astype(np.int64))
        take = np.concatenate(rows)
        return pa.RecordBatch.from_arrays(
            [batch.column("label").take(pa.array(take)), pa.array(np.concatenate(dims), pa.int32()),
             pa.array(np.concatenate(blocks), pa.int32()), pa.array(np.concatenate(strips)),
             *(batch.column(c).take(pa.array(take)) for c in ("rep", "n", "v"))],
            ["label", "dims", "block", "strip", "rep", "n", "v"],
        )

    return by_batch(
        sets, cut, f"label {label_kind}, dims int, block int, strip bigint, rep bigint, n bigint, v binary"
    )


def _links_of(groups: DataFrame, cosine: float, width: int) -> DataFrame:
    """(rep, links, to): links counted for each vector, and one edge to its local component."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        home, guest = group[group["side"] == 0], group[group["side"] == 1]
        same = bool(group["same"].iloc[0])
        if same:
            guest = home
        if home.empty or guest.empty:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("rep", "links", "to")})
        d, block = int(group["dims"].iloc[0]), int(group["block"].iloc[0])
        turn, slices = rotation(d), block_slices(d, width)
        x, y = _unit(home["v"].tolist())[1], _unit(guest["v"].tolist())[1]
        near = _within(x @ turn, y @ turn, slices, block, cosine)
        if same:
            near &= np.triu(np.ones(near.shape, bool), 1)
        i, j = np.nonzero(near)
        keep = (x[i] * y[j]).sum(axis=1) >= cosine
        i, j = i[keep], j[keep]
        ids = np.concatenate([home["rep"].to_numpy(), guest["rep"].to_numpy()])
        n = np.concatenate([home["n"].to_numpy(), guest["n"].to_numpy()])
        j = j if same else j + len(home)
        links = np.bincount(i, weights=n[j], minlength=len(ids)) + np.bincount(j, weights=n[i], minlength=len(ids))
        met = np.flatnonzero(links)
        root = _local_roots(ids, i, j)
        return pd.DataFrame({"rep": ids[met], "links": links[met].astype(np.int64), "to": root[met]})

    keys = ["label", "dims", "block", "strip", "pair", "tile", "other"]
    return groups.groupBy(*keys).applyInPandas(compare, "rep bigint, links bigint, to bigint")


def _within(x: np.ndarray, y: np.ndarray, slices: list[slice], block: int, cosine: float) -> np.ndarray:
    """Pairs within the share of ``block`` and beyond that of every block before it."""
    d = x.shape[1]
    out = np.ones((len(x), len(y)), bool)
    for b in range(block, -1, -1):
        cols = slices[b]
        share = (2 - 2 * cosine) * (cols.stop - cols.start) / d + SLACK
        p, q = x[:, cols], y[:, cols]
        apart = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :] - 2 * (p @ q.T)
        out &= (apart <= share) if b == block else (apart > share)
        if not out.any():
            break
    return out


def _local_roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id each is connected with, by the pairs (i, j) alone."""
    root = np.arange(len(ids))
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    best = rank.copy()
    while len(i):
        low = np.minimum(best[i], best[j])
        before = best.copy()
        np.minimum.at(best, i, low)
        np.minimum.at(best, j, low)
        best = np.minimum(best, best[np.argsort(rank)[best]])
        if (before == best).all():
            break
    return ids[np.argsort(rank, kind="stable")[best]] if len(ids) else ids[root]


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, width: int = BLOCK_WIDTH, tile: int = TILE,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    Only vectors of the same label and length are compared; a link is a cosine of at
    least ``cosine`` in double precision. Vectors that are null, empty or zero or hold a
    null or a non-finite component, and those with a null label, link with nothing.
    ``component_id`` is the smallest id reachable, ``kept`` tells whether it is one's
    own. Equal vectors are compared as one and count as many; repeated ids are rows of
    their own that share the component. An empty table gives an empty table.

    A strip with many vectors is cut into tiles that are compared two by two, each pair
    of tiles in a task of its own, so that no label and no cluster is gathered in one
    place. Tasks return counts and one edge per vector, never pairs.
    """
    rows = stored(_valid_rows(vectors, id_column, vector_column, label_column))
    valid = rows.where("v is not null")
    equal = valid.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    sets = stored(equal.withColumn("rep", F.monotonically_increasing_id()))
    strips = stored(_strips(sets, cosine, width))
    place = ["label", "dims", "block", "strip"]
    sizes = strips.groupBy(*place).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    # The next strip's number of tiles, for the pairs that reach across.
    after = sizes.select("label", "dims", "block", (F.col("strip") - 1).alias("strip"), F.col("tiles").alias("tiles_after"))
    before = sizes.select("label", "dims", "block", (F.col("strip") + 1).alias("strip"), F.col("tiles").alias("tiles_before"))
    counted = sizes.join(after, place, "left").join(before, place, "left").na.fill(0, ["tiles_after", "tiles_before"])
    dealt = strips.join(counted, place).withColumn("t", F.pmod(F.xxhash64("rep", "v"), F.col("tiles")).cast("int"))
    # Pairs of tiles in a strip (lower first), then of a tile and those of the next strip.
    zero = F.lit(0)
    inner = F.transform(
        F.sequence(zero, F.col("tiles") - 1),
        lambda u: F.struct(
            F.col("strip").alias("strip"), F.lit(0).alias("pair"),
            F.least(u, F.col("t")).alias("tile"), F.greatest(u, F.col("t")).alias("other"),
            F.when(F.col("t") <= u, 0).otherwise(1).alias("side"), (u == F.col("t")).alias("same"),
        ),
    )

    def across(count: str, as_home: bool):
        pairs = F.transform(
            F.sequence(zero, F.greatest(F.col(count) - 1, zero)),
            lambda u: F.struct(
                (F.col("strip") if as_home else F.col("strip") - 1).alias("strip"), F.lit(1).alias("pair"),
                (F.col("t") if as_home else u).alias("tile"), (u if as_home else F.col("t")).alias("other"),
                F.lit(0 if as_home else 1).alias("side"), F.lit(False).alias("same"),
            ),
        )
        return F.when(F.col(count) > 0, pairs).otherwise(F.slice(pairs, 1, 0))

    sides = F.concat(inner, across("tiles_after", True), across("tiles_before", False))
    spread = dealt.select("label", "dims", "block", "rep", "n", "v", F.explode(sides).alias("s")).select(
        "label", "dims", "block", "rep", "n", "v", "s.*"
    )
    found = stored(_links_of(spread, cosine, width))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    name, of = sets.select("rep", "least"), sets.select(F.col("rep").alias("to"), F.col("least").alias("least_to"))
    between = found.select("rep", "to").where("rep <> to").distinct().join(name, "rep").join(of, "to")
    # Equal vectors are a component; so are rows of one id, whatever their vectors.
    copies = rows.join(sets.where("n > 1").select("label", "v", "least"), ["label", "v"]).select("id", "least")
    components = connected_components(between.select("least", "least_to").union(copies))
    # A vector's own copies are linked with it; so are all copies of those it is linked with.
    counts = sets.join(linked, "rep", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    told = rows.join(counts, ["label", "v"], "left").join(components, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return told.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (component == F.col("id")).alias("kept"),
    )
