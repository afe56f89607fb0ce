"""N-gram Jaccard join by PartEnum signatures.

Two shingle sets of sizes a <= b with similarity t or more differ in at most
(1-t)/(1+t)*(a+b) elements. Sets are put into size bands (from a size to 1/t^2 of it),
so that similar sets are in the same band or in neighbouring ones; band j is also joined
with those sets of band j-1 that are large enough. For each band the shingle domain is hashed into n parts, a little more than
the number k of elements that may differ. The subset of a set that falls into one part
is a signature: every differing element spoils one part, so at least n-k parts agree (in
the terms of PartEnum: n parts, none of the second level, all enumerated).

The signatures that most sets have are left out as far as the spare parts allow: similar
sets share several, and the rarest of these are enough (:func:`_shared`). So a passage that
very many texts have in common does not bring each of them together with all others.

The sets of a signature are compared with one of them, its leader. Those unlike the leader
could still be similar to others: such pairs differ from the leader in the same shingles,
and are joined by the rarest of those (:func:`_same_differences`), not each with all others.

A part that is empty in both sets agrees too, but says nothing and makes no signature.
A set is *settled* by a partition if fewer than n-k of its parts are empty: then any
similar set shares a signature with it. Sets that are not are hashed again with the next
seed, on top of the first, until one settles them; of two similar sets the one settled
first makes both share a signature. So no pair is missed, whatever the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shingles import as_signed, each_set, mix
from .tables import by_batch, free_shuffles, let_go, stored, where_id_in

SIMILARITY = Fraction(3, 4)
# Parts beyond the differences allowed: n = k + 1 + k * SPARE_PARTS.
SPARE_PARTS = Fraction(12, 100)

# Numbers in the last bits of a signature that tell its partition.
PARTITIONS = 64

# Shingles of the sets that a task signs at a time.
SIGNED_SHINGLES = 200_000
# The outline of a set, by which most unlike pairs are told apart: its least number of
# parts, and the shingles per part beyond which it gets more.
OUTLINE_PARTS, OUTLINE_FILL = 128, 4
# Sets of a leader that are paired without a look at their differences.
PAIRED = 16

_U = np.uint64


def bands(size: int, t: Fraction = SIMILARITY) -> list[tuple[int, int, int]]:
    """(band, lowest size, highest size) of the size's own band and of the next."""
    low, band = 1, 0
    while True:
        high = int(low / t / t)
        if size <= high:
            return [(band, low, high), (band + 1, high + 1, int((high + 1) / t / t))]
        low, band = high + 1, band + 1


def _may_differ(a: int, b: int, t: Fraction) -> int:
    return int((1 - t) / (1 + t) * (a + b))


def _widths(size: int, t: Fraction) -> list[tuple[int, int, int]]:
    """(band, parts, differences allowed) of the joins a set of this size takes part in."""
    out = []
    for band, low, high in bands(size, t):
        partner = min(high, int(size / t))
        if partner >= low:  # else too small for any partner in the next band
            most = _may_differ(high, high, t)
            out.append((band, most + 1 + int(SPARE_PARTS * most), _may_differ(size, partner, t)))
    return out


def signatures(sets: list[np.ndarray], t: Fraction = SIMILARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, set numbers, spare) of many sets of distinct shingle hashes, none empty.

    The last bits of a signature tell the partition (band and seed) that it is of. A set
    shares at least ``spare`` + 1 signatures of that partition with every similar set.
    """
    known: dict[int, list[tuple[int, int, int]]] = {}
    sigs, owners, spares = [], [], []
    todo = [
        (i, *width, 0) for i, s in enumerate(sets) for width in known.setdefault(len(s), _widths(len(s), t))
    ]
    while todo:
        owner, band, parts, differ, seed = np.array(todo, np.int64).T
        size = np.array([len(sets[i]) for i in owner])
        shingles = np.concatenate([sets[i] for i in owner])
        salt = mix((band * 1_000_003 + seed).astype(np.uint64) + _U(1))
        hashed = mix(shingles + np.repeat(salt, size))
        part = ((hashed >> _U(32)) * np.repeat(parts.astype(np.uint64), size)) >> _U(32)
        first = np.cumsum(parts) - parts
        place = np.repeat(first, size) + part.astype(np.int64)
        total = int(parts.sum())
        # sums of 32 bits are exact in doubles
        told = mix(hashed ^ _U(0x5555555555555555))
        low = np.bincount(place, (told & _U(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
        high = np.bincount(place, (told >> _U(32)).astype(np.float64), total).astype(np.uint64)
        filled = np.zeros(total, bool)
        filled[place] = True
        join = np.repeat(np.arange(len(todo)), parts)[filled]
        number = (np.arange(total) - np.repeat(first, parts))[filled].astype(np.uint64)
        found = mix(mix(low[filled] + (high[filled] << _U(32)) + number * _U(0x9E3779B97F4A7C15)) ^ salt[join])
        partition = ((band % 8) * 8 + np.minimum(seed, 7)).astype(np.uint64)
        sigs.append((found & ~_U(PARTITIONS - 1)) | partition[join])
        owners.append(owner[join])
        shared = np.bincount(join, minlength=len(todo)) - differ
        spares.append(np.maximum(shared - 1, 0)[join])
        settled = shared > 0
        todo = [(*row[:4], row[4] + 1) for row, done in zip(todo, settled) if not done]
    return np.concatenate(sigs), np.concatenate(owners), np.concatenate(spares)


def set_key(shingles: np.ndarray) -> int:
    """64 bits that stand for a whole set."""
    return int(mix(mix(shingles).sum(dtype=np.uint64, keepdims=True) ^ mix(np.array([len(shingles)], np.uint64))).view(np.int64)[0])


def outline(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each part of the domain, 255 at most.

    Two sets differ in at least as many shingles as their outlines do. Larger sets have
    more parts, always a power of two, so that an outline can be coarsened to a shorter
    one by adding up neighbours.
    """
    parts = OUTLINE_PARTS
    while parts * OUTLINE_FILL < len(shingles):
        parts *= 2
    part = mix(shingles) >> _U(65 - parts.bit_length())
    return np.minimum(np.bincount(part.astype(np.int64), minlength=parts), 255).astype(np.uint8).tobytes()


def outlines_apart(x: bytes, y: bytes) -> int:
    """The least number of shingles in which two sets of these outlines differ."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int32) for v in (x, y))
    parts = min(len(a), len(b))
    a, b = (v.reshape(parts, -1).sum(axis=1) for v in (a, b))
    return int(np.abs(a - b).sum())


def _sets(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, n_shingles, key, outline): of every row's set; 0 and nulls if it is empty."""
    kind = docs.schema[id_column].dataType.simpleString()

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, outlines = [], [], []
        for s in each_set(batch.column("t")):
            n.append(len(s))
            keys.append(set_key(s) if len(s) else None)
            outlines.append(outline(s) if len(s) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column("i"), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(outlines, pa.binary())],
            [id_column, "n_shingles", "key", "outline"],
        )

    rows = docs.select(docs[id_column].alias("i"), docs[text_column].alias("t"))
    return by_batch(rows, measure, f"`{id_column}` {kind}, n_shingles bigint, key bigint, outline binary")


def _signed(docs: DataFrame, text_column: str, t: Fraction) -> DataFrame:
    """(sig, key, spare): a row for every signature of every set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            sets: list[np.ndarray] = []
            size = 0
            for s in each_set(batch.column("t")):
                if len(s):
                    sets.append(s)
                    size += len(s)
                if size >= SIGNED_SHINGLES:
                    yield rows(sets)
                    sets, size = [], 0
            if sets:
                yield rows(sets)

    def rows(sets: list[np.ndarray]) -> pa.RecordBatch:
        sigs, owners, spares = signatures(sets, t)
        keys = np.array([set_key(s) for s in sets], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(as_signed(sigs)), pa.array(keys[owners]), pa.array(spares.astype(np.int32))], ["sig", "key", "spare"]
        )

    return docs.select(docs[text_column].alias("t")).mapInArrow(sign, "sig bigint, key bigint, spare int")


def _met(signed: DataFrame) -> DataFrame:
    """(sig, key, spare) of the signatures that different sets share.

    Rows are dealt and sorted by signature and streamed, so that a signature shared by any
    number of sets needs no memory. Of equal sets one row stays, but for those far apart
    in a very long run.
    """
    names = ["sig", "key", "spare"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, told = None, False  # the first row of the last signature, and if it was handed on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in names]
            if first is not None:
                rows = [np.concatenate(([f], c)) for f, c in zip(first, rows)]
            order = np.lexsort((rows[1], rows[0]))
            if first is not None:  # the row put before is the first of its signature again
                order = np.concatenate(([0], order[order != 0]))
            rows = [c[order] for c in rows]
            sigs, keys = rows[:2]
            new = np.concatenate(([True], sigs[1:] != sigs[:-1]))
            begins = np.flatnonzero(new)
            leader = keys[begins][np.cumsum(new) - 1]
            fresh = new | ((keys != leader) & np.concatenate(([True], keys[1:] != keys[:-1])))
            several = np.add.reduceat(fresh, begins, dtype=np.int64) > 1
            out = fresh & several[np.cumsum(new) - 1]
            handed = told and len(begins) > 0
            if handed:
                out[0] = False
            last = begins[-1]
            told = bool(several[-1]) or (handed and last == 0)
            first = [c[last] for c in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in rows], names)

    dealt = signed.repartition("sig").sortWithinPartitions("sig")
    return dealt.mapInArrow(stream, "sig bigint, key bigint, spare int")


def _shared(signed: DataFrame) -> DataFrame:
    """(a, b, n): the leader ``a`` of ``n`` signatures and each other set ``b`` they have.

    Signatures are those needed to find all similar sets. Similar sets share more than
    ``spare`` signatures of a partition, so the ``spare`` most frequent ones of each can
    be left out: of those that two similar sets share, the rarest is among the others of
    both. Passages that many texts have in common go this way. The leader is the set that
    meets others most often, so that of many copies of a text it is one with few edits
    and the same for most signatures.
    """
    met = stored(_met(signed))
    free_shuffles(signed.sparkSession)
    met = met.distinct()
    often = met.groupBy("sig").agg(F.count("*").alias("often"))
    own = Window.partitionBy("key", F.pmod("sig", F.lit(PARTITIONS)))
    ranked = met.join(often, "sig").withColumns(
        {"_nth": F.row_number().over(own.orderBy(F.desc("often"), "sig")), "meets": F.sum("often").over(own)}
    )
    needed = stored(ranked.where(F.col("_nth") > F.col("spare")).select("sig", "key", "meets"))
    leaders = needed.groupBy("sig").agg(F.max(F.struct("meets", "key")).alias("top"), F.count("*").alias("sets")).where("sets > 1")
    led = needed.join(leaders.select("sig", F.col("top.key").alias("leader")), "sig").where("key <> leader")
    return led.groupBy(F.col("leader").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("n"))


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, total) of pairs of set keys: sizes of the intersection and the union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, total = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                common.append(both)
                total.append(len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())],
                ["a", "b", "common", "total"],
            )

    return _side_by_side(pairs, sets).mapInArrow(compare, "a bigint, b bigint, common bigint, total bigint")


def _side_by_side(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, x, y): pairs of set keys and their shingles."""
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")


def _differences(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """(leader, key, n, excess, diff) of pairs (a, b): the shingles that only one of the two sets has.

    ``excess`` is (q+p)n - (q-p) times the size of set b, for t = p/q. Two sets x and y are
    similar if and only if their differences from any third set have (excess of x +
    excess of y) / 2(q+p) shingles in common at least.
    """
    more, less = t.denominator + t.numerator, t.denominator - t.numerator

    def rows(leaders: list, keys: list, sizes: list[int], diffs: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(d) for d in diffs], np.int64)
        ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(leaders, pa.int64()), pa.array(keys, pa.int64()), pa.array(n),
             pa.array(more * n - less * np.array(sizes, np.int64)),
             pa.ListArray.from_arrays(ends, pa.array(as_signed(np.concatenate(diffs))))],
            ["leader", "key", "n", "excess", "diff"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            found: tuple[list, ...] = ([], [], [], [])
            size = 0
            for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "x", "y"))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                diff = np.setxor1d(x, y, assume_unique=True)
                for held, value in zip(found, (a.as_py(), b.as_py(), len(y), diff)):
                    held.append(value)
                size += len(diff)
                if size >= SIGNED_SHINGLES:
                    yield rows(*found)
                    found, size = ([], [], [], []), 0
            if found[0]:
                yield rows(*found)

    return _side_by_side(pairs, sets).mapInArrow(compare, "leader bigint, key bigint, n bigint, excess bigint, diff array<bigint>")


def _same_differences(members: DataFrame, diffs: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (x, y) of a leader's sets that may be similar, x not similar to the leader.

    A set that is not similar to the leader has an excess so large that any similar set
    shares a difference with it, often many. The differences of each set are ordered, the
    rarest among the leader's sets first, and of two similar sets the first one in common
    comes so early in both that those from there on are enough.
    """
    twice = 2 * (t.denominator + t.numerator)
    told = diffs.drop("diff").join(members.select("leader", "key", "group", "led"), ["leader", "key"])
    least = told.groupBy("leader").agg(F.min("excess").alias("any"), F.min(F.when(~F.col("led"), F.col("excess"))).alias("unlike"))
    told = stored(told.join(least, "leader").withColumn("partner", F.when(F.col("led"), F.col("unlike")).otherwise(F.col("any"))))
    each = diffs.select("leader", "key", F.explode("diff").alias("shingle"))
    often = each.withColumn("often", F.count("*").over(Window.partitionBy("leader", "shingle")))
    rarest = Window.partitionBy("leader", "key").orderBy("often", "shingle")
    ranked = often.withColumn("nth", F.row_number().over(rarest)).where("often > 1")
    early = stored(
        ranked.join(told, ["leader", "key"])
        .withColumn("enough", twice * (F.col("n") - F.col("nth") + 1))
        .where(F.col("enough") >= F.col("excess") + F.col("partner"))
        .select("leader", "shingle", "key", "excess", "enough", "group", "led")
    )
    x, y = (early.select("leader", "shingle", *(F.col(c).alias(c + i) for c in ("key", "excess", "enough", "group", "led"))) for i in "xy")
    return x.where(~F.col("ledx")).join(y, ["leader", "shingle"]).where(
        (F.col("groupx") != F.col("groupy"))
        & (F.col("ledy") | (F.col("keyx") < F.col("keyy")))
        & (F.least("enoughx", "enoughy") >= F.col("excessx") + F.col("excessy"))
    ).select(F.col("keyx").alias("x"), F.col("keyy").alias("y"))


def _plausible(pairs: DataFrame, outlines: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b) and ``least``, the least their Jaccard distance can be by their outlines.

    Pairs that cannot reach ``t`` have a ``least`` over 1 - t.
    """

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        shown = zip(batch.column("ox").to_pylist(), batch.column("oy").to_pylist())
        apart = np.array([outlines_apart(x, y) for x, y in shown], np.int64)
        both = batch.column("nx").to_numpy() + batch.column("ny").to_numpy()
        # a union of (both + apart) / 2 at least, with ``apart`` outside the intersection
        return pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(2 * apart / (both + apart))], ["a", "b", "least"]
        )

    x = outlines.select(F.col("key").alias("a"), F.col("n_shingles").alias("nx"), F.col("outline").alias("ox"))
    y = outlines.select(F.col("key").alias("b"), F.col("n_shingles").alias("ny"), F.col("outline").alias("oy"))
    joined = pairs.join(x, "a").join(y, "b").select("a", "b", "nx", "ny", "ox", "oy")
    return by_batch(joined, compare, "a bigint, b bigint, least double")


def similar_pairs(docs: DataFrame, sets: DataFrame, id_column: str, text_column: str, t: Fraction) -> DataFrame:
    """Links (a, b) between set keys that connect the same sets as all pairs with similarity ``t``.

    Two sets that share a signature are compared, or else connected by other links. To
    need few comparisons, every set is compared with the leader that it shares the most
    signatures with; then with its other leaders that it is not connected with; then
    those not connected with a leader with the others of that leader: with all, if they
    are few, by the distances to the leader (the Jaccard distance obeys the triangle
    inequality), else with those that differ from it in the same shingles. Before two
    sets are laid side by side their outlines are compared, which rules out most unlike
    pairs and no similar one.
    """
    apart = float(1 - t) + 1e-9
    is_link = F.col("common") * t.denominator >= F.col("total") * t.numerator
    counted = stored(_shared(_signed(docs, text_column, t)))
    free_shuffles(docs.sparkSession)
    outlines = stored(
        sets.where("key is not null").groupBy("key").agg(
            F.min(id_column).alias("i"), F.first("n_shingles").alias("n_shingles"), F.first("outline").alias("outline")
        )
    )
    looked = stored(_plausible(counted.select("a", "b"), outlines, t).join(counted, ["a", "b"]))
    maybe = looked.where(F.col("least") <= apart)

    def compared(pairs: DataFrame) -> DataFrame:
        told = stored(_compared(docs, outlines, pairs, text_column, id_column))
        free_shuffles(docs.sparkSession)
        return told

    def in_groups(links: DataFrame) -> DataFrame:
        """(key, group) of the sets that links connect with others."""
        found = connected_components(links)
        return found.select(F.col("node").alias("key"), F.col("component").alias("group"))

    def apart_pairs(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        ga, gb = (groups.select(F.col("key").alias(c), F.col("group").alias(f"g{c}")) for c in "ab")
        placed = pairs.join(ga, "a", "left").join(gb, "b", "left")
        return placed.where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b")

    best = maybe.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")
    told = compared(best)
    groups = in_groups(told.where(is_link).select("a", "b"))
    others = maybe.select("a", "b").join(told.select("a", "b"), ["a", "b"], "left_anti")
    told = told.union(compared(apart_pairs(others, groups)))
    links = told.where(is_link).select("a", "b")
    groups = in_groups(links)

    # (leader, key): the distance if it was measured, and the least it can be
    known = looked.join(told, ["a", "b"], "left").select(
        F.col("a").alias("leader"), F.col("b").alias("key"), (1 - F.col("common") / F.col("total")).alias("d"), "least"
    )
    of_leader = groups.select(F.col("key").alias("leader"), F.col("group").alias("leaders"))
    members = stored(
        known.join(groups, "key", "left").join(of_leader, "leader", "left").select(
            "leader", "key", "d", "least", F.coalesce("group", "key").alias("group"),
            (F.coalesce("group", "key") == F.coalesce("leaders", "leader")).alias("led"),
        )
    )
    unsettled = members.groupBy("leader").agg(F.count("*").alias("sets"), F.count_if(~F.col("led")).alias("unlike"))
    unsettled = stored(unsettled.where("unlike > 0 and sets > 1").select("leader", "sets"))
    few = members.join(unsettled.where(F.col("sets") <= PAIRED), "leader", "left_semi")
    many = stored(members.join(unsettled.where(F.col("sets") > PAIRED), "leader", "left_semi"))
    x = few.where(~F.col("led")).select(
        "leader", F.col("key").alias("x"), F.coalesce("d", "least").alias("dx"), F.col("group").alias("gx")
    )
    y = few.select("leader", F.col("key").alias("y"), F.col("d").alias("dy"), F.col("group").alias("gy"), "led")
    rest = x.join(y, "leader").where(
        (F.col("gx") != F.col("gy"))
        & (F.col("led") | (F.col("x") < F.col("y")))
        & (F.col("dy").isNull() | (F.col("dx") - F.col("dy") <= apart))
    ).select("x", "y")
    far = many.select(F.col("leader").alias("a"), F.col("key").alias("b"))
    diffs = stored(_differences(far, _laid_out(docs, outlines, far, text_column, id_column), t))
    rest = stored(rest.union(_same_differences(many, diffs, t)))
    free_shuffles(docs.sparkSession)
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = _plausible(rest, outlines, t).where(F.col("least") <= apart).select("a", "b")
    both_ways = told.select("a", "b").union(told.select("b", "a"))
    more = compared(more.join(both_ways, ["a", "b"], "left_anti"))
    return links.union(more.where(is_link).select("a", "b"))


def _laid_out(docs: DataFrame, outlines: DataFrame, pairs: DataFrame, text_column: str, id_column: str) -> DataFrame:
    """(key, shingles) of the sets in stored pairs (a, b) of keys, whose texts are read again."""
    keys = stored(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    ids = stored(outlines.join(keys, "key").select("i").distinct())

    def lay_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [s for s in each_set(batch.column("t")) if len(s)]
        return pa.RecordBatch.from_arrays(
            [pa.array([set_key(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())],
            ["key", "shingles"],
        )

    named = docs.select(docs[id_column].alias("i"), docs[text_column].alias("t"))
    # sets that no row with an id has are looked for among the rows without one
    asked = where_id_in(named, "i", ids).unionByName(named.where("i is null"))
    laid = by_batch(asked.select("t"), lay_out, "key bigint, shingles binary")
    # an id may stand for several rows and sets: of each set that is asked for, one
    return laid.join(keys, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles"))


def _compared(docs: DataFrame, outlines: DataFrame, pairs: DataFrame, text_column: str, id_column: str) -> DataFrame:
    """:func:`_similarities` of pairs of set keys, whose texts are read again."""
    pairs = stored(pairs)
    return _similarities(pairs, _laid_out(docs, outlines, pairs, text_column, id_column))


def near_duplicates(
    docs: DataFrame, similarity: Fraction = SIMILARITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest id reachable by links, one's own included. Texts
    without words, empty or null, have no shingle and no link. Rows with the same id are
    one document of several texts: they share the component. Rows with a null id have a
    null component unless their text links them with others. An empty table gives an
    empty table; other columns are ignored.
    """
    sets = stored(_sets(docs, id_column, text_column))
    links = similar_pairs(docs, sets, id_column, text_column, similarity)
    keyed, row_id = sets.where("key is not null"), F.col(id_column)
    # an id with several texts chains their sets
    chained = keyed.where(row_id.isNotNull()).groupBy(row_id).agg(F.min("key").alias("key"), F.max("key").alias("last"))
    chained = chained.where("key < last").select(row_id, F.col("key").alias("first"))
    chains = keyed.join(chained, id_column).select("first", "key")
    found = connected_components(links.union(chains)).toDF("key", "component")
    placed = stored(
        keyed.join(found, "key", "left").select(id_column, "n_shingles", F.coalesce("component", "key").alias("component"))
    )
    least = placed.groupBy("component").agg(F.min(row_id).alias("component_id"))
    told = placed.join(least, "component").select(id_column, "n_shingles", "component_id")
    # empty texts are where the other texts of their id are, or alone
    of_id = told.groupBy(row_id).agg(F.min("component_id").alias("component_id"))
    empty = sets.where("key is null").join(of_id, id_column, "left")
    return told.unionByName(empty.select(id_column, "n_shingles", F.coalesce("component_id", id_column).alias("component_id")))
