"""Prefix trie of conversations by van Emde Boas recursion.

All sequences are cut at half of the depth. The cut prefix of a sequence gets a name, a
digest that equal prefixes share. What stands above the cut is the upper trie; what
stands below, told apart by the name of its cut prefix, are the lower forests. Both are
cut again, all of one level in one join, until every segment is a single turn: its name
is a node. Totals go the other way: the forests below a cut are summed for each cut
prefix and grafted on all nodes of the upper trie that lead to it, from the shortest
segments to the whole. Both take as many levels as the longest sequence has binary
digits, whatever its length, and no step holds a whole sequence or a whole subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

ROOT = b""
WORD = r"[^\x20\x09-\x0D]+"

# Characters of a list of ids that are handed on as one value.
_CHUNK_CHARS = 1_000_000

# Depths that one row is spread to at a time.
_STRIDE = 4096


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def number_turns(
    turns: DataFrame,
    id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
) -> DataFrame:
    """(id, position, key, words) of every turn, stored; positions run from 1 without a gap.

    ``key`` is a digest of role and text (null: empty), ``words`` the number of words of
    the text. Turns are in order of ``turn_column``, null first; ties by ``key``, so that
    only equal turns are left in no order. Equal rows stay as often as they come. Rows of
    a null id belong to no conversation and are left out. Other columns are ignored.

    Rows are dealt by ranges of (id, turn), so a conversation that holds a third of all
    rows is numbered by many tasks, and the counts of its ranges are added up.
    """
    role, text = (F.coalesce(turns[c], F.lit("")) for c in (role_column, text_column))
    rows = turns.where(turns[id_column].isNotNull()).select(
        turns[id_column].alias("id"), turns[turn_column].alias("turn"),
        _digest(F.length(role).cast("string"), F.lit(":"), role, text).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("tie"),
    )
    run = Window.partitionBy("id", "part").orderBy("turn", "key", "tie")
    dealt = rows.repartitionByRange("id", "turn", "key", "tie").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt.select("id", "part", "key", "words", F.row_number().over(run).alias("inside")))
    earlier = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("id", "part").count().select(
        "id", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before")
    )
    return stored(
        dealt.join(before, ["id", "part"]).select(
            "id", (F.col("before") + F.col("inside")).alias("position"), "key", "words"
        )
    )


def _name_blocks(rows: DataFrame, levels: int) -> list[DataFrame]:
    """(id, at, name) of the blocks of 1, 2, 4, ... turns that begin at a multiple of their size."""
    blocks = [rows.select("id", (F.col("position") - 1).alias("at"), F.col("key").alias("name"))]
    for _ in range(levels - 1):
        left = F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left")
        right = F.max(F.when(F.col("at") % 2 == 1, F.col("name"))).alias("right")
        pairs = blocks[-1].groupBy("id", F.floor(F.col("at") / 2).alias("at")).agg(left, right)
        whole = pairs.where("left is not null and right is not null")
        blocks.append(stored(whole.select("id", "at", _digest(F.col("left"), F.col("right")).alias("name"))))
    return blocks


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _name_prefixes(rows: DataFrame, members: DataFrame, levels: int) -> DataFrame:
    """(id, length, depth, parent, name, words): the node that every sequence reaches at every depth."""
    blocks = _name_blocks(rows, levels)
    begin = members.where("length > 0").select(
        "id", "length", F.lit(0).cast("long").alias("at"), F.lit(ROOT).alias("name")
    )
    segments = [begin]
    for level in reversed(range(levels)):
        half = 1 << level
        # A segment may be empty: its name is that of the whole sequence.
        cut = _union(segments).where(F.col("at") + half <= F.col("length"))
        upper = blocks[level].select("id", (F.col("at") * half).alias("at"), F.col("name").alias("block"))
        lower = cut.join(upper, ["id", "at"]).select(
            "id", "length", (F.col("at") + half).alias("at"), _digest(F.col("name"), F.col("block")).alias("name")
        )
        segments.append(stored(lower))
    cuts = _union(segments)
    above = cuts.where("at < length").select("id", (F.col("at") + 1).alias("depth"), F.col("name").alias("parent"))
    own = cuts.where("at > 0").select("id", F.col("at").alias("depth"), "length", "name")
    words = rows.select("id", F.col("position").alias("depth"), "words")
    return stored(own.join(above, ["id", "depth"]).join(words, ["id", "depth"]))


def _spread(cuts: DataFrame, size: int) -> DataFrame:
    """``cuts`` once for each of the ``size`` depths down to their cut (``depth``)."""
    steps = F.explode(F.sequence(F.lit(0), F.lit((size - 1) // _STRIDE))).alias("step")
    strides = cuts.select("*", steps).withColumn("step", F.col("step") * _STRIDE)
    last = F.least(F.col("step") + _STRIDE, F.lit(size)) - 1
    near = strides.select("*", F.explode(F.sequence(F.col("step"), last)).alias("up"))
    return near.withColumn("depth", F.col("depth") - F.col("up")).drop("step", "up")


def _graft(own: DataFrame, paths: DataFrame, levels: int, what: list[str]) -> DataFrame:
    """Sums of the columns ``what`` over all subtrees, by name.

    ``own`` has what every node adds itself, with its parent, depth and a member.
    """
    sums = [F.sum(c).alias(c) for c in what]
    gains = [own]
    for level in range(levels):
        half = 1 << level
        # The tops of the lower forests, summed for each cut prefix; any member leads up from there.
        tops = _union(gains).where((F.col("depth") - 1) % (2 * half) == half)
        cuts = tops.groupBy("parent", "depth").agg(F.min("id").alias("id"), *sums).drop("parent")
        way = _spread(cuts.withColumn("depth", F.col("depth") - 1), half)
        above = way.join(paths.select("id", "depth", "name", "parent"), ["id", "depth"])
        gains.append(stored(above.groupBy("name", "parent", "depth").agg(F.min("id").alias("id"), *sums)))
    below = _union(gains).select("name", "parent", "depth", *what)
    root = below.where("depth = 1").select(F.col("parent").alias("name"), *what)
    first = own.where("depth = 0").select("name", *what)
    return below.where("depth > 0").select("name", *what).unionByName(root).unionByName(first).groupBy("name").agg(*sums)


def _list_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of the ids of each name, ascending, in decimal, joined by commas.

    Tasks of (name, id) ranges write pieces of the lists; the pieces of a list are then
    read in order by one task, which keeps no more than one of them.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
        name, first, ids, size, done = None, 0, [], 0, []

        def shut():
            if ids:
                done.append((name, first, ",".join(ids)))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)

        for batch in batches:
            for n, i in zip(batch.column("name").to_pylist(), batch.column("id").to_pylist()):
                if n != name or size > _CHUNK_CHARS:
                    shut()
                    name, first, ids, size = n, i, [], 0
                ids.append(str(i))
                size += len(ids[-1]) + 1
            if done:
                yield out()
                done.clear()
        shut()
        if done:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.binary()), ("ends_sha256", pa.string())])
        name, sha, done = None, None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)

        for batch in batches:
            for n, ids in zip(batch.column("name").to_pylist(), batch.column("ids")):
                if n == name:
                    sha.update(b",")
                else:
                    if sha:
                        done.append((name, sha.hexdigest()))
                    name, sha = n, hashlib.sha256()
                sha.update(ids.as_py().encode())
            if done:
                yield out()
                done.clear()
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([sha.hexdigest()])], schema=schema)

    lists = ends.repartitionByRange("name", "id").sortWithinPartitions("name", "id")
    written = lists.mapInArrow(pieces, "name binary, first bigint, ids string")
    return written.repartition("name").sortWithinPartitions("name", "first").mapInArrow(
        digests, "name binary, ends_sha256 string"
    )


def prefix_trie(rows: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node: every distinct prefix of a sequence, the empty one (the root) included.

    ``rows`` (id, position, key, words) holds the items of the sequences, positions from 1
    without a gap; ``members`` (id, length) every sequence once, also the empty ones. Ids
    are integers, none null. Both are read many times and should be stored tables.

    Returned: ``name`` and ``parent`` (binary names; root: empty, null), ``id`` (the
    smallest member), ``parent_id``, ``depth``, ``words`` (of the last item), ``n_convs``
    (members), ``n_children``, ``n_leaves`` (childless nodes of the subtree),
    ``saved_tokens`` ((members - 1) * words, summed over the subtree) and ``ends_sha256``
    (of the ids that end here). Subtrees include their top. Without members there is no
    node. Equal sequences share all nodes; a sequence of any length is cut like the others.
    """
    longest = members.agg(F.max("length")).first()[0] or 0
    levels = longest.bit_length()
    paths = _name_prefixes(rows, members, levels)
    reached = paths.groupBy("name", "parent", "depth", "words").agg(
        F.min("id").alias("id"), F.count("*").alias("n_convs")
    )
    root = members.groupBy(F.lit(ROOT).alias("name")).agg(F.min("id").alias("id"), F.count("*").alias("n_convs"))
    root = root.withColumns(
        {"parent": F.lit(None).cast("binary"), "depth": F.lit(0).cast("long"), "words": F.lit(0).cast("long")}
    )
    nodes = stored(reached.unionByName(root))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(
        F.count("*").alias("n_children")
    )
    nodes = stored(
        nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    )
    own = nodes.select(
        "name", "parent", "depth", "id", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    totals = _graft(own, paths, levels, ["n_leaves", "saved_tokens"])
    ends = paths.where("depth = length").select("name", "id").unionByName(
        members.where("length = 0").select(F.lit(ROOT).alias("name"), "id")
    )
    above = nodes.select(F.col("name").alias("parent"), F.col("id").alias("parent_id"))
    no_end = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(totals, "name")
        .join(_list_digests(ends), "name", "left")
        .join(above, "parent", "left")
        .select(
            "name", "parent", "id", "parent_id", "depth", "words", "n_convs", "n_children", "n_leaves",
            "saved_tokens", F.coalesce("ends_sha256", F.lit(no_end)).alias("ends_sha256"),
        )
    )
