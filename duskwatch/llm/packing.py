"""Packing: first-fit decreasing in randomised groups, over a tournament tree of bins."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import held_as, vocabulary
from .tables import by_batch, slabs, stored

CAPACITY = 4096
# Pieces packed together; enough of them that the last, part-filled bins hardly count.
GROUP_PIECES = 4096


class Bins:
    """Open bins of equal capacity; the leftmost with enough room is found in log time.

    A tournament tree: every leaf holds the room of a bin, every inner node the larger
    of its two. Unused bins have all their room, so a fit always exists.
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece put into the first bin that can hold it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        offset = self.capacity - room[node]
        room[node] -= length
        number = node - self.leaves
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return number, offset


def first_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) for each length, in the order given; longest first, ties in order."""
    bins = Bins(len(lengths), capacity)
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        placed[i] = bins.put(lengths[i])
    return placed


def cut_documents(
    docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int = CAPACITY,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Every document's ids, then ``end_id``, cut into pieces of at most ``capacity``.

    (id, start, length, ids_crc32, doc_tokens), one row per piece, pieces all full but
    the last. A null text is an empty document: ``end_id`` alone. No shuffle.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = vocabulary(vocabulary_path)
        end = np.array([end_id], "<u4")
        rows, start, length, crc, total = [], [], [], [], []
        for first, texts in slabs(batch.column("t")):
            for r, found in enumerate(words.ids(texts), first):
                ids = np.concatenate((found, end))
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    rows.append(r)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids))
        longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
        owner = batch.column("i").take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([owner, *longs], [id_column, "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("i"), docs[text_column].alias("t"))
    return by_batch(
        rows, cut, f"`{id_column}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint",
        held_as(vocabulary_path),
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset``; ``pieces`` has a column ``length``.

    A full piece is a sequence by itself. The others go to random groups of about
    ``group_pieces`` rows each (a hash of the row's number, so that no document id,
    however often it is repeated, can overload one) and each group is packed by itself,
    first-fit decreasing. The pieces are written once before that, which fixes their
    numbers for tasks that run again; ties of length go by number. An empty table gives
    an empty table; columns of the two names are replaced; lengths that are null, 0 or
    over ``capacity`` are an error.
    """
    pieces = pieces.drop("_row", "_group", "sequence_id", "offset")
    names = pieces.columns
    rows = stored(pieces.withColumn("_row", F.monotonically_increasing_id()))
    wrong, partial = rows.agg(
        F.count_if(~F.coalesce(F.col("length").between(1, capacity), F.lit(False))),
        F.count_if(F.col("length") < capacity),
    ).first()
    if wrong:
        raise ValueError(f"{wrong} pieces are empty or longer than {capacity}")
    groups = max(1, -(-partial // group_pieces))
    full = rows.where(F.col("length") == capacity).withColumns(
        {"sequence_id": F.col("_row") * 2 + 1, "offset": F.lit(0).cast("long")}
    )
    # Sequence numbers: odd ones are full pieces, even ones are bins named after the
    # first row put into them, so both are unique without a count over all groups.
    schema = "_row bigint, sequence_id bigint, offset bigint"

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row", kind="stable")
        placed = first_fit_decreasing(group["length"].tolist(), capacity)
        out = pd.DataFrame({"_row": group["_row"].to_numpy()})
        bins = pd.Series([b for b, _ in placed])
        out["sequence_id"] = out.groupby(bins.to_numpy())["_row"].transform("min") * 2
        out["offset"] = [o for _, o in placed]
        return out

    keyed = rows.where(F.col("length") < capacity).select(
        "_row", "length", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group")
    )
    placed = keyed.groupBy("_group").applyInPandas(fit, schema)
    packed = rows.where(F.col("length") < capacity).join(placed, "_row")
    columns = [*names, "sequence_id", "offset"]
    return full.select(columns).unionByName(packed.select(columns))


def pack_documents(
    docs: DataFrame, vocabulary_path: str, end_id: int, capacity: int = CAPACITY,
    group_pieces: int = GROUP_PIECES, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """:func:`cut_documents`, then :func:`pack`."""
    pieces = cut_documents(docs, vocabulary_path, end_id, capacity, id_column, text_column)
    return pack(pieces, capacity, group_pieces)


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, pieces, tokens, padding) of packed pieces.

    A sequence is padded to ``capacity`` unless its tokens are a power of two.
    """
    used = packed.groupBy("sequence_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"))
    whole = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return used.withColumn("padding", F.when(whole, F.lit(0)).otherwise(F.lit(capacity) - F.col("tokens")))
