"""Benchmark decontamination: fingerprints of item-sized windows, then exact running counts of shingles.

Every item and every window of a text as long as an item has a SimHash of 512 bits, to
which its shingles vote by weight. Fingerprints of the items of one length are indexed by
64 blocks of a byte. Two that differ by at most RADIUS bits have a block that differs by at
most one bit, so probing each block of a window with that byte and its eight neighbours
meets every item within the radius (multi-index hashing).

Of bags with a similarity of 0.75 or more the cosine is 6/7 at least, so that a bit differs
with a probability of about 0.17 (0.19 for the shortest bags): 88 bits in the middle, with
a deviation of 8.5. RADIUS lies more than 4 deviations above it, and 11 below the 256 bits of
unlike texts.

Windows that hold too few shingles of any item of their length cannot reach the similarity
and get no fingerprint. Of the items met, the best window follows exactly from running counts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shingles import SHINGLE_WORDS, each_words, mix, shingle_hashes, words_of
from .tables import by_batch, held

SIMILARITY = 0.75
# Bits of a fingerprint, in blocks of a byte, and how many may differ: less than two in each block.
BITS = 512
BLOCKS = BITS // 8
RADIUS = 2 * BLOCKS - 1
# Items sent to the tasks at a time: a bounded number of bytes of their texts.
ITEM_BYTES = 8_000_000

# Windows whose votes are summed at a time, and pairs of fingerprints compared at a time.
_SUMMED, _COMPARED = 4096, 200_000
_SALTS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64))
# a byte and those that differ from it by a bit
_NEAR = np.concatenate(([0], 1 << np.arange(8))).astype(np.uint8)
_FIRST_BITS = 20
_TOP = np.uint64(64 - _FIRST_BITS)


def _votes(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(mix(shingles[:, None] ^ _SALTS).astype("<u8").view(np.uint8), axis=1)


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles at the ascending ``starts``: every shingle votes on every bit.

    A shingle that comes twice votes twice. The votes of the first window of a run are
    summed; those of the next ones follow from what comes in and what goes out. A run is
    cut where windows do not touch, so that memory and work are bounded by its windows.
    """
    out = np.empty((len(starts), BLOCKS), np.uint8)
    cuts = np.flatnonzero(np.diff(starts) > size) + 1
    for run in np.split(np.arange(len(starts)), cuts):
        i, stop = run[0], run[-1] + 1
        while i < stop:
            a = starts[i]
            j = i + int(np.searchsorted(starts[i:stop], a + _SUMMED))
            b = starts[j - 1]
            sums = np.zeros((b - a + 1, BITS), np.int32)
            for at in range(a, a + size, _SUMMED):
                sums[0] += _votes(shingles[at : min(at + _SUMMED, a + size)]).sum(axis=0, dtype=np.int32)
            sums[1:] = _votes(shingles[a + size : b + size])
            sums[1:] -= _votes(shingles[a:b])
            np.cumsum(sums, axis=0, out=sums)
            out[i:j] = np.packbits(2 * sums[starts[i:j] - a] > size, axis=1)
            i = j
    return out


class _Lengths:
    """The items of one length: their shingles all together, their fingerprints and the index of these."""

    def __init__(self, items: list[int], bags: dict[int, np.ndarray], shingles: np.ndarray):
        self.items, self.shingles = np.array(items, np.int64), shingles
        self.size = len(bags[items[0]])
        self.prints = np.concatenate([fingerprints(bags[i], np.zeros(1, np.int64), self.size) for i in items])
        # the items of each byte of each block, one after the other
        keys = (np.arange(BLOCKS) * 256 + self.prints).ravel()
        order = np.argsort(keys, kind="stable")
        self.members = (order // BLOCKS).astype(np.int32)
        self.first = np.searchsorted(keys[order], np.arange(BLOCKS * 256 + 1)).astype(np.int32)

    def near(self, prints: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (print, place in ``items``) whose fingerprints differ by at most ``radius`` bits, some at a time."""
        own, step = self.prints.view(np.uint64), max(1, _COMPARED // (4 * len(self.items) + BLOCKS))
        for at in range(0, len(prints), step):
            some = prints[at : at + step]
            keys = np.arange(BLOCKS)[:, None] * 256 + (some[:, :, None] ^ _NEAR)
            keys = keys.reshape(len(some), -1)
            begin, often = self.first[keys], self.first[keys + 1] - self.first[keys]
            window = np.repeat(np.arange(len(some)), often.sum(axis=1))
            begin, often = begin.ravel(), often.ravel()
            place = np.repeat(begin - np.cumsum(often) + often, often) + np.arange(often.sum())
            window, item = np.divmod(np.unique(window * len(self.items) + self.members[place]), len(self.items))
            apart = np.bitwise_count(own[item] ^ some.view(np.uint64)[window]).sum(axis=1)
            yield window[apart <= radius] + at, item[apart <= radius]


class _Known:
    """The shingles of one width of all items: numbers for them, which item has which how often, items by length."""

    def __init__(self, bags: dict[int, np.ndarray]):
        own = {i: np.unique(bag, return_counts=True) for i, bag in bags.items()}
        self.names = np.unique(np.concatenate([names for names, _ in own.values()]))
        self.of = {i: (np.searchsorted(self.names, names), counts) for i, (names, counts) in own.items()}
        holder: dict[int, list[int]] = defaultdict(list)
        for item, bag in bags.items():
            holder[len(bag)].append(item)
        self.lengths = [
            _Lengths(items, bags, np.unique(np.concatenate([self.of[i][0] for i in items]))) for items in holder.values()
        ]
        # a quick look before the exact one: is there any known shingle with these first bits?
        self.marked = np.zeros(1 << _FIRST_BITS, bool)
        self.marked[(self.names >> _TOP).astype(np.int64)] = True
        self.wanted = np.zeros(len(self.names), np.int64)

    def found_in(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers) of the known ones among the shingles of a text."""
        at = np.flatnonzero(self.marked[(own >> _TOP).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.names, own[at]), len(self.names) - 1)
        same = self.names[number] == own[at]
        return at[same], number[same]

    def promising(self, of: _Lengths, at: np.ndarray, number: np.ndarray, n: int, similarity: float) -> np.ndarray:
        """Starts of the windows that hold enough shingles of items of that length, in a text of ``n`` shingles.

        Similar bags of x and y shingles have at least s / (1 + s) * (x + y) in common. A
        text shorter than the item is one window.
        """
        size = min(of.size, n)
        need = math.ceil(similarity / (1 + similarity) * (of.size + size) - 1e-9)
        if size < need or len(at) < need:
            return np.zeros(0, np.int64)
        self.wanted[of.shingles] = 1
        at = at[self.wanted[number] > 0]
        self.wanted[of.shingles] = 0
        if len(at) < need:
            return np.zeros(0, np.int64)
        upto = np.zeros(n + 1, np.int64)
        upto[at + 1] = 1
        np.cumsum(upto, out=upto)
        return np.flatnonzero(upto[size:] - upto[: n + 1 - size] >= need)

    def best_window(self, item: int, at: np.ndarray, number: np.ndarray, size: int, last: int) -> tuple[int, int]:
        """(shared shingles by weight, start) of the best of all windows of ``size`` shingles.

        Windows start at 0 to ``last``; of equally good ones it is the first. A shingle
        that the item has c times counts for the windows that hold it but not its c-th
        occurrence before; these are intervals of starts, and the number of intervals over
        a start is what its window shares with the item.
        """
        names, counts = self.of[item]
        self.wanted[names] = counts
        c = self.wanted[number]
        self.wanted[names] = 0
        at, number, c = at[c > 0], number[c > 0], c[c > 0]
        order = np.argsort(number, kind="stable")
        at, number, c = at[order], number[order], c[order]
        back = np.arange(len(at)) - c
        earlier = np.where((back >= 0) & (number[back] == number), at[back], -1)
        begin = np.maximum(np.maximum(earlier, at - size) + 1, 0)
        inside = (begin <= at) & (begin <= last)
        begin, end = np.sort(begin[inside]), np.sort(at[inside] + 1)
        over = np.arange(1, len(begin) + 1) - np.searchsorted(end, begin, "right")
        # of equal begins the last one has them all; the first such start is told
        top = int(over.argmax())
        return int(over[top]), int(begin[top])


class Items:
    """Benchmark items ready for search in one task."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids, sizes = [], []
        bags: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
        for item_id, text in items:
            hashes = words_of(text)
            if not len(hashes):
                continue
            bag = shingle_hashes(hashes)
            bags[min(len(hashes), SHINGLE_WORDS)][len(self.ids)] = bag
            self.ids.append(item_id)
            sizes.append(len(bag))
        self.sizes = np.array(sizes, np.int64)
        self.known = {width: _Known(of) for width, of in bags.items()}

    def search(self, hashes: np.ndarray, similarity: float = SIMILARITY) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of its best window in the words of a whole text.

        An item is met if the fingerprint of some promising window is within RADIUS of its
        own. Of equally good windows it is the first.
        """
        best: dict[int, tuple[float, int, int]] = {}
        for width, known in self.known.items():
            if len(hashes) < width:
                continue
            own = shingle_hashes(hashes, width)
            at, number = known.found_in(own)
            if not len(at):
                continue
            for of in known.lengths:
                starts = known.promising(of, at, number, len(own), similarity)
                if not len(starts):
                    continue
                n = min(of.size, len(own))
                prints = np.unique(fingerprints(own, starts, n), axis=0)
                met = np.zeros(len(of.items), bool)
                for _, places in of.near(prints):
                    met[places] = True
                for i in of.items[met].tolist():
                    common, start = known.best_window(i, at, number, n, len(own) - n)
                    s = common / (of.size + n - common)
                    if s >= similarity:
                        best[i] = (s, start, n + width - 1)
        return best


def _chunks(benchmark: DataFrame, item_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The items, a bounded number of bytes at a time."""
    chunk, size = [], 0
    for row in benchmark.where("text is not null").toLocalIterator():
        chunk.append((row[0], row[1]))
        size += len(row[1])
        if size >= item_bytes:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id",
    text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """(id, item_id, similarity, start_word, n_words) for every document row and item in it.

    A window as long as an item (in words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) holds it
    if their bags of five-word shingles have a weighted similarity of at least
    ``similarity``; the best window is told. A document shorter than the item is the one
    window, and ``n_words`` are those of the window. Items of fewer than five words are one
    shingle. Null or empty texts hold nothing and are held by nothing; repeated rows are
    told each; ids are passed on as they are; other columns are ignored. Whole texts of
    any length are searched; windows are fingerprinted a bounded number at a time.

    An item is found by fingerprints first; of windows right at 0.75 far less than one in
    a thousand is beyond their radius. The similarities told are exact.

    Documents are read once per ``item_bytes`` of items and not shuffled. Whatever the
    number of items, the tasks hold a bounded part of them at a time.
    """
    kinds = docs.schema[id_column].dataType.simpleString(), benchmark.schema[item_id_column].dataType.simpleString()
    schema = f"`{id_column}` {kinds[0]}, item_id {kinds[1]}, similarity double, start_word bigint, n_words bigint"
    rows = docs.select(docs[id_column].alias("i"), docs[text_column].alias("t"))
    items = benchmark.select(benchmark[item_id_column], benchmark[item_text_column].alias("text"))
    item_type = items.limit(0).toArrow().schema.field(0).type
    spark = docs.sparkSession
    found = spark.createDataFrame([], schema)
    for chunk in _chunks(items, item_bytes):
        sent = spark.sparkContext.broadcast(chunk)

        def search(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            ready = _ready(sent)
            hits = [
                (r, i, s, at, n)
                for r, hashes in enumerate(each_words(batch.column("t")))
                for i, (s, at, n) in sorted(ready.search(hashes, similarity).items())
            ]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("i").take(pa.array([h[0] for h in hits], pa.int64())),
                    pa.array([ready.ids[h[1]] for h in hits], item_type),
                    pa.array([h[2] for h in hits], pa.float64()),
                    pa.array([h[3] for h in hits], pa.int64()),
                    pa.array([h[4] for h in hits], pa.int64()),
                ],
                [id_column, "item_id", "similarity", "start_word", "n_words"],
            )

        found = found.unionByName(by_batch(rows, search, schema, "items"))
    return found


def _ready(sent) -> Items:
    """The items this Python worker was sent last, prepared once."""
    return held("items", sent.value, lambda: Items(sent.value))
