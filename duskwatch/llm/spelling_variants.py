"""Spelling variants: words one edit apart, found by pairs of trie nodes.

All words stand in two tries, one of their letters forward and one backward. A word cut
at place i is the pair (node of its first i letters, node of the rest read backward); with
the letter at i skipped it is (node of the first i, node of what follows that letter). Two
words differ by one replaced letter if they share a skipping pair, and by one inserted
letter if a skipping pair of the longer is a cut of the shorter. So neighbours are found by
joining pairs of integers; a pair is shared by one word for each letter at most, and by one
cut word, so the members of a pair are few whatever the number of words.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import slabs, stored

# Letters (in Latin-1, where a letter is a byte). Fixed by what a word is.
_LETTERS = rb"[a-z\xc0-\xff]"

# Different words a task counts before it hands them on.
_MOST_COUNTED = 200_000

# First letters whose trie nodes are numbered by the letters themselves, 21 bits each.
_PLAIN = 3


def count_words(
    docs: DataFrame, least_length: int = 6, dropping: int | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(word, n): all words of ``least_length`` letters and how often they occur.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. With
    ``dropping``, a run whose CRC-32 of ``<id>:<run>`` it divides first loses the letter
    at that number modulo its length. A null text has no words, a null id counts as
    empty text, equal rows count as often as they come, other columns are ignored.

    Tasks count before the shuffle, in a table of bounded size.
    """
    # No shorter run can give a word: letters are only taken away.
    runs = re.compile(_LETTERS + b"{%d,}" % least_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[bytes] = Counter()

        def out():
            words = [w.decode("latin-1") for w in counted]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counted.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column("i").to_pylist()
            for start, texts in slabs(batch.column("t")):
                for i, text in enumerate(texts, start):
                    # Anything beyond Latin-1 becomes "?", which ends a run as it should.
                    found = Counter(runs.findall(text.as_py().encode("latin-1", "replace").lower()))
                    if dropping is None:
                        counted.update(found)
                    else:
                        head = zlib.crc32(f"{ids[i]}:".encode())
                        for word, n in found.items():
                            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), head)
                            if h % dropping == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_length:
                                    continue
                            counted[word] += n
                    if len(counted) > _MOST_COUNTED:
                        yield out()
                        counted.clear()
        if counted:
            yield out()

    rows = docs.select(F.coalesce(docs[id_column].cast("string"), F.lit("")).alias("i"), docs[text_column].alias("t"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _trie_nodes(words: DataFrame) -> DataFrame:
    """(id, back, depth, first, digest, number) of every node on the way of every word but the roots.

    ``digest`` stands for the letters that lead to the node, or ``number`` if they are
    few; ``first`` says that the last of them does not repeat the one before it.
    """
    schema = pa.schema(
        [("id", pa.int64()), ("back", pa.bool_()), ("depth", pa.int32()), ("first", pa.bool_()), ("digest", pa.binary()), ("number", pa.int64())]
    )

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for i, word in zip(batch.column("id").to_pylist(), batch.column("word")):
                word = word.as_py()
                for back in (False, True):
                    way, last, number = hashlib.blake2b(digest_size=16), "", 0
                    for depth, c in enumerate(reversed(word) if back else word, 1):
                        way.update(c.encode("utf-32-le"))
                        number = number << 21 | ord(c) if depth <= _PLAIN else None
                        rows.append((i, back, depth, c != last, way.digest() if number is None else None, number))
                        last = c
                        if len(rows) >= 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return words.select("id", "word").mapInArrow(
        nodes, "id bigint, back boolean, depth int, first boolean, digest binary, number bigint"
    )


def _numbered_ways(words: DataFrame) -> DataFrame:
    """(id, ahead, behind, firsts): the numbers of a word's nodes in both tries, from the roots on.

    A node deeper than three letters has the least id of the words that pass it for its
    number, which names it among the nodes of its depth. ``firsts`` holds the places
    whose letter does not repeat the one before.
    """
    nodes = stored(_trie_nodes(words))
    deep = nodes.where("number is null")
    book = deep.groupBy("back", "depth", "digest").agg(F.min("id").alias("number"))
    named = deep.drop("number").join(book, ["back", "depth", "digest"]).select("id", "back", "depth", "first", "number")
    # Only the empty word has no node but the roots.
    root = words.where("word = ''").select("id", *[F.lit(None).cast(named.schema[c].dataType).alias(c) for c in named.columns[1:]])
    ways = named.unionByName(nodes.where("number is not null").drop("digest")).unionByName(root).groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("depth").isNotNull(), F.struct("back", "depth", "first", "number")))).alias("ns")
    )

    def one(back: bool) -> Column:
        return F.filter("ns", lambda n: n["back"] == F.lit(back))

    def numbers(back: bool) -> Column:
        return F.concat(F.array(F.lit(0).cast("long")), F.transform(one(back), lambda n: n["number"]))

    return ways.select(
        "id", numbers(False).alias("ahead"), numbers(True).alias("behind"),
        F.transform(one(False), lambda n: n["first"]).alias("firsts"),
    )


def _members(ways: DataFrame) -> DataFrame:
    """(id, m, i, j, a, b, skips, first): every cut and every skipping pair of every word.

    (i, a) is the node of the first i letters, (j, b) that of the last j.
    """
    size = F.size("firsts")

    def pair(i: Column, j: Column, skips: bool, first: Column) -> Column:
        return F.struct(
            i.alias("i"), j.alias("j"), F.get("ahead", i).alias("a"), F.get("behind", j).alias("b"),
            F.lit(skips).alias("skips"), first.alias("first"),
        )

    cuts = F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, size - i, False, F.lit(True)))
    skips = F.transform("firsts", lambda f, i: pair(i, size - i - 1, True, f))
    return ways.select("id", "m", F.inline(F.concat(cuts, skips)))


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): for every word with a neighbour, how many and the id of the first.

    ``words`` (id, word, n) has every word once, ids in code-point order. The first
    neighbour is that of largest n, then smallest word.
    """
    members = _members(_numbered_ways(words).join(words.select("id", (-F.col("n")).alias("m")), "id"))
    # One word for each letter that may be skipped, and one cut word: never more.
    groups = members.groupBy("i", "j", "a", "b").agg(
        F.array_sort(F.collect_list(F.struct("skips", "m", "id", "first"))).alias("g")
    ).where(F.size("g") > 1)
    skipping = F.filter("g", lambda x: x["skips"])
    parted = groups.select(
        skipping.alias("s"),
        F.filter("g", lambda x: ~x["skips"]).alias("c"),
        F.filter(skipping, lambda x: x["first"]).alias("longer"),
    )

    def told(x: Column, n: Column, best: Column) -> Column:
        return F.struct(x["id"].alias("id"), n.cast("long").alias("n"), best.alias("best"))

    def of(x: Column) -> Column:
        return F.struct(x["m"].alias("m"), x["id"].alias("id"))

    # A replaced letter: all other skipping words of the pair.
    replaced = F.transform(
        "s", lambda x, k: told(x, F.size("s") - 1, F.when(k == 0, of(F.get("s", F.lit(1)))).otherwise(of(F.get("s", F.lit(0)))))
    )
    # An inserted letter: the cut word and the longer ones. In a run of equal letters any
    # may be the inserted one; the first stands for all.
    shorter = F.transform("longer", lambda x: told(x, F.size("c"), of(F.get("c", F.lit(0)))))
    longer = F.transform("c", lambda x: told(x, F.size("longer"), of(F.get("longer", F.lit(0)))))
    links = parted.select(F.inline(F.concat(replaced, shorter, longer))).where("n > 0")
    return links.groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best")).select(
        "id", "n_near", F.col("best.id").alias("best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) for every row (id, form): the end of the way along the forms.

    A form occurs several times as often as its word, so ways end and are short: each
    round doubles the steps, and their number grows with the logarithm of the longest.
    """
    ways = stored(forms.toDF("id", "root"))
    while True:
        on = ways.select(F.col("id").alias("root"), F.col("root").alias("next"))
        ways = stored(ways.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ways.where("moved").isEmpty():
            return ways.select("id", "root")
        ways = ways.drop("moved")


def group_spellings(counts: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row (word, n) of ``counts``.

    Two words are near if they differ by exactly one inserted, deleted or replaced code
    point. ``form`` is the near word of largest n, then smallest in code-point order, if
    its n is at least ``times`` (over 1) the word's; else null. ``root`` follows the forms
    to the last. Words are distinct; rows with a null word or count are ignored; an empty
    table gives an empty table. Words of any length are taken whole: the work of a word
    grows with its length.
    """
    ordered = counts.where("word is not null and n is not null").select("word", "n").orderBy("word")
    # Numbers rise with the sorted words.
    words = stored(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    near = stored(near_words(words))
    other = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    told = stored(
        words.join(near, "id", "left").join(other, "best", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            *[F.when(F.col("form_n") >= F.col("n") * times, F.col(c)).alias(c) for c in ("best", "form", "form_n")],
        )
    )
    roots = _roots(told.where("best is not null").select("id", "best"))
    last = words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    named = told.join(roots.withColumnRenamed("root", "root_id"), "id", "left").join(last, "root_id", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
