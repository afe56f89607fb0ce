"""Language identification: known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import by_batch, held, slabs, stored

UNKNOWN = "und"
# Labelled rows the model is fitted on, about; a hash of the id picks them.
TRAIN_ROWS = 20_000
# Words and n-grams of the model: the most frequent ones seen at least so often.
MAX_WORDS, MAX_GRAMS, LEAST_SEEN = 200_000, 200_000, 3
# Labelled rows, words and n-grams of every language that are kept however rare it is.
LEAST_ROWS, LEAST_KEYS = 200, 5_000
LONGEST_GRAM = 4
SMOOTHING = 0.1
# The score of a text is as sure as this many of its words would make it at most.
SURE_WORDS = 10
# Words a Python worker remembers.
REMEMBERED = 500_000


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies by language, one row of ``logs`` for each known word or n-gram."""

    languages: tuple[str, ...]
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray

    def word_scores(self, word: str) -> np.ndarray:
        """Log frequency of the word in each language; of its n-grams if it is unknown.

        n-grams of the longest length of which the word has a known one are averaged; a
        word without any says nothing (zeros).
        """
        row = self.words.get(word)
        if row is not None:
            return self.logs[row]
        framed = f" {word} "
        for n in range(min(LONGEST_GRAM, len(framed)), 0, -1):
            cut = (framed[i : i + n] for i in range(len(framed) - n + 1))
            rows = [row for row in map(self.grams.get, cut) if row is not None]
            if rows:
                return self.logs[rows].mean(axis=0)
        return np.zeros(len(self.languages), self.logs.dtype)


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letters(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(where each text begins, distinct words, words in order as numbers): runs of letters."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"\P{L}+")
    coded = lists.flatten().dictionary_encode()
    begins = lists.offsets.to_numpy()
    return begins - begins[0], coded.dictionary.to_pylist(), coded.indices.to_numpy()


def count_words(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) of a table (text, lang); summed within batches before the shuffle."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        langs = batch.column("lang").to_pylist()
        for first, texts in slabs(batch.column("text")):
            begins, words, codes = _letters(texts)
            for r in range(len(texts)):
                own, n = np.unique(codes[begins[r] : begins[r + 1]], return_counts=True)
                for c, k in zip(own.tolist(), n.tolist()):
                    seen[langs[first + r], words[c]] += k
        keys = [k for k in seen if k[1]]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([seen[k] for k in keys], pa.int64())],
            ["lang", "word", "n"],
        )

    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    return by_batch(rows, count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, key: str, most: int, languages: tuple[str, ...]) -> tuple[list[str], np.ndarray]:
    """The most frequent keys, ``most`` or so, and their smoothed log frequencies.

    Beyond the ``most`` of all languages together each language has its own ``LEAST_KEYS``.
    """
    own = [F.sum(F.when(F.col("lang") == lang, F.col("n"))).alias(f"n{i}") for i, lang in enumerate(languages)]
    by_key = counts.groupBy(key).agg(F.sum("n").alias("total"), *own)
    seen = stored(by_key.where(F.col("total") >= LEAST_SEEN))
    top = seen.orderBy(F.desc("total"), key).limit(most)
    for i in range(len(languages)):
        top = top.unionByName(seen.where(F.col(f"n{i}") > 0).orderBy(F.desc(f"n{i}"), key).limit(LEAST_KEYS))
    top = top.toPandas().drop_duplicates(key).sort_values(["total", key], ascending=[False, True])
    table = top[[f"n{i}" for i in range(len(languages))]].fillna(0).to_numpy(np.float64) + SMOOTHING
    return top[key].tolist(), np.log(table / table.sum(axis=0)).astype(np.float32)


def fit(labelled: DataFrame, id_column: str = "doc_id", train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model from about ``train_rows`` rows (all, if there are fewer) of (id, text, lang).

    Rows with a null text or language teach nothing. Counting is a Spark aggregate; the
    driver gets at most ``MAX_WORDS`` words and ``MAX_GRAMS`` n-grams of each length, and
    ``LEAST_KEYS`` more for each language. A language has about ``LEAST_ROWS`` rows at
    least, or all it has. Rows are drawn by id and text, so one hot id is no whole.
    """
    rows = labelled.where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    overall = min(1.0, train_rows / max(1, sum(sizes.values())))
    steps = 1 << 30
    drawn = F.pmod(F.xxhash64(id_column, "text"), F.lit(steps))
    below = F.lit(int(overall * steps))
    for lang, n in sizes.items():
        if LEAST_ROWS > overall * n:
            below = F.when(F.col("lang") == lang, F.lit(int(min(1.0, LEAST_ROWS / n) * steps))).otherwise(below)
    picked = rows.where(drawn < below)
    counts = stored(count_words(picked))
    languages = tuple(sorted(r[0] for r in counts.select("lang").distinct().collect()))
    framed = F.concat(F.lit(" "), "word", F.lit(" "))
    names, logs = _frequent(counts, "word", MAX_WORDS, languages)
    words = {w: i for i, w in enumerate(names)}
    grams: dict[str, int] = {}
    tables = [logs]
    for n in range(1, LONGEST_GRAM + 1):
        places = F.transform(F.sequence(F.lit(1), F.length(framed) - n + 1), lambda i: F.substring(framed, i, F.lit(n)))
        cut = counts.where(F.length(framed) >= n).select("lang", F.explode(places).alias("gram"))
        found = cut.groupBy("lang", "gram").agg(F.count("*").alias("n"))
        names, logs = _frequent(found, "gram", MAX_GRAMS, languages)
        first = sum(map(len, tables))
        grams.update({g: first + i for i, g in enumerate(names)})
        tables.append(logs)
    return LanguageModel(languages, words, grams, np.concatenate(tables))


class _Memory(dict):
    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> np.ndarray:
        found = self.model.word_scores(word) if word else np.zeros(len(self.model.languages))
        if word not in self.model.words:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def score_texts(texts: pa.Array, memory: _Memory) -> tuple[list[str], np.ndarray]:
    """(language, score) of each whole text."""
    languages = memory.model.languages
    begins, words, codes = _letters(texts)
    each = np.array([memory[w] for w in words], np.float64).reshape(len(words), len(languages))
    told = np.array([bool(w) for w in words], float)
    upto = np.concatenate((np.zeros((1, len(languages))), np.cumsum(each[codes], axis=0)))
    n_upto = np.concatenate(([0.0], np.cumsum(told[codes])))
    sums, n = upto[begins[1:]] - upto[begins[:-1]], n_upto[begins[1:]] - n_upto[begins[:-1]]
    mean = sums / np.maximum(n, 1)[:, None] * np.minimum(n, SURE_WORDS)[:, None]
    weight = np.exp(mean - mean.max(axis=1, keepdims=True))
    best = mean.argmax(axis=1)
    score = weight[np.arange(len(best)), best] / weight.sum(axis=1)
    return [languages[b] if k else UNKNOWN for b, k in zip(best, n)], np.where(n > 0, score, 0.0)


def identify(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score`` (0 to 1), from the text alone.

    ``und`` with score 0 if the text is null, empty or has no letter, or if the model
    knows no language. Ties go to the first language by name. Columns of these names
    are replaced; repeated rows stay; an empty table gives an empty table; no shuffle.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by MAX_WORDS, MAX_GRAMS
    place = docs.columns.index(text_column)

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = [], []
        if not sent.value.languages:
            langs, scores = [UNKNOWN] * batch.num_rows, [np.zeros(batch.num_rows)]
        else:
            memory = held("language", sent.value, lambda: _Memory(sent.value))
            for _, texts in slabs(batch.column(place)):
                lang, score = score_texts(texts, memory)
                langs += lang
                scores.append(score)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores))],
            [*batch.schema.names, "lang_pred", "score"],
        )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return by_batch(docs, predict, f"{fields}, lang_pred string, score double", "language")
