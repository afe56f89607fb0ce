"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm import decontaminate, jaccard_join, language_id, packing
from duskwatch.llm.queries import END_ID, WORD_VOCABULARY, table
from duskwatch.llm.tables import stored, where_id_in


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found.

    Those without any letter (null, empty, digits and signs only) go. The language is
    predicted from the text; the columns stay as they are. If no document has a language
    to learn from, nothing can be told and all stay.
    """
    model = language_id.fit(docs.where(~language_id.held_out(docs["doc_id"])).select("doc_id", "text", "lang"))
    if not model.languages:
        return docs
    rows = docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    told = language_id.identify(rows, model)
    return told.where(F.col("lang_pred") != language_id.UNKNOWN).select("row.*")


def _text_key(docs: DataFrame) -> Column:
    """128 bits that stand for a text; a null text counts as empty."""
    text = F.coalesce(docs["text"], F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _row_key(docs: DataFrame) -> Column:
    """Id and text of a row, ordered by id (null last), so that neither nulls nor repeated ids mix up texts."""
    doc_id = docs["doc_id"]
    some = F.lit(0).cast(docs.schema["doc_id"].dataType)
    return F.struct(
        doc_id.isNull().alias("without"), F.coalesce(doc_id, some).alias("id"), _text_key(docs).alias("text")
    )


def _keyed(docs: DataFrame, key: Column) -> DataFrame:
    """(key, row): the whole row apart, whatever its columns are called."""
    return docs.select(key.alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, those without an id last.

    Rows are told apart by id and text: a row with a null id goes if its text is in a
    group of which another stays; rows that repeat an id with unlike texts are judged each
    by its own; of several rows with the same id and text one stays, unless the text has no
    word (then it is like nothing and all stay).
    """
    key = _row_key(docs)
    groups = stored(jaccard_join.near_duplicates(docs.select(key.alias("doc_id"), "text")))
    leave = stored(groups.where("component_id <> doc_id").select("doc_id").distinct())
    kept = where_id_in(_keyed(docs, key), "key", leave, keep=False)
    repeated = stored(
        groups.where("component_id = doc_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    )
    if not repeated.isEmpty():
        once = where_id_in(kept, "key", repeated).groupBy("key").agg(F.first("row").alias("row"))
        kept = where_id_in(kept, "key", repeated, keep=False).unionByName(once)
    return kept.select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A row goes or stays by its text alone, whether its id is null, repeated or neither;
    null and empty texts hold nothing.
    """
    key = _text_key(docs)
    found = decontaminate.find_contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return where_id_in(_keyed(docs, key), "key", stored(found.select("doc_id").distinct()), keep=False).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens from all documents that are left."""
    return packing.pack_documents(docs, WORD_VOCABULARY, END_ID)


STAGES = [
    ("language_id", keep_known_language),
    ("jaccard_join", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# Predictions and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
