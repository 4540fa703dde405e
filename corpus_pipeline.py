"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet below the folder in spark.checkpoint.dir and reads it as the next
stage's documents.  All stages but the last return the columns of ``documents``, and
keep columns that came in besides them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.llm import language, mixing, packing, repeats, simhash
from itemspark.session import cut_lineage

#: Bytes of the shortest repeated string that goes: less than 50 words have.
REPEATED_BYTES = 240
ANCHOR_BYTES = 32

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Texts whose best language scores less are in none of the learned languages.  Short
#: and mixed documents score from about 0.35, so only noise lies below.
LEAST_SCORE = 0.2

#: Fingerprints, suffix order and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``stage`` with further columns under names of their own, and give these back."""
    further = {c: f"_in{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
    done = stage(docs.withColumnsRenamed(further)).select(*[further.get(c, c) for c in docs.columns])
    return done.withColumnsRenamed({name: c for c, name in further.items()})


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages.

    Rejected are texts that are null or without a letter, and those that no language's
    kernel fits.  The lang column stays as it is.  If there is no label to learn from,
    all texts with a letter stay.
    """
    languages, weights = language.learned(docs)
    if not languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    fits = (F.col("lang_pred") != language.NONE) & (F.col("score") >= LEAST_SCORE)
    return apart(docs, lambda own: language.predict(own, languages, weights).where(fits))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id.

    A null doc_id is the smallest.  Of different texts under that doc_id the one with
    the smallest hash stays; of rows equal in doc_id and text, one.
    """
    known = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("doc_id"), "text")
    groups = simhash.near_groups(known)
    kept = cut_lineage(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
                       .groupBy(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.hash").alias("_hash")).count(), "kept")

    def first_rows(own: DataFrame) -> DataFrame:
        own = own.withColumn("_own", F.xxhash64("text"))
        found = own.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left_semi")
        repeated = kept.where(F.col("count") > 1).limit(1).count() > 0
        return found.dropDuplicates(["doc_id", "_own"]) if repeated else found

    return apart(docs, first_rows)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of REPEATED_BYTES bytes that occurred before: in a
    document of smaller doc_id, or earlier in the same text.  So one copy of a passage
    stays in the corpus, and a document with nothing but its own text is left alone.

    n_chars of a changed document is counted anew.  Documents of which nothing is left
    go; those that were empty before stay.
    """
    def cut(own: DataFrame) -> DataFrame:
        changed = F.size("removed") > 0
        found = repeats.without_repeats(own, REPEATED_BYTES, as_text=True, keep_first=True, gram_bytes=ANCHOR_BYTES).where(~changed | (F.length("kept") > 0))
        return found.withColumns({
            "text": F.when(changed, F.col("kept")).otherwise(F.col("text")),
            "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))})

    return apart(docs, cut)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens meet the target weights of source,
    language and topic."""
    return apart(docs, lambda own: mixing.mixed(own).where("sampled"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens."""
    return packing.pack(packing.token_pieces(docs.select("doc_id", "text"), packing.default_tokenizer()))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_strings),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
