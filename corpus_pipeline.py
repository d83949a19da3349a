"""The training-data pipeline over ``documents``: quality, language, near-duplicates, benchmark passages, piece ids.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns the columns of documents, the last one the encoded corpus.
Rows with null texts, ids or languages are treated as the operators say; a null or empty text has no letter and goes at the
language stage; rows repeated with one id share that id's fate, and each row without an id is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from demur.llm import decontam, language, neardup, pieces, quality
from demur.llm.common import keyed, table, without
from demur.sources.staging import stage

#: Model file of the last stage; None takes the public 32,000-piece one.
PIECES_MODEL: str | None = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality reaches the threshold."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    scored = quality.score(docs, model, tuple(columns))
    return scored.toDF(*columns, "quality score").where(F.col("quality score") >= quality.KEEP_FROM).select(*columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin."""
    columns = docs.columns
    found = language.identify(docs, language.learn_dictionaries(docs), tuple(columns))
    return found.toDF(*columns, "told language", "language score", "language rejected").where(~F.col("language rejected")).select(*columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group of near-duplicates: five-word shingles, similarity 0.8 or more; of a group without ids, one row."""
    rows = keyed(docs, "row_key")
    groups = neardup.near_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text"))
    copies = stage(groups.where(~F.col("kept")).select(F.col("doc_id").alias("row_key")).distinct(), "copies")
    return without(rows, copies, "row_key").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    rows = keyed(docs, "row_key")
    found = decontam.contaminated(rows.select(F.col("row_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = stage(found.where("contaminated").select(F.col("doc_id").alias("row_key")).distinct(), "contaminated")
    return without(rows, hit, "row_key").select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and the piece ids of every document."""
    path = PIECES_MODEL
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(docs, path, ("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("pieces", pieces_stage)]
#: Learned models and lattices are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage keeps is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
