"""From raw documents to packed training sequences: quality, near duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwise.llm.edit_dups import near_duplicate_documents
from plotwise.llm.packing import pack_documents
from plotwise.llm.personal_data import find_personal_data, masked
from plotwise.llm.quality import fit_quality, graded, quoted, score_quality
from plotwise.llm.wordtok import default_tokenizer
from plotwise.scratch import write_table


def _key(text_md5: Column) -> Column:
    """A row's id and text as one string, so that joins need no rule for null ids."""
    return F.concat_ws(":", text_md5, F.col("doc_id").cast("string"))


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in docs.columns]


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _own_key() -> Column:
    return _key(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade (clean) is high enough; rows and columns are otherwise as they were.

    As in all stages: null texts count as empty, rows that repeat an id are separate, column names may hold any sign and further columns go
    through untouched, and an empty table gives an empty table.
    """
    model = fit_quality(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    rows = docs.select("text", F.struct(*_columns(docs)).alias("row"))
    return score_quality(rows, model, ["row"]).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; of rows that repeat id and text, one."""
    key = _free(docs, "key of the row")
    kept = write_table(near_duplicate_documents(docs).where("kept").select(_key(F.col("text_md5")).alias(key)), "kept")
    keyed = docs.withColumn(key, _own_key())
    return keyed.hint("merge").join(kept, key, "left_semi").dropDuplicates([key]).select(*_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the identifiers in their text replaced by [EMAIL], [IP], [CARD], [PHONE] or [FOUND]; n_chars follows the text."""
    key, found = _free(docs, "key of the row"), _free(docs, "spans of the row")
    spans = find_personal_data(docs).where("size(spans_list) > 0").select(_key(F.col("text_md5")).alias(key), F.col("spans_list").alias(found)).dropDuplicates([key])
    keyed = docs.withColumn(key, _own_key()).hint("merge").join(write_table(spans, "found"), key, "left")
    done = keyed.withColumn("text", F.when(F.col(found).isNotNull(), masked(F.col("text"), F.col(found))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(found).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*_columns(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences."""
    return pack_documents(docs, default_tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", packing)]

#: Training, sketches and tokenizers have no SQL form; tests/llm/test_pipeline.py holds near duplicates to all pairs, and the other stages to rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
