"""From raw documents to encoded training text, in five stages over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxlake.llm.common import documents, stored
from boxlake.llm.exact import drop_exact_duplicates
from boxlake.llm.mixing import mix
from boxlake.llm.pieces import encoding_digests, model_path
from boxlake.llm.quality_rules import keep_good
from boxlake.llm.similar import drop_similar

#: Segments whose results a worker of the last stage keeps: fewer than where encoding is all it does.
MEMO = 30_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the tokeniser bands reject go; so do null and empty texts. Repeated rows share a verdict."""
    return keep_good(docs.select(*COLUMNS), model_path())


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest doc_id stays; of rows that repeat it, one."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 80 % of their five-word shingles, over any chain of such pairs, that with the least doc_id stays."""
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of a document are rows of their own from here on; a source whose target is below its size loses documents."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text, a row for each row of the mix."""
    return encoding_digests(docs, model_path(), keep_ids=True, memo=MEMO, forget=True)


STAGES = [("quality rules", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("encode", encode)]
#: Rolling hashes, components of similar texts and BPE have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what each keeps is written as Parquet and read again by the next.

    Of documents.parquet only COLUMNS are used, so further columns can't clash with those of the stages. Nulls in any
    column, empty tables and texts of any length are fine; what becomes of them is said at each stage.
    """
    docs = documents(spark, sf_dir)
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, f"stage-{n}-{name.replace(' ', '-')}")
    return docs
