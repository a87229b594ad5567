"""From raw documents to packed training windows: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet and read again. All
stages but the last return the columns of documents, with the rows (and, after the first, the texts) that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import jaccard, packing, quality, toxicity
from plumbline.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many documents of their host share.

    Null and empty texts have too few words and go; a long text is taken whole. Rows that repeat a doc_id stay together if one of them passes, and null
    ids count as one id. Rows without a host count as one host's. Other columns pass through, whatever their names; an empty table stays empty.
    """
    return quality.filtered(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is learnt from the labelled ones among them.

    Each row is judged by its own text, so repeated rows go or stay together; null and empty texts have the score of the bias, a long text counts each
    gram once, a score equal to the threshold goes. Labels other than 0 and 1, null ids of labels, and labels of documents that aren't there are not used. Without any
    usable label nothing is known of a text and none scores below the threshold. Other columns pass through; an empty table stays empty.
    """
    return toxicity.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more: the one with the smallest doc_id.

    Texts of fewer than five words have their whole sequence as one shingle; null texts and texts without words are linked with nothing and stay. Long texts are
    taken whole. Other columns pass through, whatever their names; an empty table stays empty.
    """
    return jaccard.deduplicated(docs, width=5, num=80, den=100)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in windows of at most 2048 ids.

    A null or empty text is the one closing id; a long one is cut into pieces of at most a window. Rows that repeat are packed each for itself, so their
    pieces repeat too. Columns other than doc_id and text are not read; an empty table gives no rows.
    """
    return packing.packed(docs)


STAGES = [("quality", quality_rules), ("toxicity", toxic_documents), ("near_duplicates", near_duplicates), ("packing", packed_windows)]

#: SQL has no tokenizer and no FTRL; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
