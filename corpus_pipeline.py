"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing and sharding, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder as Parquet and
reads again as the next stage's documents. All stages but the last return the columns of the documents they got.

Results in odd cases are those of the operators, row by row. Null, empty and wordless texts pass all stages but the draw of mixing.
Of rows that repeat in id and text one stays after near_dedup, of rows that agree in id alone each is judged by itself; null ids are
ids like others. Ties (copies) go to the smallest id. Very long texts are taken whole. Without labels no document is toxic, without
benchmark items none is contaminated; an empty table of documents gives an empty result. Further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm import decontam, mixing, neardup, sharding, toxicity
from larkspan.llm.common import cut, table

#: Near copies in the pipeline: word shingles of this width, and their least Jaccard similarity. Operator 10's own query differs.
SHINGLE_WIDTH = 5
SIMILARITY = (80, 100)


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier chain learns from labelled documents of the stage's own input."""
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), keep=True)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, SIMILARITY, SHINGLE_WIDTH)


def contaminated_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shards_query(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("near_dedup", one_of_near_copies),
    ("decontamination", contaminated_documents_go),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Classifier training and MinHash can't be put into SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
