"""The training-data pipeline: documents through the quality classifier, near-duplicate removal, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
one's documents.  All but the last give the columns of ``documents``; the last adds the shard.

All stages go by ``doc_id``, ``text``, ``lang`` and ``source`` and keep every other column as it is, whatever its name; only a column named ``shard``
is replaced by the last.  Texts are read whole, however long.  An empty table stays empty.  Rows with a null ``doc_id`` are kept by the stages
that remove rows, as nothing can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.common import fresh, table, written
from corpusmill.llm.decontam import decontaminate, sql_leaks
from corpusmill.llm.jaccard_join import one_of_each, sql_classes
from corpusmill.llm.mixing import mix, sql_mix
from corpusmill.llm.perplexity import keep_good, sql_judge
from corpusmill.llm.sharding import SHARDS, assign_shards, sql_jump


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject.

    Null texts and those of under five bytes stay, as nothing speaks against them; null languages are judged by all trusted documents.  Of repeated
    rows with one id all go if one is rejected.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links: the one with the lowest id, so there are no ties.

    Null, empty and wordless texts are in no group and stay; repeated rows with one id all stay or go.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark.

    Null and empty texts hold none and stay, as do all documents where the benchmark is empty; repeated rows with one id all stay or go.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate says; no source has a rate under 1, so none is lost.

    Null sources are one source; null and empty texts weigh nothing and come as often as their source's others; rows with one id and source share
    their fate.
    """
    return mix(docs, into=fresh(docs, "copy")).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shards; rows with one id share a shard, null ids the empty text's."""
    return assign_shards(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs


_SAME = "doc_id IS NULL OR doc_id NOT IN"
#: DuckDB SQL for the rows of ``run``.
ORACLE_SQL = f"""WITH RECURSIVE {sql_judge("documents", "judged")},
good AS MATERIALIZED (SELECT * FROM documents WHERE {_SAME} (SELECT doc_id FROM judged WHERE NOT keep AND doc_id IS NOT NULL)),
{sql_classes("good", "near")},
one AS MATERIALIZED (SELECT * FROM good WHERE {_SAME} (SELECT doc_id FROM near WHERE doc_id <> class_id)),
{sql_leaks("one", "leaks")},
clean AS MATERIALIZED (SELECT * FROM one WHERE {_SAME} (SELECT doc_id FROM leaks WHERE doc_id IS NOT NULL)),
{sql_mix("clean", "mixed")},
keyed AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM mixed),
{sql_jump("keyed", SHARDS, "shards")}
SELECT doc_id, text, lang, source, n_chars, shard FROM keyed JOIN shards USING (k)"""
