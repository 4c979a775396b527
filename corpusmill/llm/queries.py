"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.chat import OP5_SQL, op5_chat
from corpusmill.llm.decontam import OP1_SQL, op1_decontamination
from corpusmill.llm.html_extract import op10_html
from corpusmill.llm.jaccard_join import OP4_SQL, op4_jaccard_join
from corpusmill.llm.mixing import OP6_SQL, op6_mixing
from corpusmill.llm.perplexity import OP2_SQL, op2_quality_classifier
from corpusmill.llm.pii_crf import op8_pii
from corpusmill.llm.quality_rules import op7_quality_rules
from corpusmill.llm.sharding import OP3_SQL, op3_sharding
from corpusmill.llm.warc import OP9_SQL, op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sharding": op3_sharding,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_chat": op5_chat,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_html": op10_html,
}

SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op2_quality_classifier": OP2_SQL, "op3_sharding": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op5_chat": OP5_SQL, "op6_mixing": OP6_SQL, "op9_warc": OP9_SQL}
