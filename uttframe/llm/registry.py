"""The queries of the corpus operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chosen_path, contamination, licenses, log_templates, merkle, mixing, passages, quality, secrets, sharding, token_counts, token_links, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_warc": _over("pages", warc.query),
    "op2_secrets": _over("documents", secrets.query),
    "op3_sharding": _over("documents", sharding.query),
    "op4_chosen_path": _over("documents", chosen_path.query),
    "op5_passages": _over("documents", passages.query),
    "op6_licenses": _over("documents", licenses.query),
    "op7_contamination": lambda spark, sf_dir: contamination.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op8_log_templates": _over("documents", log_templates.query),
    "op9_mixing": _over("documents", mixing.query),
    "op10_quality": _over("documents", quality.query),
    "op11_array_merging": _over("documents", token_counts.query),
    "op12_incidence": _over("documents", token_links.query),
    "op13_witnesses": _over("documents", merkle.query),
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE, "op2_secrets": secrets.ORACLE, "op6_licenses": licenses.ORACLE, "op8_log_templates": log_templates.ORACLE, "op10_quality": quality.ORACLE,
    "op13_witnesses": merkle.ORACLE,
}
