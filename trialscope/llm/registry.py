"""Registered queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from trialscope.llm import bpe, chat, exact, html, jaccard, lines, merkle, packing, phrases, pii, quality, sql, suffixes, toxicity


ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers must find this package, also where it is run from a checkout in another folder
    known = spark.sparkContext.environment
    known["PYTHONPATH"] = ":".join(dict.fromkeys([ROOT, *filter(None, known.get("PYTHONPATH", "").split(":"))]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": lambda s, d: html.extract(table(s, d, "pages")),
        "op2_byte_bpe": lambda s, d: bpe.round_trip(table(s, d, "documents")),
        "op3_exact_dedup": lambda s, d: exact.exact_groups(table(s, d, "documents")),
        "op4_line_dedup": lambda s, d: lines.line_report(table(s, d, "documents")),
        "op5_quality_rules": lambda s, d: quality.quality(table(s, d, "documents")),
        "op6_ngram_jaccard": lambda s, d: jaccard.similar_components(table(s, d, "documents")),
        "op7_suffix_dedup": lambda s, d: suffixes.report(table(s, d, "documents")),
        "op8_packing": lambda s, d: packing.pack(table(s, d, "documents")),
        "op10_toxicity": lambda s, d: toxicity.toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "pipeline": corpus_pipeline.run,
        "op11_chat_formatting": lambda s, d: chat.digests(table(s, d, "conversations")),
        "op12_phrase_collocations": lambda s, d: phrases.collocations(table(s, d, "documents")),
        "op13_merkle_manifest": lambda s, d: merkle.verified(table(s, d, "documents")),
        "op9_pii": lambda s, d: pii.report(table(s, d, "documents"), pii.key_of(s)),
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
