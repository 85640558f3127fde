"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op01_secrets import secrets_query
from .op02_bpe import bpe_query
from .op03_warc import WARC_SQL, warc_query
from .op04_jaccard import JACCARD_SQL, jaccard_query
from .op05_topk import TOPK_SQL, topk_query
from .op06_licenses import license_query
from .op07_dedup import DEDUP_SQL, dedup_query
from .op08_html import html_query
from .op09_quality import quality_query
from .op10_decontaminate import decontaminate_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets_query,
    "op2_bpe": bpe_query,
    "op3_warc": warc_query,
    "op4_jaccard_join": jaccard_query,
    "op5_topk": topk_query,
    "op6_license_scan": license_query,
    "op7_substring_dedup": dedup_query,
    "op8_html_text": html_query,
    "op9_quality": quality_query,
    "op10_decontaminate": decontaminate_query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": WARC_SQL,
    "op4_jaccard_join": JACCARD_SQL,
    "op5_topk": TOPK_SQL,
    "op7_substring_dedup": DEDUP_SQL,
}
