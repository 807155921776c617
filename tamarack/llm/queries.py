"""The registry of the corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op10_bpe_encoding
from .licenses import op1_license_scans
from .licenses import oracle as license_sql
from .near import op4_ngram_jaccard_join
from .packing import op7_best_fit_packing
from .pii import op9_pii
from .prefix_counts import op5_token_counts
from .quality import op2_quality_rules
from .sketches import op6_document_fingerprints
from .templates import op3_html_extraction
from .warc import ORACLE as WARC_SQL
from .warc import op8_warc_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scans, op2_quality_rules, op3_html_extraction, op4_ngram_jaccard_join, op5_token_counts, op6_document_fingerprints, op7_best_fit_packing, op8_warc_archives, op9_pii, op10_bpe_encoding)
}
ORACLE_SQL: dict[str, str] = {"op1_license_scans": license_sql(), "op8_warc_archives": WARC_SQL}
