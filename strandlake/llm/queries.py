"""The registered queries of this subpackage, and DuckDB SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_text, langid, lm, packing, pii, quotes, rules, simhash, spelling, substrings, vectors, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_pii": lambda s, d: pii.digest(table(s, d, "documents")),
        "op2_quotations": lambda s, d: quotes.conversations(table(s, d, "conversations")),
        "op3_language": lambda s, d: langid.digest(table(s, d, "documents")),
        "op4_simhash": lambda s, d: simhash.digest(table(s, d, "documents")),
        "op5_packing": lambda s, d: packing.pack(table(s, d, "documents")),
        "op6_substrings": lambda s, d: substrings.digest(table(s, d, "documents")),
        "op7_decontamination": lambda s, d: decontam.digest(table(s, d, "documents"), table(s, d, "benchmark")),
        "op8_quality": lambda s, d: rules.digest(table(s, d, "documents"), table(s, d, "labels")),
        "op9_html": lambda s, d: html_text.extract(table(s, d, "pages").select("page_id", "url", "html"), growth=None),
        "op10_lm": lambda s, d: lm.digest(table(s, d, "documents")),
        "op11_spelling": lambda s, d: spelling.variants(table(s, d, "documents")),
        "op12_vectors": lambda s, d: vectors.near_duplicates(table(s, d, "embeddings")),
        "op13_whitening": lambda s, d: whitening.whitened(table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": decontam.SQL, "op8_quality": rules.SQL}
