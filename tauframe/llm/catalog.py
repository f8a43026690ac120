"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tauframe.llm import (
    chat, decontamination, fill_middle, fingerprints, licenses, mixing, near_dedup, pieces, pii, quality_rules, ranked_search,
    substring_dedup, warc,
)

MODULES = (quality_rules, fingerprints, mixing, chat, pii, pieces, warc, near_dedup, substring_dedup, licenses,
           ranked_search, decontamination, fill_middle)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in vars(m).items()
            if name.startswith("op") and name[2:3].isdigit()}


def sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in getattr(m, "SQL", {}).items()}
