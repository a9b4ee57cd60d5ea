"""Imports every operator of this package, so that its query is registered."""

from lineweave.llm import (  # noqa: F401
    embedding_dedup,
    html_text,
    lang_id,
    license_scan,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    pii,
    spelling,
    toxicity,
    winnowing,
)
from lineweave.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
