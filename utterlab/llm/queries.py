"""Imports every operator module, which registers its query."""

from __future__ import annotations

from utterlab.llm import (  # noqa: F401
    chat_format,
    decontamination,
    divergence,
    jaccard_join,
    line_dedup,
    packing,
    pii,
    prefix_trie,
    quality,
    simhash,
    substring_dedup,
    toxicity,
    warc,
)
from utterlab.llm.registry import ORACLES, QUERIES  # noqa: F401
