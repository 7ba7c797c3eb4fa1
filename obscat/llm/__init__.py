"""Operators of a training-data pipeline; importing the package registers their queries."""

from obscat.llm.registry import ORACLES, QUERIES  # isort: skip
from obscat.llm import (  # noqa: F401
    bpe,
    decontam,
    dedup,
    langid,
    licenses,
    pii,
    quality,
    secrets,
    topk,
    toxicity,
    trie,
    warc,
    whitening,
)

__all__ = ["ORACLES", "QUERIES"]
