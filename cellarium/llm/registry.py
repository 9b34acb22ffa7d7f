"""The queries of the training-data operators."""

from __future__ import annotations

from . import decontaminate, html_text, langid, ngram_join, ordinal, packing, quality_rules, secrets, sharding, toxicity

_MODULES = (decontaminate, html_text, langid, ngram_join, ordinal, packing, quality_rules, secrets, sharding, toxicity)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
