"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from foldlake.llm import decontaminate, fingerprints, language, ngram_join, packing, quality, secrets, sharding, sstable, toxicity

MODULES = (decontaminate, fingerprints, language, ngram_join, packing, quality, secrets, sharding, sstable, toxicity)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
