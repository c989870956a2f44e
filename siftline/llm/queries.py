"""All queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from siftline.llm import audit, bpe, collocations, decontaminate, fingerprints, lines, mixing, quality, repeats, sharding, simhash, tokencount, toxicity

MODULES = [sharding, tokencount, quality, simhash, repeats, lines, fingerprints, decontaminate, toxicity, bpe, collocations, mixing, audit]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
