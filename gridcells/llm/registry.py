"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from gridcells.llm import decontam, editcount, exactdedup, langid, licenses, linededup, packing, periodic, quality, repair, secrets, simhash, toxicity

#: Modules with QUERIES and SQL, in the order of the operators. They are imported here
#: and now, so that a missing library shows where the entry module tries this import.
MODULES = (packing, linededup, langid, decontam, secrets, editcount, simhash, licenses, toxicity, quality, repair, periodic, exactdedup)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
