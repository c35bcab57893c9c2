"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from quillstream.llm import q_cutoffs, q_languages, q_leaks, q_packing, q_splitting, q_unify

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (q_cutoffs, q_languages, q_leaks, q_packing, q_splitting, q_unify):
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
