"""All registered queries of the library's own operators."""

from __future__ import annotations

from weft.plans import artifacts, coherences, evidence, fanin, joins, landings, manuscripts, numbers, operations, outcomes, packs, papers, prose, revisions, streams, studies, supplies, surfaces, synthesis, verdicts

MODULES = (evidence, landings, studies, synthesis, joins, manuscripts, surfaces, numbers, operations, supplies, verdicts, streams, outcomes, prose, artifacts, fanin, revisions, packs, papers, coherences)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
