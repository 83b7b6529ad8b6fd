"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from rillstone.plans import assembly, corpus, episodes, nested, rollouts

QUERIES: dict = {**corpus.QUERIES, **episodes.QUERIES, **rollouts.QUERIES, **assembly.QUERIES, **nested.QUERIES}
ORACLES: dict[str, str] = {**corpus.ORACLES, **episodes.ORACLES, **rollouts.ORACLES, **assembly.ORACLES, **nested.ORACLES}
