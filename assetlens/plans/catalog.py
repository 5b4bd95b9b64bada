"""Importing this module registers every query."""

from assetlens.plans import q_wash, q_graph, q_security, q_tables, q_history, q_chain, q_evidence, q_decide, q_feeds, q_stream, q_views  # noqa: F401
