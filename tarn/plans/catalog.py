"""All registered queries of the engine: name -> callable(spark, sf_dir), and their SQL twins."""

from __future__ import annotations

from tarn.plans import document_queries, graph_queries, listing_queries, recall_queries, run_queries, store_queries

MODULES = (recall_queries, store_queries, graph_queries, document_queries, listing_queries, run_queries)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: s for m in MODULES for name, s in m.ORACLES.items()}
