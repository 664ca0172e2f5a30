"""Registered queries. Importing the package fills the registry."""

from tessera.plans import dossier_queries, history_queries, inspection_queries, knowledge_queries, operations_queries, rank_queries, relation_queries, resolution_queries, scope_queries, search_queries, source_queries, source_scan_queries, summary_queries, view_queries  # noqa: F401
