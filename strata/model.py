"""Schemas of the tables that the tiers share."""

from __future__ import annotations

TIERS = ("structured", "semantic", "relational", "hierarchical", "memory")

DOCS = "doc_id string, text string, meta map<string,string>"
CHUNKS = "chunk_id string, doc_id string, position int, text string, context string, meta map<string,string>, ord long, vector array<double>"
QUERIES = "query_id string, text string, top_k int"
EVIDENCE = "query_id string, tier string, source_id string, text string, score double, meta map<string,string>"
ENTITIES = "key string, name string, type string, ord long"
EDGES = "src string, dst string, relation string, chunk_id string, ord long"
