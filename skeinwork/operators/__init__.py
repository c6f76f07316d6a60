"""Relational, graph, retrieval, message and text-edit operators."""
