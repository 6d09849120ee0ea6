"""Relational and graph operators over node, edge and event tables."""
