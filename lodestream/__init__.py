"""Lodestream: retrieval, agent-memory and corpus analytics as Spark plans."""
