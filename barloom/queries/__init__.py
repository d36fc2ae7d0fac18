"""Registered queries and, where SQL can express them, the same as DuckDB SQL."""

from barloom.queries import bars, ingest, relational, research, training

MODULES = [training, bars, relational, research, ingest]
