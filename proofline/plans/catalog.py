"""All queries of the core library: name -> callable(spark, sf_dir), and the DuckDB SQL beside."""

from __future__ import annotations

from . import audit, evaluation, ingest, office, reads, runs

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (ingest, office, audit, reads, evaluation, runs):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
