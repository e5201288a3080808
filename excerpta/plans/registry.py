"""All registered queries."""

from excerpta.plans import ingest, operations, search, semantic, versions

MODULES = (search, ingest, versions, semantic, operations)
QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
