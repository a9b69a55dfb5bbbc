"""The registered queries over the driver's tables and, where SQL can say the same, their SQL."""

from pumpwise.queries import countries, lookups, prices, published, scalars, sources

MODULES = (prices, lookups, scalars, sources, countries, published)
QUERIES = {k: v for m in MODULES for k, v in m.REGISTRY.queries.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.REGISTRY.sql.items()}
