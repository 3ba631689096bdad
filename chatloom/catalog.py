"""Names of queries, and their SQL."""

from .plans import lookups, search, service, texts, upkeep

QUERIES: dict = lookups.QUERIES | texts.QUERIES | service.QUERIES | search.QUERIES | upkeep.QUERIES
ORACLE_SQL: dict[str, str] = lookups.SQL | texts.SQL | service.SQL | search.SQL | upkeep.SQL
