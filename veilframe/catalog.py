"""All registered queries of the privacy engine and their SQL."""

from __future__ import annotations

from .plans import detail_queries, folder_queries, queries
from .plans.carriers import CARRIERS
from .plans.queries_sql import SQL

FLAGSHIP = "anonymize_text"
QUERIES = queries.QUERIES | detail_queries.QUERIES | folder_queries.QUERIES
#: Every SQL starts with the carrier texts it reads, written out as common table expressions; one that adds its own goes on with a comma.
ORACLE_SQL = {name: f"WITH {'RECURSIVE ' if sql.lstrip().startswith(',') else ''}{CARRIERS}\n{sql}" for name, sql in (SQL | detail_queries.SQL | folder_queries.SQL).items()}

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
