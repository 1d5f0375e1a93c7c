"""Every operator as a registered query over the given tables, with SQL to check it by.

``QUERIES`` maps a name to a callable (spark, folder) -> DataFrame, ``ORACLES`` the same name
to SQL over views of the tables.
"""

from inkgate.catalog import (
    answer_queries,
    duplicate_queries,
    event_queries,
    gate_queries,
    lookup_queries,
    run_queries,
    text_queries,
    tracking_queries,
)

_GROUPS = (
    gate_queries,
    lookup_queries,
    text_queries,
    answer_queries,
    duplicate_queries,
    tracking_queries,
    event_queries,
    run_queries,
)

QUERIES = {name: query for group in _GROUPS for name, query in group.QUERIES.items()}
ORACLES = {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
