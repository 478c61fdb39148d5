"""Named queries over the driver tables and the SQL that DuckDB runs for each."""

from __future__ import annotations

from periodica.plans import changes, exports, files, letters, lists, records, rosters, sheets, streams, texts, threads, tools  # noqa: F401  they register their queries
from periodica.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
