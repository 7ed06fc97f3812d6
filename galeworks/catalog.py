"""All registered queries of the library and their SQL."""

from __future__ import annotations

from galeworks.plans import cases, chain, climate, events, files, grid, models, more, skill, space  # noqa: F401  each registers its queries
from galeworks.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
