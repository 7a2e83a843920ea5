"""Every registered query of the engine with its oracle SQL."""

from __future__ import annotations

from . import analytics, files, texts


def queries() -> dict:
    return {**texts.QUERIES, **analytics.QUERIES, **files.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**texts.SQL, **analytics.SQL, **files.SQL}
