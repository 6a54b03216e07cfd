"""Queries of the comparison engine, and their SQL."""

from __future__ import annotations

from parity.plans import queries as own


def queries() -> dict:
    return dict(own.QUERIES)


def oracle_sql() -> dict:
    return dict(own.ORACLES)
