"""All core queries, collected from the modules that register them."""

from __future__ import annotations

from pulsegrid.plans import clustering, instruments, messages, readout, validators  # noqa: F401
from pulsegrid.plans.catalog import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
