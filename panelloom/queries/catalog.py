"""Imports every query module, which fills the registry."""

from panelloom.queries import (  # noqa: F401
    aggregates,
    backtesting,
    explaining,
    ingesting,
    joining,
    measuring,
    modelling,
    quality,
    scalar,
    splitting,
    tables,
    windows,
)
from panelloom.queries.registry import ORACLES, QUERIES  # noqa: F401
