"""Registered queries of the engine's own operators and the SQL that checks them."""

from . import cases, tables, texts

QUERIES = {**tables.QUERIES, **texts.QUERIES, **cases.QUERIES}
ORACLES = {**tables.ORACLES, **texts.ORACLES, **cases.ORACLES}
