"""Queries over the driver's tables, one module per operator family."""

from quire.plans import audit, catalog, events, logs, rules, semistructured, status, store, streaming, text

MODULES = (events, catalog, status, audit, logs, text, store, semistructured, streaming, rules)
