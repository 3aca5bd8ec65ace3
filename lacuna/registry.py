"""The queries of the engine's own operators, by name, and their DuckDB oracles. Names start with the operator they show."""

from .plans import dispatch, entropy, flows, imaged, ledger, mixed, recovery, requests, streams

QUERIES = {**entropy.QUERIES, **imaged.QUERIES, **mixed.QUERIES, **recovery.QUERIES, **ledger.QUERIES, **streams.QUERIES, **requests.QUERIES, **dispatch.QUERIES, **flows.QUERIES}
ORACLES = {**entropy.ORACLES, **imaged.ORACLES, **mixed.ORACLES, **recovery.ORACLES, **ledger.ORACLES, **streams.ORACLES, **requests.ORACLES, **dispatch.ORACLES, **flows.ORACLES}
