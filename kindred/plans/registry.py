"""All queries over the reference's operators, by name, with their DuckDB equivalents."""

import inspect

from kindred.plans import audit as _audit
from kindred.plans import checks as _checks
from kindred.plans import evaluation as _evaluation
from kindred.plans import queries as _queries
from kindred.plans import records as _records
from kindred.plans import sql as _sql
from kindred.plans import stores as _stores

QUERIES = {name: f for m in (_queries, _audit, _records, _stores, _evaluation, _checks) for name, f in vars(m).items() if inspect.isfunction(f) and f.__module__ == m.__name__ and not name.startswith("_")}
ORACLES = _sql.ORACLES | _audit.ORACLES | _records.ORACLES | _stores.ORACLES | _evaluation.ORACLES | _checks.ORACLES
__all__ = ["ORACLES", "QUERIES"]
