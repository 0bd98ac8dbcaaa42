"""All queries of the engine by name, with SQL for the reference database where it can state them."""

from . import collections_, extensions, ranking, representation, samples

_MODULES = (ranking, representation, collections_, samples, extensions)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
