"""The registered queries and, where SQL can express them, their oracles."""

from . import categorical, models, numeric

_MODULES = [categorical, numeric, models]

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
