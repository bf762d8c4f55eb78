"""The queries of this subpackage and their oracles."""

from . import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

_MODULES = [op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13]

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
