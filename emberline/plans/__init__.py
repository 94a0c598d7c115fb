"""Registered queries over the given tables and the SQL that checks them."""

from . import corner_queries, detection_queries, incident_queries, landed_queries, roster_queries, time_queries

_MODULES = (detection_queries, roster_queries, time_queries, incident_queries, corner_queries, landed_queries)

PLANS = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
#: The stream keeps what the batch operator keeps.
ORACLES["streamed_throttle"] = ORACLES["throttled_events"]
#: SQL functions give what the expressions give.
ORACLES |= {f"sql_{k}": ORACLES[v] for k, v in {"product_names": "product_names", "unit_tokens": "unit_token_lists", "coordinates": "coordinate_labels", "boxes": "box_algebra"}.items()}
