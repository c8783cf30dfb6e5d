"""All registered queries and their DuckDB checks."""
from . import catalog_answers, catalog_dialogue, catalog_metrics, oracle_turns  # noqa: F401  (they register on import)
from .catalog import QUERIES
from .oracle import ORACLE

QUERIES["session_replay"] = QUERIES.pop("session_replay")      # the longest one comes last

__all__ = ["QUERIES", "ORACLE"]
