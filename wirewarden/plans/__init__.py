"""Registered queries: `QUERIES` and, where SQL can express them, `ORACLE_SQL`."""

from wirewarden.plans import contract_queries, document_queries, redaction_queries, tool_queries  # noqa: F401  register their queries
from wirewarden.plans.queries import ORACLE_SQL, QUERIES  # noqa: F401
