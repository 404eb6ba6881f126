"""All registered queries and their SQL."""

from shortlist.plans import q_digest, q_ingest, q_model, q_pages, q_reports, q_rules, q_stream  # noqa: F401  they register their queries
from shortlist.plans.base import ORACLE, QUERIES
from shortlist.plans.q_rules import flagship

__all__ = ["ORACLE", "QUERIES", "flagship"]
