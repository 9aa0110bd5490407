"""All registered queries."""

from quern.plans import events, fields, ingredients, label_tables, labels, measures, more, recognition, records, relational, scoring, streams, texts, warnings  # noqa: F401
from quern.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
