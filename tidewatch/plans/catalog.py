"""All registered queries."""

from tidewatch.plans import article_queries, ingest_queries, source_queries, stream_queries, track_queries  # noqa: F401
from tidewatch.plans.registry import QUERIES  # noqa: F401
