"""All registered queries with their SQL twins."""

from framelens.plans import cake_queries, extra_queries, frame_queries, live_queries, match_queries, pattern_queries, peak_queries, track_queries  # noqa: F401
from framelens.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "run_identification"
