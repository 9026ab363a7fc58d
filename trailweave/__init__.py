"""trailweave: event-log analytics as Spark DataFrame programs.

Every operator takes DataFrames and returns a DataFrame (or takes columns and
returns a ``Column``); nothing here runs outside Spark except small, bounded
statistics that decide how a plan is partitioned.
"""

from trailweave.session import build_session

__all__ = ["build_session"]
