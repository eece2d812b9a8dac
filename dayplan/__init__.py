"""Daily demand, production, forecast and inventory planning on Spark."""

from dayplan.planner import Planner
from dayplan.session import build_session
from dayplan.sources.tables import StoredTable

__all__ = ["Planner", "StoredTable", "build_session"]
