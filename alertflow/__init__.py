"""Log analytics on Spark: scoring, alerting, incidents and dashboards as DataFrame jobs."""

from alertflow.session import get_session

__all__ = ["get_session"]
__version__ = "0.1.0"
