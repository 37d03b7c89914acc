"""Analytics over coding-agent telemetry, expressed as Spark DataFrame jobs."""

from telemill.session import prepare_session

__all__ = ["prepare_session"]
