"""trackspark: multi-object tracking analytics as plain Spark DataFrame operators."""

from trackspark.session import configure, get_session

__all__ = ["configure", "get_session"]
__version__ = "0.1.0"
