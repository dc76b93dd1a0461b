"""Spark-native analytics for irregular environmental sensor readings."""

from hazeline.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
