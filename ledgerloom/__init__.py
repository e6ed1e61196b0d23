"""ledgerloom: a PySpark-native analytics engine for business-application metadata, code and text."""

from ledgerloom.session import build_session, checkpointed

__all__ = ["build_session", "checkpointed"]
