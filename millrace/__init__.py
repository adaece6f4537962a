"""A Spark-native engine for a small SQL dialect with a transactional and an analytical mode."""

from __future__ import annotations

from .errors import EngineError

__all__ = ["Engine", "EngineError", "Result"]


def __getattr__(name: str):
    """Engine and Result on first use, so that workers that only need a module of the package start fast."""
    if name in ("Engine", "Result"):
        from . import session

        return getattr(session, name)
    raise AttributeError(name)
