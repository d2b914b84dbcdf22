"""Network-state analytics as Spark DataFrame operators."""

from netloom.config import EngineConfig

__all__ = ["EngineConfig"]
