"""Event-sequence impact analysis as Spark DataFrame jobs."""

from eddyline.config import SPINE, Spine

__all__ = ["SPINE", "Spine"]
