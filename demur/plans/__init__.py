from . import q_boot, q_crossfit, q_curves, q_facts, q_gates, q_ladder, q_ranges, q_refits, q_sources, q_splits  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
