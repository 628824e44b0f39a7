"""Imports every query module so that the registry is complete."""

from importlib import import_module

from decision_lens.plans.registry import ORACLES, QUERIES

MODULES = ["cleaning", "profiling", "sampling", "models", "trees", "explanations", "similarity", "reports", "tables", "documents"]
for _m in MODULES:
    import_module(f"decision_lens.plans.{_m}")

__all__ = ["QUERIES", "ORACLES"]
