"""Importing this module registers every query."""

import importlib

from combirisk.plans.registry import CHECKS, QUERIES

for _module in ("source", "scalar", "join", "table", "network", "regimen", "alternative", "evaluation"):
    importlib.import_module(f"combirisk.plans.{_module}_queries")

__all__ = ["CHECKS", "QUERIES"]
