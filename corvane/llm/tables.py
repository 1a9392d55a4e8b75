"""The tables that the queries read."""

from __future__ import annotations

from corvane.plans.catalog import table

__all__ = ["table"]
