"""Traceable business figures from messy tables, as PySpark DataFrame operators."""

from tabulith.policy import POLICY, Policy
from tabulith.table import ColumnInfo, Sheet

__all__ = ["POLICY", "Policy", "ColumnInfo", "Sheet"]
