"""Column expressions shared by the operators; all stay inside the JVM."""

from oreline.functions.amounts import half_up_ratio, line_cost, line_gross
from oreline.functions.fingerprint import row_hash

__all__ = ["half_up_ratio", "line_cost", "line_gross", "row_hash"]
