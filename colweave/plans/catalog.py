"""All operators by name, from the modules that lower them."""

from ..functions import arith, bits, casts, checked, nulls, predicates, time
from ..functions.registry import AGGREGATES, OPERATORS
from ..operators import aggregates

__all__ = ["AGGREGATES", "OPERATORS", "aggregates", "arith", "bits", "casts", "checked", "nulls", "predicates", "time"]
