"""Column expressions shared by the operators (all JVM-side built-ins)."""

from dayspan.functions.columns import (  # noqa: F401
    as_col, guarded_greatest, guarded_least, days_inclusive, ratio, hash_unit,
    hash_key, blank, null_safe_on,
)
