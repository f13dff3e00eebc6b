"""Three-valued activation as columns: 0 never, 1 maybe, 2 always.

Numbers instead of NULLs: aggregates and ``greatest`` skip NULLs, so a maybe would
get lost there.  And is the minimum, or the maximum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER, MAYBE, ALWAYS = 0, 1, 2
#: Reachability is a pair (production, test); its code is production * 3 + test.
BOTH, TEST_ONLY, PRODUCTION_ONLY, NOWHERE = 8, 2, 6, 0

#: Output roles by priority, then the two for files that nothing builds.
ROLES = ("production", "example", "test", "bench", "build", "conditional", "inactive", "orphan")


def both(*values: Column) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def either(*values: Column) -> Column:
    return F.greatest(*values) if len(values) > 1 else values[0]


def negate(value: Column) -> Column:
    return F.lit(2) - value


def activation(flag: Column) -> Column:
    """A boolean; NULL is maybe."""
    return F.when(flag.isNull(), F.lit(MAYBE)).when(flag, F.lit(ALWAYS)).otherwise(F.lit(NEVER))


def code(production: Column, test: Column) -> Column:
    return production * 3 + test


def classify(production: Column, example: Column, test: Column, bench: Column, build: Column, referenced: Column) -> Column:
    """The output role of a file's activation in each kind of target: the first in
    priority that isn't never, conditional if only a maybe; else inactive where
    something refers to the file, and orphan where nothing does."""
    out = F.when(referenced, F.lit("inactive")).otherwise(F.lit("orphan"))
    for name, value in reversed(list(zip(ROLES, (production, example, test, bench, build)))):
        out = F.when(value == ALWAYS, F.lit(name)).when(value == MAYBE, F.lit("conditional")).otherwise(out)
    return out


def classify_sql(production: str, example: str, test: str, bench: str, build: str, referenced: str) -> str:
    """``classify`` as SQL: each operation on a column takes its time on the driver."""
    out = f"CASE WHEN {referenced} THEN 'inactive' ELSE 'orphan' END"
    for name, value in reversed(list(zip(ROLES, (production, example, test, bench, build)))):
        out = f"CASE WHEN {value} = {ALWAYS} THEN '{name}' WHEN {value} = {MAYBE} THEN 'conditional' ELSE {out} END"
    return out
