"""What a physical plan does: for tests and for deciding when to compact."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> Counter:
    """How often each physical operator occurs."""
    return Counter(m[1] for line in plan_text(df).splitlines() if (m := re.match(r"[\s:+\-*()\d]*([A-Z]\w+)", line)))


def exchanges(df: DataFrame) -> int:
    """Shuffles in the plan; what a cached table was built with does not count."""
    count, cached = 0, None
    for line in plan_text(df).splitlines():
        m = re.match(r"([\s:+\-*()\d]*)([A-Z]\w+)", line)
        if not m:
            continue
        depth = len(re.match(r"[\s:+\-]*", line)[0])
        if cached is not None and depth > cached:
            continue
        cached = None
        if m[2] == "InMemoryRelation":
            cached = depth
        elif m[2] == "Exchange":
            count += 1
    return count
