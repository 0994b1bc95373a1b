"""Read the physical plan of a DataFrame through the public ``explain`` API.

Used by tests and by anyone checking that a query kept the intended shape:
filters pushed into the scan, pruned read schemas, no cartesian product, no
Python evaluation in the hot path.
"""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame

# Physical operators that must not appear in the library's plans.
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "FlatMapCoGroupsInPandas", "AggregateInPandas")
PRODUCT_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def forbidden_nodes(df: DataFrame) -> list[str]:
    text = plan_text(df, "simple")
    return [node for node in PYTHON_NODES + PRODUCT_NODES if node in text]
