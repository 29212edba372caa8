"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregations by node and a join; the number of rounds grows with the logarithm of the longest path.
Tables between rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges (a, b); component is the smallest node reachable."""
    now = written(edges.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges")
    state = _state(now)
    while True:
        both = now.union(now.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) as m")
        large = both.join(least, "a").where("b > a").selectExpr("b as a", "m as b")
        large = written(large.where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # here b < a throughout
        before = now
        small = large.join(least, "a").selectExpr("explode(array(struct(b as a, m as b), struct(a as a, m as b))) as e").select("e.a", "e.b")
        now = written(small.where("a <> b").distinct(), "edges")
        discard(before)
        discard(large)
        new = _state(now)
        if new == state:
            break
        state = new
    return now.selectExpr("a as node", "b as component").union(now.selectExpr("b as node", "b as component").distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("s")).first()
    return row["n"], row["s"]
