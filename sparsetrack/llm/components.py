"""Connected components of a link table, by smallest-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

LEAST_PARTS, ROWS = 24, 20_000


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``links`` (a, b), for every node that has a link.

    A round takes each node's smallest label among its neighbours, then the label's own label, so long chains shrink by
    halves; rounds go on until no label changes.  Each is written, so a lost executor costs one round at most; it is written
    by as many tasks as its rows call for, since few rows in many files cost more than the rounds themselves.
    """
    parts = max(LEAST_PARTS, 2 * links.count() // ROWS)
    both = written(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).where("node <> other").distinct().coalesce(parts), "edges")
    labels = written(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")).coalesce(parts), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        mine = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = written(mine.join(jump, "next", "left").select("node", "label", F.least("next", "far").alias("next")).coalesce(parts), "labels")
        done = step.where("label <> next").isEmpty()
        discard(labels)
        if done:
            discard(both)
            return step.select("node", "label")
        labels = step.select("node", F.col("next").alias("label"))
