"""Connected components of a link table by least-label propagation with pointer jumping, each round checkpointed."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """The table, computed and kept in the checkpoint folder: what follows neither plans nor computes it again."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tallyforge-"))
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links(a, b)``; the component is the least node reachable. Nodes are compared as text.

    Each round every node takes the least label of itself, its neighbours and its label's label, so distances halve; it ends when
    no label changes. Rounds are written to the checkpoint folder, so a lost executor costs one round."""
    text = links.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).filter("a <> b")
    both = settled(text.union(text.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")).checkpoint()
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        following = labels.join(near, "node").join(jump, "label").select("node", F.least("label", "near", "up").alias("label"), F.col("label").alias("before")).checkpoint()
        if following.filter("label <> before").isEmpty():
            return following.select("node", F.col("label").alias("component"))
        labels = following.drop("before")
