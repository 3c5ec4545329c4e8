"""Connected components of a large sparse graph by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.session import Scratch


def merge_labels(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (node, label) after joining along ``links`` (a, b: nodes).

    A label is the smallest node of its component.  The graph is contracted to one
    vertex for each label.  Each pass hooks every vertex to the smallest one it is
    linked with, follows the hooks twice, and renames vertices, labels and the ends
    of the links alike, so that a link is given up only when both its ends have one
    name.  (Looking up the label of the node a link once named would not do: after
    a pass that node may have moved on without the others that bore its name.)
    All state is in written tables.
    """
    given = labels
    la = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    lb = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    named = links.join(la, "a").join(lb, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    used: list[DataFrame] = []  # tables of the pass before that nothing reads once the links have their new names
    while True:
        open_links = scratch.write(named.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "open")
        for table in used:
            scratch.forget(table)
        if open_links.isEmpty():
            return labels
        used = [open_links]
        both = open_links.unionAll(open_links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to"))
        hooks = scratch.write(hooks, "hooks")
        for _ in range(2):
            far = hooks.select(F.col("node").alias("to"), F.col("to").alias("far"))
            used.append(hooks)
            hooks = scratch.write(hooks.join(far, "to", "left").select("node", F.coalesce("far", "to").alias("to")), "hooks")
        to = hooks.select(F.col("node").alias("label"), "to")
        used.append(hooks)
        last, labels = labels, scratch.write(labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        if last is not given:
            scratch.forget(last)
        ta = hooks.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        tb = hooks.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        named = open_links.join(ta, "a").join(tb, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
