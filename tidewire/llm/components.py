"""Connected components of links, on the executors.

While there are more than ``LOCAL`` links, rounds contract the graph: each vertex takes the least label among its own and its neighbours', labels
take their label's label, and links are rewritten to labels, equal ones and loops dropped. What is left then, at most LOCAL links, is
united by one task; nothing is collected by the driver. Either way gives the same labels, the least id of each component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import drop, table

LOCAL = 500_000


@_text.tidy
def _unite(batches):
    a, b = [], []
    for x in batches:
        a.append(x.column(0).to_numpy())
        b.append(x.column(1).to_numpy())
    if not a:
        return
    ids, at = np.unique(np.concatenate(a + b), return_inverse=True)
    p, q = at[: len(at) // 2], at[len(at) // 2 :]
    up = np.arange(len(ids))
    while True:
        m = up.copy()
        np.minimum.at(m, p, up[q])
        np.minimum.at(m, q, up[p])
        np.minimum.at(m, up[p], m[p])
        np.minimum.at(m, up[q], m[q])
        m = m[m]
        if (m == up).all():
            break
        up = m
    yield pa.record_batch({"id": pa.array(ids), "component": pa.array(ids[up])})


def components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """``links`` (a, b, integers) to (id, component): each linked id with the least id reachable from it."""
    links = table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while links.limit(local + 1).count() > local:
        both = links.union(links.selectExpr("b", "a"))
        near = table(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("l")).select("id", F.least("id", "l").alias("l")), "near")
        jump = near.select(F.col("id").alias("j"), F.col("l").alias("to"))
        step = table(near.join(jump, near.l == jump.j, "left").select("id", F.coalesce("to", "l").alias("l")), "step")
        if labels is None:
            labels = step.select("id", F.col("l").alias("component"))
        else:
            was, labels = labels, labels.join(step, labels.component == step.id, "left").select(labels.id, F.coalesce(step.l, labels.component).alias("component"))
            labels = table(labels, "labels")
            drop(was)
        to = lambda c: step.select(F.col("id").alias(c), F.col("l").alias(f"l{c}"))
        new = links.join(to("a"), "a").join(to("b"), "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).where("a <> b").distinct()
        new = table(new, "edges")
        drop(links, near)
        links = new
    rest = links.repartition(1).mapInArrow(_unite, "id bigint, component bigint")
    if labels is None:
        return table(rest, "labels")
    rest = rest.withColumnRenamed("id", "r").withColumnRenamed("component", "c")
    return table(labels.join(rest, labels.component == rest.r, "left").select("id", F.coalesce("c", "component").alias("component")), "labels")
