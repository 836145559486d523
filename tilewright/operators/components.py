"""Connected components of an edge table, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tilewright.session import checkpointed


#: Up to so many edges are joined by one task; more go through rounds of joins.
SMALL = 100_000


def _join_all(kind: T.DataType):  # noqa: ANN202
    """Of all edges of a small graph, (node, label) by union of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):  # noqa: ANN001, ANN202
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        plain = (lambda v: tuple(v.values())) if isinstance(kind, T.StructType) else (lambda v: v)
        for t in batches:
            for a, b in zip(map(plain, t.column("a").to_pylist()), map(plain, t.column("b").to_pylist()), strict=True):
                up.setdefault(a, a)
                up.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        back = (lambda v: dict(zip(kind.names, v, strict=True))) if isinstance(kind, T.StructType) else (lambda v: v)
        arrow = to_arrow_type(kind)
        nodes = list(up)
        yield pa.record_batch({"node": pa.array([back(x) for x in nodes], arrow), "label": pa.array([back(root(x)) for x in nodes], arrow)})

    return run


def connected_components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) is connected to. Nodes may have any type
    that has an order; whole numbers are taken as long.

    Edges are counted: up to ``small`` are joined in one task. Of more, each round a node and its present label's
    node are offered the labels of the node's neighbours, and the node its label's own label; each takes the least,
    so that whole trees join and chains halve. Offers combine before they are shuffled, which keeps a round's cost to
    the number of edges, whatever the degree of a node. Labels are checkpointed each round, and end in an aggregate,
    as a join would hand on all of its sides' partitionings to the next round's plan.
    """
    kind = edges.schema["a"].dataType
    kind = T.LongType() if isinstance(kind, T.IntegralType) else kind
    links = checkpointed(edges.where("a <> b").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).distinct())
    if links.count() <= small:
        return links.coalesce(1).mapInArrow(_join_all(kind), T.StructType().add("node", kind).add("label", kind))
    both = checkpointed(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        seen = labels.join(near, F.col("node") == F.col("a")).select("node", "label", "low")
        further = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        offers = seen.select("node", F.least("label", "low").alias("offer"), F.col("label").alias("own")).unionByName(
            seen.select(F.col("label").alias("node"), F.col("low").alias("offer"), F.lit(None).cast(kind).alias("own"))
        )
        offers = offers.unionByName(labels.join(further, F.col("label") == F.col("via")).select("node", F.col("further").alias("offer"), F.lit(None).cast(kind).alias("own")))
        new = checkpointed(offers.groupBy("node").agg(F.min("offer").alias("label"), F.max("own").alias("own")))
        changed = new.where("label <> own").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
