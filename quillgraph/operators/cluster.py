"""Density clusters of embeddings by true cosines, with neighbours found by locality-sensitive hashing.

Equal vectors are one node with a weight. In each of several tables of random planes a node
falls into a cell, the signs of its first products; cosines are measured among the members of
a cell. A node whose neighbours at the threshold, itself included, weigh enough in some table
is a core; cores that are neighbours are one cluster; another node joins the cluster of its
nearest core; the rest and the clusters of too few vectors are noise.

Per cell only a forest of its cores' links and one core for each other member leave the task,
never its pairs. The bits of a cell follow the number of nodes, the number of tables follows
from the bits and the recall wanted for a pair that stands just at the threshold. Cells over
LARGEST nodes take more bits, in which only members far closer than others stay together; such as
agree in all bits are dealt into parts, and each part is tied to the cell's smallest member.

Defined results: vectors that are null, of another length, without direction or not finite are
noise, rows with a null id too; equal vectors are in one cluster; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.components import connected_components
from quillgraph.sources.scratch import materialize

#: Nodes that a cell is meant to hold, and most that one task compares.
ROOM, LARGEST = 250, 2_000
#: Signs kept of a node in each table, and how many more a crowded cell takes at a time.
SIGNS, MORE = 60, 8
#: Share of the pairs just at the threshold that meet in some table.
RECALL = 0.99
CELL = ["table", "signs", "cell", "part"]


def tables_needed(bits: int, cosine: float, recall: float = RECALL) -> int:
    """How many tables of cells of so many bits let a pair of this cosine meet with probability `recall`."""
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def _codes(tables: int, dimensions: int, seed: int):
    """Rows (id, weight, v) once for each table, with the signs of the vector there."""

    def run(batches):
        powers = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            x = np.array(batch["v"].tolist(), float).reshape(len(batch), dimensions)
            for t in range(tables):
                planes = np.random.default_rng((seed, t)).normal(size=(dimensions, SIGNS))
                yield batch.assign(table=t, code=(x @ planes > 0) @ powers)

    return run


def _near(rows: pd.DataFrame, cosine: float) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """A cell's rows in the order of their ids, their cosines, and which reach the threshold."""
    rows = rows.sort_values("id", ignore_index=True)
    x = np.array(rows["v"].tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosines = x @ x.T
    near = cosines >= cosine
    np.fill_diagonal(near, True)
    return rows, cosines, near


def _neighbours(cosine: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, _, near = _near(rows, cosine)
        return pd.DataFrame({"id": rows["id"], "weight": near @ rows["weight"].to_numpy()})

    return run


def _links(cosine: float):
    """Stars over a cell's components of cores, and for each other member its nearest core, if near enough."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, cosines, near = _near(rows, cosine)
        ids, core = rows["id"].to_numpy(), rows["core"].to_numpy(bool)
        a, b, how = [], [], []
        left = core.copy()
        while left.any():
            first = int(np.argmax(left))
            left[first] = False
            front = np.array([first])
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & left)
                left[front] = False
                a += [ids[first]] * len(front)
                b += ids[front].tolist()
                how += [None] * len(front)
        if core.any():
            at = np.flatnonzero(core)
            for i in np.flatnonzero(~core):
                best = at[np.argmax(cosines[i, at])]
                if near[i, best]:
                    a.append(ids[best]), b.append(ids[i]), how.append(float(cosines[i, best]))
        return pd.DataFrame({"a": pd.array(a, "int64"), "b": pd.array(b, "int64"), "cosine": pd.array(how, "Float64")})

    return run


def _cells(codes: DataFrame, bits: int) -> DataFrame:
    """Codes with their cell: the first bits, more of them where more than LARGEST nodes share a cell."""
    cell = lambda n: F.shiftright("code", SIGNS - n)
    rows = codes.withColumns({"signs": F.lit(bits), "cell": cell(bits)})
    while bits < SIGNS:
        crowded = materialize(rows.where(F.col("signs") == bits).groupBy("table", "signs", "cell").count().where(F.col("count") > LARGEST).select("table", "signs", "cell", F.lit(True).alias("crowded")), "crowded")
        if not crowded.limit(1).count():
            break
        bits = min(SIGNS, bits + MORE)
        rows = rows.join(crowded, ["table", "signs", "cell"], "left")
        rows = rows.withColumns({"signs": F.when(F.col("crowded"), bits).otherwise(F.col("signs")), "cell": F.when(F.col("crowded"), cell(bits)).otherwise(F.col("cell"))}).drop("crowded")
    full = rows.where(F.col("signs") == SIGNS).groupBy("table", "signs", "cell").agg(F.count("*").alias("n"), F.min("id").alias("low")).where(F.col("n") > LARGEST)
    # Half of LARGEST on average, so that a part drawn by hash stays below it.
    full = full.select("table", "signs", "cell", "low", F.ceil(2 * F.col("n") / LARGEST).cast("int").alias("parts"))
    rows = rows.join(full, ["table", "signs", "cell"], "left")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("id") == F.col("low"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    return rows.withColumn("part", F.explode(parts)).drop("low", "parts", "code")


def density_clusters(vectors: DataFrame, dimensions: int, cosine: float = 0.9, least: int = 2, least_cluster: int = 6, seed: int = 42) -> DataFrame:
    """vectors (vec_id, embedding): (vec_id, cluster), -1 for noise. A cluster is named by its smallest id.

    A core has neighbours of weight `least` at the cosine, itself included; a cluster has `least_cluster` vectors or more.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.withColumn("usable", F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") == dimensions) & (length > 0) & (length < float("inf")), F.lit(False)))
    usable = rows.where("usable")
    # Numbers of nodes are fixed once they are written; an id may repeat with several vectors.
    nodes = usable.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight")).withColumn("id", F.monotonically_increasing_id())
    nodes = materialize(nodes, "vectors")
    n = nodes.count()
    bits = max(1, math.ceil(math.log2(max(n, 1) / ROOM)))
    codes = nodes.select("id", "weight", "v").mapInPandas(_codes(tables_needed(bits, cosine), dimensions, seed), "id long, weight long, v array<double>, table int, code long")
    cells = materialize(_cells(materialize(codes, "codes"), bits), "cells")
    counted = cells.groupBy(*CELL).applyInPandas(_neighbours(cosine), "id long, weight long")
    cores = materialize(counted.groupBy("id").agg(F.max("weight").alias("weight")).where(F.col("weight") >= least).select("id", F.lit(True).alias("core")), "cores")
    marked = cells.join(cores, "id", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    links = materialize(marked.groupBy(*CELL).applyInPandas(_links(cosine), "a long, b long, cosine double"), "links")
    grown = connected_components(links.where("cosine IS NULL").select("a", "b").distinct()).select(F.col("node").alias("id"), "component")
    named = cores.join(grown, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    nearest = links.where("cosine IS NOT NULL").groupBy("b").agg(F.max(F.struct("cosine", (-F.col("a")).alias("low")))["low"].alias("low"))
    border = nearest.select(F.col("b").alias("node"), (-F.col("low")).alias("id")).join(named, "id").select(F.col("node").alias("id"), "cluster")
    settled = materialize(nodes.join(named.unionByName(border), "id").select("low", "v", "weight", "cluster"), "settled")
    large = settled.groupBy("cluster").agg(F.sum("weight").alias("n"), F.min("low").alias("name")).where(F.col("n") >= least_cluster).select("cluster", "name")
    found = usable.join(settled.join(large, "cluster").select("v", "name"), "v", "left").select("vec_id", F.coalesce("name", F.lit(-1)).alias("cluster"))
    return found.unionByName(rows.where("NOT usable").select("vec_id", F.lit(-1).cast("long").alias("cluster")))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count("*").alias("n"))
