"""Density hierarchy of embeddings: principal components, mutual reachability, a minimum spanning forest, condensed tree, excess of mass.

1. Vectors become unit vectors, centred, on their leading principal components; the matrix of
   moments is summed over tasks. Equal vectors are one node with a weight.
2. Nodes meet in cells (signs of random planes, several tables; one cell if they are few). A
   node's core distance is that of its second nearest other vector. Each cell keeps only a
   minimum spanning forest of its mutual reachability distances: an edge that is not in a
   part's forest is in no forest of the whole.
3. Boruvka rounds join the cells' forests: every component picks its lightest edge.
4. The tree is condensed upwards in bands of edge weights. What a band joins is one task's
   group of at most BAND edges (more only if they weigh the same); later bands see it as one
   node. Components of one weight join at once, so the result does not depend on which of
   several spanning forests was found.
5. A cluster stays if it is at least as stable as the best choice below it; a vector belongs to
   the topmost cluster that stays above the place where it joined.

Defined results: vectors that are null, of another length, without direction or not finite
are noise (-1), rows with a null id too; equal vectors are in one cluster; distances under
1e-6 count as that; the hierarchy's only root is no cluster; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import cluster
from quillgraph.operators.components import connected_components
from quillgraph.sources.scratch import materialize

#: Tables of cells, edges of a band, the least distance, digits that distances are compared by.
TABLES, BAND, LEAST, DIGITS = 12, 200_000, 1e-6, 9
STATE = "comp long, size long, points array<long>, cluster string, mass double, below double"


def _usable(dimensions: int):
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") == dimensions) & (length > 0) & (length < float("inf")), F.lit(False))


def _moments(dimensions: int):
    def run(batches):
        n, s, g = 0, np.zeros(dimensions), np.zeros((dimensions, dimensions))
        for batch in batches:
            x = np.array(batch["v"].tolist(), float).reshape(len(batch), dimensions)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        i, j = np.triu_indices(dimensions)
        yield pd.DataFrame({"i": np.r_[-1, np.arange(dimensions), i], "j": np.r_[-1, np.full(dimensions, -1), j], "m": np.r_[float(n), s, g[i, j]]})

    return run


def principal_axes(vectors: DataFrame, dimensions: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading axes (as columns) of unit vectors (v): moments are summed by Spark, their matrix of dimensions x dimensions is the driver's."""
    rows = vectors.select("v").mapInPandas(_moments(dimensions), "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).collect()
    m = {(r.i, r.j): r.m for r in rows}
    n = m[-1, -1] if m else 0.0
    if not n:
        return np.zeros(dimensions), np.eye(dimensions)[:, :components]
    mean = np.array([m[i, -1] for i in range(dimensions)]) / n
    second = np.array([[m[min(i, j), max(i, j)] for j in range(dimensions)] for i in range(dimensions)]) / n
    values, axes = np.linalg.eigh(second - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:components]]
    return mean, axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def _reduced(mean: np.ndarray, axes: np.ndarray):
    def run(batches):
        for batch in batches:
            x = np.array(batch["v"].tolist(), float).reshape(len(batch), len(mean))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": list(np.round((x - mean) @ axes, 12))})

    return run


def _distances(rows: pd.DataFrame) -> np.ndarray:
    x = np.array(rows["v"].tolist(), float)
    square = (x * x).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    return np.maximum(np.round(d, DIGITS), LEAST)


def _nearest(neighbours: int):
    """Each member's nearest others in its cell: as many as it can take to weigh `neighbours`."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        d = _distances(rows)
        np.fill_diagonal(d, np.inf)
        k = min(neighbours, len(rows) - 1)
        at = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(rows), 0), int)
        ids, weight = rows["id"].to_numpy(), rows["weight"].to_numpy()
        return pd.DataFrame({"id": np.repeat(ids, k), "d": np.take_along_axis(d, at, 1).ravel(), "other": ids[at].ravel(), "weight": weight[at].ravel()})

    return run


def _cores(nearest: DataFrame, nodes: DataFrame, neighbours: int) -> DataFrame:
    """(id, core): the distance within which other vectors weigh `neighbours`; the farthest known where all weigh less."""
    one = nearest.groupBy("id", "other").agg(F.min("d").alias("d"), F.first("weight").alias("weight"))
    sorted_ = one.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", "other", "weight"))).alias("near"))  # `neighbours` a table at most
    start = F.struct((F.col("weight") - 1).alias("sum"), F.when(F.col("weight") > neighbours, F.lit(LEAST)).otherwise(F.lit(None).cast("double")).alias("core"))
    step = lambda s, x: F.struct((s["sum"] + x["weight"]).alias("sum"), F.coalesce(s["core"], F.when(s["sum"] + x["weight"] >= neighbours, x["d"])).alias("core"))
    rows = nodes.select("id", "weight").join(sorted_, "id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<struct<d:double,other:bigint,weight:bigint>>")))
    far = F.coalesce(F.array_max(F.transform("near", lambda x: x["d"])), F.lit(LEAST))
    return rows.select("id", F.coalesce(F.aggregate("near", start, step)["core"], far).alias("core"))


def _cell_forest(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges of a cell's minimum spanning tree under mutual reachability, by Prim's rule on the whole matrix."""
    core, ids = rows["core"].to_numpy(), rows["id"].to_numpy()
    d = np.maximum(_distances(rows), np.maximum(core[:, None], core[None, :]))
    best, by = d[0].copy(), np.zeros(len(rows), int)
    left = np.ones(len(rows), bool)
    left[0] = False
    a, b, w = [], [], []
    for _ in range(len(rows) - 1):
        at = int(np.where(left, best, np.inf).argmin())
        left[at] = False
        a.append(ids[by[at]]), b.append(ids[at]), w.append(best[at])
        nearer = left & (d[at] < best)
        best[nearer], by[nearer] = d[at][nearer], at
    return pd.DataFrame({"a": pd.array(a, "int64"), "b": pd.array(b, "int64"), "w": pd.array(w, "float64")})


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of edges (a, b, w), by rounds in which each component picks its first edge by weight and ends."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    live = materialize(edges.where("a <> b").groupBy(low.alias("a"), high.alias("b")).agg(F.min("w").alias("w")).withColumns({"ca": F.col("a"), "cb": F.col("b")}), "edges")
    parts = []
    while live.limit(1).count():
        ends = live.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("w", "a", "b", "ca", "cb").alias("e"))
        picked = materialize(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "picked")
        parts.append(picked.select("a", "b", "w"))
        names = connected_components(picked.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        named = live.join(names.select(F.col("node").alias("ca"), F.col("component").alias("na")), "ca", "left").join(names.select(F.col("node").alias("cb"), F.col("component").alias("nb")), "cb", "left")
        live = materialize(named.select("a", "b", "w", F.coalesce("na", "ca").alias("ca"), F.coalesce("nb", "cb").alias("cb")).where("ca <> cb"), "edges")
    if not parts:
        return live.select("a", "b", "w")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _close(state: dict, weight: float | None, parent: str | None, tree: list) -> float:
    """A cluster ends where it joins another: its stability against the best choice below it."""
    birth = 0.0 if weight is None else 1 / weight
    stable = state["mass"] - birth * state["size"]
    tree.append({"kind": "tree", "name": state["cluster"], "parent": parent, "chosen": bool(stable >= state["below"])})
    return max(stable, state["below"])


def condense(states: dict[int, dict], edges, least: int) -> tuple[dict[int, dict], list[dict], list[dict], dict[int, int]]:
    """Join components along edges (a, b, w) by rising weight, those of one weight at once.

    states by component; returns the states that are left, (point, name) memberships, closed clusters, and each component's new name.
    """
    up = {c: c for c in states}

    def root(c):
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    members, tree = [], []
    edges = sorted(edges, key=lambda e: e[2])
    at = 0
    while at < len(edges):
        weight, to = edges[at][2], at
        touched: dict[int, list[int]] = {}
        while to < len(edges) and edges[to][2] == weight:
            a, b = root(edges[to][0]), root(edges[to][1])
            if a != b:
                a, b = min(a, b), max(a, b)
                up[b] = a
                touched[a] = touched.pop(a, [a]) + touched.pop(b, [b])
            to += 1
        at = to
        for low, parts in touched.items():
            own = [states.pop(p) for p in parts]
            grown = [s for s in own if s["cluster"] is not None]
            dust = [p for s in own if s["cluster"] is None for p in s["points"]]
            dust_size = sum(s["size"] for s in own if s["cluster"] is None)
            size = sum(s["size"] for s in own)
            if len(grown) == 1:
                state = grown[0] | {"size": size, "mass": grown[0]["mass"] + dust_size / weight}
            elif size >= least:
                name = f"{low}:{weight!r}"
                state = {"size": size, "points": [], "cluster": name, "mass": size / weight, "below": sum(_close(s, weight, name, tree) for s in grown)}
            else:
                state = {"size": size, "points": dust, "cluster": None, "mass": 0.0, "below": 0.0}
            if state["cluster"] is not None:
                members += [{"kind": "member", "point": p, "name": state["cluster"]} for p in dust]
                state["points"] = []
            states[low] = state
    return states, members, tree, {c: root(c) for c in up}


OUT = "kind string, comp long, size long, points array<long>, cluster string, mass double, below double, point long, name string, parent string, chosen boolean, old long"


def _band(least: int):
    columns = [c.split()[0] for c in OUT.split(", ")]

    def run(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        states = {}
        for comp, size, points, name, mass, below in zip(nodes["comp"], nodes["size"], nodes["points"], nodes["cluster"], nodes["mass"], nodes["below"]):
            states[int(comp)] = {"size": int(size), "points": [int(p) for p in points], "cluster": name, "mass": float(mass), "below": float(below)}
        left, members, tree, names = condense(states, list(zip(edges["ca"].tolist(), edges["cb"].tolist(), edges["w"].tolist())), least)
        rows = [{"kind": "node", "comp": c, **s} for c, s in left.items()] + members + tree
        rows += [{"kind": "name", "old": a, "comp": b} for a, b in names.items() if a != b]
        kinds = {"comp": "Int64", "size": "Int64", "point": "Int64", "old": "Int64", "chosen": "boolean", "mass": "Float64", "below": "Float64"}
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=kinds.get(c, "object")) for c in columns})

    return run


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def condensed_tree(nodes: DataFrame, forest: DataFrame, least: int = 6) -> tuple[DataFrame, DataFrame]:
    """nodes (id, weight), forest (a, b, w): memberships (id, name) and the tree (name, parent, chosen) of clusters."""
    heavy = F.col("weight") >= least
    name = F.when(heavy, F.concat(F.col("id").cast("string"), F.lit(":0")))
    state = nodes.select(F.col("id").alias("comp"), F.col("weight").alias("size"), F.when(heavy, F.array().cast("array<long>")).otherwise(F.array("id")).alias("points"), name.alias("cluster"), F.when(heavy, F.col("weight") / LEAST).otherwise(0.0).alias("mass"), F.lit(0.0).alias("below"))
    members, trees = [nodes.where(heavy).select("id", name.alias("name"))], []
    rest = materialize(forest.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w"), "forest")
    bands = max(1, math.ceil(rest.count() / BAND))
    cuts = sorted(set(rest.approxQuantile("w", [i / bands for i in range(1, bands)], 0.1 / bands))) if bands > 1 else []
    state = materialize(state, "state")
    for cut in [*cuts, None]:
        now = materialize(rest.where(F.col("w") <= cut) if cut is not None else rest, "band")
        if cuts:
            groups = connected_components(now.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("node", "comp")
        else:  # BAND edges at most: one group holds them
            groups = now.select(F.explode(F.array("ca", "cb")).alias("comp")).distinct().withColumn("component", F.lit(0).cast("long"))
        named = state.join(groups, "comp", "left")
        taken = named.where("component IS NOT NULL").groupBy("component").cogroup(now.join(groups.select(F.col("comp").alias("ca"), F.col("component").alias("of")), "ca").groupBy("of"))
        out = materialize(taken.applyInPandas(_band(least), OUT), "condensed")
        columns = [c.split()[0] for c in STATE.split(", ")]
        state = materialize(named.where("component IS NULL").select(columns).unionByName(out.where("kind = 'node'").select(columns)), "state")
        members.append(out.where("kind = 'member'").select(F.col("point").alias("id"), "name"))
        trees.append(out.where("kind = 'tree'").select("name", "parent", "chosen"))
        if cut is not None:
            new = out.where("kind = 'name'").select("old", F.col("comp").alias("new"))
            later = rest.where(F.col("w") > cut)
            later = later.join(new.select(F.col("old").alias("ca"), F.col("new").alias("na")), "ca", "left").join(new.select(F.col("old").alias("cb"), F.col("new").alias("nb")), "cb", "left")
            rest = materialize(later.select(F.coalesce("na", "ca").alias("ca"), F.coalesce("nb", "cb").alias("cb"), "w"), "forest")
    roots = state.where("cluster IS NOT NULL")
    several = roots.limit(2).count() > 1
    # Components that nothing joins meet at no density at all; a single one is the root.
    trees.append(roots.select(F.col("cluster").alias("name"), F.lit(None).cast("string").alias("parent"), (F.lit(several) & (F.col("mass") >= F.col("below"))).alias("chosen")))
    return _union(members), _union(trees)


def topmost_chosen(tree: DataFrame) -> DataFrame:
    """(name, top): the topmost chosen cluster among a cluster and those above it, by doubling the steps upwards."""
    t = materialize(tree.select("name", F.col("parent").alias("up"), F.expr("CASE WHEN chosen THEN name END").alias("top")), "tops")
    while t.where("up IS NOT NULL").limit(1).count():
        above = t.select(F.col("name").alias("up"), F.col("up").alias("far"), F.col("top").alias("higher"))
        t = materialize(t.join(above, "up", "left").select("name", F.col("far").alias("up"), F.coalesce("higher", "top").alias("top")), "tops")
    return t.where("top IS NOT NULL").select("name", "top")


def density_hierarchy(vectors: DataFrame, dimensions: int, components: int = 10, least: int = 6, neighbours: int = 2, seed: int = 42) -> DataFrame:
    """vectors (vec_id, embedding): (vec_id, cluster), -1 for noise. A cluster is named by its smallest id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).withColumn("usable", _usable(dimensions))
    usable = rows.where("usable").select("vec_id", "v")
    mean, axes = principal_axes(usable, dimensions, min(components, dimensions))
    flat = materialize(usable.mapInPandas(_reduced(mean, axes), "vec_id long, v array<double>"), "reduced")
    nodes = materialize(flat.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight")).withColumn("id", F.monotonically_increasing_id()), "vectors")
    n = nodes.count()
    bits = 0 if n <= cluster.LARGEST else math.ceil(math.log2(n / cluster.ROOM))
    codes = nodes.select("id", "weight", "v").mapInPandas(cluster._codes(TABLES if bits else 1, axes.shape[1], seed), "id long, weight long, v array<double>, table int, code long")
    cells = materialize(cluster._cells(materialize(codes, "codes"), bits), "cells")
    nearest = cells.groupBy(*cluster.CELL).applyInPandas(_nearest(neighbours), "id long, d double, other long, weight long")
    cores = materialize(_cores(materialize(nearest, "nearest"), nodes, neighbours), "cores")
    edges = cells.join(cores, "id").groupBy(*cluster.CELL).applyInPandas(_cell_forest, "a long, b long, w double")
    forest = materialize(spanning_forest(edges) if bits else edges, "forest")
    members, tree = condensed_tree(nodes.select("id", "weight"), forest, least)
    placed = members.join(topmost_chosen(tree), "name").join(nodes.select("id", "v", "low"), "id")
    named = placed.join(placed.groupBy("top").agg(F.min("low").alias("cluster")), "top").select("v", "cluster")
    found = flat.join(named, "v", "left").select("vec_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return found.unionByName(rows.where("NOT usable").select("vec_id", F.lit(-1).cast("long").alias("cluster")))
