"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

On unit vectors cosine >= c means distance <= sqrt(2 - 2c). The upper level of each label's
tree is made by Spark: some vectors become nodes and every vector belongs to its nearest one.
Below, a task builds nested levels whose radii halve. Pairs of nodes whose balls are further
apart than the threshold are pruned, first between upper nodes, then inside tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from waveledger.llm.shared import checked, components, id_or_least, real_id
from waveledger.sources.tables import staged

#: Vectors of one upper node that a task takes at a time.
NODE = 1024
#: Vectors that one task assigns to upper nodes.
CHUNK = 4096
#: Node pairs that are compared at a time.
FRONTIER = 1 << 20
#: Room for rounding in bounds; links are decided on the cosine itself.
SLACK = 1e-9


class CoverTree:
    """Nested levels over unit vectors: a node's children cover its points at half its radius.

    Nodes are arrays: `centre` (a point), `radius` (of the farthest point below), `child` and
    `children` (first child and their number; children lie side by side). Leaves are points.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre, self.radius, self.child, self.children = [], [], [], []
        if not len(points):
            return
        todo = [self._node(0, np.arange(len(points)))]
        while todo:
            node, members, far = todo.pop()
            if len(members) == 1:
                continue
            parts = self._cover(self.centre[node], members, far, self.radius[node] / 2)
            self.child[node], self.children[node] = len(self.centre), len(parts)
            todo += [self._node(c, m) for c, m in parts]
        self.centre, self.child, self.children = (np.array(x, np.int64) for x in (self.centre, self.child, self.children))
        self.radius = np.array(self.radius)

    def _distance(self, centre: int, members: np.ndarray) -> np.ndarray:
        dots = self.points[members] @ self.points[centre]
        return np.sqrt(np.maximum(2 - 2 * dots, 0))

    def _node(self, centre: int, members: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        far = np.zeros(1) if len(members) == 1 else np.where(members == centre, 0.0, self._distance(centre, members))
        self.centre.append(centre)
        self.radius.append(float(far.max()))
        self.child.append(-1)
        self.children.append(0)
        return len(self.centre) - 1, members, far

    def _cover(self, centre: int, members: np.ndarray, far: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
        """The centre again, then uncovered points in turn, each with what it covers first."""
        if radius < 1e-6:  # equal to rounding: no level can part them
            return [(int(m), np.array([m])) for m in members]
        parts = [(centre, members[far <= radius])]
        members = members[far > radius]
        while len(members):
            # some candidates at a time against all that is left: one product for many of them
            ahead = members[:FRONTIER // max(len(members), 1) + 64]
            near = self.points[ahead] @ self.points[members].T >= 1 - radius * radius / 2
            near[np.arange(len(ahead)), np.arange(len(ahead))] = True
            free = np.ones(len(members), bool)
            for i in range(len(ahead)):
                if free[i]:
                    mine = near[i] & free
                    free &= ~mine
                    parts.append((int(ahead[i]), members[mine]))
            members = members[free]
        return parts


def near_pairs(a: CoverTree, b: CoverTree, reach: float):
    """Yields arrays (i, j) of points that may be within `reach`: pairs of leaves left by dual traversal.

    A pair of nodes is opened by comparing all children of one with all of the other. Of a tree
    with itself, each unordered pair of nodes is opened once.
    """
    if not len(a.points) or not len(b.points):
        return
    same = a is b
    stack = [(0, 0)]
    while stack:
        m, n = stack.pop()
        left = np.arange(a.child[m], a.child[m] + a.children[m]) if a.children[m] else np.array([m])
        right = np.arange(b.child[n], b.child[n] + b.children[n]) if b.children[n] else np.array([n])
        for at in range(0, len(left), FRONTIER // len(right) + 1):
            some = left[at:at + FRONTIER // len(right) + 1]
            dots = a.points[a.centre[some]] @ b.points[b.centre[right]].T
            bound = a.radius[some][:, None] + b.radius[right] + (reach + SLACK)
            i, j = np.nonzero(2 - 2 * dots <= bound * bound)
            i, j = some[i], right[j]
            if same and m == n:
                i, j = i[i <= j], j[i <= j]
            leaves = (a.children[i] == 0) & (b.children[j] == 0)
            if leaves.any():
                yield a.centre[i[leaves]], b.centre[j[leaves]]
            stack += zip(i[~leaves].tolist(), j[~leaves].tolist())


def linked(xa, xb, same: bool, threshold: float):
    """(i, j) of all pairs with cosine >= threshold; i < j if both sides are `same`. Rows are (vector, norm, unit)."""
    reach = math.sqrt(max(2 - 2 * threshold, 0))
    a = CoverTree(xa[2])
    b = a if same else CoverTree(xb[2])
    found = []
    for i, j in near_pairs(a, b, reach):
        if same:
            i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        cosine = np.einsum("ij,ij->i", xa[0][i], xb[0][j]) / (xa[1][i] * xb[1][j])
        hit = cosine >= threshold
        found.append(np.stack([i[hit], j[hit]]))
    return np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, norms and unit vectors; scaled first, so squares stay in the range of doubles."""
    top = np.abs(x).max(1, keepdims=True)
    x = x / top
    norm = np.sqrt((x * x).sum(1))
    return x, norm, x / norm[:, None]


def _local_roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest index each index is linked to within these pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[pairs[0]], root[pairs[1]])
        new = root.copy()
        np.minimum.at(new, pairs[0], low)
        np.minimum.at(new, pairs[1], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def usable(vector: Column) -> Column:
    """Not null, some component not zero, none null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector.

    Vectors of equal, not null labels and equal lengths are linked at cosine >= `threshold` (in
    doubles). Vectors that are null, empty, all zero, or have null or non-finite components are
    linked with none, and are their own class. Equal vectors of a label are one node with a
    count, so copies make no pairs. A missing id is the smallest and stays null. Rows that
    repeat an id are vectors of their own and share its class. Other columns are not read.
    """
    checked(vectors, id_col, vector_col, label_col)
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(id_or_least(id_col).alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.when(F.col(label_col).isNotNull() & usable(vector), vector).alias("v"))
    rows = rows.withColumns({"dim": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), F.col("v"))})
    rows = staged(rows.withColumn("valid", F.col("v").isNotNull()), "vectors")
    # 128 bits name a vector
    same = ["label", "dim", "h1", "h2"]
    reps = staged(rows.filter("valid").groupBy(*same).agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by("v", "id").alias("v")), "reps")
    links = _links(reps, threshold)
    totals = links.groupBy("label", "dim", "h1", "h2").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), "a", "b")
    facts = (reps.select(*same, "rep", "copies").join(totals, same, "left").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*[F.col(c).alias(f"_{c}") for c in same], F.coalesce("root", "rep").alias("root"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    key = F.col("valid")
    for c in same:
        key = key & (F.col(c) == F.col(f"_{c}"))
    out = rows.drop("v").join(facts, key, "left")
    component = F.coalesce("root", "id")
    return out.select(real_id(F.col("id")).alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      real_id(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def _links(reps: DataFrame, threshold: float) -> DataFrame:
    """label, dim, h1, h2, rep, links, root: for each pair of upper nodes and vector linked in it."""
    reach = math.sqrt(max(2 - 2 * threshold, 0))
    group = ["label", "dim"]
    sizes = staged(reps.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("h1").alias("low")), "labels")
    sizes = sizes.withColumns({"nodes": F.expr(f"(n + {NODE - 1}) div {NODE}"),
                               "chunks": F.expr(f"(n + {CHUNK - 1}) div {CHUNK}")})
    # upper nodes: one vector in NODE, chosen by hash, and the one of least hash
    draw = F.shiftrightunsigned("h2", 1) / F.lit(float(2**63))
    rows = reps.join(sizes, group).withColumn(
        "top", (F.col("h1") == F.col("low")) | (draw < (F.col("nodes") - 1) / F.col("n")))
    tops = rows.filter("top").select(*group, "h1", "h2", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    chunked = rows.select(*group, "h1", "h2", "rep", "copies", "v", F.pmod(F.xxhash64("h1", "h2"), F.col("chunks")).alias("chunk"))
    assigned_schema = T.StructType([f for f in chunked.schema.fields if f.name != "chunk"]
                                   + [T.StructField("n1", T.LongType()), T.StructField("n2", T.LongType()),
                                      T.StructField("far", T.DoubleType())])

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("h1", "ascending"), ("h2", "ascending")])
        x, c = _sides(_matrix(left["v"]))[2], _sides(_matrix(right["v"]))[2]
        dots = x @ c.T
        best = dots.argmax(1)
        far = np.sqrt(np.maximum(2 - 2 * dots[np.arange(len(x)), best], 0))
        out = left.drop_columns(["chunk"])
        for name, values in (("n1", right["h1"].to_numpy()[best]), ("n2", right["h2"].to_numpy()[best]), ("far", far)):
            out = out.append_column(name, pa.array(values))
        return out

    keys = [*group, "chunk"]
    assigned = staged(chunked.groupBy(*keys).cogroup(tops.toDF(*tops.columns).groupBy(*keys)).applyInArrow(
        lambda left, right: assign(left, right) if left.num_rows and right.num_rows else _nothing(assigned_schema),
        assigned_schema), "assigned")
    # nodes with many vectors are cut into blocks, which share centre and bound
    node = [*group, "n1", "n2"]
    nodes = staged(assigned.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
                   .withColumn("blocks", F.expr(f"(n + {2 * NODE - 1}) div {2 * NODE}")), "nodes")
    centres = reps.select(*group, F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.col("v").alias("centre"))
    nodes = nodes.join(centres, node).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # a vector can be an upper node of several labels: names hold within a label and length only
    nodes = nodes.withColumn("name", F.xxhash64(*group, "n1", "n2", "block"))
    # which pairs of nodes can hold a link: each chunk of nodes against all nodes of the label
    per = nodes.groupBy(*group).agg(F.expr(f"(count(1) + {CHUNK - 1}) div {CHUNK}").alias("chunks"))
    nodes = staged(nodes.select(*node, "name", "radius", "centre", "blocks", "block").join(per, group), "nodes")
    mine = nodes.withColumn("chunk", F.pmod("name", F.col("chunks"))).select(*group, "chunk", "name", "radius", "centre")
    others = nodes.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(
        *group, "chunk", "name", "radius", "centre")
    pair_schema = T.StructType([*(reps.schema[c] for c in group), *(T.StructField(n, T.LongType()) for n in ("a", "b"))])

    def prune(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = _sides(_matrix(left["centre"]))[2], _sides(_matrix(right["centre"]))[2]
        a, b = left["name"].to_numpy(), right["name"].to_numpy()
        apart = np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))
        near = apart <= left["radius"].to_numpy()[:, None] + right["radius"].to_numpy()[None] + reach + 1e-6
        i, j = np.nonzero(near & (a[:, None] <= b[None]))
        return left.select(group).take(pa.array(i)).append_column("a", pa.array(a[i])).append_column("b", pa.array(b[j]))

    pairs = staged(mine.groupBy(*keys).cogroup(others.toDF(*others.columns).groupBy(*keys)).applyInArrow(
        lambda left, right: prune(left, right) if left.num_rows and right.num_rows else _nothing(pair_schema),
        pair_schema), "node-pairs")
    sides = pairs.select(*group, "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("name"))
    blocks = nodes.select(*node, "name", "blocks", "block")
    members = (assigned.join(nodes.select(*node, "blocks").distinct(), node)
               .withColumn("block", F.pmod(F.xxhash64("h2", "h1"), F.col("blocks")))
               .join(blocks.drop("blocks"), [*node, "block"])
               .select("name", *group, "h1", "h2", "rep", "copies", "v"))
    out_schema = T.StructType([reps.schema[c] for c in group] + [
        T.StructField(n, T.LongType()) for n in ("h1", "h2", "rep", "links", "root")])

    def compare(table: pa.Table) -> pa.Table:
        name, a, b = (table[c].to_numpy() for c in ("name", "a", "b"))
        left, right = np.flatnonzero(name == a), np.flatnonzero(name == b)
        same = a[0] == b[0]
        x = _matrix(table["v"])
        xa = _sides(x[left])
        xb = xa if same else _sides(x[right])
        found = linked(xa, xb, same, threshold)
        i, j = left[found[0]], right[found[1]]
        copies, rep = table["copies"].to_numpy(), table["rep"].to_numpy()
        links = np.zeros(len(rep), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        # number vectors by id, so that local classes are named by their smallest
        order = np.argsort(rep, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = rep[order[_local_roots(len(rep), np.stack([place[i], place[j]]))[place]]]
        hit = np.flatnonzero(links)
        got = table.select(["label", "dim", "h1", "h2", "rep"]).take(pa.array(hit))
        return got.append_column("links", pa.array(links[hit])).append_column("root", pa.array(root[hit]))

    found = sides.join(members, [*group, "name"]).groupBy(*group, "a", "b").applyInArrow(compare, out_schema)
    return staged(found, "links")


def _nothing(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()
