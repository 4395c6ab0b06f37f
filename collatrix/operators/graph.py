"""Similarity graphs: rank affinities, fusion, mutual edges, weights, components, communities."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.operators.ranking import in_order
from collatrix.session import materialize

MAX_ROUNDS = 60
#: So many links at most, 16 bytes each, have their components found in one task; more go in rounds.
ONE_TASK = 1 << 20


def rank_affinity(ranked: DataFrame, k: int) -> DataFrame:
    """(a, b, weight, mutual) with a < b from ranked neighbours (src, dst, rank).

    A direction weighs (k + 1 - rank) / k; an edge weighs its greater direction times
    0.35 + 0.65 times its lesser, which is 0 if the neighbour does not return it.
    """
    w = (F.lit(k + 1) - F.col("rank")) / F.lit(float(k))
    both = ranked.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w"))
    grouped = both.groupBy("a", "b").agg(F.max("w").alias("high"), F.min("w").alias("low"), F.count("*").alias("n"))
    low = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.col("low"))
    return grouped.select("a", "b", (F.col("high") * (F.lit(0.35) + F.lit(0.65) * low)).alias("weight"), (F.col("n") > 1).alias("mutual"))


def fuse(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, b, weight, n_views): mean of both views plus half of the lesser, over the union of edges."""
    x = first.select("a", "b", F.col("weight").alias("w1"))
    y = second.select("a", "b", F.col("weight").alias("w2"))
    zero = F.lit(0.0)
    joined = x.join(y, ["a", "b"], "full_outer").select("a", "b", F.coalesce("w1", zero).alias("w1"), F.coalesce("w2", zero).alias("w2"))
    weight = F.lit(0.5) * (F.col("w1") + F.col("w2")) + F.lit(0.5) * F.least("w1", "w2")
    return joined.select("a", "b", weight.alias("weight"), ((F.col("w1") > 0).cast("int") + (F.col("w2") > 0).cast("int")).alias("n_views"))


def mutual_edges(ranked: DataFrame) -> DataFrame:
    """(a, b, rank_a, rank_b) of neighbours that name each other."""
    ranked = materialize(ranked.select("src", "dst", "rank"), "ranked")
    there = ranked.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("rank").alias("rank_a"))
    back = ranked.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("rank").alias("rank_b"))
    return there.join(back, ["a", "b"]).where("a < b")


def endpoints(edges: DataFrame, *columns: str) -> DataFrame:
    """One row per end of each edge: (node, other, columns)."""
    one = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), *columns)
    return one.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), *columns))


def parent_normalized(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """(a, b, weight): 1 / rank of each end over the sum of its parent's ends; the mean of both ends.

    ``edges`` has (a, b, rank_a, rank_b), ``parents`` (node, parent); the ends of a parent weigh 1 in all.
    """
    ends = edges.select("a", "b", F.col("a").alias("node"), (F.lit(1.0) / F.col("rank_a")).alias("w"))
    ends = ends.unionByName(edges.select("a", "b", F.col("b").alias("node"), (F.lit(1.0) / F.col("rank_b")).alias("w")))
    ends = ends.join(parents, "node")
    mass = ends.groupBy("parent").agg(F.sum("w").alias("mass"))
    shares = ends.join(mass, "parent").withColumn("share", F.col("w") / F.col("mass"))
    return shares.groupBy("a", "b").agg((F.sum("share") / F.lit(2.0)).alias("weight"))


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of links (a, b): roots of both ends go under the lesser, until all links are inside."""
    links = [b[["a", "b"]].to_numpy(dtype=np.int64) for b in batches]
    nodes, ends = np.unique(np.concatenate([np.empty((0, 2), dtype=np.int64), *links]), return_inverse=True)
    root = np.arange(len(nodes))
    a, b = ends.reshape(-1, 2).T
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    yield pd.DataFrame({"node": nodes, "root": nodes[root]})


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the least node of its component.

    Each round takes the least label around a node, then the label of that label, so
    paths shrink by doubling. Labels are written in each round, which cuts the
    lineage; hubs are rows of a join that adaptive execution can split, and the
    minimum is combined before it is shuffled. Up to ``ONE_TASK`` links need no rounds.
    """
    links = materialize(links.where("a <> b").select("a", "b"), "links")
    if links.count() <= ONE_TASK and all(dict(links.dtypes)[c] in ("int", "bigint") for c in "ab"):
        schema = links.select(F.col("a").alias("node"), F.col("a").alias("root")).schema
        return materialize(links.coalesce(1).mapInPandas(_roots, schema), "labels")
    both = materialize(endpoints(links).distinct(), "both")
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "labels")
    for _ in range(MAX_ROUNDS):
        seen = both.join(labels.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        better = labels.join(seen, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = better.join(jump, "root", "left").select("node", "old", F.coalesce("far", "root").alias("root"))
        after = materialize(after, "labels")
        moved = after.where("old <> root").limit(1).count()
        labels = after.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, weight) of a maximum spanning forest, by rounds in which each tree takes its best edge out.

    Ties go to the least (a, b), which makes all edges distinct, so no round closes a circle.
    """
    edges = materialize(edges.select("a", "b", "weight"), "edges")
    nodes = endpoints(edges).select("node").distinct()
    labels = nodes.select("node", F.col("node").alias("root"))
    chosen = None
    for _ in range(MAX_ROUNDS):
        named = edges.join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        out = named.where("ra <> rb")
        order = F.struct((-F.col("weight")).alias("w"), "a", "b")
        ends = out.select("ra", order.alias("e")).unionByName(out.select(F.col("rb").alias("ra"), order.alias("e")))
        best = ends.groupBy("ra").agg(F.min("e").alias("e")).select("e.a", "e.b", (-F.col("e.w")).alias("weight")).distinct()
        best = materialize(best, "forest")
        if not best.limit(1).count():
            break
        chosen = best if chosen is None else chosen.unionByName(best).distinct()
        joined = connected_components(chosen)
        labels = materialize(nodes.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "trees")
    return chosen if chosen is not None else edges.limit(0)


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row with the quality of a partition (node, label): inner weight less what degrees would make."""
    named = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    degree = endpoints(edges, "weight").join(labels, "node").groupBy("label").agg(F.sum("weight").alias("d"))
    inner = named.where("la = lb").groupBy(F.col("la").alias("label")).agg(F.sum("weight").alias("w"))
    total = edges.agg(F.sum("weight").alias("m"))
    parts = degree.join(inner, "label", "left").crossJoin(F.broadcast(total))
    return parts.agg(F.sum(F.coalesce("w", F.lit(0.0)) / F.col("m") - F.lit(resolution) * (F.col("d") / (2 * F.col("m"))) ** 2).alias("quality"), F.count("*").alias("communities"))


class _Level:
    """A graph whose nodes stand for groups of nodes of the graph below: neighbours with weights, and degrees, inner edges included."""

    def __init__(self, near: list[dict[int, float]], degree: np.ndarray, total: float):
        self.near, self.degree, self.total = near, degree.tolist(), total

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int, total: float) -> _Level:
        near: list[dict[int, float]] = [{} for _ in range(n)]
        for x, y, w in zip(a.tolist(), b.tolist(), weight.tolist(), strict=True):
            if x != y:
                near[x][y] = near[x].get(y, 0.0) + w
                near[y][x] = near[y].get(x, 0.0) + w
        degree = np.bincount(a, weight, n) + np.bincount(b, weight, n)
        return cls(near, degree, total)

    def merged(self, group: np.ndarray) -> _Level:
        n = int(group.max()) + 1
        near: list[dict[int, float]] = [{} for _ in range(n)]
        for v, own in enumerate(self.near):
            x = int(group[v])
            for u, w in own.items():
                if (y := int(group[u])) != x:
                    near[x][y] = near[x].get(y, 0.0) + w
        return _Level(near, np.bincount(group, self.degree, n), self.total)

    def best(self, v: int, part: list[int], mass: list[float], resolution: float, inside: list[int] | None = None) -> tuple[int, float]:
        """The neighbouring part that a node, taken out of its own, gains most by, and what it gains over staying alone; ties to its own, then to the least."""
        gains: dict[int, float] = {}
        for u, w in self.near[v].items():
            if inside is None or inside[u] == inside[v]:
                c = part[u]
                gains[c] = gains.get(c, 0.0) + w
        here, pull = part[v], resolution * self.degree[v]
        choice, most = here, round(gains.pop(here, 0.0) - pull * mass[here] / self.total, 12)
        for c, gain in gains.items():
            value = gain - pull * mass[c] / self.total
            if value < most - 1e-11:
                continue  # Rounding cannot make it the best.
            value = round(value, 12)
            if value > most or (value == most and choice != here and c < choice):
                choice, most = c, value
        return choice, most

    def move(self, part: np.ndarray, resolution: float, rng) -> np.ndarray:
        """Nodes move to the part that gains most, as long as any does."""
        mass = np.bincount(part, self.degree, len(part)).tolist()
        part = part.tolist()
        queue = deque(rng.permutation(len(part)).tolist())
        waiting = set(queue)
        while queue:
            v = queue.pop()
            waiting.discard(v)
            here = part[v]
            mass[here] -= self.degree[v]
            to, _ = self.best(v, part, mass, resolution)
            mass[to] += self.degree[v]
            if to != here:
                part[v] = to
                again = [u for u in self.near[v] if part[u] != to and u not in waiting]
                waiting.update(again)
                queue.extendleft(reversed(again))
        return np.array(part)

    def refine(self, part: np.ndarray, resolution: float, rng) -> np.ndarray:
        """Each part built anew from single nodes: a node that is still alone joins a neighbouring piece of its part if that gains."""
        inside, piece, mass, size = part.tolist(), list(range(len(part))), list(self.degree), [1] * len(part)
        for v in rng.permutation(len(part)).tolist():
            if size[piece[v]] == 1:
                here = piece[v]
                mass[here] -= self.degree[v]
                to, gain = self.best(v, piece, mass, resolution, inside)
                to = to if gain > 0 else here
                piece[v] = to
                mass[to] += self.degree[v]
                size[here] -= 1
                size[to] += 1
        return np.array(piece)


def _numbered(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def _pieces(level: _Level, part: np.ndarray) -> np.ndarray:
    """Parts cut into what hangs together."""
    out = np.full(len(part), -1)
    for start in range(len(part)):
        if out[start] < 0:
            out[start], todo = start, [start]
            while todo:
                v = todo.pop()
                for u in level.near[v]:
                    if out[u] < 0 and part[u] == part[v]:
                        out[u] = start
                        todo.append(u)
    return _numbered(out)


def _leiden(pdf: pd.DataFrame, resolution: float, seed: int, total: float) -> np.ndarray:
    """(node, community) of one component: nodes move, communities are refined, and the refined pieces become the nodes of the next level.

    Repeated from what came out until no single node moves any more. ``total`` is the sum of degrees of the whole graph.
    """
    nodes, at = np.unique(np.r_[pdf["a"].to_numpy(), pdf["b"].to_numpy()], return_inverse=True)
    half = len(pdf)
    first = _Level.of(at[:half], at[half:], pdf["weight"].to_numpy(dtype=float), len(nodes), total)
    rng = np.random.default_rng(seed)
    out = np.arange(len(nodes))
    for _ in range(MAX_ROUNDS):
        level, stands_for, part = first, np.arange(len(nodes)), out
        while True:
            moved = level.move(part, resolution, rng)
            if level is first and (moved == part).all():
                return np.stack([nodes, out], axis=1)
            part = _numbered(moved)
            piece = _numbered(level.refine(part, resolution, rng))
            if int(part.max()) + 1 == len(part) or int(piece.max()) + 1 == len(piece):
                break
            home = np.empty(int(piece.max()) + 1, dtype=np.int64)
            home[piece] = part
            level, stands_for, part = level.merged(piece), piece[stands_for], home
        out = _pieces(first, part[stands_for])
    return np.stack([nodes, out], axis=1)


def _by_component(edges: DataFrame, roots: DataFrame):
    """Edges grouped by component. Few bytes can be much work, so the number of tasks does not shrink with them."""
    named = edges.join(roots.select(F.col("node").alias("a"), "root"), "a")
    return named.repartition(4 * edges.sparkSession.sparkContext.defaultParallelism, "root").groupBy("root")


def _degree_sum(edges: DataFrame) -> float:
    return 2.0 * (edges.agg(F.sum("weight").alias("w")).first()["w"] or 0.0) or 1.0


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 11) -> DataFrame:
    """(node, label) of communities by local moving, refinement and merging for weighted modularity, one task per connected component.

    Every community is connected. Labels are numbered by size, then by least node. A component must fit in a task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _leiden(pdf, resolution, seed, total)
        return pd.DataFrame({"node": found[:, 0], "root": int(pdf["root"].iloc[0]), "part": found[:, 1]})

    edges = materialize(edges.select("a", "b", "weight"), "edges")
    total = _degree_sum(edges)
    parts = materialize(_by_component(edges, connected_components(edges)).applyInPandas(run, "node long, root long, part long"), "parts")
    size = parts.groupBy("root", "part").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    ranked = in_order(size, [F.desc("n"), F.col("first")], rank="place").select("root", "part", (F.col("place") - 1).alias("label"))
    return parts.join(ranked, ["root", "part"]).select("node", "label")


def capped_extra_edges(edges: DataFrame, forest: DataFrame, most: int = 2) -> DataFrame:
    """Edges outside the forest, from the heaviest, while both ends have fewer than ``most`` of them.

    The order decides, but only inside a component of the forest: one task per component.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[int, int] = {}
        keep = []
        for r in pdf.sort_values(["weight", "a", "b"], ascending=False).itertuples():
            if used.get(r.a, 0) < most and used.get(r.b, 0) < most:
                used[r.a], used[r.b] = used.get(r.a, 0) + 1, used.get(r.b, 0) + 1
                keep.append((r.a, r.b, r.weight))
        return pd.DataFrame(keep, columns=["a", "b", "weight"])

    rest = edges.select("a", "b", "weight").join(forest.select("a", "b"), ["a", "b"], "left_anti")
    roots = connected_components(forest).select(F.col("node").alias("a"), "root")
    return rest.join(roots, "a").groupBy("root").applyInPandas(run, "a long, b long, weight double")


def sensitivity(edges: DataFrame, resolutions: tuple[float, ...] = (0.5, 1.0, 2.0), seeds: tuple[int, ...] = (7, 11, 13)) -> DataFrame:
    """(resolution, seed, node, label): the communities of every setting; components are found once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in resolutions:
            for s in seeds:
                found = _leiden(pdf, r, s, total)
                out.append(pd.DataFrame({"resolution": r, "seed": s, "node": found[:, 0], "root": int(pdf["root"].iloc[0]), "part": found[:, 1]}))
        return pd.concat(out)

    edges = materialize(edges.select("a", "b", "weight"), "edges")
    total = _degree_sum(edges)
    parts = materialize(_by_component(edges, connected_components(edges)).applyInPandas(run, "resolution double, seed long, node long, root long, part long"), "parts")
    size = parts.groupBy("resolution", "seed", "root", "part").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    order = W.partitionBy("resolution", "seed").orderBy(F.desc("n"), "first")
    ranked = size.withColumn("label", F.row_number().over(order) - 1)
    return parts.join(ranked, ["resolution", "seed", "root", "part"]).select("resolution", "seed", "node", "label")


def disconnected_communities(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, pieces) of communities that fall apart when only their own edges are left."""
    named = edges.select("a", "b").join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    inner = connected_components(named.where("la = lb").select("a", "b"))
    pieces = labels.join(inner, "node", "left").groupBy("label").agg(F.countDistinct(F.coalesce("root", "node")).alias("pieces"))
    return pieces.where("pieces > 1")


def hash_groups(df: DataFrame, key: str, value: str, most: int = 5, bits: int = 64) -> DataFrame:
    """(key, group): rows whose hashes, whole numbers, differ in ``most`` bits at most are linked, and the least key names what hangs together.

    Of ``most`` + 1 pieces of two such hashes at least one is equal, so hashes meet by piece and are then compared. Rows of one hash meet as one.
    """
    rows = df.select(F.col(key).alias("node"), F.col(value).cast("long").alias("h"))
    heads = materialize(rows.groupBy("h").agg(F.min("node").alias("head")), "hashes")
    cuts = [round(i * bits / (most + 1)) for i in range(most + 2)]
    pieces = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("h", a).bitwiseAND(F.lit((1 << (z - a)) - 1)).alias("x")) for i, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    dealt = heads.select("head", "h", F.explode(F.array(*pieces)).alias("piece"))
    a, b = (dealt.select("piece", F.col("head").alias(t), F.col("h").alias(f"h_{t}")) for t in "ab")
    near = a.join(b, "piece").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b"))) <= most)).select("a", "b").distinct()
    roots = connected_components(near).select(F.col("node").alias("head"), "root")
    named = heads.join(roots, "head", "left").select("h", F.coalesce("root", "head").alias("group"))
    return rows.join(named, "h").select(F.col("node").alias(key), "group")
