"""Exact vector search in blocks.

Vectors are packed into blocks of bounded size; each task multiplies one block of
queries with blocks of candidates and returns the best few of each query, so
what is shuffled is blocks and short lists, never pairs. Scores are rounded to
``DIGITS`` decimals before they are ranked, so that ties go to the least id
whatever the order of summation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 9
BLOCK = 2048


def rounded(x: np.ndarray) -> np.ndarray:
    """Numbers at ``DIGITS`` decimals, halves away from zero as in SQL."""
    scaled = x * 10.0**DIGITS
    return np.where(np.abs(scaled) < 2.0**52, np.trunc(scaled + np.copysign(0.5, scaled)) / 10.0**DIGITS + 0.0, x)


def block_count(df: DataFrame, block: int | None = None) -> int:
    return max(1, -(-df.count() // (block or BLOCK)))


def pack(df: DataFrame, blocks: int) -> DataFrame:
    """(block, ids, parents, families, dim, vectors) of rows (id, parent, family, v): one row per block, in order of ids."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        matrix = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        cells = [pdf[c].to_numpy(dtype=np.int64).tobytes() for c in ("id", "parent", "family")]
        return pd.DataFrame([(int(pdf["block"].iloc[0]), *cells, matrix.shape[1], matrix.tobytes())], columns=["block", "ids", "parents", "families", "dim", "vectors"])

    dealt = df.select("id", "parent", "family", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").applyInPandas(run, "block long, ids binary, parents binary, families binary, dim int, vectors binary")


class _Block:
    """Ids, parents and families as three rows, vectors, and the greatest length of a vector."""

    def __init__(self, r):
        self.cells = np.stack([np.frombuffer(c, dtype=np.int64) for c in (r.ids, r.parents, r.families)])
        self.v = np.frombuffer(r.vectors, dtype=np.float64).reshape(-1, r.dim)
        norms = np.sqrt((self.v * self.v).sum(axis=1))
        self.norm = float(norms[np.isfinite(norms)].max(initial=0.0))


class _Nearest:
    """The best ``k`` items so far of each query of a block: similarities, and cells of the items, best first."""

    def __init__(self, queries: _Block, k: int, other: int):
        self.queries, self.k, self.other = queries, k, other
        self.sim = np.full((len(queries.v), k), -np.inf)
        self.hit = np.zeros((3, len(queries.v), k), dtype=np.int64)

    def add(self, items: _Block) -> None:
        """Items that short floats, off by less than ``slack``, leave in question are compared in full."""
        q, x = self.queries, items
        kind = np.float32 if q.norm * x.norm < 1e30 else np.float64
        slack = 1e-5 * q.norm * x.norm + 10.0**-DIGITS
        rough = q.v.astype(kind) @ x.v.astype(kind).T
        floor = self.sim[:, -1]
        if np.isneginf(floor).any() and len(x.v) > self.k:
            open_ = rough.copy()
            open_[(q.cells[self.other][:, None] == x.cells[self.other][None, :]) | ~np.isfinite(open_)] = -np.inf
            floor = np.maximum(floor, np.partition(open_, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero(rough >= (floor - slack).astype(kind)[:, None])
        fine = q.cells[self.other][row] != x.cells[self.other][col]
        row, col = row[fine], col[fine]
        step = 1 << 17
        sim = rounded(np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q.v[row[a : a + step]], x.v[col[a : a + step]]) for a in range(0, len(row), step)]]))
        fine = np.isfinite(sim) & (sim >= self.sim[row, -1])
        self._merge(row[fine], sim[fine], x.cells[:, col[fine]])

    def _merge(self, row: np.ndarray, sim: np.ndarray, hit: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.unique(row)
        row = np.r_[row, np.repeat(touched, self.k)]
        sim = np.r_[sim, self.sim[touched].reshape(-1)]
        hit = np.concatenate([hit, self.hit[:, touched].reshape(3, -1)], axis=1)
        order = np.lexsort((hit[0], -sim, row))
        row, sim, hit = row[order], sim[order], hit[:, order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        self.sim[row[best], place[best]] = sim[best]
        self.hit[:, row[best], place[best]] = hit[:, best]

    def found(self) -> pd.DataFrame:
        at, to = np.nonzero(np.isfinite(self.sim))
        dst, parent, family = self.hit[:, at, to]
        return pd.DataFrame({"src": self.queries.cells[0][at], "dst": dst, "dst_parent": parent, "dst_family": family, "sim": self.sim[at, to]})


def _best_per(q: _Block, x: _Block, k: int, other: int, per: int) -> pd.DataFrame:
    """The best ``k`` items of each kind in a block, for each query."""
    sims = rounded(q.v @ x.v.T)
    sims[q.cells[other][:, None] == x.cells[other][None, :]] = -np.inf
    src, dst, kinds = [], [], x.cells[per]
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        order = at[np.argsort(-sims[:, at], axis=1, kind="stable")[:, :k]]
        src.append(np.repeat(np.arange(len(sims)), order.shape[1]))
        dst.append(order.reshape(-1))
    src, dst = np.concatenate(src), np.concatenate(dst)
    sim = sims[src, dst]
    fine = np.isfinite(sim)
    src, dst, sim = src[fine], dst[fine], sim[fine]
    return pd.DataFrame({"src": q.cells[0][src], "dst": x.cells[0][dst], "dst_parent": x.cells[1][dst], "dst_family": x.cells[2][dst], "sim": sim})


def search(queries: DataFrame, items: DataFrame, k: int, other: str = "id", per: str | None = None) -> DataFrame:
    """(src, dst, dst_parent, dst_family, sim): for each query its best ``k`` items, or best ``k`` per ``per``.

    ``other`` names the column in which a query and its hits must differ. A task holds a block of
    queries and goes through blocks of items; what an item must reach rises as better ones are found.
    """
    at = {"id": 0, "parent": 1, "family": 2}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.block < 0:
                    if held is not None and per is None:
                        yield held.found()
                    held, key = _Nearest(_Block(r), k, at[other]), (r.q_block, r.part)
                elif key != (r.q_block, r.part):
                    continue  # No query has a hash of this block.
                elif per is None:
                    held.add(_Block(r))
                else:
                    yield _best_per(held.queries, _Block(r), k, at[other], at[per])
        if held is not None and per is None:
            yield held.found()

    q_blocks, blocks = block_count(queries), block_count(items)
    # Few blocks of queries go through parts of the items, so that all cores have work.
    parts = min(blocks, -(-2 * items.sparkSession.sparkContext.defaultParallelism // q_blocks))
    columns = ("block", "ids", "parents", "families", "dim", "vectors")
    left = pack(queries, q_blocks).withColumn("q_block", F.col("block")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).withColumn("block", F.lit(-1).cast("long"))
    right = pack(items, blocks).withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long")))).withColumn("part", F.pmod("block", F.lit(parts)))
    met = left.select("q_block", "part", *columns).unionByName(right.select("q_block", "part", *columns))
    dealt = met.repartition("q_block", "part").sortWithinPartitions("q_block", "part", "block")
    found = dealt.mapInPandas(run, "src long, dst long, dst_parent long, dst_family long, sim double")
    keys = ["src"] + ([f"dst_{per}"] if per else [])
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("sim"), "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def group_distinct(found: DataFrame, k: int) -> DataFrame:
    """The best hit of each other parent, and of these the first ``k``; from the best per parent."""
    one = found.where("rank = 1").drop("rank")
    return one.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc("sim"), "dst"))).where(F.col("rank") <= k)


def prefer_context(best: DataFrame, across: DataFrame) -> DataFrame:
    """(src, dst, dst_family, sim): a family's best hit in another context where it has one, or else its best hit.

    Both are the best hits per family: ``best`` of all items, ``across`` of those in other contexts.
    """
    other = across.select("src", "dst_family", F.struct("dst", "sim").alias("other"))
    joined = best.select("src", "dst_family", F.struct("dst", "sim").alias("own")).join(other, ["src", "dst_family"], "left")
    hit = F.coalesce("other", "own")
    return joined.select("src", hit["dst"].alias("dst"), "dst_family", hit["sim"].alias("sim"))
