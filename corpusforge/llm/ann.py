"""Approximate nearest neighbours: small-world graphs by shard (operator 8).

Vectors are dealt into shards by hash; each shard's task builds a hierarchical
navigable small-world graph, which is stored as flat neighbour arrays. A query
searches every shard's graph, and the shards' results are merged. Equal
vectors are one node, however many rows have it.

Shards are as large as a task's memory allows, as a search costs little more
in a large graph than in a small one. A shard's index moves once, to the task
that streams all queries past it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

#: Bounds of a shard: vectors, and bytes of them. Small tables are built in so many tasks.
SHARD_ROWS, SHARD_BYTES, LEAST_SHARDS = 65_536, 32 << 20, 8
LINKS = 12  # of a node on an upper level; twice as many on the lowest
BUILD_BREADTH, SEARCH_BREADTH = 64, 80


class SmallWorld:
    """One graph. ``links[l]`` is a (nodes x width) array of neighbours on level
    l, -1 where there is none; ``entry`` is a node of the highest level."""

    def __init__(self, unit: np.ndarray, links: list[np.ndarray], entry: int):
        self.unit, self.links, self.entry = unit, links, entry

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 3) -> SmallWorld:
        rng = np.random.default_rng(seed)
        unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
        n = len(unit)
        level_of = np.floor(-np.log(1 - rng.random(n)) / math.log(LINKS)).astype(int)
        top = int(level_of.max())
        # some room beyond the wanted degree, so that lists are pruned rarely
        graph = cls(unit, [np.full((n, 3 * LINKS if lv == 0 else 2 * LINKS), -1, np.int32) for lv in range(top + 1)], 0)
        degree = np.zeros((top + 1, n), dtype=np.int32)
        reached = -1
        for node in range(n):
            level = int(level_of[node])
            if reached >= 0:
                at = [graph.entry]
                for lv in range(reached, level, -1):
                    at = [graph._search(unit[node], at, 1, lv)[0][1]]
                for lv in range(min(level, reached), -1, -1):
                    found = graph._search(unit[node], at, BUILD_BREADTH, lv)
                    at = [x for _, x in found]
                    for other in graph._spread(node, np.array(at), LINKS):
                        graph._link(node, int(other), lv, degree)
                        graph._link(int(other), node, lv, degree)
            if level > reached:
                reached, graph.entry = level, node
        return graph

    def _spread(self, node: int, near: np.ndarray, most: int) -> np.ndarray:
        """Of neighbours, nearest first, those nearer to the node than to any
        taken before; then the nearest others, up to ``most``."""
        to_node = self.unit[near] @ self.unit[node]
        order = np.argsort(-to_node, kind="stable")
        near, to_node = near[order], to_node[order]
        among = self.unit[near] @ self.unit[near].T
        closest = np.full(len(near), -2.0)
        taken, left = [], []
        for i in range(len(near)):
            if len(taken) == most:
                break
            if closest[i] <= to_node[i]:
                taken.append(i)
                np.maximum(closest, among[i], out=closest)
            else:
                left.append(i)
        return near[taken + left[: most - len(taken)]]

    def _link(self, node: int, other: int, level: int, degree: np.ndarray) -> None:
        row, have = self.links[level][node], degree[level, node]
        if other in row[:have]:
            return
        if have == len(row):
            kept = self._spread(node, np.append(row, other), 2 * LINKS if level == 0 else LINKS)
            row[:] = -1
            row[: len(kept)] = kept
            degree[level, node] = len(kept)
        else:
            row[have] = other
            degree[level, node] += 1

    def _search(self, query: np.ndarray, entries: list[int], breadth: int, level: int) -> list[tuple[float, int]]:
        """The nearest nodes found on a level, (-similarity, node), nearest first."""
        links, unit = self.links[level], self.unit
        seen = set(entries)
        sims = unit[entries] @ query
        ahead = [(-float(s), x) for s, x in zip(sims, entries, strict=True)]
        heapq.heapify(ahead)
        best = [(-d, x) for d, x in ahead]
        heapq.heapify(best)
        while len(best) > breadth:
            heapq.heappop(best)
        while ahead:
            d, x = heapq.heappop(ahead)
            if len(best) >= breadth and -d < best[0][0]:
                break
            new = [y for y in links[x].tolist() if y >= 0 and y not in seen]
            if not new:
                continue
            seen.update(new)
            for s, y in zip((unit[new] @ query).tolist(), new, strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (s, y))
                    heapq.heappush(ahead, (-s, y))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, y))
                    heapq.heappush(ahead, (-s, y))
        return sorted((-s, x) for s, x in best)

    def nearest(self, query: np.ndarray, k: int) -> list[int]:
        q = (query / np.linalg.norm(query)).astype(np.float32)
        at = [self.entry]
        for level in range(len(self.links) - 1, 0, -1):
            at = [self._search(q, at, 1, level)[0][1]]
        return [x for _, x in self._search(q, at, max(SEARCH_BREADTH, k), 0)[:k]]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of a vector and each of some, in double precision."""
    return (b * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))


_INDEX = "dims int, shard int, keys array<binary>, vectors binary, entry int, widths array<int>, links binary"


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("vkey")  # the graph does not depend on the order of arrival
    vectors = _matrix(table["vec"])
    graph = SmallWorld.build(vectors)
    return pa.table(
        {
            "dims": table["dims"].slice(0, 1),
            "shard": table["shard"].slice(0, 1),
            "keys": pa.array([table["vkey"].to_pylist()], pa.list_(pa.binary())),
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "entry": pa.array([graph.entry], pa.int32()),
            "widths": pa.array([[x.shape[1] for x in graph.links]], pa.list_(pa.int32())),
            "links": pa.array([b"".join(x.tobytes() for x in graph.links)], pa.binary()),
        }
    )


def _load(row: dict) -> tuple[SmallWorld, np.ndarray]:
    n = len(row["keys"])
    vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(n, -1)
    flat, links, at = np.frombuffer(row["links"], dtype=np.int32), [], 0
    for width in row["widths"]:
        links.append(flat[at : at + n * width].reshape(n, width))
        at += n * width
    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    return SmallWorld(unit, links, row["entry"]), vectors


def _searcher(k: int):
    """Shards in a row, each its index followed by the queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, vectors, keys, of = None, None, None, None
        for batch in batches:
            shards = list(zip(batch.column("dims").to_pylist(), batch.column("shard").to_pylist(), strict=True))
            out: tuple[list, list, list] = ([], [], [])
            for i, here in enumerate(shards):
                if batch.column("keys")[i].is_valid:
                    row = {name: batch.column(name)[i].as_py() for name in ("keys", "vectors", "entry", "widths", "links")}
                    (graph, vectors), keys, of = _load(row), row["keys"], here
                elif of == here:  # a shard of other dimensions may have no index
                    query = np.array(batch.column("vec")[i].as_py())
                    found = graph.nearest(query, k)
                    out[0].extend([batch.column("qkey")[i].as_py()] * len(found))
                    out[1].extend(keys[x] for x in found)
                    out[2].extend(cosine(query, vectors[found]).tolist())
            types = (pa.binary(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["qkey", "vkey", "score"])

    return search


def nearest_neighbours(rows: DataFrame, id_col: str, vector_col: str, is_query, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, id_col, score): for each row that ``is_query`` (a Column) holds
    for, the ``k`` nearest other rows found by cosine, nearest first, ties to
    the smaller id; fewer where fewer rows take part.

    Rows take no part if the id is null, or the vector is null, empty, all zero
    or holds a null or non-finite component. Vectors of different lengths are
    never compared. Repeated rows of an id count once. Every vector is
    indexed. An empty table, or one without queries, gives an empty result. Scores are double-precision cosines of the original vectors;
    only the search is approximate."""
    scratch = Scratch(rows.sparkSession, "ann")
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    usable = (
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    known = rows.select(F.col(id_col).alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    name = F.unhex(F.md5(F.array_join(F.col("vec").cast("array<string>"), ",").cast("binary")))
    known = known.where(usable).withColumn("vkey", name)
    known = scratch.cut(known, "known")
    # of equal vectors, the k + 1 smallest ids can be results (one may be the query's own)
    distinct = known.select("vkey", "id").distinct()
    place = Window.partitionBy("vkey").orderBy("id")
    owners = distinct.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1)
    owners = scratch.cut(owners.groupBy("vkey").agg(F.sort_array(F.collect_list("id")).alias("ids")), "owners")
    vectors = known.groupBy("vkey", "vec").agg(F.max(F.col("asks").cast("int")).alias("asks"))
    held = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    most = max(1, min(shard_rows, SHARD_BYTES // (8 * max(held.dims or 1, 1))))
    shards = max(LEAST_SHARDS, math.ceil(held.n / most))
    shard = F.pmod(F.xxhash64("vkey"), F.lit(shards)).cast("int")
    vectors = scratch.cut(vectors.withColumns({"dims": F.size("vec"), "shard": shard}), "vectors")
    index = vectors.select("dims", "shard", "vkey", "vec").groupBy("dims", "shard").applyInArrow(_build, _INDEX)
    index = scratch.cut(index, "index")

    asked = vectors.where("asks = 1").select("dims", F.col("vkey").alias("qkey"), "vec")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = index.unionByName(asked, allowMissingColumns=True).repartition(shards, "dims", "shard")
    ordered = both.sortWithinPartitions("dims", "shard", F.col("keys").isNull(), "qkey")
    found = ordered.mapInArrow(_searcher(k + 1), "qkey binary, vkey binary, score double")
    # per query vector, the k + 1 best (score, id); each query drops itself
    nearest = Window.partitionBy("qkey").orderBy(F.col("score").desc(), "id")
    merged = found.join(owners, "vkey").select("qkey", "score", F.explode("ids").alias("id"))
    merged = merged.withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= k + 1)
    merged = merged.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct("_n", "id", "score"))).alias("found"))
    queries = known.where("asks").select(F.col("id").alias("query_id"), F.col("vkey").alias("qkey")).distinct()
    out = queries.join(scratch.cut(merged, "merged"), "qkey")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias(id_col), F.col("hit.score").alias("score"))
