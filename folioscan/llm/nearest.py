"""Approximate nearest neighbours by largest inner product: HNSW graphs in shards.

1. Vectors with equal components are one point, so that copies do not fill each other's
   neighbour lists; a point keeps its ``k`` + 1 smallest ids, as no further one can be among
   the ``k`` nearest of any query (of an id's equal vectors, one).
2. Points are dealt to shards of about ``shard_size`` by length (its binary order of magnitude,
   so that long vectors do not blur the others) and by a hash of their components. Each
   shard is built in a task of its own: a hierarchical navigable small-world graph whose
   layers are flat arrays of neighbour numbers. Points go in from the highest layer to the
   lowest, in groups that search the graph so far at once; neighbours are chosen by
   Malkov and Yashunin's heuristic, and full lists are chosen anew by the same rule.
   Inner products become distances by one more component, the square root of what is
   missing to the longest vector of the shard (queries have 0 there).
   The graph is written as rows of some hundred points: components, ids and neighbours.
3. Queries come in blocks. Every block meets every shard by an equal join on the shard's
   number, made from the blocks (so pairs of blocks and shards, not of vectors, are rows).
   A task streams the graph, then the blocks that came for it.
4. Each shard gives its nearest for a query, with the inner product of the original
   vectors in double precision, summed in the order of the components. The lists of all
   shards are merged.

Work at query time grows with queries times shards, as every row is searched; larger
shards make it less, at the price of longer builds and more memory in a task (about
``shard_size`` * (4 * dimension + 4 * ``CAPACITY``) bytes).

Rules: vectors that are null, empty, all zero or hold a null or non-finite component take
no part, nor do null ids. Vectors meet only vectors of their own length. A query with an
id's vector never finds that id; if an id occurs with several vectors, each is a point and a
query, and all rows of that id count as the query's own. Ties go to the smaller id. With
fewer than ``k`` candidates all are returned. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.session import ship_package, written

NEAREST = 20
SHARD_SIZE = 8192
LINKS = 16
CAPACITY = 3 * LINKS  # of a list on the lowest layer; a list that is full is cut to 2 * LINKS
EF_BUILD = 96
EF_SEARCH = 128
GROUP = 256
EXPANDED = 4
PIECE = 256
BLOCK = 512
QUERIES_AT_ONCE = 1 << 15  # of a task


class Graph:
    """Points in the order of their layers, highest first, so layer l has the points 0 to sizes[l] - 1."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, lists: list[np.ndarray] | None = None) -> None:
        scaled = vectors / np.abs(vectors).max(initial=1e-300)
        norms = np.einsum("ij,ij->i", scaled, scaled)
        longest = norms.max(initial=0)
        self.points = (np.c_[scaled, np.sqrt(longest - norms)] / np.sqrt(longest)).astype(np.float32)
        self.sizes = [int((levels >= level).sum()) for level in range(int(levels.max(initial=0)) + 1)]
        self.lists = lists if lists is not None else [np.full((n, CAPACITY), -1, np.int32) for n in self.sizes]

    def distances(self, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Half the squared distance to points of one length, up to a constant: less is nearer."""
        return -np.einsum("ij,ij->i", queries[rows], self.points[ids])

    def search(self, queries: np.ndarray, level: int, ef: int, starts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest found on a layer among its first ``limit`` points, and how near: ids and distances, nearest first; -1 where there are fewer.

        All queries go on at the same time: each expands its nearest points that are not
        expanded yet, until all points of its list are.
        """
        n, lists = len(queries), self.lists[level]
        all_rows = np.arange(n)
        ids = np.full((n, ef), -1, np.int64)
        dist = np.full((n, ef), np.inf, np.float32)
        todo = np.zeros((n, ef), bool)
        seen = np.zeros((n, limit + 1), bool)  # the last one stands for no point
        width = starts.shape[1]
        for at in range(min(width, ef)):
            own = np.where(starts[:, at] >= 0, starts[:, at], limit)
            fresh = ~seen[all_rows, own] & (own < limit)
            seen[all_rows, own] = True
            rows = all_rows[fresh]
            ids[rows, at], todo[rows, at] = own[rows], True
            dist[rows, at] = self.distances(queries, rows, own[rows])
        active = all_rows
        while len(active):
            waiting = np.where(todo[active], dist[active], np.inf)
            take = min(EXPANDED, ef)
            chosen = np.argpartition(waiting, take - 1, axis=1)[:, :take] if take < ef else np.tile(np.arange(ef), (len(active), 1))
            real = np.take_along_axis(todo[active], chosen, 1)
            todo[active[:, None], chosen] = False
            near = lists[np.where(real, ids[active[:, None], chosen], 0)]
            near = np.where(real[:, :, None] & (near >= 0) & (near < limit), near, limit)
            fresh = np.zeros(near.shape, bool)
            for at in range(take):
                mine = near[:, at]
                fresh[:, at] = ~seen[active[:, None], mine] & (mine < limit)
                seen[active[:, None], mine] = True
            near, fresh = near.reshape(len(active), -1), fresh.reshape(len(active), -1)
            rows, columns = np.nonzero(fresh)
            found = near[rows, columns]
            d = np.full(near.shape, np.inf, np.float32)
            d[rows, columns] = self.distances(queries, active[rows], found)
            both = np.concatenate([dist[active], d], 1)
            keep = np.argpartition(both, ef - 1, axis=1)[:, :ef]
            dist[active] = np.take_along_axis(both, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, near, -1)], 1), keep, 1)
            todo[active] = np.take_along_axis(np.concatenate([todo[active], fresh], 1), keep, 1)
            active = active[todo[active].any(1)]
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def down(self, queries: np.ndarray, level: int, limit: int) -> np.ndarray:
        """Where a search on a layer begins: what the layers above lead to."""
        starts = np.zeros((len(queries), 1), np.int64)
        for above in range(len(self.sizes) - 1, level, -1):
            if min(self.sizes[above], limit) > 1:
                starts = self.search(queries, above, 4, starts, min(self.sizes[above], limit))[0]
        return starts

    def diverse(self, points: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Of candidates, nearest first: those nearer to the point than to any that is chosen before; then the nearest of the others."""
        n, width = ids.shape
        real = ids >= 0
        vectors = self.points[np.maximum(ids, 0)]
        between = -np.matmul(vectors, vectors.transpose(0, 2, 1))
        half = np.einsum("nij,nij->ni", vectors, vectors) / 2
        between += half[:, :, None] + half[:, None, :]
        own = dist + half + (np.einsum("ij,ij->i", points, points) / 2)[:, None]
        chosen = np.zeros((n, width), bool)
        for at in range(width):
            hidden = (chosen & (between[:, at] < own[:, at, None])).any(1)
            chosen[:, at] = real[:, at] & ~hidden & (chosen.sum(1) < most)
        order = np.argsort(np.where(chosen, 0, 1) + 2 * ~real, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(real, order, 1), np.take_along_axis(ids, order, 1), -1)

    def insert(self, first: int, end: int, level: int) -> None:
        """Link the points first to end - 1 on a layer with those before them, and with each other."""
        group = self.points[first:end]
        n = end - first
        ids = np.zeros((n, 0), np.int64)
        dist = np.zeros((n, 0), np.float32)
        if first:
            ids, dist = self.search(group, level, EF_BUILD, self.down(group, level, first), first)
        mates = -(group @ group.T).astype(np.float32)
        np.fill_diagonal(mates, np.inf)
        ids = np.concatenate([ids, np.tile(np.arange(first, end), (n, 1))], 1)
        ids[np.arange(n), ids.shape[1] - n + np.arange(n)] = -1
        dist = np.concatenate([dist, mates], 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :EF_BUILD]
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        lists = self.lists[level]
        linked = self.diverse(group, ids, dist, LINKS)
        lists[first:end, : linked.shape[1]] = linked
        rows, columns = np.nonzero(linked >= 0)
        self.link_back(level, linked[rows, columns], first + rows)

    def link_back(self, level: int, to: np.ndarray, new: np.ndarray) -> None:
        """Add ``new`` to the lists of ``to``; lists that get too long are chosen anew."""
        lists = self.lists[level]
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        heads, begins, counts = np.unique(to, return_index=True, return_counts=True)
        for part in range(0, len(heads), 1024):
            some = slice(part, part + 1024)
            self._link_back(lists, heads[some], begins[some], counts[some], new)

    def _link_back(self, lists: np.ndarray, heads: np.ndarray, begins: np.ndarray, counts: np.ndarray, new: np.ndarray) -> None:
        width = CAPACITY + int(counts.max())
        merged = np.full((len(heads), width), -1, np.int64)
        merged[:, :CAPACITY] = lists[heads]
        rows = np.repeat(np.arange(len(heads)), counts)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        known = (lists[heads] >= 0).sum(1)
        added = new[np.repeat(begins, counts) + within]
        twice = (lists[heads[rows]] == added[:, None]).any(1)
        merged[rows, known[rows] + within] = np.where(twice, -1, added)
        sizes = (merged >= 0).sum(1)
        front = np.argsort(merged < 0, axis=1, kind="stable")
        merged = np.take_along_axis(merged, front, 1)
        fits = sizes <= CAPACITY
        lists[heads[fits]] = merged[fits, :CAPACITY]
        full = np.flatnonzero(~fits)
        for start in range(0, len(full), 256):
            some = full[start : start + 256]
            own, ids = self.points[heads[some]], merged[some][:, : sizes[some].max()]
            dist = np.full(ids.shape, np.inf, np.float32)
            rows, columns = np.nonzero(ids >= 0)
            dist[rows, columns] = self.distances(own, rows, ids[rows, columns])
            order = np.argsort(dist, axis=1, kind="stable")[:, : 2 * CAPACITY]
            cut = self.diverse(own, np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), 2 * LINKS)
            lists[heads[some]] = -1
            lists[heads[some], : cut.shape[1]] = cut

    @classmethod
    def build(cls, vectors: np.ndarray, levels: np.ndarray) -> Graph:
        graph = cls(vectors, levels)
        for level in range(len(graph.sizes) - 1, -1, -1):
            size, above = graph.sizes[level], graph.sizes[level + 1] if level + 1 < len(graph.sizes) else 0
            first, end = 0, min(size, max(64, min(above, 4 * GROUP)))
            while first < size:
                graph.insert(first, end, level)
                first, end = end, min(size, 2 * end, end + GROUP)
        return graph


def levels_of(n: int) -> np.ndarray:
    """Highest layers of n points, highest first: layers thin out by 1 / LINKS, in equal steps of probability."""
    steps = (np.arange(n) + 0.5) / max(n, 1)
    return np.floor(-np.log(steps) / np.log(LINKS)).astype(np.int64)


def inner(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products row by row, in double precision, summed from the first component to the last."""
    total = np.zeros(len(queries))
    for at in range(queries.shape[1]):
        total += queries[:, at] * vectors[:, at]
    return total


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


_GRAPH = "width int, scale int, shard long, kind int, piece int, vectors binary, ids binary, links binary"


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points sorted by shard to graphs, one shard after the other."""
    held: list[tuple[np.ndarray, list[int]]] = []
    key = None

    def graph() -> pa.RecordBatch:
        vectors = np.stack([v for v, _ in held])
        built = Graph.build(vectors, levels_of(len(held)))
        rows = []
        for piece, start in enumerate(range(0, len(held), PIECE)):
            end = start + PIECE
            ids = b"".join(struct.pack(f"<{1 + len(own)}q", len(own), *own) for _, own in held[start:end])
            links = b"".join(np.ascontiguousarray(lists[start:end]).tobytes() for lists in built.lists)
            rows.append((*key, 0, piece, vectors[start:end].tobytes(), ids, links))
        return _rows(rows)

    for batch in batches:
        keys = zip(*(batch.column(name).to_pylist() for name in ("width", "scale", "shard")))
        for own, vector, ids in zip(keys, _vectors(batch.column("v")), batch.column("ids").to_pylist()):
            if key != own:
                if held:
                    yield graph()
                key, held = own, []
            held.append((vector, ids))
    if held:
        yield graph()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries to blocks of queries of one length; ids hold pairs of an id and a hash."""
    held: dict[int, list[tuple]] = {}

    def block(width: int) -> pa.RecordBatch:
        some = held.pop(width)
        ids = np.array([one[:2] for one in some], np.int64).tobytes()
        return _rows([(width, None, None, 1, 0, np.concatenate([v for _, _, v in some]).tobytes(), ids, None)])

    for batch in batches:
        for width, vec_id, code, vector in zip(
            batch.column("width").to_pylist(), batch.column("id").to_pylist(), batch.column("h1").to_pylist(), _vectors(batch.column("v"))
        ):
            held.setdefault(width, []).append((vec_id, code, vector))
            if len(held[width]) == BLOCK:
                yield block(width)
    for width in list(held):
        yield block(width)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["width", "scale", "shard", "kind", "piece", "vectors", "ids", "links"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def _loaded(pieces: list[dict]) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """The graph, its vectors, all ids, and where each point's ids begin."""
    width = pieces[0]["width"]
    vectors = np.frombuffer(b"".join(p["vectors"] for p in pieces)).reshape(-1, width)
    levels = levels_of(len(vectors))
    sizes = [int((levels >= level).sum()) for level in range(int(levels.max()) + 1)]
    parts: list[list[np.ndarray]] = [[] for _ in sizes]
    for number, piece in enumerate(pieces):
        flat, at = np.frombuffer(piece["links"], np.int32).reshape(-1, CAPACITY), 0
        for level, size in enumerate(sizes):
            n = max(0, min(size - number * PIECE, PIECE))
            parts[level].append(flat[at : at + n])
            at += n
    raw, ids, begins = np.frombuffer(b"".join(p["ids"] for p in pieces), np.int64), [], [0]
    at = 0
    for _ in range(len(vectors)):
        n = int(raw[at])
        ids.append(raw[at + 1 : at + 1 + n])
        begins.append(begins[-1] + n)
        at += 1 + n
    return Graph(vectors, levels, [np.concatenate(p) for p in parts]), vectors, np.concatenate(ids), np.array(begins)


_FOUND = "query_id long, code long, vec_ids array<long>, scores array<double>"


def _searched(k: int, ef: int):
    """Rows of shards (graph first, then blocks of queries) to each query's nearest in the shard."""

    def nearest(loaded: tuple, block: dict) -> Iterator[pa.RecordBatch]:
        graph, vectors, ids, begins = loaded
        queries = np.frombuffer(block["vectors"]).reshape(-1, vectors.shape[1])
        own, codes = np.frombuffer(block["ids"], np.int64).reshape(-1, 2).T
        scaled = queries / np.abs(queries).max(1, keepdims=True)
        padded = np.c_[scaled / np.linalg.norm(scaled, axis=1, keepdims=True), np.zeros(len(queries))].astype(np.float32)
        for start in range(0, len(own), GROUP):
            some = slice(start, start + GROUP)
            points, _ = graph.search(padded[some], 0, ef, graph.down(padded[some], 0, len(vectors)), len(vectors))
            rows, columns = np.nonzero(points >= 0)
            points = points[rows, columns]
            scores = inner(queries[some][rows], vectors[points])
            counts = begins[points + 1] - begins[points]
            rows, scores = np.repeat(rows, counts), np.repeat(scores, counts)
            within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            candidates = ids[np.repeat(begins[points], counts) + within]
            other = candidates != own[some][rows]
            rows, scores, candidates = rows[other], scores[other], candidates[other]
            order = np.lexsort((candidates, -scores, rows))
            rows, scores, candidates = rows[order], scores[order], candidates[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            best = rank < k
            rows, scores, candidates = rows[best], scores[best], candidates[best]
            ends = pa.array(np.searchsorted(rows, np.arange(len(own[some]) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[some]), pa.array(codes[some]),
                 pa.ListArray.from_arrays(ends, pa.array(candidates)), pa.ListArray.from_arrays(ends, pa.array(scores))],
                names=["query_id", "code", "vec_ids", "scores"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pieces, loaded = None, [], None
        for batch in batches:
            for at in range(len(batch)):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                if (own := tuple(row[name] for name in ("width", "scale", "shard", "chunk"))) != key:
                    key, pieces, loaded = own, [], None
                if row["kind"] == 0:
                    pieces.append(row)
                elif pieces:
                    loaded = loaded or _loaded(pieces)
                    yield from nearest(loaded, row)

    return run


def sound(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, width, scale, h1, h2, v (as doubles) of the rows that take part."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), values.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.filter(finite & F.exists("v", lambda x: x != 0))
    own = own.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))  # -0.0 becomes 0.0
    own = own.withColumn("most", F.array_max(F.transform("v", F.abs)))
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(x / F.col("most"), F.lit(2.0)))
    scale = F.round(F.log2("most") + F.log2(squares) / 2).cast("int")
    return own.select("id", F.size("v").alias("width"), scale.alias("scale"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")


def points(rows: DataFrame, k: int) -> DataFrame:
    """width, scale, h1, h2, v, ids (the k + 1 smallest): one row for each vector.

    A vector that fills many rows leaves every task with one copy and k + 1 ids at most.
    """
    key = ["width", "scale", "h1", "h2"]
    ranked = rows.select(*key, "id").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("id")))
    ids = ranked.filter(F.col("rank") <= k + 1).groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return rows.groupBy(*key).agg(F.first("v").alias("v")).join(ids, key)


_SHARD = ["width", "scale", "shard"]


def graphs(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """The table of all shards' graphs."""
    dealt = found.join(sizes, ["width", "scale"]).withColumn("shard", F.pmod("h1", F.col("shards")))
    dealt = dealt.repartition(*_SHARD).sortWithinPartitions(*_SHARD, "h1", "h2").select(*_SHARD, "v", "ids")
    return written(dealt.mapInArrow(_built, _GRAPH), "hnsw-graphs")


def nearest(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST,
            shard_size: int = SHARD_SIZE, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for all rows where ``queries``, a condition on the column ``id``, holds."""
    ship_package(vectors.sparkSession)
    rows = sound(vectors, vec_id, vector)
    found = written(points(rows, k), "hnsw-points")
    asked = rows.filter(queries).groupBy("id", "width", "h1", "h2").agg(F.first("v").alias("v"))
    blocks = written(asked.select("width", "id", "h1", "v").mapInArrow(_blocks, _GRAPH), "hnsw-queries").drop("scale", "shard")
    n_queries = blocks.groupBy("width").agg(F.sum(F.octet_length("ids") / 16).alias("n_queries"))
    sizes = found.groupBy("width", "scale").agg(F.ceil(F.count("*") / shard_size).alias("shards")).join(n_queries, "width", "left")
    sizes = sizes.select("width", "scale", "shards", F.ceil(F.coalesce("n_queries", F.lit(1)) / QUERIES_AT_ONCE).alias("chunks"))
    sizes = written(sizes, "hnsw-sizes")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = [*_SHARD, "chunk", "kind", "piece", "vectors", "ids", "links"]
    graph = graphs(found, sizes).join(sizes, ["width", "scale"]).withColumn("chunk", numbers("chunks")).select(*columns)
    dealt = blocks.join(sizes, "width").withColumn("chunk", F.pmod(F.xxhash64("ids"), F.col("chunks"))).withColumn("shard", numbers("shards")).select(*columns)
    met = graph.unionByName(dealt).repartition(*_SHARD, "chunk").sortWithinPartitions(*_SHARD, "chunk", "kind", "piece")
    by_shard = met.mapInArrow(_searched(k, ef), _FOUND)
    each = by_shard.select("query_id", "code", F.inline(F.arrays_zip(F.col("vec_ids").alias("vec_id"), F.col("scores").alias("score"))))
    by_query = Window.partitionBy("query_id", "code").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
