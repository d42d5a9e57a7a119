"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are cut into blocks of bounded size, and every pair of a query block
and a data block is one group of a shuffle. Its task builds a cover tree over either
side and descends both together: a pair of nodes is dropped when the largest score
that its covering radii allow lies below the worst kth score of the query node. The k
best of each pair are merged by one more shuffle on the query.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A node is split only into children of at least so many points on average.
LEAST_CHILD = 256
#: A child's covering radius against its parent's.
SHRINK = 0.7
#: Node pairs of at most so many scores are scored in one product.
PRODUCT = 1 << 21
#: Queries in a block; data rows in a block lie between the two bounds.
QUERY_BLOCK = 8_192
DATA_BLOCK = (8_192, 32_768)


@dataclass
class Node:
    """Points of a tree with their covering radius, and what bounds their inner products."""

    center: np.ndarray
    norm: float
    radius: float
    points: np.ndarray
    angle: float
    norms: tuple[float, float]
    children: list[Node] = field(default_factory=list)


def cover_tree(
    vectors: np.ndarray, points: np.ndarray | None = None, center: int | None = None, least: int = LEAST_CHILD
) -> Node:
    """A node's centre is one of its points and the centre of its first child (nesting);
    children lie within their radius of their centre (covering); centres of siblings
    are further apart than that radius (separation). A node whose points are too spread
    for children of ``least`` points stays a leaf.
    """
    points = np.arange(len(vectors)) if points is None else points
    center = int(points[0]) if center is None else center
    own = vectors[points]
    squares = np.einsum("ij,ij->i", own, own)
    middle = vectors[center]

    def distances(to: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squares - 2 * (own @ to) + to @ to, 0))

    distance = distances(middle)
    radius, norm = float(distance.max()), float(np.sqrt(middle @ middle))
    length = np.sqrt(squares)
    cosine = (own @ middle) / np.maximum(length * norm, 1e-300)
    angle = float(np.arccos(np.clip(cosine, -1, 1)).max()) if norm and length.min() else np.pi
    node = Node(middle, norm, radius, points, angle, (float(length.min()), float(length.max())))
    most = len(points) // least
    if most < 2 or radius == 0:
        return node
    nearest, group, centers = distance, np.zeros(len(points), np.int64), [center]
    while nearest.max() > SHRINK * radius:
        if len(centers) == most:
            return node
        far = int(nearest.argmax())
        gap = distances(own[far])
        closer = gap < nearest
        closer[far] = True
        group[closer] = len(centers)
        nearest = np.where(closer, gap, nearest)
        centers.append(int(points[far]))
    node.children = [cover_tree(vectors, points[group == g], c, least) for g, c in enumerate(centers)]
    return node


_NONE = np.iinfo(np.int64)


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scored = k, 0
        self.score = np.full((n, k), _NONE.min)
        self.ids = np.full((n, k), _NONE.max)

    def worst(self, queries: np.ndarray) -> np.ndarray:
        """The kth score of each query, the least number where there are fewer."""
        return self.score[queries, -1]

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores of some queries against rows in the order of their ids; ``own`` ids are left out."""
        self.scored += scores.size
        fresh = np.append(True, ids[1:] != ids[:-1])
        if not fresh.all():  # an id counts with its best row
            scores, ids = np.maximum.reduceat(scores, np.flatnonzero(fresh), axis=1), ids[fresh]
        floor = self.worst(queries)[:, None]
        if len(ids) > self.k + 1:
            # One more than k, since the query's own row may be among them.
            kth = np.partition(scores, len(ids) - self.k - 1, axis=1)[:, len(ids) - self.k - 1, None]
            floor = np.maximum(floor, kth.astype(np.int64))
        row, at = np.nonzero((scores >= floor) & (ids[None, :] != own[:, None]))
        met = np.unique(row)
        if not len(met):
            return
        row = np.concatenate([row, np.repeat(met, self.k)])
        score = np.concatenate([scores[row[: len(at)], at].astype(np.int64), self.score[queries[met]].ravel()])
        found = np.concatenate([ids[at], self.ids[queries[met]].ravel()])
        # An id that is there twice counts once, with its best score.
        by = np.lexsort((-score, found, row))
        row, score, found = row[by], score[by], found[by]
        again = np.append(False, (row[1:] == row[:-1]) & (found[1:] == found[:-1]) & (found[1:] != _NONE.max))
        row, score, found = row[~again], score[~again], found[~again]
        by = np.lexsort((found, -score, score == _NONE.min, row))
        row, score, found = row[by], score[by], found[by]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        top = place < self.k
        self.score[queries[row[top]], place[top]] = score[top]
        self.ids[queries[row[top]], place[top]] = found[top]


def _bound(a: Node, b: Node) -> float:
    """No point of one node has a larger inner product with one of the other."""
    inner = float(a.center @ b.center)
    top = inner + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    slack = 1e-9 * (abs(inner) + a.norms[1] * b.norms[1]) + 1e-6
    if a.norm and b.norm:
        between = float(np.arccos(np.clip(inner / (a.norm * b.norm), -1, 1))) - a.angle - b.angle
        cosine = float(np.cos(min(max(between - 1e-7, 0.0), np.pi)))
        longest = a.norms[1] * b.norms[1] if cosine >= 0 else a.norms[0] * b.norms[0]
        top = min(top, longest * cosine)
    return top + slack


def dual_search(
    queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int,
    least: int = LEAST_CHILD, product: int = PRODUCT,
) -> Best:
    """The k best data rows of every query, its own id left out.

    Both trees are descended together: where a query node is divided, so are the data nodes
    that are no smaller. A query leaf then takes its data nodes from the highest bound down
    and stops where the bound falls below its worst kth score. A data node that cannot be
    divided, or is small, is scored whole by one product.
    """
    best = Best(len(queries), k)
    if not len(queries) or not len(data):
        return best
    exact = np.abs(queries).max() * np.abs(data).max() * queries.shape[1] < 2**53
    whole = (queries, data) if exact else (queries.astype(np.int64), data.astype(np.int64))

    def score(q: Node, d: Node) -> None:
        points = d.points[np.argsort(data_ids[d.points], kind="stable")]
        step = max(1, PRODUCT // len(points))
        for low in range(0, len(q.points), step):
            some = q.points[low : low + step]
            best.offer(some, whole[0][some] @ whole[1][points].T, data_ids[points], query_ids[some])

    stack = [(cover_tree(queries, least=least), [cover_tree(data, least=least)])]
    while stack:
        q, met = stack.pop()
        if q.children:
            finer = [c for d in met for c in (d.children if d.children and d.radius >= q.radius else [d])]
            stack += [(c, finer) for c in q.children]
            continue
        heap = [(-_bound(q, d), i, d) for i, d in enumerate(met)]
        heapq.heapify(heap)
        made = len(heap)
        while heap and -heap[0][0] >= best.worst(q.points).min():
            d = heapq.heappop(heap)[2]
            if not d.children or len(q.points) * len(d.points) <= product:
                score(q, d)
                continue
            for c in d.children:
                heapq.heappush(heap, (-_bound(q, c), made, c))
                made += 1
    return best


def _matrix(column: pa.ChunkedArray, wide: int) -> np.ndarray:
    """One row per vector, shorter ones filled up with zeros."""
    column = column.combine_chunks()
    size = column.value_lengths().to_numpy(False)
    out = np.zeros((len(column), wide))
    flat = column.flatten().to_numpy(False)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _search_task(k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        wide = 1
        for t in (queries, data):
            if t.num_rows:
                wide = max(wide, int(t["vector"].combine_chunks().value_lengths().to_numpy(False).max()))
        ids = queries["id"].to_numpy(), data["id"].to_numpy()
        best = dual_search(
            _matrix(queries["vector"], wide), ids[0], _matrix(data["vector"], wide), ids[1], k
        )
        row, place = np.nonzero(best.score > _NONE.min)
        return pa.table(
            {
                "query_id": pa.array(ids[0][row], pa.int64()),
                "vec_id": pa.array(best.ids[row, place], pa.int64()),
                "score": pa.array(best.score[row, place], pa.int64()),
            }
        )

    return run


def scaled(vector: Column, scale: int = 256) -> Column:
    """Integer components, or null for a vector that is null or has a null or non-finite one."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(wide, lambda x: F.floor(x * scale)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the k best rows for every query.

    ``vectors`` has ``id`` (long) and ``vector`` (integers; scores must fit a long).
    Null ids and null vectors take no part; shorter vectors count as filled up with
    zeros. Rows with the query's id are not candidates; repeated equal rows count once;
    of rows that share an id, each is a candidate, and an id is ranked by its best row.
    Fewer than k candidates give fewer rows, an empty table none.
    """
    rows = vectors.filter("id IS NOT NULL AND vector IS NOT NULL").distinct()
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
    least, most = DATA_BLOCK
    block = min(most, max(least, counted["n"] // 64))
    data_blocks = max(1, -(-counted["n"] // block))
    query_blocks = max(1, -(-counted["q"] // QUERY_BLOCK))

    def placed(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.withColumns(
            {
                own: F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int"),
                other: F.explode(F.sequence(F.lit(0), F.lit(others - 1))),
            }
        )

    queries = placed(rows.filter(is_query), "qb", query_blocks, "db", data_blocks)
    data = placed(rows, "db", data_blocks, "qb", query_blocks)
    found = (
        queries.groupBy("qb", "db")
        .cogroup(data.groupBy("qb", "db"))
        .applyInArrow(_search_task(k), "query_id long, vec_id long, score long")
    )
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        each.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
