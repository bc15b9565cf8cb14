"""Exact top-k inner products by dual-tree search over cover trees.

1. Equal vectors become one point with its k + 1 least ids, which suffice, so copies cost no search.
2. Points and queries go to the nearest of a few centres, which a bounded sample gives (SAMPLE rows, farthest first), so that
   a cell holds vectors that lie together. Cells are cut into blocks and groups of bounded size by a hash of the vector.
3. Each block of points and each group of queries becomes a cover tree, once: a row with its centre, its radius and the tree.
4. For a group Q (centre q, radius s) and a block R (centre r, radius t), no pair scores more than
   q.r + |q|t + |r|s + st. Each group searches its FIRST most promising blocks, carrying its queries' kth scores from one to the
   next. Then the bound is held against the group's worst kth score, by cells first and by blocks then: what cannot hold a
   better point is dropped before any vector is shuffled. What is left is searched with the kth scores so far.
5. In a search, both trees are gone down together; a pair of nodes is pruned by the same bound against the worst kth score
   of the queries below its query node, and in a leaf by each query's own. The best k of each query are merged at the end.

Queries are a stated set, so groups times blocks is the most there can be to search; vectors of random directions come near
it, as their covering radii are close to their lengths, clustered ones stay far below.

Scores are exact: components become floor(1024 x) as integers; products are computed in floats where they are whole
numbers, else in 64-bit integers, else in Python's. A component or a score beyond a long is an error, it never wraps.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no part; vectors of different
lengths never meet; a query's own id is not a candidate; ties go to the smaller id; repeated rows of an id count once if
they are equal and as candidates of their own otherwise; fewer than k candidates give fewer rows; an empty table gives none;
further columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize

SCALE = 1024
K = 10
EVERY = 100
BLOCK_ROWS = 8192
GROUP_ROWS = 1024
#: Rows of the sample that gives the cells' centres, and the most cells. A cell is meant for half a block's rows.
SAMPLE, CELLS = 4096, 256
FIRST = 4
#: Groups that meet one block in one task, at most.
MEET = 32
LEAF = 16
BASE = 1.5


def _distances(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = points - c
    return np.sqrt((gap * gap).sum(1))


def farthest_first(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Points in the order in which each is the farthest from those before it, how far it was, and how far the rest is at most."""
    order, gaps = [0], [np.inf]
    gap = _distances(points, points[0])
    while len(order) < most and (far := float(gap.max())) > 0:
        at = int(gap.argmax())
        order.append(at)
        gaps.append(far)
        np.minimum(gap, _distances(points, points[at]), out=gap)
    return np.array(order), np.array(gaps), float(gap.max())


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    for s in range(0, len(points), 4096):
        part = points[s : s + 4096]
        out[s : s + 4096] = (((centres * centres).sum(1)) - 2 * part @ centres.T).argmin(1)
    return out


class CoverTree:
    """A cover tree over points, in arrays.

    Level by level, the scale shrinks by BASE. A level's net is a start of the farthest-first order: its points lie more than
    the scale apart (separation), every point lies within the scale of one of them (covering), and each net holds the one
    above it (nesting). A point's parent is the nearest of the net above. The levels end where a net would hold more than
    one in LEAF points; the last net's nodes are leaves with the points nearest to them. Chains of a node that is its own
    only child are one node.

    points are put in the order of the leaves, so that a node holds the slice start:end; place: where each was before.
    nets: for each level its scale and its points, as places; for tests.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF, base: float = BASE):
        n = len(points)
        order, gaps, rest = farthest_first(points, max(1, n // leaf))
        sizes, scales = [1], [float(_distances(points, points[0]).max())]
        scale = scales[0]
        while len(order) > sizes[-1] and scale / base >= rest and scale > 0:
            scale /= base
            if (size := int((gaps > scale).sum())) > sizes[-1]:
                sizes.append(size)
                scales.append(scale)
        self.nets = [(scale, order[:size]) for scale, size in zip(scales, sizes, strict=True)]
        kids: list[list[list[int]]] = []  # of each level's net, the members of the next net below each
        for above, size in zip(sizes, sizes[1:], strict=False):
            up = np.concatenate([np.arange(above), nearest(points[order[above:size]], points[order[:above]])])
            below: list[list[int]] = [[] for _ in range(above)]
            for k, p in enumerate(up.tolist()):
                below[p].append(k)
            kids.append(below)
        own = nearest(points, points[order[: sizes[-1]]])
        own[order[: sizes[-1]]] = np.arange(sizes[-1])  # of equal points too
        by_leaf = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=sizes[-1]))[:-1])
        centre, start, size_of, children, place = [], [], [], [], []
        todo, done = [(0, 0, -1)], 0
        while todo:
            c, level, parent = todo.pop()
            while level < len(kids) and len(kids[level][c]) == 1:
                level += 1
            node = len(centre)
            centre.append(int(order[c]))
            start.append(done)
            children.append([])
            size_of.append(0)
            if parent >= 0:
                children[parent].append(node)
            if level < len(kids):
                todo += [(k, level + 1, node) for k in reversed(kids[level][c])]
            else:
                place.append(by_leaf[c])
                size_of[node] = len(by_leaf[c])
                done += len(by_leaf[c])
        for node in range(len(centre) - 1, -1, -1):
            size_of[node] += sum(size_of[k] for k in children[node])
        self.place = np.concatenate(place)
        self.points = points[self.place]
        self.start, self.end = np.array(start), np.array(start) + np.array(size_of)
        self.children = [np.array(k, np.int64) for k in children]
        self.centres = points[np.array(centre)]
        self.radius = np.array([_distances(self.points[s:e], c).max() for s, e, c in zip(self.start, self.end, self.centres, strict=True)])
        self.norms = np.sqrt((self.centres * self.centres).sum(1))


def bounds(centre: np.ndarray, norm: float, radius: float, centres: np.ndarray, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Scores that no pair below a node and each of the others exceeds, rounded up."""
    return bounds_at(centres @ centre, norm, radius, norms, radii)


def bounds_at(at: np.ndarray, norm: np.ndarray | float, radius: np.ndarray | float, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The same from the centres' products, for one node or for as many as there are others."""
    high = at + norm * radii + norms * radius + radius * radii
    return high + 1e-9 * (np.abs(at) + norm * norms + norm * radii + norms * radius + radius * radii) + 1e-3


class Searcher:
    """The best (score, -id) of each query of a tree; kth scores are carried from one tree of points to the next.

    queries, points: exact integers in the order of the tree's points. compared: pairs whose scores were computed.
    """

    def __init__(self, tree: CoverTree, queries: np.ndarray, own: np.ndarray, k: int, worst: np.ndarray | None = None):
        self.tree, self.queries, self.own, self.k = tree, queries, own, k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(len(queries))]
        self.worst = np.full(len(queries), -np.inf) if worst is None else worst.copy()
        self.lengths = np.sqrt((tree.points * tree.points).sum(1))
        self.compared = 0

    def _exact(self, other: CoverTree, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and points as numbers whose products are exact."""
        longest = lambda t: float(np.sqrt((t.points * t.points).sum(1)).max())
        most = longest(self.tree) * longest(other)
        kind = np.float64 if most < 2**52 else np.int64 if most < 2**61 else object
        return self.queries.astype(kind), points.astype(kind)

    def meet(self, other: CoverTree, points: np.ndarray, ids: list[np.ndarray]) -> None:
        left, right = self._exact(other, points)
        t, worst = self.tree, self.worst
        high = float(bounds(t.centres[0], t.norms[0], t.radius[0], other.centres[:1], other.norms[:1], other.radius[:1])[0])
        todo, made = [(-high, 0, 0, 0)], 1
        while todo:
            high, _, q, r = heapq.heappop(todo)
            if -high < worst[t.start[q] : t.end[q]].min():  # equal bounds go on, for ties
                continue
            split_q = len(t.children[q]) and (not len(other.children[r]) or t.radius[q] > other.radius[r])
            if not split_q and not len(other.children[r]):
                own = np.arange(t.start[q], t.end[q])
                own = own[self._each(slice(t.start[q], t.end[q]), other, np.array([r]))[:, 0] >= worst[own]]
                if len(own):
                    self._compare(left, right, ids, own, slice(other.start[r], other.end[r]))
                continue
            if split_q:
                kids = t.children[q]
                highs = bounds(other.centres[r], other.norms[r], other.radius[r], t.centres[kids], t.norms[kids], t.radius[kids])
                pairs = [(x, r, h) for x, h in zip(kids.tolist(), highs.tolist(), strict=True) if h >= worst[t.start[x] : t.end[x]].min()]
            else:
                kids = other.children[r]
                if len(t.children[q]):
                    highs = bounds(t.centres[q], t.norms[q], t.radius[q], other.centres[kids], other.norms[kids], other.radius[kids])
                    fine = highs >= worst[t.start[q] : t.end[q]].min()
                else:
                    each = self._each(slice(t.start[q], t.end[q]), other, kids)
                    highs, fine = each.max(axis=0), (each >= worst[t.start[q] : t.end[q], None]).any(axis=0)
                pairs = [(q, x, h) for x, h in zip(kids[fine].tolist(), highs[fine].tolist(), strict=True)]
            for x, y, h in pairs:
                heapq.heappush(todo, (-h, made, x, y))
                made += 1

    def _each(self, qs: slice, other: CoverTree, nodes: np.ndarray) -> np.ndarray:
        """The bounds of single queries, the points of a leaf, with each of the nodes."""
        at, spread = self.tree.points[qs] @ other.centres[nodes].T, self.lengths[qs, None] * other.radius[nodes]
        return at + spread + 1e-9 * (np.abs(at) + spread + self.lengths[qs, None] * other.norms[nodes]) + 1e-3

    def _compare(self, left: np.ndarray, right: np.ndarray, ids: list[np.ndarray], qs: np.ndarray, rs: slice) -> None:
        scores = left[qs] @ right[rs].T
        self.compared += scores.size
        hit = scores >= self.worst[qs][:, None]
        for j in np.flatnonzero(hit.any(axis=1)).tolist():
            q, row = int(qs[j]), scores[j]
            heap, at = self.heaps[q], np.flatnonzero(hit[j])
            for x in at[np.argsort(-row[at], kind="stable")].tolist():
                score = int(row[x])
                if len(heap) == self.k and score < heap[0][0]:
                    break
                for i in ids[rs.start + x].tolist():
                    if i == self.own[q]:
                        continue
                    if len(heap) < self.k:
                        heapq.heappush(heap, (score, -i))
                    elif (score, -i) > heap[0]:
                        heapq.heapreplace(heap, (score, -i))
                    else:
                        break
            if len(heap) == self.k:
                self.worst[q] = max(self.worst[q], heap[0][0])

    def found(self) -> tuple[list[int], list[int], list[int]]:
        """Query ids, ids and scores."""
        rows = [(int(o), -i, s) for o, heap in zip(self.own, self.heaps, strict=True) for s, i in heap]
        if any(abs(s) >= 1 << 63 for _, _, s in rows):
            raise OverflowError("a score does not fit a long")
        return tuple(map(list, zip(*rows, strict=True))) if rows else ([], [], [])


# ---------------------------------------------------------------- the plan

_FOUND = "query_id long, vec_id long, score long"
_TREE = "n int, cell int, name string, size long, centre binary, norm double, radius double, cell_centre binary, cell_norm double, cell_radius double, tree binary"


def _load(blob: bytes) -> tuple:
    return pickle.loads(blob)


def _cells(centres: dict[int, np.ndarray]):
    """The nearest centre of each vector; 0 where there is none for its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            lengths, cell = batch.column("n").to_numpy(), np.zeros(batch.num_rows, np.int32)
            flat, ends = batch.column("v").values.to_numpy(), batch.column("v").offsets.to_numpy()
            for n in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == n)
                if n and n in centres:
                    cell[own] = nearest(flat[ends[own][:, None] + np.arange(n)].astype(float), centres[n])
            yield {"n": batch.column("n"), "cell": cell, "v": batch.column("v"), "ids": batch.column("ids")}

    return run


def _grow(centres: dict[int, np.ndarray]):
    """The tree of one block or group."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        n, cell, part = (x.as_py() for x in key)
        exact = np.array(rows["v"].combine_chunks().flatten(), np.int64).reshape(rows.num_rows, n)
        order = np.lexsort((*exact.T[::-1], np.array([x[0] for x in rows["ids"].to_pylist()])))  # whatever order the rows came in
        exact, ids = exact[order], [np.array(x) for x in rows["ids"].take(pa.array(order)).to_pylist()]
        tree = CoverTree(exact.astype(float))
        home = centres[n][cell] if n and n in centres else np.zeros(n)
        spread = float(_distances(tree.points, home).max())
        blob = pickle.dumps((tree, exact[tree.place], [ids[p] for p in tree.place.tolist()]), 5)
        row = {"n": n, "cell": cell, "name": f"{n}/{cell}/{part}", "size": len(exact), "centre": tree.centres[0].tobytes(), "norm": tree.norms[0], "radius": tree.radius[0], "cell_centre": home.tobytes(), "cell_norm": float(np.sqrt((home * home).sum())), "cell_radius": spread, "tree": blob}
        types = {"n": pa.int32(), "cell": pa.int32(), "name": pa.string(), "size": pa.int64(), "tree": pa.binary(), "centre": pa.binary(), "cell_centre": pa.binary()}
        return pa.table({k: pa.array([v], types.get(k, pa.float64())) for k, v in row.items()})

    return run


def _trees(rows: DataFrame, centres: dict[int, np.ndarray], most: int) -> DataFrame:
    """A row for each block of at most about this many rows. rows: n, v, ids."""
    placed = map_arrow(rows.select("n", "v", "ids"), _cells(centres), "n int, cell int, v array<long>, ids array<long>")
    sizes = placed.groupBy("n", "cell").agg(F.count(F.lit(1)).alias("count"))
    parts = placed.join(sizes, ["n", "cell"]).withColumn("part", F.pmod(F.xxhash64("v", "ids"), F.ceil(F.col("count") / most).cast("long")))
    return materialize(parts.select("n", "cell", "part", "v", "ids").groupBy("n", "cell", "part").applyInArrow(_grow(centres), _TREE))


def _with_bounds(pairs: DataFrame, prefix: str = "") -> DataFrame:
    """pairs of a group (q_ columns) and a block or cell with the column high, their bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            num = {k: batch.column(k).to_numpy() for k in ("n", "q_norm", "q_radius", "norm", "radius")}
            high = np.empty(batch.num_rows)
            for n in np.unique(num["n"]).tolist():  # vectors of one length: all products at once
                own = np.flatnonzero(num["n"] == n)
                q, c = (np.frombuffer(b"".join(batch.column(k).take(pa.array(own)).to_pylist())).reshape(len(own), n) for k in ("q_centre", "centre"))
                high[own] = bounds_at(np.einsum("ij,ij->i", q, c), *(num[k][own] for k in ("q_norm", "q_radius", "norm", "radius")))
            yield {"n": batch.column("n"), "q_name": batch.column("q_name"), "cell": batch.column("cell"), "name": batch.column("name"), "high": high}

    return map_arrow(pairs, run, "n int, q_name string, cell int, name string, high double")


def _searched_first(k: int):
    def run(key: tuple, groups: pa.Table, blocks: pa.Table) -> pa.Table:
        """A group and its most promising blocks, the best first. A row with what it found and its queries' worst scores."""
        if not groups.num_rows:
            return pa.table({"q_name": pa.array([], pa.string()), "least": pa.array([], pa.float64()), "worst": pa.array([], pa.binary()), "found": pa.array([], pa.binary())})
        tree, queries, ids = _load(groups["q_tree"][0].as_py())
        s = Searcher(tree, queries, np.array([x[0] for x in ids]), k)
        for at in np.argsort(-np.array(blocks["high"]), kind="stable").tolist():
            s.meet(*_load(blocks["tree"][at].as_py()))
        return pa.table({"q_name": [groups["q_name"][0].as_py()], "least": [float(s.worst.min())], "worst": pa.array([s.worst.tobytes()], pa.binary()), "found": pa.array([pickle.dumps(s.found())], pa.binary())})

    return run


def _searched(k: int):
    def run(key: tuple, blocks: pa.Table, groups: pa.Table) -> pa.Table:
        """A block and some groups that it may hold something for."""
        out: tuple[list, list, list] = ([], [], [])
        if blocks.num_rows and groups.num_rows:
            block = _load(blocks["tree"][0].as_py())
            for at in range(groups.num_rows):
                tree, queries, ids = _load(groups["q_tree"][at].as_py())
                s = Searcher(tree, queries, np.array([x[0] for x in ids]), k, np.frombuffer(groups["worst"][at].as_py()))
                s.meet(*block)
                for x, y in zip(out, s.found(), strict=True):
                    x.extend(y)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for blob in batch.column("found").to_pylist():
            q, i, s = pickle.loads(blob)
            yield {"query_id": q, "vec_id": i, "score": s}


def sample_centres(points: DataFrame, cells: int) -> dict[int, np.ndarray]:
    """Of each length of vectors in a sample of SAMPLE points, the cells' centres: farthest first."""
    by_length: dict[int, list] = {}
    for (v,) in points.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect():
        by_length.setdefault(len(v), []).append(v)
    out = {}
    for n, rows in by_length.items():
        own = np.array(rows, float).reshape(len(rows), n)
        out[n] = own[farthest_first(own, cells)[0]]
    return out


def search_plan(embeddings: DataFrame, *, k: int = K, every: int = EVERY, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Trees of points, trees of queries, what the first searches found, and the pairs of group and block that are left."""
    x = F.col("embedding")
    fine = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('inf'))"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(fine)
    rows = rows.select("vec_id", F.transform(x, lambda e: F.floor(F.lit(SCALE) * e.cast("double")).cast("long")).alias("v"), F.size(x).alias("n"))
    by_id = Window.partitionBy("v").orderBy("vec_id")
    least = rows.withColumn("place", F.dense_rank().over(by_id)).where(F.col("place") <= k + 1)  # k besides the query itself
    points = materialize(least.groupBy("n", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))
    centres = sample_centres(points, max(1, min(CELLS, -(-2 * points.count() // block_rows))))
    blocks = _trees(points, centres, block_rows)
    queries = rows.where(F.col("vec_id") % every == 0).distinct().select("n", "v", F.array("vec_id").alias("ids"))
    groups = _trees(queries, centres, group_rows).select("n", *[F.col(c).alias(f"q_{c}") for c in ("name", "size", "centre", "norm", "radius", "tree")])
    narrow = groups.drop("q_tree", "q_size")
    cells = blocks.groupBy("n", "cell").agg(F.first("cell_centre").alias("centre"), F.first("cell_norm").alias("norm"), F.max("cell_radius").alias("radius"), F.lit("").alias("name"))
    by_cell = materialize(_with_bounds(narrow.join(cells, "n")))
    flat = blocks.select("n", "cell", "name", "centre", "norm", "radius")

    def by_block(chosen: DataFrame) -> DataFrame:
        return _with_bounds(chosen.join(narrow, ["n", "q_name"]).join(flat, ["n", "cell"]))

    # of each group, the blocks in its best cells; then the best of those
    promising = by_cell.withColumn("place", F.row_number().over(Window.partitionBy("q_name").orderBy(F.desc("high"), "cell"))).where(F.col("place") <= FIRST)
    first = by_block(promising.select("n", "q_name", "cell"))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("q_name").orderBy(F.desc("high"), "name"))).where(F.col("place") <= FIRST)
    first = materialize(first.select("q_name", "name", "high"))
    trees = blocks.select("name", "tree")
    begun = groups.select("q_name", "q_tree").groupBy("q_name").cogroup(first.join(trees, "name").groupBy("q_name")).applyInArrow(_searched_first(k), "q_name string, least double, worst binary, found binary")
    begun = materialize(begun)
    least = begun.select("q_name", "least")
    cells_left = by_cell.join(least, "q_name").where("high >= least").select("n", "q_name", "cell")
    left = by_block(cells_left).join(least, "q_name").where("high >= least").join(first.select("q_name", "name"), ["q_name", "name"], "left_anti")
    return blocks, groups, begun, materialize(left.select("q_name", "name"))


def top_k(embeddings: DataFrame, *, k: int = K, every: int = EVERY, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every, its k best others."""
    blocks, groups, begun, left = search_plan(embeddings, k=k, every=every, block_rows=block_rows, group_rows=group_rows)
    counts = left.groupBy("name").agg(F.count(F.lit(1)).alias("count")).withColumn("parts", F.ceil(F.col("count") / MEET).cast("long"))
    of_group = groups.select("q_name", "q_tree").join(begun.select("q_name", "worst"), "q_name")
    meeting = left.join(counts, "name").withColumn("part", F.pmod(F.xxhash64("q_name"), F.col("parts"))).join(of_group, "q_name").select("name", "part", "q_tree", "worst")
    block = blocks.select("name", "tree").join(counts, "name").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("name", "part", "tree")
    found = block.groupBy("name", "part").cogroup(meeting.groupBy("name", "part")).applyInArrow(_searched(k), _FOUND)
    found = found.unionByName(map_arrow(begun.select("found"), _unpacked, _FOUND))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


op8 = top_k


def op8_sql() -> str:
    return f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % {EVERY} = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= {K}"""
