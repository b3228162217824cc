"""Exact top-k inner products: KD-trees per shard.

A coarse tree over a bounded sample cuts the space into cells by median splits; rows are counted by cell, and a cell is
one shard or, where many vectors are close or equal, several of bounded size, dealt by a hash. Each shard is one KD-tree,
built once and kept in the shared folder: median splits along the widest side, with the tight bounding box of what lies
below. Three steps:

1. Where a shard's tree is built, its own queries are searched, which gives each query a first k-th score.
2. A query is sent on only to shards whose box allows an inner product of that score at least. Boxes meet queries in
   blocks: a row a shard's queries and a few thousand boxes, never rows to rows.
3. Each tree goes to its task once (again for every ``block_rows`` queries of the table), and the queries sent to it
   stream past. Boxes in it are opened best first until the next one cannot beat the query's k-th score.

A box whose bound equals the k-th score is still opened, since ties go to the smaller id. The best k of the shards are
merged by query. All arithmetic is on integers (exact in doubles while sums stay below 2**53; larger ones use Python
integers). The sample only places the cells: every row is in a tree, and boxes are those of the rows.

Where boxes rule nothing out, a query's numbers go to each shard. With n rows of d components and shards of
``SHARD_VALUES`` components that is n / every * n * d / SHARD_VALUES queries sent.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; vectors of other lengths
are compared within their length only; repeated ids are candidates each, except for queries of the same id; a query
with fewer candidates gets all of them; an empty table gives no rows; further columns are ignored. A null id takes no
part. A score beyond a long is the nearest long, before ties are told apart; a component that leaves the range of
doubles is the largest double of its sign. Ids and vectors that repeat are told apart by their place in the input,
which must read alike twice (a table does).
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Components of a shard (32 MB as doubles) and of the sample that places the cells; rows of a shard that is not worth
#: another task; rows of a leaf; boxes sent with a shard's queries; queries that a tree's task takes.
SHARD_VALUES, SAMPLE_VALUES, LEAST_ROWS, LEAF_ROWS, BOXES, BLOCK_ROWS = 1 << 22, 1 << 20, 2_048, 256, 4_096, 65_536
SCALE, TOP, EVERY = 256, 5, 50
#: Cells at most, each with 16 rows of the sample at least; beyond them cells have several shards.
CELLS = 1_024
LEAST, MOST = -(2**63), 2**63 - 1


def cells(sample: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median splits of the sample into up to ``wanted`` cells: side, value and (low, high) child of each node; a
    negative child is a cell, ~child its number."""
    side, value, child, found = [], [], [], 1
    heap = [(-len(sample), 0, np.arange(len(sample)), None)] if len(sample) else []
    while heap and found < wanted:
        _, cell, rows, place = heapq.heappop(heap)
        part = sample[rows]
        widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        x = part[:, widest]
        middle = np.partition(x, len(x) // 2)[len(x) // 2]
        if middle == x.min():
            if x.max() == middle:
                continue  # equal points stay one cell
            middle = x[x > middle].min()
        node = len(side)
        side.append(widest)
        value.append(middle)
        child.append([~cell, ~found])
        if place:
            child[place[0]][place[1]] = node
        heapq.heappush(heap, (-int((x < middle).sum()), cell, rows[x < middle], (node, 0)))
        heapq.heappush(heap, (-int((x >= middle).sum()), found, rows[x >= middle], (node, 1)))
        found += 1
    return np.array(side, int), np.array(value, float), np.array(child, int).reshape(-1, 2)


def cell_of(vectors: np.ndarray, side: np.ndarray, value: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The cell of each vector."""
    at = np.full(len(vectors), 0 if len(side) else -1)
    while (open_ := np.flatnonzero(at >= 0)).size:
        node = at[open_]
        at[open_] = child[node, (vectors[open_, side[node]] >= value[node]).astype(int)]
    return ~at


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where every sum of products is exact, else as Python integers."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**53:
        return a, b
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).astype(object), whole(b).astype(object)


def _long(scores: np.ndarray) -> np.ndarray:
    """Scores that are Python integers, brought into the range of a long."""
    return scores if scores.dtype != object else np.minimum(np.maximum(scores, LEAST), MOST)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query that each box allows."""
    queries, both = _exact(queries, np.concatenate([low, high]))
    return _long(np.maximum(queries, 0) @ both[len(low) :].T + np.minimum(queries, 0) @ both[: len(low)].T)


def _blob(a: np.ndarray) -> bytes:
    """Whole numbers in the smallest type that holds them all."""
    if a.dtype == np.float64:
        top = float(np.abs(a).max(initial=0))
        a = a.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.float64)
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def _array(blob: bytes) -> np.ndarray:
    return np.load(io.BytesIO(blob), allow_pickle=False)


class Tree:
    """A KD-tree over vectors of whole numbers: nodes as arrays, children after their parents."""

    FIELDS = ("low", "high", "child", "span", "ids", "vectors")

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
        order, low, high, child, span, work = np.arange(len(ids)), [], [], [], [], [(0, len(ids), -1, 0)]
        while work:
            a, b, parent, hand = work.pop()
            node = len(low)
            if parent >= 0:
                child[parent][hand] = node
            part = vectors[order[a:b]]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            child.append([-1, -1])
            span.append((a, b))
            side = int(np.argmax(high[-1] - low[-1]))
            if b - a > leaf_rows and high[-1][side] > low[-1][side]:  # equal points stay one leaf
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, side], middle, kind="introselect")]
                work += [(a + middle, b, node, 1), (a, a + middle, node, 0)]
        tree = cls()
        tree.low, tree.high, tree.child, tree.span = np.array(low), np.array(high), np.array(child), np.array(span)
        tree.ids, tree.vectors = ids[order], vectors[order]
        return tree

    def store(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: np.frombuffer(_blob(getattr(self, f)), np.uint8) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Tree:
        tree, stored = cls(), np.load(io.BytesIO(blob), allow_pickle=False)
        for f in cls.FIELDS:
            setattr(tree, f, _array(stored[f].tobytes()))
        tree.vectors = tree.vectors.astype(np.float64)
        return tree

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[list[tuple[int, int]]]:
        """For each query the best (score, -id) of this tree, k at most, that reach its floor."""
        for at in range(0, len(queries), 256):
            some = queries[at : at + 256]
            limits = bounds(some, self.low, self.high).tolist()
            some, vectors = _exact(some, self.vectors)
            for query_id, query, floor, limit in zip(query_ids[at : at + 256].tolist(), some, floors[at : at + 256].tolist(), limits, strict=True):
                yield self._best(query_id, query, floor, limit, vectors, k)

    def _best(self, query_id: int, query: np.ndarray, floor: int, limit: list, vectors: np.ndarray, k: int) -> list[tuple[int, int]]:
        best, heap = [], [(-limit[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:
                break
            if self.child[node, 0] >= 0:
                for c in self.child[node].tolist():
                    if limit[c] >= floor:
                        heapq.heappush(heap, (-limit[c], c))
                continue
            a, b = self.span[node].tolist()
            scores = _long(vectors[a:b] @ query)
            near = np.flatnonzero((scores >= floor) & (self.ids[a:b] != query_id))
            if len(near) > k:  # by score, then by id
                near = near[np.lexsort((self.ids[a:b][near], -scores[near]))[:k]]
            for i in near:
                entry = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return best


def _whole(x: pd.Series, scale: int) -> np.ndarray:
    return np.nan_to_num(np.floor(np.stack(x.to_numpy()).astype(np.float64) * scale))


FOUND = "query_id long, vec_id long, score long"


def _rows(query_ids: np.ndarray, found: list[list[tuple[int, int]]]) -> pd.DataFrame:
    out = [(int(q), -i, s) for q, best in zip(query_ids.tolist(), found, strict=True) for s, i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def top_k(
    vectors: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, shard_rows: int | None = None, block_rows: int = BLOCK_ROWS, boxes: int = BOXES
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``, against all other rows."""
    spark, x = vectors.sparkSession, F.col("embedding")
    if vectors.schema["embedding"].dataType.simpleString() not in ("array<float>", "array<double>"):
        x = x.cast("array<double>")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    clean = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.size(x).alias("dims")).where("vec_id IS NOT NULL AND dims > 0")
    # a row for each length of a vector
    counts = {r[0]: (r[1], r[2]) for r in clean.groupBy("dims").agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).collect()}
    counts = {d: c for d, c in counts.items() if c[1]}
    if not counts:
        return clean.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    clean = clean.where(F.col("dims").isin(list(counts)))
    tasks = 2 * spark.sparkContext.defaultParallelism
    size = {d: shard_rows or max(1, SHARD_VALUES // d) for d in counts}
    wanted = {d: max(math.ceil(n / size[d]), min(tasks, math.ceil(n / LEAST_ROWS))) for d, (n, _) in counts.items()}
    size = {d: max(1, min(size[d], 2 * math.ceil(counts[d][0] / n))) for d, n in wanted.items()}

    sample: dict[int, list] = {d: [] for d in counts}
    for r in clean.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(max(1, SAMPLE_VALUES // max(counts))).select("dims", "x").toLocalIterator():
        sample[r.dims].append(r.x)
    tops = {d: cells(_whole(pd.Series(s), scale) if s else np.zeros((0, d)), min(wanted[d], CELLS, max(1, len(s) // 16))) for d, s in sample.items()}
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def shard_of(x: pd.Series, row: pd.Series) -> pd.Series:
        """The cell of a vector; once the cells are counted, one of the cell's shards."""
        out, lengths = np.zeros(len(x), np.int64), x.map(len).to_numpy()
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            out[at] = cell_of(_whole(x.iloc[at], scale), *tops[int(d)])
            if parts:
                first, many = parts[int(d)]
                out[at] = first[out[at]] + row.to_numpy()[at] % many[out[at]]
        return pd.Series(out)

    shard_of.__annotations__ = {"x": pd.Series, "row": pd.Series, "return": pd.Series}

    def placed() -> DataFrame:
        row = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(1 << 31))
        return clean.withColumn("shard", F.pandas_udf(shard_of, "long")("x", row))

    held = {d: np.zeros(len(t[0]) + 1, np.int64) for d, t in tops.items()}
    for r in placed().groupBy("dims", "shard").count().collect():  # CELLS rows a length at most
        held[r.dims][r.shard] = r["count"]
    for d, of in held.items():
        many = np.maximum(1, -(-of // size[d]))
        parts[d] = (np.concatenate([[0], np.cumsum(many)[:-1]]), many)
    shards = {d: int(many.sum()) for d, (_, many) in parts.items()}

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """A shard's tree, its box, and its queries with the best of the shard itself."""
        numbers, ids = _whole(pdf["x"], scale), pdf["vec_id"].to_numpy()
        tree, asked = Tree.build(ids, numbers), np.flatnonzero(ids % every == 0)
        query_ids, queries = ids[asked], numbers[asked]
        found = list(tree.search(query_ids, queries, np.full(len(asked), LEAST), k))
        floors = np.array([b[0][0] if len(b) == k else LEAST for b in found], np.int64)
        entries = np.array([e for b in found for e in b], np.int64).reshape(-1, 2)
        row = {"dims": int(key[0]), "shard": int(key[1]), "box": _blob(np.stack([tree.low[0], tree.high[0]])), "tree": tree.store(), "ids": _blob(query_ids), "x": _blob(queries)}
        return pd.DataFrame([row | {"floors": _blob(floors), "lengths": _blob(np.array([len(b) for b in found], np.int64)), "entries": _blob(entries)}])

    build.__annotations__ = {}
    built = cut(placed().groupBy("dims", "shard").applyInPandas(build, "dims int, shard long, box binary, tree binary, ids binary, x binary, floors binary, lengths binary, entries binary"))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                entries, ends = _array(r.entries).tolist(), np.cumsum(_array(r.lengths)).tolist()
                yield _rows(_array(r.ids), [[tuple(e) for e in entries[a:b]] for a, b in zip([0] + ends, ends, strict=False)])

    own.__annotations__ = {}
    home = built.select("ids", "lengths", "entries").mapInPandas(own, FOUND)

    # Step 2: a shard's queries and a block of boxes.
    block = F.floor(F.col("shard") / boxes)
    box = built.groupBy("dims", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("shard", "box"))).alias("boxes"))
    blocks = F.create_map(*[F.lit(v) for d in counts for v in (d, math.ceil(shards[d] / boxes))])
    asking = built.select("dims", "shard", "ids", "x", "floors").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (blocks[F.col("dims")] - 1).cast("long"))))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                query_ids, queries, floors = _array(r.ids), _array(r.x), _array(r.floors)
                if not len(query_ids):
                    continue
                both = np.stack([_array(b["box"]) for b in r.boxes]).astype(np.float64)
                allowed = np.concatenate([bounds(queries[a : a + 1024], both[:, 0], both[:, 1]) >= floors[a : a + 1024, None] for a in range(0, len(queries), 1024)])
                for j, b in enumerate(r.boxes):
                    go = np.flatnonzero(allowed[:, j])
                    if b["shard"] != r.shard and len(go):
                        yield pd.DataFrame({"dims": [r.dims], "shard": [b["shard"]], "origin": [r.shard], "ids": [_blob(query_ids[go])], "x": [_blob(queries[go])], "floors": [_blob(floors[go])]})

    route.__annotations__ = {}
    sent = asking.join(box, ["dims", "block"]).mapInPandas(route, "dims int, shard long, origin long, ids binary, x binary, floors binary")

    # Step 3: a tree and the queries sent to it, a task for each block_rows queries of the table.
    slots = {d: max(1, math.ceil(c[1] / block_rows)) for d, c in counts.items()}
    starts = dict(zip(counts, np.cumsum([0] + [shards[d] * slots[d] for d in counts]).tolist(), strict=False))
    slot_of, start_of = (F.create_map(*[F.lit(v).cast("long") for d in counts for v in (d, m[d])])[F.col("dims").cast("long")] for m in (slots, starts))
    sent = sent.select("dims", "shard", "ids", "x", "floors", F.pmod(F.xxhash64("origin"), slot_of).alias("slot"), F.lit(None).cast("binary").alias("tree"))
    empty = F.lit(None).cast("binary")
    trees = built.select("dims", "shard", empty.alias("ids"), empty.alias("x"), empty.alias("floors"), F.explode(F.sequence(F.lit(0).cast("long"), slot_of - 1)).alias("slot"), "tree")
    places = sum(shards[d] * slots[d] for d in counts)
    width = min(places, 4096)
    meet = sent.unionByName(trees).withColumn("place", start_of + F.col("shard") * slot_of + F.col("slot"))
    meet = meet.repartitionById(width, F.pmod(F.col("place"), F.lit(width)).cast("int")).sortWithinPartitions("place", F.col("tree").isNull())

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.tree is not None:
                    tree = r.tree  # read only if a query comes
                    continue
                if isinstance(tree, bytes):
                    tree = Tree.load(tree)
                ids = _array(r.ids)
                yield _rows(ids, list(tree.search(ids, _array(r.x), _array(r.floors), k)))

    search.__annotations__ = {}
    found = home.unionByName(meet.select("tree", "ids", "x", "floors").mapInPandas(search, FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
