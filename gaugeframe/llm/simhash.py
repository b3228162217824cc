"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits and link at up to 4 differing bits. The anchors are the 4096 words of the binary Golay code
[23, 12, 7], which is perfect: each 23-bit point lies within 3 bits of one anchor (the covering radius). The
fingerprint is cut into blocks of 22, 21 and 21 bits (padded with zeros). Of two linked fingerprints at least one block
differs in 1 bit or less, so it is enough to look in each block for fingerprints within 1 bit: each fingerprint is at
home at the anchor nearest to its block and is replicated to every anchor within 3 + 1 bits, about six; whoever is at
home at an anchor is compared with all replicas there, in full width. No link is lost.

Beyond ``PAIRED_FROM`` distinct fingerprints an anchor is a pair of code words of two blocks, for each two of the three
blocks: two blocks together then differ in 2 bits at most, 4096 times as many anchors share the work, and the replicas
follow all splits of those 2 bits. Both forms are exact.

Equal fingerprints are one node from the start. Anchors that many share are cut into tiles, (part of those at home) x
(part of the replicas), so that a task holds ``TILE_ROWS`` of each at most. A tile returns a spanning forest of its
links, never all pairs; the components of all forests are the classes.

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like any other; repeated
rows and rows that share an id are one node; a row without id takes the class of its fingerprint and never joins
classes; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard
from .common import ascii_lower, begin, cut, narrowed, table, texts_of
from .components import components

BITS, MOST, SHINGLE = 64, 4, 4
#: Offset and width of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: the generator polynomial of the Golay code.
GOLAY = 0b101011100011
PAIRED_FROM = 40_000_000
TILE_ROWS = 2_000
#: Replicas of all fingerprints are made in memory of this many rows at a time.
CHUNK = 20_000


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The 64-bit SimHash of each text as a signed long: a bit is set if it is in over half the XXH64 hashes (seed 42)
    of the word shingles, repeats included."""
    def hashes(t: str) -> np.ndarray:
        from xxhash import xxh64_intdigest

        words = ascii_lower(t).encode().split()  # bytes.split() splits at the contract's white space
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) <= shingle:
            return np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-1].tolist()]
        return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=False)], np.uint64)

    def typed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("simhash")
        for texts in batches:
            out = np.zeros(len(texts), np.uint64)
            for i, t in enumerate(texts_of(texts)):
                h = hashes(t) if t else ()
                if len(h):
                    counts = np.zeros(64, np.int64)
                    for k in range(0, len(h), 65_536):  # bounded memory for very long texts
                        part = h[k : k + 65_536]
                        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                    out[i] = np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0]
            yield pa.array(out.view(np.int64))

    typed.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(typed, "long")(text)


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes its error patterns of weight 5 or less, lightest first: (patterns, weights,
    where each syndrome's begin). A point and a pattern of its syndrome differ by a code word: the anchors within
    reach of point x are x ^ pattern."""
    patterns = np.array([sum(1 << b for b in c) for w in range(6) for c in combinations(range(23), w)], np.int64)
    weights = np.array([w for w in range(6) for _ in combinations(range(23), w)], np.int64)
    rest = syndrome(patterns)
    order = np.lexsort((patterns, weights, rest))
    return patterns[order], weights[order], np.searchsorted(rest[order], np.arange(2049))


def syndrome(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= ((x >> bit) & 1) * (GOLAY << (bit - 11))
    return x


def _block(fp: np.ndarray, at: int, width: int) -> np.ndarray:
    return ((fp.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _reach(x: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into x, anchor) for each anchor within 3 + extra bits of the points x."""
    patterns, weights, begin = golay()
    s = syndrome(x)
    n = begin[s + 1] - begin[s]
    index = np.repeat(np.arange(len(x)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[s], n)
    near = weights[at] <= 3 + extra
    return index[near], x[index[near]] ^ patterns[at[near]]


def anchored(fp: np.ndarray, paired: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor id, whether the row is at home there)."""
    index, anchor, home = [], [], []

    def put(i: np.ndarray, a: np.ndarray, which: int, h: bool) -> None:
        index.append(i)
        anchor.append(a | np.int64(which) << 46)
        home.append(np.full(len(i), h))

    reach = {(b, e): _reach(_block(fp, *BLOCKS[b]), e) for b in range(3) for e in range(3 if paired else 2)}
    if not paired:
        for b in range(3):
            put(*reach[b, 0], b, True)
            put(*reach[b, 1], b, False)
        return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)
    for which, (b, c) in enumerate(combinations(range(3), 2)):
        own_b, own_c = (np.zeros(len(fp), np.int64) for _ in range(2))
        own_b[reach[b, 0][0]], own_c[reach[c, 0][0]] = reach[b, 0][1], reach[c, 0][1]
        put(np.arange(len(fp)), own_b << 23 | own_c, which, True)
        seen = []
        for e, f in ((1, 1), (2, 0), (0, 2)):
            (i, x), (j, y) = reach[b, e], reach[c, f]
            n = np.bincount(j, minlength=len(fp))
            first = np.cumsum(n) - n
            k = np.repeat(np.arange(len(i)), n[i])
            at = np.arange(len(k)) - np.repeat(np.cumsum(n[i]) - n[i], n[i]) + first[i[k]]
            seen.append(np.stack([i[k], x[k] << 23 | y[at]]))
        both = np.unique(np.concatenate(seen, axis=1), axis=1)
        put(both[0], both[1], which, False)
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def forest(home_fp: np.ndarray, home_node: np.ndarray, fp: np.ndarray, node: np.ndarray) -> list[tuple[int, int]]:
    """Links (node, node) that join what is linked between those at home and the replicas, without cycles."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    out = []
    step = max(1, (1 << 21) // max(1, len(fp)))
    for a in range(0, len(home_fp), step):
        near = np.bitwise_count(home_fp[a : a + step, None] ^ fp[None, :]) <= MOST
        for i, j in zip(*np.nonzero(near), strict=True):
            x, y = root(int(home_node[a + i])), root(int(node[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((max(x, y), min(x, y)))
    return out


def links(nodes: DataFrame, paired: bool = False, tile_rows: int = TILE_ROWS) -> DataFrame:
    """nodes (fp, node) with distinct fp: (u, v) links that connect all whose fingerprints are linked."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids = (batch.column(k).to_numpy() for k in (0, 1))
            for a in range(0, len(fps), CHUNK):
                fp, node = fps[a : a + CHUNK], ids[a : a + CHUNK]
                index, anchor, home = anchored(fp, paired)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[index]), pa.array(node[index]), pa.array(home)], names=["anchor", "fp", "node", "home"])

    rows = nodes.select("fp", "node").mapInArrow(replicate, "anchor long, fp long, node long, home boolean")
    rows = cut(rows) if paired else rows  # three blocks are quickly anchored again, and then need no copy
    # Anchors shared by more than a tile's rows: parts of those at home x parts of the replicas.
    sizes = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / F.lit(tile_rows)).cast("int")
    crowded = sizes.where(F.col("n") > tile_rows).select("anchor", parts.alias("parts"))
    crowded = crowded if paired else F.broadcast(crowded)  # of 3 x 4096 anchors at most
    rows = rows.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", "home"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiled = rows.select("anchor", "fp", "node", "home", own.alias("own"), other.alias("other"))
    tiled = tiled.select("anchor", F.when(F.col("home"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("home"), F.col("other")).otherwise(F.col("own")).alias("j"), "fp", "node", "home")
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiled = tiled.repartition(spread, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(chunk: pa.Table, last: bool) -> tuple[list[tuple[int, int]], pa.Table | None]:
            key = np.stack([chunk.column(k).to_numpy().astype(np.int64) for k in ("anchor", "i", "j")])
            edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            bounds = [0, *edges.tolist(), chunk.num_rows]
            fp, node = chunk.column("fp").to_numpy().view(np.uint64), chunk.column("node").to_numpy()
            home = chunk.column("home").to_numpy(zero_copy_only=False)
            found: list[tuple[int, int]] = []
            for a, b in zip(bounds, bounds[1 : None if last else -1], strict=False):
                h = home[a:b]
                if h.any() and b - a > 2:
                    found += forest(fp[a:b][h], node[a:b][h], fp[a:b][~h], node[a:b][~h])
            return found, None if last else chunk.slice(bounds[-2])

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                found, rest = flush(pa.Table.from_batches(held).combine_chunks(), False)
                held = rest.combine_chunks().to_batches() if rest is not None else []
                yield batch_of(found)
        if held:
            yield batch_of(flush(pa.Table.from_batches(held).combine_chunks(), True)[0])

    return tiled.mapInArrow(compare, "u long, v long")


def classes(docs: DataFrame, paired: bool | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; fp is the fingerprint as a signed long."""
    prints = cut(docs.select("doc_id", fingerprints(F.coalesce(docs["text"], F.lit(""))).alias("fp")))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"))
    if paired is None:
        paired = nodes.count() > PAIRED_FROM
    found = components(links(nodes, paired, tile_rows))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint in 16 hex digits and the class it belongs to."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return classes(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def _apart(pairs: DataFrame, near_to: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes that are not in one class of near_to (node, component) yet."""
    of = lambda c: near_to.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class"))
    both = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    return both.where(F.coalesce("u_class", "u") != F.coalesce("v_class", "v")).select("u", "v")


def similar(docs: DataFrame, shingle: int = jaccard.SHINGLE, similarity: tuple[int, int] = jaccard.SIMILARITY, **sizes: int) -> DataFrame:
    """(doc_id, key, class) for each row of docs: key is the node of its text (its set of shingles), class the least
    node that a chain of texts of that Jaccard similarity or more leads to. Anchors propose the links within ``MOST``
    bits, which are checked; texts at the threshold differ in some 10 of 64 bits, beyond the reach of any anchors, so
    prefix filtering then finds all links between the classes so far. sizes: small, part and tile of jaccard."""
    known = jaccard.nodes(docs, shingle)
    texts = known.where("n > 0").groupBy("node").agg(F.min("fp").alias("fp"))
    prints = cut(texts.groupBy("fp").agg(F.min("node").alias("node")))
    same = texts.join(prints.withColumnRenamed("node", "u"), "fp").where("u <> node").select("u", F.col("node").alias("v"))
    close = links(prints, prints.count() > PAIRED_FROM).union(same)
    close = jaccard.compared(close.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), docs, known, shingle, similarity)
    pairs, large = jaccard.proposed(docs, known, shingle, similarity, sizes.get("small", jaccard.SMALL), sizes.get("part", jaccard.PART))
    close = cut(close.union(jaccard.compared(_apart(pairs, components(close)), docs, known, shingle, similarity)))
    near_to = cut(components(close))
    more = cut(jaccard.remaining(large, near_to, known, similarity, sizes.get("tile", jaccard.TILE)))
    if not more.isEmpty():
        near_to = components(close.union(jaccard.compared(more, docs, known, shingle, similarity)))
    near_to = near_to.select("node", F.col("component").alias("class"))
    return known.join(near_to, "node", "left").select("doc_id", F.col("node").alias("key"), F.coalesce("class", "node").alias("class"))


def kept(docs: DataFrame, found: DataFrame, mark: Column) -> DataFrame:
    """docs with one document of each class: the one with the least id (of rows that repeat it, the one whose values
    as JSON sort first). Rows without an id stay only where no document with an id shares their class, one of a class.
    found: (doc_id, key, class) of each row; mark: the key of a row of docs, evaluated only for rows whose id is null
    or repeated. Texts are shuffled for those rows only."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = found.groupBy("class").agg(F.min("doc_id").alias("least"))
    ids = found.where("doc_id is not null").join(least, "class").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("doc_id") == F.col("least")).alias("first"))
    single = narrowed(docs.where("doc_id is not null"), ids.where("n > 1 or not first").select("doc_id"), "doc_id", "left_anti")
    odd = docs.where("doc_id is null").unionByName(narrowed(docs, ids.where("n > 1").select("doc_id"), "doc_id", "left_semi"))
    odd = odd.select(row.alias("row"), F.to_json(row).alias("sort"), F.col("doc_id").alias("own"), mark.alias("key"))
    named = found.select("key", "class").distinct().join(least, "class")
    odd = odd.join(named, "key").where(F.col("own").eqNullSafe(F.col("least"))).groupBy("class").agg(F.min_by("row", "sort").alias("row"))
    return single.unionByName(odd.select("row.*"))


def keep_one(docs: DataFrame, shingle: int = jaccard.SHINGLE, similarity: tuple[int, int] = jaccard.SIMILARITY) -> DataFrame:
    """docs with one document of each class of ``similar``, as ``kept`` says."""
    return kept(docs, cut(similar(docs, shingle, similarity)), jaccard.node(F.col("text"), shingle))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
