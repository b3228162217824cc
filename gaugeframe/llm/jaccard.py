"""Links between texts by the Jaccard similarity of their word shingles, exact: no pair at or over the threshold is
missed. It checks the links that SimHash proposes, and finds those beyond SimHash's reach.

A text is the set of its ``SHINGLE``-word shingles (lower case in ASCII; a shorter text is one shingle), each a 64-bit
hash of its words' XXH64. Texts with the same set are one node, named by a hash of the set.

Candidates come from prefix filtering: with the shingles of all sets in one order, two sets of similarity s have one in
common among the first n - ceil(s n) + 1 of each. The order puts rare shingles first, so that passages which many texts
share are in a prefix only where they are most of a text:

1. half of all shingles (by a bit of the hash), by the number of texts that hold them, counted over all texts;
2. the other half, by hash; needed only by sets with too few of the first half;
3. shingles that a sample of the texts already shows to be common, which therefore take no part in the counting.

Counting deals (shingle, node) to slices, each slice sends the shingles of more than one text to buckets of nodes, and
a bucket knows all prefixes of its nodes. The positions of a shared shingle bound what two sets can have in common;
pairs whose bound is too low are left out, as are pairs whose parity sketches show too many differences. All others are
compared in full. Nodes that share a shingle are paired at once up to ``SMALL`` of them. Of more, each is first paired
with one of them (in parts of ``PART`` nodes, whose middles are paired too), and only those that still lie in several
classes are paired across classes, in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, REMEMBERED, ascii_lower, begin, cut, give_back, narrowed

#: Similarity as a fraction, so that the threshold is exact.
SHINGLE, SIMILARITY = 5, (4, 5)
SMALL, PART, TILE = 32, 20_000, 4_000
#: Documents looked at for common shingles, and how many shingles are kept as common at most. They only set the order.
SAMPLE, COMMON = 4_000, 50_000
#: Entries that a worker packs at a time, rows it reads at a time, and slices a shuffle partition.
PACKED, ROWS, SLICES = 300_000, 300, 8
#: Nodes that a task remembers, so that most copies are dealt once.
SEEN = 50_000
COUNTED = np.dtype([("low", "<u4"), ("node", "<i8")])
RANKED = np.dtype([("shingle", "<i8"), ("node", "<i8"), ("n", "<i4"), ("df", "<i4")])
ENTRY = np.dtype([("shingle", "<i8"), ("node", "<i8"), ("n", "<i4"), ("at", "<i4"), ("part", "<i4")])
PAIR = "u long, v long"
#: Of the sketch that leaves out most pairs before whole sets are moved.
BITS = 1024
#: Pairs whose sketches are compared at a time, three arrays of 128 bytes a pair.
SKETCHED = 8_192


class _Words(dict):
    """Word -> hash, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        value = xxh64_intdigest(word, 42)
        if len(word) < 64:
            if len(self) > 50_000:
                self.clear()
            self[word] = value
        return value


_WORDS = _Words()
REMEMBERED["jaccard"] = _WORDS.clear


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = ascii_lower(text or "").encode().split()
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - shingle + 1)
    h = w[:n].copy()
    for i in range(1, min(shingle, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
    return np.unique(mixed(h).view(np.int64))


def named(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), 42)).astype(np.int64))


def node(text: Column, shingle: int = SHINGLE) -> Column:
    """The node of each text. Spark must not take it for an expression that it may repeat: a filter on it, as a join
    adds one, would run it twice, and each core of an executor would need two workers from then on."""
    import pandas as pd

    def typed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([named(shingles(t, shingle)) for t in texts], dtype="int64")

    typed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(typed, "long").asNondeterministic()(text)


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each of ``BITS`` classes of hashes: whether the set has an odd number of them. Two sets differ by at
    least as many hashes as these bits do."""
    return np.packbits(np.bincount(hashes.view(np.uint64) % np.uint64(BITS), minlength=BITS) & 1 == 1).tobytes()


def majority(hashes: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if it is in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def text_sets(batches: Iterator[pa.RecordBatch], column: int, shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """A few rows at a time, with their sets."""
    begin("jaccard")
    for n, batch in enumerate(batches):
        if n % 8 == 7:
            give_back()
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            yield part, [shingles(t, shingle) for t in part.column(column).to_pylist()]


def nodes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, node, n, fp, sketch, some) for each row: n shingles, SimHash fp, parity sketch, and of a sample of the
    nodes the shingles themselves."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    most = int(share * 2**63) - 1

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in text_sets(batches, 1, shingle):
            names = [named(h) for h in sets]
            some = [h.tobytes() if x & (2**63 - 1) <= most else None for h, x in zip(sets, names, strict=True)]
            columns = [pa.array(names, pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([majority(h) for h in sets], pa.int64()), pa.array([parities(h) for h in sets], pa.binary()), pa.array(some, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "node", "n", "fp", "sketch", "some"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(docs.select("doc_id", "text").mapInArrow(described, f"doc_id {kind}, node long, n long, fp long, sketch binary, some binary"))


def common_shingles(known: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes that several texts of the sample have, sorted, with the rank of each by frequency and its share."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64))], names=["h"])

    some = known.where("some is not null").dropDuplicates(["node"]).select("some")
    rows = some.mapInArrow(each, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    hashes = np.array([r[0] for r in reversed(rows)], np.int64)
    order = np.argsort(hashes)
    return hashes[order], order, np.array([r[1] for r in reversed(rows)])[order] / max(1, SAMPLE)


def dealt(h: np.ndarray, common: np.ndarray, ranks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes to be counted, the prefix's hashes beyond these (``most`` in all), and for each of the latter its
    place in common or -1."""
    place = np.full(len(h), -1)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        place = np.where(common[at] == h, at, -1)
    first = h.view(np.uint64) >> np.uint64(40) & np.uint64(1) == 1
    counted, second, third = h[first & (place < 0)], np.flatnonzero(~first & (place < 0)), np.flatnonzero(place >= 0)
    left = max(0, most - len(counted))
    rest = np.concatenate([second, third[np.argsort(ranks[place[third]])] if left > len(second) else third[:0]])[:left]
    return counted, h[rest], place[rest]


def near(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether entries of the same shingle may be of near sets, by what the sets can have in common."""
    p, q = similarity
    both = np.minimum(a["at"], b["at"]) + 1 + np.minimum(a["n"] - a["at"], b["n"] - b["at"]) - 1
    return (p + q) * both.astype(np.int64) >= p * (a["n"].astype(np.int64) + b["n"])


def candidates(entries: np.ndarray, similarity: tuple[int, int], small: int = SMALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (u, v) of nodes, the entries of shingles that more than ``small`` nodes share, and the middle of each part
    of a shingle that is dealt in parts."""
    e = entries[np.argsort(entries["shingle"], kind="stable")]
    same = e["shingle"][1:] == e["shingle"][:-1]
    e = e[np.append(same, False) | np.insert(same, 0, False) | (e["part"] >= 0)] if len(e) else e
    e = e[np.lexsort((e["node"], e["part"], e["shingle"]))]
    differs = lambda *names: np.insert(np.any([e[c][1:] != e[c][:-1] for c in names], axis=0), 0, True) if len(e) else np.zeros(0, bool)
    e = e[differs("shingle", "part", "node")]  # copies of a document
    begin = np.flatnonzero(differs("shingle", "part"))
    size = np.diff(np.append(begin, len(e)))
    found, large, middles = [np.zeros((0, 2), np.int64)], [e[:0]], [e[:0]]

    def put(a: np.ndarray, b: np.ndarray) -> None:
        held = near(a, b, similarity)
        found.append(np.stack([a["node"][held], b["node"][held]], axis=1))

    whole = e["part"][begin] < 0 if len(e) else np.zeros(0, bool)
    for n in np.unique(size[whole & (size > 1) & (size <= small)]).tolist():
        at = begin[whole & (size == n)]
        for i in range(n):
            for j in range(i + 1, n):
                put(e[at + i], e[at + j])
    for a, n in zip(begin[~whole | (size > small)].tolist(), size[~whole | (size > small)].tolist(), strict=True):
        part = e[a : a + n]
        middle = part[np.argsort(part["n"], kind="stable")[n // 2]]
        put(np.repeat(middle[None], n), part)
        large.append(part)
        if middle["part"] >= 0:
            middles.append(middle[None])
    pairs = np.sort(np.concatenate(found), axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0), np.concatenate(large), np.concatenate(middles)


def sketches_of(rows: pa.Array | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint64).reshape(-1, BITS // 64)


def plausible(n: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether sets of n shingles together may be near, by their parity sketches x and y."""
    p, q = similarity
    apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)  # at least
    return (p + q) * (n - apart) >= 2 * p * n


def across(entries: np.ndarray, classes: np.ndarray, sketches: np.ndarray, other: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Pairs (u, v) of entries of one shingle, one of those marked as other and one of the rest, that may be near and
    lie in different classes."""
    rows, all_ = np.flatnonzero(other), np.flatnonzero(~other)
    found = [np.zeros((0, 2), np.int64)]
    step = max(1, (1 << 16) // max(1, len(all_)))
    for k in range(0, len(rows), step):
        a = rows[k : k + step]
        i, j = np.nonzero(near(entries[a][:, None], entries[all_][None, :], similarity) & (classes[a][:, None] != classes[all_][None, :]))
        i, j = a[i], all_[j]
        for at in range(0, len(i), SKETCHED):
            u, v = i[at : at + SKETCHED], j[at : at + SKETCHED]
            held = plausible(entries["n"][u].astype(np.int64) + entries["n"][v], sketches[u], sketches[v], similarity)
            found.append(np.stack([entries["node"][u[held]], entries["node"][v[held]]], axis=1))
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def _packs(which: np.ndarray, entries: np.ndarray, final: bool) -> pa.RecordBatch:
    """A row for each slice: its entries as bytes."""
    order = np.argsort(which, kind="stable")
    which, entries = which[order], entries[order]
    begin = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else np.zeros(0, np.int64)
    data = [x.tobytes() for x in np.split(entries, begin[1:])] if len(which) else []
    return pa.RecordBatch.from_arrays([pa.array(which[begin].astype(np.int32)), pa.array(np.full(len(begin), final)), pa.array(data, pa.binary())], names=["slice", "final", "entries"])


PACK = "slice int, final boolean, entries binary"


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, bytes]]:
    """For each slice (rows come sorted by slice) the entries that are not final, and those that are."""
    now, held = None, ([], [])
    for batch in batches:
        for which, final, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if which != now:
                if now is not None:
                    yield now, b"".join(held[0]), b"".join(held[1])
                now, held = which, ([], [])
            held[final].append(data)
    if now is not None:
        yield now, b"".join(held[0]), b"".join(held[1])


def _slice_of(x: np.ndarray, n: int) -> np.ndarray:
    return (mixed(x.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _parts(node_: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The part of each entry of a shingle that is dealt in so many parts; -1 where it is dealt whole."""
    return np.where(parts > 1, _slice_of(node_, 1 << 30) % np.maximum(parts, 1), -1).astype(np.int32)


def _to_final(e: np.ndarray, slices: int) -> pa.RecordBatch:
    return _packs(_slice_of(e["shingle"] * 31 + e["part"] + 1, slices), e, True)


def prefixes(docs: DataFrame, known: DataFrame, shingle: int, similarity: tuple[int, int], part: int = PART) -> DataFrame:
    """The entries of all prefixes, packed, in partitions by shingle."""
    p, q = similarity
    common, ranks, shares = common_shingles(known)
    total = known.count()
    common_parts = np.ceil(shares * total / part).astype(np.int64)
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = SLICES * spread
    most = lambda n: n - -(-p * n // q) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries to be counted by shingle; and, final, sizes by node (as entries without a shingle) and prefixes
        beyond the counted half."""
        counted, sizes, rest, n, seen = [], [], [], 0, set()

        def packed() -> Iterator[pa.RecordBatch]:
            e = np.concatenate(counted)
            which = _slice_of(e["shingle"], slices)
            c = np.empty(len(e), COUNTED)
            c["low"], c["node"] = e["shingle"].view(np.uint64) >> np.uint64(32), e["node"]
            yield _packs(which, c, False)
            for x in (np.array(sizes, RANKED), np.concatenate(rest) if rest else np.zeros(0, RANKED)):
                yield _packs(_slice_of(x["node"], slices), x, True)
            for x in (counted, sizes, rest):
                x.clear()

        for _, sets in text_sets(batches, 0, shingle):
            for h in sets:
                name = named(h)
                if not len(h) or name in seen:  # copies are one node
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                first, beyond, place = dealt(h, common, ranks, most(len(h)))
                # Two shingles may look alike when counted; the positions go by those that differ.
                low = first.view(np.uint64) >> np.uint64(32)
                first = first[np.unique(low << np.uint64(32) | _slice_of(first, slices).astype(np.uint64), return_index=True)[1]]
                e = np.empty(len(first), [("shingle", "<i8"), ("node", "<i8")])
                e["shingle"], e["node"] = first, name
                counted.append(e)
                sizes.append((0, name, len(h), len(first)))
                n += len(first) + len(beyond) + 1
                if len(beyond):
                    r = np.empty(len(beyond), RANKED)
                    r["shingle"], r["node"], r["n"], r["df"] = beyond, name, np.where(place < 0, 1, common_parts[place] if len(common) else 1), -1 - len(first) - np.arange(len(beyond))
                    rest.append(r)
                if n >= PACKED:
                    yield from packed()
                    n = 0
        if counted:
            yield from packed()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each slice, the entries whose shingle several nodes hold, with their number."""
        for which, data, final in _by_slice(batches):
            c = np.frombuffer(data, COUNTED)
            if len(c):
                c = c[np.lexsort((c["node"], c["low"]))]
                new = np.append(True, c["low"][1:] != c["low"][:-1])
                c = c[new | np.append(True, c["node"][1:] != c["node"][:-1])]  # copies in several tasks
                begin = np.flatnonzero(np.append(True, c["low"][1:] != c["low"][:-1]))
                df = np.diff(np.append(begin, len(c)))
                df = np.repeat(df, df)
                c, df = c[df > 1], df[df > 1]
                e = np.empty(len(c), RANKED)
                e["shingle"], e["node"], e["n"], e["df"] = c["low"].astype(np.int64) << 31 | which, c["node"], 0, np.minimum(df, 2**31 - 1)
                yield _packs(_slice_of(e["node"], slices), e, True)
            if final:
                yield _packs(np.array([which]), np.frombuffer(final, RANKED)[None], True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each bucket of nodes, their prefixes."""
        for _, _, data in _by_slice(batches):
            e = np.frombuffer(data, RANKED)
            size = e[(e["n"] > 0) & (e["df"] >= 0)]
            size = size[np.unique(size["node"], return_index=True)[1]]
            of = lambda x: size[np.searchsorted(size["node"], x["node"])]  # noqa: E731, B023
            late = e[e["df"] < 0]
            got = e[(e["df"] > 0) & (e["n"] == 0)]
            got = got[np.lexsort((got["shingle"], got["df"], got["node"]))]
            begin = np.flatnonzero(np.append(True, got["node"][1:] != got["node"][:-1])) if len(got) else np.zeros(0, np.int64)
            n = np.diff(np.append(begin, len(got)))
            own = of(got)
            at = np.arange(len(got)) - np.repeat(begin, n) + own["df"] - np.repeat(n, n)
            held = at < own["n"] - -(-p * own["n"].astype(np.int64) // q) + 1
            out = np.empty(held.sum() + len(late), ENTRY)
            k = held.sum()
            out["shingle"][:k], out["node"][:k], out["n"][:k], out["at"][:k] = got["shingle"][held], got["node"][held], own["n"][held], at[held]
            out["part"][:k] = _parts(got["node"][held], -(-got["df"][held].astype(np.int64) // part))
            out["shingle"][k:], out["node"][k:], out["n"][k:], out["at"][k:] = late["shingle"], late["node"], of(late)["n"], -1 - late["df"]
            out["part"][k:] = _parts(late["node"], late["n"].astype(np.int64))
            yield _to_final(out, slices)

    by = lambda df: df.repartition(spread, "slice").sortWithinPartitions("slice")
    entries = by(docs.select("text").mapInArrow(count, PACK))
    entries = by(entries.mapInArrow(rank, PACK))
    return by(entries.mapInArrow(place, PACK)).select("slice", "final", "entries")


def proposed(docs: DataFrame, known: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, small: int = SMALL, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of nodes that may be near, and the entries (node, shingle, n, at) of shingles that many share, for
    ``remaining``."""

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, data in _by_slice(batches):
            pairs, large, middles = candidates(np.frombuffer(data, ENTRY), similarity, small)
            for kind, u, v, e in ((0, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), ENTRY)), (1, large["node"], large["node"], large), (2, middles["node"], middles["node"], middles)):
                columns = [np.full(len(u), kind, np.int32), *map(np.ascontiguousarray, (u, v, e["shingle"], e["n"], e["at"]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "u", "v", "shingle", "n", "at"])

    found = cut(prefixes(docs, known, shingle, similarity, part).mapInArrow(pairs_of, "kind int, u long, v long, shingle long, n int, at int"))
    middles = found.where("kind = 2").select("shingle", "u")
    ends = middles.groupBy("shingle").agg(F.min("u").alias("v"))
    pairs = found.where("kind = 0").select("u", "v").union(middles.join(ends, "shingle").where("u <> v").select(F.least("u", "v"), F.greatest("u", "v"))).distinct()
    return pairs, found.where("kind = 1").select(F.col("u").alias("node"), "shingle", "n", "at")


def remaining(large: DataFrame, near_to: DataFrame, known: DataFrame, similarity: tuple[int, int] = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Pairs (u, v) that share one of the shingles of ``large``, lie in different classes of near_to (node, component)
    and may be near by their sketches. Of each shingle all nodes outside its largest class meet all nodes, in tiles."""
    import pandas as pd

    e = large.join(near_to, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = e.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(F.sum("c").alias("c"), F.max(F.struct("c", "component")).alias("top")).where("c > top.c")
    parts = lambda n: F.ceil(n / F.lit(tile)).cast("int")
    sizes = cut(sizes.select("shingle", F.col("top.component").alias("top"), parts(F.col("c")).alias("wide"), parts(F.col("c") - F.col("top.c")).alias("high")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_KEYS else sizes  # else all nodes of a shingle meet in a task
    e = cut(e.join(sizes, "shingle").withColumn("other", F.col("component") != F.col("top")))
    e = e.join(narrowed(known.select("node", "sketch"), e.select("node"), "node", "left_semi").dropDuplicates(["node"]), "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["shingle", "node", "n", "at", "component", "sketch"]
    all_ = e.select(*columns, F.lit(False).alias("other"), own("wide").alias("i"), "high").select("*", every("high").alias("j")).drop("high")
    some = e.where("other").select(*columns, "other", "wide", own("high").alias("j")).select("*", every("wide").alias("i")).drop("wide")

    def cross(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(len(rows), ENTRY)
        for c in ("shingle", "node", "n", "at"):
            x[c] = rows[c].to_numpy()
        pairs = across(x, rows["component"].to_numpy(), sketches_of(rows["sketch"]), rows["other"].to_numpy(bool), similarity)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    cross.__annotations__ = {}
    return all_.unionByName(some).groupBy("shingle", "i", "j").applyInPandas(cross, PAIR).distinct()


def compared(pairs: DataFrame, docs: DataFrame, known: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Those of pairs (u, v), without repeats, whose sets are near."""
    p, q = similarity

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (sketches_of(batch.column(k).to_pylist()) for k in (4, 5))
                mask = pa.array(plausible(batch.column(2).to_numpy() + batch.column(3).to_numpy(), x, y, similarity))
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], names=["u", "v"])

    pairs = cut(pairs)
    of_pairs = narrowed(known, pairs.select(F.col("u").alias("node")).union(pairs.select("v")), "node", "left_semi")
    sketches = of_pairs.select("node", "n", "sketch").dropDuplicates(["node"])
    side = lambda c, k: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    both = pairs.join(side("u", 1), "u").join(side("v", 2), "v").select("u", "v", "n1", "n2", "s1", "s2")
    pairs = cut(both.mapInArrow(sketched, PAIR))
    wanted = cut(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    # One document of each node that occurs; of documents without an id, all.
    ids = narrowed(known, wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    texts = narrowed(docs.select("doc_id", "text"), ids.select("doc_id").where("doc_id is not null"), "doc_id", "left_semi").union(docs.where("doc_id is null").select("doc_id", "text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in text_sets(batches, 0, shingle):
            yield pa.RecordBatch.from_arrays([pa.array([named(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], names=["node", "set"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, x, y = batch.columns
            held = []
            for a, b in zip(x, y, strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64)
                joint = len(np.intersect1d(a, b, assume_unique=True))
                held.append((p + q) * joint >= p * (len(a) + len(b)))
            mask = pa.array(held, pa.bool_())
            yield pa.RecordBatch.from_arrays([u.filter(mask), v.filter(mask)], names=["u", "v"])

    full = cut(narrowed(texts.select("text").mapInArrow(sets, "node long, set binary"), wanted, "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.join(full.select(F.col("node").alias("u"), F.col("set").alias("x")), "u").join(full.select(F.col("node").alias("v"), F.col("set").alias("y")), "v")
    return cut(both.select("u", "v", "x", "y").mapInArrow(check, PAIR))
