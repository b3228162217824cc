"""Mixing sources to target weights by min-cost flow.

Documents belong to one source or to several that overlap. They are counted by membership pattern (the set of their
sources): patterns and sources are few, documents are not. A flow routes the words of each pattern to the quotas of its
sources; the first pass over a pattern costs 1 a word, each further pass more, so costs are convex and nothing repeats
before it must. The flow says how many words of a pattern are taken; documents are then selected in the order of a
seeded hash: whole passes for all, one more for those before a cut, and a part of the one document at the cut, so that
a source's words meet its target to the word.

The cut is found by words in 4096 hash buckets for each pattern, then in 4096 parts of one bucket, and then among the
documents of one part only (one in 2 ** 24 of the pattern), so no pattern is sorted by one task. Texts are never
shuffled, but for those of that part.

Defined cases: null text has size 0 and takes 0; texts of any length are counted whole; a null source is a source of
its own, last in order; null or repeated members of an array of sources count once; repeated rows are documents each,
and where only one of them is taken, which does not matter; rows alike but in further columns are told apart by these;
null ids are allowed; an empty table gives no rows; further columns, of any type and name, are ignored or kept as they
are. More than ``MOST_PATTERNS`` patterns are an error, not a partial mix.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, cut, fresh_name, table

WEIGHTS = (5, 2, 1)
SHARE, MOST_PASSES = 1.5, 2
#: Patterns that the driver plans for: some hundred MB there. Up to BROADCAST_KEYS of them are sent to all executors.
MOST_PATTERNS = 1_000_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """share of all words by weight; a target stops at ``most`` times its source's words and the excess is dealt again
    by weight until none is above."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        full = {i for i in open_ if weights[i] * left / total >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = weights[i] * left / total
            break
        for i in sorted(full):
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= full
    return out


def min_cost_flow(words: list[int], member: list[tuple[int, ...]], quotas: list[int], passes: int) -> list[dict[int, int]]:
    """For each pattern (words, its sources), the words it sends to each source's quota. Passes over a pattern cost
    1, 3, 5, ... a word; quotas that cannot be met are met as far as possible. Patterns that no chain of common sources
    connects are networks of their own."""
    sent: list[dict[int, int]] = [{} for _ in words]
    head = list(range(len(quotas)))

    def root(s: int) -> int:
        while head[s] != s:
            head[s] = head[head[s]]
            s = head[s]
        return s

    for sources in member:
        for s in sources[1:]:
            head[root(s)] = root(sources[0])
    networks: dict[int, list[int]] = {}
    for p, sources in enumerate(member):
        if sources:
            networks.setdefault(root(sources[0]), []).append(p)
    for tied in networks.values():
        _flow(tied, words, member, quotas, passes, sent)
    return sent


def _flow(tied: list[int], words: list[int], member: list[tuple[int, ...]], quotas: list[int], passes: int, sent: list[dict[int, int]]) -> None:
    """The flow of one network, by successive shortest paths with potentials, into sent."""
    # Nodes: 0 the start, patterns, sources, the end.
    sources = sorted({s for p in tied for s in member[p]})
    node_of = {("p", p): i + 1 for i, p in enumerate(tied)} | {("s", s): i + 1 + len(tied) for i, s in enumerate(sources)}
    end = len(node_of) + 1
    arcs: list[list[int]] = []  # to, capacity, cost, back
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, capacity, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    between = {}
    for p in tied:
        for k in range(passes):
            arc(0, node_of["p", p], words[p], 2 * k + 1)
        for s in member[p]:
            between[p, s] = arc(node_of["p", p], node_of["s", s], passes * words[p], 0)
    for s in sources:
        arc(node_of["s", s], end, quotas[s], 0)
    potential = [0] * (end + 1)
    while True:
        dist, via = [float("inf")] * (end + 1), [-1] * (end + 1)
        dist[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in out[a]:
                b, capacity, cost = arcs[e]
                step = d + cost + potential[a] - potential[b]
                if capacity and step < dist[b]:
                    dist[b], via[b] = step, e
                    heapq.heappush(heap, (step, b))
        if via[end] < 0:
            break
        potential = [p + min(d, dist[end]) for p, d in zip(potential, dist, strict=True)]
        path, b = [], end
        while b:
            path.append(via[b])
            b = arcs[via[b] ^ 1][0]
        amount = min(arcs[e][1] for e in path)
        for e in path:
            arcs[e][1] -= amount
            arcs[e ^ 1][1] += amount
    for (p, s), e in between.items():
        if arcs[e ^ 1][1]:
            sent[p][s] = arcs[e ^ 1][1]


def members(sources: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>"))))


def plan(narrow: DataFrame, weight_of: Callable[[int], float], share: float, most: int) -> tuple[list[dict], list[dict]]:
    """For each pattern {pattern, words, taken}, and for each source its size and target. narrow: (pattern, size)."""
    counted = narrow.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(counted) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} patterns of sources: join sources first")
    patterns = sorted(((tuple(r[0]), int(r[1])) for r in counted), key=lambda r: [(x is None, x) for x in r[0]])
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, (s or "").encode()))
    index = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for p, w in patterns:
        for s in p:
            sizes[index[s]] += w
    goal = targets(sizes, [weight_of(i) for i in range(len(names))], share, most)
    flow = min_cost_flow([w for _, w in patterns], [tuple(index[s] for s in p) for p, _ in patterns], [round(t) for t in goal], most)
    taken = [{"pattern": list(p), "words": w, "taken": sum(f.values())} for (p, w), f in zip(patterns, flow, strict=True)]
    return taken, [{"source": s, "source_size": n, "target": t} for s, n, t in zip(names, sizes, goal, strict=True)]


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_KEYS else df


def order_of(seed: str, key: list[Column]) -> Column:
    return F.md5(F.concat_ws("\x1f", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("\x1e")) for k in key)))


def bucket_of(order: Column) -> Column:
    """The first 24 bits of the order."""
    return F.conv(F.substring(order, 1, 6), 16, 10).cast("int")


def cut_points(narrow: DataFrame, taken: list[dict]) -> DataFrame:
    """(p, pattern, whole, extra, cut, before): whole passes over a pattern, and extra words of one more, which ends in
    the bucket ``cut`` with ``before`` words in earlier buckets. narrow: (pattern, size, bucket)."""
    goals = [(i, t["pattern"], int(t["taken"] // t["words"]) if t["words"] else 0, int(t["taken"] % t["words"]) if t["words"] else 0) for i, t in enumerate(taken)]
    kinds = {"p": pa.int32(), "pattern": pa.list_(pa.string()), "whole": pa.int64(), "extra": pa.int64()}
    # As a list it would pass through Python workers of another kind, a daemon and two workers more on each executor.
    goals = narrow.sparkSession.createDataFrame(pa.table({c: pa.array([g[k] for g in goals], kind) for k, (c, kind) in enumerate(kinds.items())}))
    rows = narrow.join(_sent(goals, len(taken)), "pattern")  # arrays with null members are equal, too
    coarse = F.shiftright("bucket", 12)

    def found(sums: DataFrame, key: str, first: Column) -> DataFrame:
        running = F.sum("words").over(Window.partitionBy("p").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))  # 4096 rows a pattern
        return sums.withColumn("before", first + running - F.col("words")).where("before <= extra and extra < before + words")

    one = found(rows.groupBy("p", "extra", coarse.alias("coarse")).agg(F.sum("size").alias("words")), "coarse", F.lit(0)).select("p", F.col("coarse").alias("at"), F.col("before").alias("ahead"))
    fine = rows.join(_sent(one, len(taken)), "p").where(coarse == F.col("at")).groupBy("p", "extra", "ahead", "bucket").agg(F.sum("size").alias("words"))
    cuts = found(fine, "bucket", F.col("ahead")).select("p", F.col("bucket").alias("cut"), "before")
    return goals.join(cuts, "p", "left")


def weight_of(i: int) -> float:
    return float(WEIGHTS[i % len(WEIGHTS)])


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """A row for each document: its size, its source's size and target, and the words the mix takes of it."""
    narrow = docs.select("doc_id", "source", members(F.array("source")).alias("pattern"), n_words(docs["text"]).alias("size"), order_of(seed, [F.col("doc_id"), F.col("source")]).alias("order"))
    narrow = cut(narrow.withColumn("bucket", bucket_of(F.col("order"))))
    taken, sources = plan(narrow, weight_of, SHARE, MOST_PASSES)
    rows = narrow.join(_sent(cut_points(narrow, taken), len(taken)), "pattern")
    at = F.col("bucket").eqNullSafe(F.col("cut"))
    ahead = Window.partitionBy("p").orderBy("order", "size", "doc_id", "source").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where(at).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    inside = inside.withColumn("taken", F.col("whole") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), F.col("extra") - F.col("ahead"))))
    outside = rows.where(~at).withColumn("taken", (F.col("whole") + F.coalesce((F.col("bucket") < F.col("cut")).cast("long"), F.lit(0))) * F.col("size"))
    chosen = outside.unionByName(inside.drop("ahead"))
    named = docs.sparkSession.createDataFrame([(s["source"], s["source_size"], s["target"]) for s in sources], "name string, source_size long, target double")
    joined = chosen.join(_sent(named, len(sources)), F.col("source").eqNullSafe(F.col("name")))
    return joined.select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, seed: str = "mix", sources: str | None = None) -> DataFrame:
    """docs as the mix takes them: a document that is taken twice has two rows, one at the cut its first words.
    sources: a column with an array of sources for corpora whose sources overlap; by default the column source."""
    member = members(F.col(sources) if sources else F.array("source"))
    order = order_of(seed, [F.col("doc_id"), *([] if sources else [F.col("source")]), F.xxhash64("text")])
    narrow = cut(docs.select(member.alias("pattern"), n_words(docs["text"]).alias("size"), bucket_of(order).alias("bucket")))
    taken, _ = plan(narrow, weight_of, SHARE, MOST_PASSES)
    names = {c: fresh_name(docs, f"mix_{c}") for c in ("p", "pattern", "whole", "extra", "cut", "before", "order", "size", "ahead", "words")}
    col = {k: F.col(v) for k, v in names.items()}
    points = cut(cut_points(narrow, taken)).withColumnsRenamed({k: names[k] for k in ("p", "pattern", "whole", "extra", "cut", "before")})
    keyed = docs.withColumns({names["pattern"]: member, names["order"]: order}).join(_sent(points, len(taken)), names["pattern"])
    bucket = bucket_of(col["order"])
    at = bucket.eqNullSafe(col["cut"])
    some = F.col("text").rlike(r"[^\x20\x09-\x0D]")  # others have no words to take
    passes = col["whole"] + F.coalesce((bucket < col["cut"]).cast("long"), F.lit(0))
    outside = keyed.where(~at & some).withColumn(names["words"], F.explode(F.array_repeat(F.lit(None).cast("long"), passes.cast("int"))))
    inside = keyed.where(at & some).withColumn(names["size"], n_words(F.col("text")))
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    ahead = Window.partitionBy(names["p"]).orderBy(names["order"], names["size"], row).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn(names["ahead"], col["before"] + F.coalesce(F.sum(names["size"]).over(ahead), F.lit(0)))
    rest = F.least(col["size"], F.greatest(F.lit(0).cast("long"), col["extra"] - col["ahead"]))
    full = F.array_repeat(F.lit(None).cast("long"), col["whole"].cast("int"))
    parts = F.when(rest == col["size"], F.concat(full, F.array(F.lit(None).cast("long")))).when(rest > 0, F.concat(full, F.array(rest))).otherwise(full)
    inside = inside.withColumn(names["words"], F.explode(parts)).drop(names["size"], names["ahead"])
    both = outside.unionByName(inside)
    first = F.array_join(F.slice(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""), 1, col["words"].cast("int")), " ")
    partly = col["words"].isNotNull()
    columns = {"text": F.when(partly, first).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(partly, F.length(first)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return both.select(*(columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The same rows in SQL: targets as the level at which sources fill up, cuts by a running sum over all documents.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM d GROUP BY source
), r AS (
  SELECT *, 1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_w
  FROM s WINDOW o AS (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min(rest / open_w, n / w) FILTER (WHERE rest / open_w < 2 * n / w) AS level FROM r
), t AS (
  SELECT source, n, CASE WHEN level IS NULL OR level * w >= 2 * n THEN CAST(2 * n AS DOUBLE) ELSE level * w END AS target FROM s, l
), q AS (
  SELECT *, least(CAST(round_even(target, 0) AS BIGINT), 2 * n) AS quota FROM t
), c AS (
  SELECT d.doc_id, d.size, q.n AS source_size, q.target, CASE WHEN q.n = 0 THEN 0 ELSE quota // q.n END AS whole, CASE WHEN q.n = 0 THEN 0 ELSE quota % q.n END AS extra,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix' || chr(31) || coalesce(CAST(d.doc_id AS VARCHAR), chr(30)) || chr(31) || coalesce(d.source, chr(30))), d.size, d.doc_id, d.source
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(size, greatest(0, extra - ahead)) AS BIGINT) AS taken FROM c
"""
