"""Packing: shortest-pack-first over the histogram of lengths.

1. One pass tokenises each document, appends the end id and cuts it at multiples of the capacity; a row for each piece
   (ids only on request, else their CRC) goes to the shared folder.
2. The histogram of piece lengths has at most ``capacity`` rows, whatever the corpus. The driver places lengths, the
   longest first, into the pack with the most room, and updates counts of packing patterns instead of packs.
3. Each piece gets its rank among the pieces of its length. Ranks are counted in buckets first, so that no length,
   however common, is sorted by one task. A pattern owns a range of ranks of each of its lengths, and so a piece's
   rank gives its sequence and offset.

Defined cases: null text is empty and gives the end id alone; repeated rows are packed each; ids may be null; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import begin, cut, default_tokenizer, table, texts_of

#: Pieces for each bucket of ranks, about.
BUCKET_ROWS = 20_000


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first: (packs, [(length, copies), ...]) for each pattern. A length without room anywhere opens
    packs that hold it as often as it goes in."""
    rooms: list[int] = []
    packs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(n: int, pattern: list[tuple[int, int]], room: int) -> None:
        if n:
            if not packs.get(room):
                insort(rooms, room)
            packs.setdefault(room, []).append((n, pattern))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = rooms[-1] if rooms else 0
            if room < length:
                copies = capacity // length
                put(left // copies, [(length, copies)], capacity - copies * length)
                put(int(left % copies > 0), [(length, left % copies)], capacity - left % copies * length)
                break
            n, pattern = packs[room].pop()
            if not packs[room]:
                rooms.pop()
            used = min(n, left)
            put(n - used, pattern, room)
            *head, (last, copies) = pattern
            put(used, [*head, (last, copies + 1)] if last == length else [*pattern, (length, 1)], room - length)
            left -= used
    return [p for room in sorted(packs) for p in packs[room]]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, copies, first sequence, offset), ascending by first rank."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for n, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            first = ranks.get(length, 0)
            found.setdefault(length, []).append((first, copies, sequence, offset))
            ranks[length] = first + n * copies
            offset += length * copies
        sequence += n
    return {length: np.array(rows, dtype=np.int64) for length, rows in found.items()}


def pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str, path: str | None, with_ids: bool) -> DataFrame:
    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import piece_table

        known, end = piece_table(path or default_tokenizer(vocabulary), "ids"), np.array([end_id], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            for i, found in enumerate(known.ids(texts_of(batch.column(1)))):
                ids = np.concatenate([found, end])
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append((i, start, len(part), zlib.crc32(part), len(ids), part if with_ids else None))
            taken, start, length, crc, total, part = zip(*rows, strict=True) if rows else ([],) * 6
            columns = [batch.column(0).take(pa.array(taken, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            if with_ids:
                columns.append(pa.array([p.astype(np.int32) for p in part], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("doc_id", kind), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long")] + [("ids", "array<int>")] * with_ids
    names = [n for n, _ in fields]
    return docs.select("doc_id", "text").mapInArrow(cut_texts, ", ".join(f"{n} {t}" for n, t in fields))


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, vocabulary: str = "word_bpe_49k.json", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece with its sequence and offset; with_ids adds the token ids."""
    rows = cut(pieces(docs, capacity, end_id, vocabulary, path, with_ids))
    hist = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}  # at most capacity rows
    table_of = slots(pack_histogram(hist, capacity))
    buckets = max(64, sum(hist.values()) // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.join(first, ["length", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("packing")
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                own = table_of[int(n)]
                row = own[np.searchsorted(own[:, 0], rank[at], side="right") - 1]
                index = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + index // row[:, 1]
                offset[at] = row[:, 3] + index % row[:, 1] * n
            kept = [batch.column(k) for k in out if k not in ("sequence_id", "offset")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=out)

    out = [c for c in rows.columns if c != "bucket"] + ["sequence_id", "offset"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"sequence_id": "long", "offset": "long"}
    return ranked.select(*out[:-2], "rank").mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
