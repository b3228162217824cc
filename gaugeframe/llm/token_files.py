"""Token-ID output: training-order materialisation.

Each scan partition's documents, every one followed by the end id, form a stream of ids that is cut into sequences of
one length; they are written to the shared folder with their partition and place, which numbers all sequences without
a gap (places before a partition are a sum over partitions). A keyed Feistel permutation with cycle-walking then maps
each number to a global slot: the training order. Slots are dealt to shards by range, and a task writes each of its
shards as one file of records of a fixed stride, so record ``slot`` lies at a known byte of a known file and reading can
go on from any slot. Files appear by rename when complete: a task that runs again writes the same bytes, and a run
that is resumed skips what is there.

Ids are little-endian, two bytes where the vocabulary allows. The last sequence of a partition may be short; it is
padded with the end id and its length is in the manifest.

Defined cases: null text is empty and gives the end id alone; repeated rows are written each; null ids are allowed; an
empty table gives no files and no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import default_tokenizer, fresh_path, table, texts_of

LENGTH, SHARD_RECORDS, ROUNDS = 1024, 4096, 6
#: Of the run table in a worker.
RUN_BYTES = 32 << 20


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor), keyed."""
    x = (x ^ np.uint64(key & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """A permutation of range(size): a balanced Feistel network on the least even number of bits that holds size,
    walked on while it leaves the range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = numbers.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        x = out[open_]
        left, right = x >> np.uint64(half), x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, key * 0x100000001B3 + r) & mask)
        out[open_] = left << np.uint64(half) | right
        open_ = open_[out[open_] >= size]
    return out.astype(np.int64)


def _file_system(folder: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" in folder or folder.startswith("file:"):
        return FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return LocalFileSystem(), folder


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def squeeze(raw: bytes, width: int) -> bytes:
    """A record on its way to its shard: low bytes, then high bytes (which vary little), compressed."""
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.frombuffer(raw, np.uint8).reshape(-1, width).T.tobytes())


def unsqueeze(packed: bytes) -> bytes:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8)
    return planes.reshape(packed[0], -1).T.tobytes()


def sequences(docs: DataFrame, length: int, end_id: int, vocabulary: str, path: str | None) -> DataFrame:
    def cut_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .bpe import piece_table

        known, end = piece_table(path or default_tokenizer(vocabulary), "ids", RUN_BYTES), np.array([end_id], "<u4")
        width = known.library.get_vocab_size()
        kind = np.dtype("<u2") if width <= 1 << 16 else np.dtype("<u4")
        part, place, held, held_n, pieces = TaskContext.get().partitionId(), 0, [], 0, []
        rows: list[tuple] = []

        def close() -> None:
            nonlocal place, held, held_n, pieces
            ids = np.concatenate(held)
            record = np.full(length, end_id, kind)
            record[:held_n] = ids
            raw = record.tobytes()
            rows.append((part, place, held_n, zlib.crc32(raw), pieces, raw))
            place, held, held_n, pieces = place + 1, [], 0, []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), known.ids(texts_of(batch.column(1))), strict=True):
                ids = np.concatenate([found, end]).astype(kind)
                start = 0
                while start < len(ids):
                    n = min(length - held_n, len(ids) - start)
                    held.append(ids[start : start + n])
                    pieces.append({"doc_id": doc_id, "start": start, "length": n})
                    held_n, start = held_n + n, start + n
                    if held_n == length:
                        close()
                        if len(rows) >= 2048:
                            yield batch_of()
        if held_n:
            close()
        yield batch_of()

    doc = docs.select(F.col("doc_id").cast("long"), "text")
    piece = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
    types, names = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), piece, pa.binary()], ["part", "place", "n_tokens", "record_crc32", "pieces", "record"]
    return doc.mapInArrow(cut_stream, "part int, place long, n_tokens int, record_crc32 long, pieces array<struct<doc_id:long,start:long,length:long>>, record binary")


def materialise(docs: DataFrame, folder: str, key: int = 1, length: int = LENGTH, shard_records: int = SHARD_RECORDS, end_id: int = 49407, vocabulary: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """Write the shards to folder (a place that driver and executors share), and the manifest beside them. Returns the
    manifest: slot, shard, byte_offset, n_tokens, record_crc32, pieces. A second call with the same folder writes what
    is missing, from the same table of sequences."""
    spark = docs.sparkSession
    jvm = spark._jvm
    where = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    store = where("x").getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(where("manifest/_SUCCESS")):
        return spark.read.parquet(f"{folder}/manifest")
    if not store.exists(where("sequences/_SUCCESS")):
        sequences(docs, length, end_id, vocabulary, path).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/sequences")
    rows = spark.read.parquet(f"{folder}/sequences")
    counts = {r[0]: r[1] for r in rows.groupBy("part").count().collect()}  # a row for each scan task
    first = np.zeros(max(counts, default=-1) + 2, np.int64)
    for p, n in counts.items():
        first[p + 1] = n
    first = np.cumsum(first)
    size = int(first[-1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = first[batch.column(0).to_numpy()] + batch.column(1).to_numpy()
            slot = permute(number, size, key)
            packed = pa.array([squeeze(r.as_py(), len(r.as_buffer()) // length) for r in batch.column(5)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // shard_records), *(batch.column(i) for i in range(2, 5)), packed], names=["slot", "shard", *batch.schema.names[2:]])

    kinds = "n_tokens int, record_crc32 long, pieces array<struct<doc_id:long,start:long,length:long>>"
    slotted = rows.mapInArrow(place, f"slot long, shard long, {kinds}, record binary")
    n_shards = max(1, -(-size // shard_records))
    tasks = min(n_shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_shards // 16))
    dealt = slotted.repartition(tasks, "shard").sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        files, base = _file_system(folder)
        files.create_dir(base, recursive=True)
        shard, stream, temporary = None, None, ""

        def end() -> None:
            if stream is not None:
                stream.close()
                files.move(temporary, f"{base}/{shard_name(shard)}")

        for batch in batches:
            shards, slots = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            stride = len(unsqueeze(batch.column(5)[0].as_py())) if batch.num_rows else 0
            for s in np.unique(shards):
                if s != shard:
                    end()
                    shard, stream = int(s), None
                    if files.get_file_info(f"{base}/{shard_name(shard)}").type.name == "NotFound":
                        temporary = f"{base}/.{shard_name(shard)}-{uuid4().hex}"
                        stream = files.open_output_stream(temporary)
                if stream is not None:
                    for record in batch.column(5).filter(pa.array(shards == s)):
                        stream.write(unsqueeze(record.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots % shard_records * stride), *(batch.column(i) for i in (2, 3, 4))], names=names)
        end()

    names = ["slot", "shard", "byte_offset", "n_tokens", "record_crc32", "pieces"]
    dealt.mapInArrow(write, f"slot long, shard long, byte_offset long, {kinds}").write.mode("overwrite").parquet(f"{folder}/manifest")
    store.delete(where("sequences"), True)
    return spark.read.parquet(f"{folder}/manifest")


def read(folder: str, first: int, n: int, length: int = LENGTH, shard_records: int = SHARD_RECORDS, width: int = 2) -> np.ndarray:
    """n records from slot ``first`` on, in training order."""
    files, base = _file_system(folder)
    out = []
    while n > 0:
        shard, at = divmod(first, shard_records)
        with files.open_input_file(f"{base}/{shard_name(shard)}") as f:
            f.seek(at * length * width)
            raw = f.read(min(n, shard_records - at) * length * width)
        if not raw:
            break
        out.append(np.frombuffer(raw, f"<u{width}").reshape(-1, length))
        first, n = first + len(out[-1]), n - len(out[-1])
    return np.concatenate(out) if out else np.zeros((0, length), f"<u{width}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"), fresh_path(spark, "op9"))
