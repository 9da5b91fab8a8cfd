"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A shard is a file of records: length (u64), masked CRC-32C of the length (u32), payload, masked CRC-32C of the payload (u32),
all little-endian. A payload is the width of an id in bytes (u8), the length of the document's id as UTF-8 (i32, -1 for
null), that id, and the token ids. Beside each shard lies an index file: per record its offset and length (u64) and its
number of tokens (u64). Shards hold ascending ranges of ids. A task writes under a name of its own and renames at its end,
so that a task that runs again, or twice, leaves the same files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrain.llm import tokens
from daygrain.llm.common import mapped, scratch, ship, slices, staged, text_column
from daygrain.llm.crc32c import crc32c, masked

INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("tokens", "<u8")])
#: Bytes of records that a reader takes from a shard at a time.
READ_BYTES = 4 << 20


#: Hadoop's names of stores, and pyarrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "viewfs": "hdfs"}


def _fs(path: str):
    """The file system of a URI and the path in it; any that pyarrow opens and that all executors share."""
    from pyarrow import fs

    scheme, told, rest = path.partition("://")
    if told:
        path = f"{SCHEMES.get(scheme, scheme)}://{rest}"
    return fs.FileSystem.from_uri(path if told or path.startswith("file:") else f"file://{path}")


def frame(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c(lengths)).tolist(), masked(crc32c(payloads)).tolist()
    return [b"".join((n, struct.pack("<I", h), p, struct.pack("<I", t))) for n, h, p, t in zip(lengths, heads, payloads, tails, strict=True)]


def unframe(data: bytes, offsets: list[int], lengths: list[int]) -> list[bytes]:
    """The payloads of records that begin at these offsets; an error where a length or checksum doesn't hold."""
    heads = [data[o : o + 8] for o in offsets]
    payloads = [data[o + 12 : o + 12 + n] for o, n in zip(offsets, lengths, strict=True)]
    told = np.array([struct.unpack_from("<I", data, o + 8)[0] for o in offsets], np.uint32), np.array([struct.unpack_from("<I", data, o + 12 + n)[0] for o, n in zip(offsets, lengths, strict=True)], np.uint32)
    if [struct.unpack("<Q", h)[0] for h in heads] != list(lengths) or (masked(crc32c(heads)) != told[0]).any() or (masked(crc32c(payloads)) != told[1]).any():
        raise ValueError("a record is damaged: its length or a checksum doesn't hold")
    return payloads


def payload(doc_id: str | None, ids: bytes, width: int) -> bytes:
    """ids: little-endian unsigned 32-bit numbers."""
    name = b"" if doc_id is None else doc_id.encode()
    body = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return struct.pack("<Bi", width, -1 if doc_id is None else len(name)) + name + body


def parse(data: bytes) -> tuple[str | None, bytes]:
    width, n = struct.unpack_from("<Bi", data)
    body = data[5 + max(0, n) :]
    return None if n < 0 else data[5 : 5 + n].decode(), body if width == 4 else np.frombuffer(body, "<u2").astype("<u4").tobytes()


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Writes the shards to `path` and returns a table of them, ascending: shard, file, docs, tokens.

    Rows are ordered by id, nulls first; rows with the same id by a hash of the text, then the text. A null text counts as empty. An
    empty table gives no shard. Bytes that aren't UTF-8 count as U+FFFD. Columns besides the two are not read."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("key"), F.col(id_col).cast("string").alias("doc_id"), text_column(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie", "text").select("doc_id", "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard, encoder = context.partitionId(), tokens.encoder(tokens.public(tokenizer), True)
        width, end = (2 if encoder.t.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4), end_id.to_bytes(4, "little")
        store, at = _fs(path)
        name, own = f"{at}/part-{shard:06d}", f"{at}/.part-{shard:06d}-{context.taskAttemptId()}"
        out, index, offset = None, [], 0
        for batch in batches:
            for some in slices(batch, tokens.BATCH_BYTES):
                ids = [x + end for x in encoder.encode_all(some.column("text"))]
                parts = [payload(d, x, width) for d, x in zip(some.column("doc_id").to_pylist(), ids, strict=True)]
                if out is None:
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(f"{own}.rec")
                for x, p, record in zip(ids, parts, frame(parts), strict=True):
                    out.write(record)
                    index.append((offset, len(p), len(x) // 4))
                    offset += len(record)
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{own}.idx") as f:
            f.write(np.array(index, INDEX).tobytes())
        for kind in ("rec", "idx"):
            store.move(f"{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{path}/part-{shard:06d}"], "docs": [len(index)], "tokens": [sum(i[2] for i in index)]})

    shards = staged(mapped(rows, put, "shard long, file string, docs long, tokens long"), "shards")
    _clear_attempts(path)
    return shards


def _clear_attempts(path: str) -> None:
    """Removes what attempts that didn't end have left: files under names of their own."""
    from pyarrow import fs

    store, at = _fs(path)
    for found in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        if found.base_name.startswith(".part-"):
            store.delete_file(found.path)


def _index(file: str) -> np.ndarray:
    store, at = _fs(f"{file}.idx")
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read(), INDEX)


def read(shards: DataFrame) -> DataFrame:
    """The documents of all shards: doc_id (string), start (tokens of all documents before it), n_tokens, ids (u32, little-endian)."""
    ship(shards.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row a shard
    based = shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    based = based.select("file", "base").repartition(max(1, shards.count()))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                index = _index(file)
                ends = index["offset"] + index["length"] + np.uint64(16)
                store, at = _fs(f"{file}.rec")
                with store.open_input_file(at) as f:
                    i = 0
                    while i < len(index):
                        origin = int(index["offset"][i])
                        j = max(i + 1, int(np.searchsorted(ends, np.uint64(origin + READ_BYTES), side="right")))
                        f.seek(origin)
                        data = f.read(int(ends[j - 1]) - origin)
                        docs = [parse(p) for p in unframe(data, (index["offset"][i:j] - np.uint64(origin)).tolist(), index["length"][i:j].tolist())]
                        n = [len(x) // 4 for _, x in docs]
                        starts = start + np.cumsum([0, *n])
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in docs], pa.string()), "start": starts[:-1], "n_tokens": pa.array(n, pa.int64()), "ids": pa.array([x for _, x in docs], pa.binary())})
                        start, i = int(starts[-1]), j

    return mapped(based, get, "doc_id string, start long, n_tokens long, ids binary")


def read_shuffled(shards: DataFrame, seed: int = 0) -> DataFrame:
    """All documents in an order that the seed sets: (doc_id, ids), each read by its offset. The index is shuffled, not the records."""
    ship(shards.sparkSession)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                index = _index(file)
                yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(index)), "offset": index["offset"].astype(np.int64), "length": index["length"].astype(np.int64)})

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file not in opened:
                    store, at = _fs(f"{file}.rec")
                    opened[file] = store.open_input_file(at)
                opened[file].seek(offset)
                doc, ids = parse(unframe(opened[file].read(length + 16), [0], [length])[0])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.string()), "ids": pa.array([ids], pa.binary())})
        for f in opened.values():
            f.close()

    index = mapped(shards.select("file"), entries, "file string, offset long, length long")
    order = F.xxhash64(F.lit(seed), "file", "offset")
    return mapped(index.orderBy(order, "file", "offset"), get, "doc_id string, ids binary")


def digest(docs: DataFrame) -> DataFrame:
    """Writes all documents to the shared folder, reads the files back and tells per document: doc_id, start, n_tokens, ids_crc32."""
    back = read(write(docs, scratch(docs.sparkSession, "records")))
    return back.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
