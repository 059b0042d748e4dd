"""Token-ID files coded with a static range asymmetric numeral system.

A folder has ``table``, the frequencies that all its files share, ``parts``, a Parquet table with the number of files and
ids of each part, and files PART-NUMBER.ids. A file holds the ids of some documents, in the documents' order::

    magic, number of documents, number of blocks          header, little-endian unsigned 32-bit integers
    ids before this file in its part                       64-bit
    doc_id, n_tokens                                       of each document, 64-bit each; the least number stands for no id
    n_ids, n_words, crc32 of the ids, crc32 of the block   of each block, 32-bit each: the checkpoints
    blocks                                                 see ``encode_block``

Blocks are independent: any one is decoded from its own bytes, the shared frequency table and its checkpoint, so that
readers can work on parts of a file at once and a damaged block harms no other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm._bpe import Words, WordTokenizer, per_worker
from panelwright.llm._store import arrow_rows, forget, new_path, partitions, pick, stored, text_bytes

MAGIC, TABLE_MAGIC = 0x324E5254, 0x314C4254
#: What stands in a file for a null id.
NO_ID = -(1 << 63)
#: Frequencies of a table sum to this power of two.
SCALE_BITS = 20
#: Interleaved states of a block; each step codes one id for every state.
LANES = 2048
#: Ids in a block.
BLOCK = 1 << 19
#: Token ids of documents in one file, about; a longer document has a file alone.
FILE_IDS = 1 << 22
_LOW = 1 << 31
U64 = np.uint64


def frequencies(counts: np.ndarray) -> np.ndarray:
    """The shared table: each id's share of 2 ** SCALE_BITS, at least 1 for every id, so that all can be coded."""
    total = 1 << SCALE_BITS
    if len(counts) > total // 2:
        raise ValueError("the vocabulary is too large for the table's scale")
    spare = total - len(counts)
    share = counts.astype(np.float64) * (spare / max(1, counts.sum()))
    out = np.floor(share).astype(np.int64)
    left = spare - int(out.sum())
    order = np.argsort(-(share - out), kind="stable")
    out[order[: left % len(out)]] += 1
    out += left // len(out)
    return (out + 1).astype(np.uint32)


class Table:
    """A frequency table with what coding needs of it."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(U64)
        self.start = np.cumsum(self.freq, dtype=U64) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_block(table: Table, ids: np.ndarray) -> bytes:
    """Lane i codes ids i, i + LANES, ... from the last to the first; a full state gives its low 32 bits to the stream.

    The block is the lanes' last states (64-bit each) and then the stream in the order in which a decoder reads it.
    """
    state = np.full(LANES, _LOW, U64)
    pieces: list[np.ndarray] = []
    shift, low = U64(SCALE_BITS), U64(63 - SCALE_BITS)
    for at in range((len(ids) - 1) // LANES * LANES, -1, -LANES) if len(ids) else ():
        part = ids[at : at + LANES]
        f, x = table.freq[part], state[: len(part)]
        full = (x >> low) >= f
        if full.any():
            pieces.append((x[full] & U64(0xFFFFFFFF)).astype(np.uint32))
            x = np.where(full, x >> U64(32), x)
        q = x // f
        state[: len(part)] = (q << shift) + (x - q * f) + table.start[part]
    stream = np.concatenate(pieces[::-1]) if pieces else np.zeros(0, np.uint32)
    return state.astype("<u8").tobytes() + stream.astype("<u4").tobytes()


def decode_block(table: Table, block: bytes, n: int) -> np.ndarray:
    """The n ids of a block."""
    state = np.frombuffer(block, "<u8", LANES).astype(U64)
    stream, read = np.frombuffer(block, "<u4", offset=8 * LANES), 0
    out = np.empty(n, np.uint32)
    shift, mask = U64(SCALE_BITS), U64((1 << SCALE_BITS) - 1)
    for at in range(0, n, LANES):
        x = state[: min(LANES, n - at)]
        slot = x & mask
        s = table.symbol[slot]
        out[at : at + len(x)] = s
        x = table.freq[s] * (x >> shift) + slot - table.start[s]
        need = np.flatnonzero(x < U64(_LOW))
        if len(need):
            x[need] = (x[need] << U64(32)) | stream[read : read + len(need)]
            read += len(need)
        state[: len(x)] = x
    return out


def encode_table(freq: np.ndarray) -> bytes:
    body = np.append(np.uint32(SCALE_BITS), freq).astype("<u4").tobytes()
    return np.array([TABLE_MAGIC, len(freq), zlib.crc32(body)], "<u4").tobytes() + body


def decode_table(content: bytes) -> np.ndarray:
    magic, n, crc = np.frombuffer(content, "<u4", 3).tolist()
    if magic != TABLE_MAGIC or zlib.crc32(content[12:]) != crc or len(content) != 16 + 4 * n:
        raise ValueError("the frequency table is damaged")
    if np.frombuffer(content, "<u4", 1, 12)[0] != SCALE_BITS:
        raise ValueError("the frequency table has another scale")
    return np.frombuffer(content, "<u4", n, 16)


def encode_file(table: Table, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, start: int = 0) -> bytes:
    blocks, marks = [], []
    for at in range(0, len(ids), BLOCK):
        part = ids[at : at + BLOCK]
        block = encode_block(table, part)
        blocks.append(block)
        marks.append((len(part), len(block) // 4, zlib.crc32(part.astype("<u4").tobytes()), zlib.crc32(block)))
    head = np.array([MAGIC, len(doc_ids), len(blocks)], "<u4").tobytes() + np.array([start], "<i8").tobytes()
    docs = np.stack([doc_ids, lengths], 1).astype("<i8").tobytes()
    return b"".join([head, docs, np.array(marks, "<u4").tobytes(), *blocks])


def decode_file(table: Table, content: bytes) -> tuple[int, list[tuple[int | None, np.ndarray]]]:
    """The ids before a file in its part, and (doc_id, ids) of its documents in order; a block that fails its checksum raises an error that names it."""
    magic, n_docs, n_blocks = np.frombuffer(content, "<u4", 3).tolist()
    if magic != MAGIC:
        raise ValueError("not a token-ID file")
    start = int(np.frombuffer(content, "<i8", 1, 12)[0])
    docs = np.frombuffer(content, "<i8", 2 * n_docs, 20).reshape(-1, 2)
    at = 20 + 16 * n_docs
    marks = np.frombuffer(content, "<u4", 4 * n_blocks, at).reshape(-1, 4)
    at += 16 * n_blocks
    out, have = np.empty(int(marks[:, 0].sum()), np.uint32), 0
    for k, (n, size, crc, own) in enumerate(marks.tolist()):
        block = memoryview(content)[at : at + 4 * size]
        if zlib.crc32(block) != own:
            raise ValueError(f"block {k} is damaged")
        ids = decode_block(table, block, n)
        if zlib.crc32(ids.astype("<u4", copy=False)) != crc:
            raise ValueError(f"block {k} decodes to other ids")
        out[have : have + n] = ids
        at, have = at + 4 * size, have + n
    ends = np.cumsum(docs[:, 1]).tolist()
    return start, [(None if d == NO_ID else d, out[e - n : e]) for (d, n), e in zip(docs.tolist(), ends, strict=True)]


class Encoding:
    """Ids of texts with what one worker knows of words; an id takes two bytes where the vocabulary allows it."""

    def __init__(self, path: str):
        self.tokenizer = WordTokenizer(path)
        self.size = self.tokenizer.library.get_vocab_size()
        self.width = 2 if self.size <= 1 << 16 else 4
        self.code = [i.to_bytes(self.width, "little") for i in range(self.size)]
        self.known = Words(self.tokenizer.pre_tokens, lambda p: b"".join([self.code[i] for i in self.tokenizer.merge(p)]), b"".join)

    def ids(self, text: str) -> bytes:
        code = self.known.__getitem__
        return b"".join([self.code[self.tokenizer.special[special]] if special is not None else b"".join(map(code, found)) for special, found in self.tokenizer.words(text)])


def _put(folder: str, name: str, content: bytes, attempt: object) -> None:
    """Write a file whole under another name and rename it: a task that runs twice leaves the same file."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/_{name}-{attempt}") as out:
        out.write(content)
    store.move(f"{root}/_{name}-{attempt}", f"{root}/{name}")


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row's whole text, append ``end_id``, and write the ids in ascending order of id as files in ``folder``.

    Ids are encoded once and sorted by range; the table comes from the counts of all ids. Null texts are empty and get
    the end id alone; rows that repeat an id stay apart, in the order of a hash of their ids, so that a task that runs
    again cuts the same files; rows with a null id come first and stay without one. Other columns are ignored; of an
    empty table only the frequencies and an empty list of parts are written.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding: Encoding = per_worker(("encode", path), lambda: Encoding(path))
        end = end_id.to_bytes(encoding.width, "little")
        for b in batches:
            ids = [(encoding.ids(str(t)) if t.is_valid else b"") + end for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    encoding = Encoding(path)
    kind, size = np.dtype(f"<u{encoding.width}"), max(encoding.size, end_id + 1)
    # ids are encoded before the sort, so that the exchange carries them and not the texts
    coded = stored(rows.mapInArrow(tokens, "doc_id long, ids binary"), "tokens")
    sorted_ids = coded.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("ids"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(text_bytes(b.column(0))[0].view(kind), minlength=size)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    found = coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each id of the vocabulary at most
    counts[np.asarray(found["id"])] = np.asarray(found["n"])
    freq = frequencies(counts)
    _put(folder, "table", encode_table(freq), "driver")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        table = Table(freq)
        docs, parts, held, start, k = [], [], 0, 0, 0

        def flush() -> None:
            nonlocal docs, parts, held, start, k
            content = encode_file(table, np.array(docs, np.int64), np.array([len(x) for x in parts], np.int64), np.concatenate(parts), start)
            _put(folder, f"{task.partitionId():06d}-{k:06d}.ids", content, task.taskAttemptId())
            docs, parts, held, start, k = [], [], 0, start + held, k + 1

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs.append(NO_ID if d is None else d)
                parts.append(np.frombuffer(x.as_buffer(), kind))
                held += len(parts[-1])
                if held >= FILE_IDS:
                    flush()
        if docs:
            flush()
        if k:
            yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), pa.array([k], pa.int32()), pa.array([start], pa.int64())], ["part", "files", "n_ids"])

    sorted_ids.mapInArrow(write, "part int, files int, n_ids long").write.parquet(f"{folder}/parts")
    forget(spark, coded)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document in a folder's files, from the folder alone.

    Only the files that ``parts`` lists are read. An empty folder's table gives no row.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"
    # one row for each part of the sort: as many as the job that wrote them had tasks
    parts = spark.read.schema("part int, files int, n_ids long").parquet(f"{folder}/parts").orderBy("part").toArrow()
    if not parts.num_rows:
        return spark.createDataFrame([], schema)
    n_ids = np.asarray(parts["n_ids"])
    place = dict(zip(parts["part"].to_pylist(), zip((np.cumsum(n_ids) - n_ids).tolist(), parts["files"].to_pylist(), strict=True), strict=True))
    freq = decode_table(bytes(spark.read.format("binaryFile").load(f"{folder}/table").select("content").first()[0]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = path.rsplit("/", 1)[1]
                part, number = map(int, name.removesuffix(".ids").split("-"))
                if number >= place.get(part, (0, 0))[1]:
                    continue  # left by an attempt that did not count
                start, docs = decode_file(table, content.as_py())
                n = np.array([len(ids) for _, ids in docs], np.int64)
                begin = place[part][0] + start + np.cumsum(n) - n
                crc = [zlib.crc32(ids.astype("<u4", copy=False)) for _, ids in docs]
                yield pa.record_batch([pa.array([d for d, _ in docs], pa.int64()), pa.array(begin), pa.array(n), pa.array(crc, pa.int64()), pa.array([name] * len(docs))], ["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    return content.mapInArrow(read, schema)


def token_store(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of ``docs`` as files in the shared folder and read them back: see ``write_tokens`` and ``read_tokens``."""
    folder = new_path(docs.sparkSession, "token-ids")
    write_tokens(docs, path, folder, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, folder)
