"""Token-id files in patched frame-of-reference blocks.

A file holds the ids of some documents in ascending doc_id order. Its ids are cut into
blocks of 128: a block stores its minimum, packs each value less the minimum at the
width that covers ``PERCENTILE`` of them, and lists the outliers that need more bits as
(place, value). An index has the start of each block, so any range of ids is read by
decoding the blocks it touches.

File: magic ``SSPF1\\0``, then as little-endian 64-bit integers the numbers of
documents, ids and blocks; doc_ids (int64) and a byte each for "null"; lengths
(uint32); starts of blocks (uint64, from the first block); blocks. A block: minimum
(uint32), width and number of outliers (bytes), 2 * width 64-bit words (values 0, 2, 4,
... in the first half of the words and 1, 3, 5, ... in the second), places (bytes),
values (uint32).

Files are written by Spark's text writer, one row a file, and read by its binary source, so
they lie in any store that Spark reaches, a task that is run again replaces what it wrote,
and their names are in the order of the documents. Null and empty texts are documents of
the end id alone; a text of any length lies in one file; null doc_ids come first; rows with
one doc_id are ordered by a hash of the text, equal rows are written each; other columns,
whatever their names, are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_dir, pick, slices_by_bytes, stash
from .token_memo import memo_of

MAGIC = b"SSPF1\0"
BLOCK = 128
PERCENTILE = 0.9
#: A task starts another file when this many ids are in one.
FILE_IDS = 8_000_000


#: Bit length of each 16-bit number.
_BITS = np.repeat(np.arange(17, dtype=np.uint8), [1, *(1 << np.arange(16))])
#: Blocks that are encoded at a time, so that what is computed from them stays in cache.
AT_A_TIME = 4096


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Of unsigned 32-bit numbers."""
    if not values.size or int(values.max()) < 1 << 16:
        return _BITS[values]
    high = values >> np.uint32(16)
    return np.where(high > 0, _BITS[high] + np.uint8(16), _BITS[values & np.uint32(0xFFFF)])


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks, and the blocks."""
    n = -(-len(ids) // BLOCK)
    sizes, parts = [np.zeros(0, np.int64)], []
    for s in range(0, n, AT_A_TIME):
        own = np.ascontiguousarray(ids[s * BLOCK : (s + AT_A_TIME) * BLOCK], np.uint32)
        if len(own) % BLOCK:
            own = np.concatenate([own, np.full(-len(own) % BLOCK, own[-1], np.uint32)])
        size, raw = _encode_some(own.reshape(-1, BLOCK))
        sizes.append(size)
        parts.append(raw)
    ends = np.cumsum(np.concatenate(sizes))
    return np.concatenate([[0], ends[:-1]]).astype("<u8")[: len(ends)], b"".join(parts)


def _encode_some(full: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sizes of some blocks, and the blocks."""
    low = full.min(1)
    rest = full - low[:, None]
    bits = bit_lengths(rest)
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.partition(bits, at, 1)[:, at]
    odd = bits > width[:, None]
    n_odd = odd.sum(1)
    row, place = np.nonzero(odd)
    values = rest[row, place].astype("<u4")
    rest[row, place] = 0
    sizes = 6 + 16 * width.astype(np.int64) + 5 * n_odd
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[starts + 4], out[starts + 5] = width, n_odd
    for w in np.unique(width).tolist():
        if w:
            at = np.flatnonzero(width == w)
            words = pack(rest[at], w).view(np.uint8).reshape(len(at), -1)
            out[(starts[at] + 6)[:, None] + np.arange(16 * w)] = words
    nth = np.arange(len(row)) - (np.cumsum(n_odd) - n_odd)[row]
    tail = starts + 6 + 16 * width.astype(np.int64)
    out[tail[row] + nth] = place
    out[(tail + n_odd)[row][:, None] + 4 * nth[:, None] + np.arange(4)] = values.view(np.uint8).reshape(-1, 4)
    return sizes, out.tobytes()


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 128) values below 2^width as (n, 2 * width) words."""
    # a lane's values of all blocks lie side by side
    lanes = values.T.astype(np.uint64).reshape(BLOCK // 2, 2, -1)
    words = np.zeros((2, width, len(values)), np.uint64)
    for i in range(BLOCK // 2):
        at, shift = divmod(i * width, 64)
        words[:, at] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[:, at + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.reshape(2 * width, -1).T, "<u8")


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.T).reshape(2, width, -1)
    out = np.empty((BLOCK // 2, 2, len(words)), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK // 2):
        at, shift = divmod(i * width, 64)
        v = lanes[:, at] >> np.uint64(shift)
        if shift + width > 64:
            v |= lanes[:, at + 1] << np.uint64(64 - shift)
        out[i] = v & mask
    return out.reshape(BLOCK, -1).T


def decode_blocks(starts: np.ndarray, data: bytes, n_ids: int) -> np.ndarray:
    """The ids of the given blocks."""
    raw, starts = np.frombuffer(data, np.uint8), starts.astype(np.int64)
    out = np.empty((len(starts), BLOCK), np.uint32)
    for s in range(0, len(starts), AT_A_TIME):
        _decode_some(starts[s : s + AT_A_TIME], raw, out[s : s + AT_A_TIME])
    return out.reshape(-1)[:n_ids]


def _decode_some(starts: np.ndarray, raw: np.ndarray, out: np.ndarray) -> None:
    low = np.ascontiguousarray(raw[starts[:, None] + np.arange(4)]).view("<u4")
    width, n_odd = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[at] = unpack(np.ascontiguousarray(raw[(starts[at] + 6)[:, None] + np.arange(16 * w)]).view("<u8"), w) if w else 0
    row = np.repeat(np.arange(len(starts)), n_odd)
    nth = np.arange(len(row)) - (np.cumsum(n_odd) - n_odd)[row]
    tail = starts + 6 + 16 * width
    place = raw[tail[row] + nth]
    values = np.ascontiguousarray(raw[(tail + n_odd)[row][:, None] + 4 * nth[:, None] + np.arange(4)]).view("<u4")
    out[row, place] = values.reshape(-1)
    out += low  # modulo 2^32


def file_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    starts, blocks = encode_blocks(ids)
    head = MAGIC + struct.pack("<qqq", len(doc_ids), len(ids), len(starts))
    return b"".join([head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), bytes(x is None for x in doc_ids), lengths.astype("<u4").tobytes(), starts.tobytes(), blocks])


def read_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a file."""
    if raw[:6] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, n_blocks = struct.unpack_from("<qqq", raw, 6)
    at = 30
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at).tolist()
    at += 8 * n_docs
    null = raw[at : at + n_docs]
    at += n_docs
    lengths = np.frombuffer(raw, "<u4", n_docs, at).astype(np.int64)
    at += 4 * n_docs
    starts = np.frombuffer(raw, "<u8", n_blocks, at)
    at += 8 * n_blocks
    return [None if z else x for x, z in zip(doc_ids, null, strict=True)], lengths, decode_blocks(starts, raw[at:], n_ids)


def write_token_files(docs: DataFrame, spec: str, folder: str, end_id: int = 2, file_ids: int = FILE_IDS) -> str:
    """Encode, append the end id and write the files to ``folder``, which is given back.
    Spark's own writer commits them, so any store that Spark can write to will do."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        memo = memo_of(spec)
        doc_ids, raws = [], []
        size = 0

        def flush():
            nonlocal doc_ids, raws, size
            lengths, ids = np.array([len(x) // 4 for x in raws], np.int64), np.frombuffer(b"".join(raws), "<u4")
            raws = []  # not held beside their copy
            made = file_bytes(doc_ids, lengths, ids)
            doc_ids, size = [], 0
            return pa.record_batch([pa.array([made], pa.binary())], names=["file"])

        for whole in batches:
            for batch in slices_by_bytes(whole, 1):
                for doc, made in zip(batch.column(0).to_pylist(), memo.ids_of([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                    doc_ids.append(doc)
                    raws.append(made + end)
                    size += len(raws[-1]) // 4
                if size >= file_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    tie = F.xxhash64("text")
    rows = pick(docs, doc_id="bigint", text="string").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    # a row is a file: its bytes and a line feed, which the reader does not look at
    files = rows.mapInArrow(run, "file binary").select(F.col("file").cast("string"))
    files.write.option("maxRecordsPerFile", 1).mode("errorifexists").text(folder)
    return folder


def read_token_files(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (and ids), read
    from the files of ``folder``."""
    names = ["shard", "part", "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard, part = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                doc_ids, lengths, ids = read_file(batch.column(2)[row].as_py())
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                starts = ends - lengths
                for s in range(0, len(doc_ids), 2000):
                    cut = slice(s, s + 2000)
                    n = len(doc_ids[cut])
                    parts = [raw[4 * i : 4 * j] for i, j in zip(starts[cut].tolist(), ends[cut].tolist(), strict=True)]
                    place = [pa.array(np.full(n, shard), pa.int64()), pa.array(np.full(n, part), pa.int64())]
                    yield pa.record_batch([*place, pa.array(doc_ids[cut], pa.int64()), pa.array(starts[cut]), pa.array(lengths[cut]), pa.array([zlib.crc32(x) for x in parts], pa.int64()), *([pa.array(parts, pa.binary())] if keep_ids else [])], names=names)

    # the writer numbers files by task and within it, so their names are in doc_id order
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("bigint")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0")
    files = found.select(number(r"part-(\d+)-[^/]*$").alias("shard"), number(r"-c(\d+)\.[^/]*$").alias("part"), "content")
    held = stash(files.mapInArrow(run, "shard bigint, part bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * keep_ids), "token-files")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    base = held.groupBy("shard", "part").agg(F.sum("n_tokens").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return held.join(base, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), *names[4:])


def token_files(docs: DataFrame, spec: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write to ``folder`` (a new one in the shared folder by default) and read back."""
    folder = write_token_files(docs, spec, folder or new_dir(docs.sparkSession, "tokens"), end_id)
    return read_token_files(docs.sparkSession, folder)
