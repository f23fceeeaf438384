"""Token ids as wavelet matrices: one compressed file a shard, with rank and select.

A shard holds whole documents in ascending id order. Its ids become bit planes, from
the highest bit down; after each plane the ids are parted stably, those with a 0 bit
first. A directory of running counts makes rank constant-time, so that from the file
alone one can read any token, count a token in any prefix, find its j-th occurrence,
and restore all ids, without another index.

File layout (little-endian, sections compressed with zstd one by one, so that a
reader opens only what it needs): magic, counts, section lengths, document ids,
document lengths, zeros of each plane, then each plane and its directory, which is
unpacked when first asked. A file has as many planes as its largest id has bits. Files are rows of a Parquet
table (shard, block, payload), the one writer that reaches every store Spark knows.

Defined results: a null text counts as empty and still gets its end id; repeated rows
are separate documents, in order of a hash of their text; a null id sorts first; an
empty table gives no file and no row.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of, saved
from .tokens import kept

MAGIC = b"KWM2"
#: Ids a shard's file holds before the next begins (a longer document has a file of its own).
BLOCK_IDS = 1 << 18
_STEP = 512  # bits between directory entries


class Plane:
    """A bit vector with its directory: counts of ones before every ``_STEP``-th bit."""

    def __init__(self, packed: np.ndarray, n: int, before: np.ndarray):
        self.packed, self.n, self.before = packed, n, before

    @staticmethod
    def directory(packed: np.ndarray, n: int) -> np.ndarray:
        whole = np.zeros(-(-n // _STEP) * (_STEP // 8), np.uint8)
        whole[: len(packed)] = packed
        ones = np.bitwise_count(whole).reshape(-1, _STEP // 8).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(ones)])

    def bit(self, i: int) -> int:
        return int(self.packed[i >> 3] >> (7 - (i & 7))) & 1

    def rank(self, bit: int, i: int) -> int:
        """How many of the first ``i`` bits equal ``bit``."""
        at = i // _STEP
        ones = int(self.before[at]) + int(np.unpackbits(self.packed[at * (_STEP // 8) : -(-i // 8)], count=i - at * _STEP).sum()) if i else 0
        return ones if bit else i - ones

    def select(self, bit: int, j: int) -> int:
        """Position of the ``j``-th (from 0) bit that equals ``bit``."""
        before = self.before if bit else np.minimum(np.arange(len(self.before)) * _STEP, self.n) - self.before
        at = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(self.packed[at * (_STEP // 8) : (at + 1) * (_STEP // 8)], count=min(_STEP, self.n - at * _STEP))
        return at * _STEP + int(np.flatnonzero(bits == bit)[j - int(before[at])])


class WaveletMatrix:
    """Bit planes and their directories, each given as an array or as a function that unpacks it."""

    def __init__(self, n: int, zeros: list[int], packed: list, directories: list):
        self.n, self.zeros, self.packed, self.directories, self._planes = n, zeros, packed, directories, {}

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        a, zeros, packed = ids.astype(kind), [], []
        for level in range(bits):
            b = ((a >> kind(bits - 1 - level)) & kind(1)).astype(bool)
            packed.append(np.packbits(b))
            ones, rest = np.flatnonzero(b), np.flatnonzero(~b)
            zeros.append(len(rest))
            a = np.concatenate((a.take(rest), a.take(ones)))
        return cls(len(ids), zeros, packed, [Plane.directory(p, len(ids)) for p in packed])

    @staticmethod
    def _given(section) -> np.ndarray:
        return section() if callable(section) else section

    def ids(self) -> np.ndarray:
        """All ids, by undoing the partings from the lowest plane up."""
        bits = len(self.zeros)
        kind = np.uint16 if bits <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for level in reversed(range(bits)):
            b = np.unpackbits(self._given(self.packed[level]), count=self.n).view(bool)
            z = self.zeros[level]
            a[z:] |= kind(1 << (bits - 1 - level))
            before = np.empty_like(a)
            before[np.flatnonzero(~b)] = a[:z]
            before[np.flatnonzero(b)] = a[z:]
            a = before
        return a.astype("<u4")

    def plane(self, level: int) -> Plane:
        if level not in self._planes:
            self._planes[level] = Plane(self._given(self.packed[level]), self.n, self._given(self.directories[level]))
        return self._planes[level]

    def access(self, i: int) -> int:
        value = 0
        for level, z in enumerate(self.zeros):
            plane = self.plane(level)
            bit = plane.bit(i)
            value = value << 1 | bit
            i = z + plane.rank(1, i) if bit else plane.rank(0, i)
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's copies among the first ``end`` ids stand below the last plane."""
        start = 0
        for level, z in enumerate(self.zeros):
            plane, bit = self.plane(level), token >> (len(self.zeros) - 1 - level) & 1
            start, end = ((z if bit else 0) + plane.rank(bit, x) for x in (start, end))
        return start, end

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` among the first ``end`` ids."""
        if token >> len(self.zeros):
            return 0
        start, end = self._range(token, self.n if end is None else end)
        return end - start

    def find(self, token: int, j: int) -> int:
        """Position of the ``j``-th (from 0) occurrence of ``token``."""
        at = self._range(token, self.n)[0] + j
        for level in reversed(range(len(self.zeros))):
            bit = token >> (len(self.zeros) - 1 - level) & 1
            at = self.plane(level).select(bit, at - (self.zeros[level] if bit else 0))
        return at


def to_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    pack = zstandard.ZstdCompressor(level=1).compress
    bits = max(1, int(ids.max(initial=0)).bit_length())
    matrix = WaveletMatrix.of(ids, bits)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    sections = [
        pack(known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes()),
        pack(np.array(lengths, "<u4").tobytes()),
        np.array(matrix.zeros, "<u8").tobytes(),
        *(pack(s.tobytes()) for p, d in zip(matrix.packed, matrix.directories) for s in (p, d.astype("<u4"))),
    ]
    head = MAGIC + struct.pack("<QII", matrix.n, len(doc_ids), bits)
    return head + np.array([len(s) for s in sections], "<u8").tobytes() + b"".join(sections)


def from_file(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their lengths, and the matrix of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    n, docs, bits = struct.unpack_from("<QII", data, 4)
    sizes = np.frombuffer(data, "<u8", 2 * bits + 3, 20)
    ends = (20 + 8 * (2 * bits + 3) + np.cumsum(sizes)).tolist()
    view = [data[int(e) - int(s) : int(e)] for e, s in zip(ends, sizes)]
    unpack = zstandard.ZstdDecompressor().decompress
    raw = unpack(view[0])
    known, ids = raw[:docs], np.frombuffer(raw, "<i8", docs, docs).tolist()
    return (
        [d if k else None for d, k in zip(ids, known)],
        np.frombuffer(unpack(view[1]), "<u4"),
        WaveletMatrix(n, np.frombuffer(view[2], "<u8").astype(int).tolist(), [lambda v=v: np.frombuffer(unpack(v), np.uint8) for v in view[3::2]], [lambda v=v: np.frombuffer(unpack(v), "<u4").astype(np.int64) for v in view[4::2]]),
    )


_FILES = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("payload", pa.binary())])


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` into files (shard, block, n_tokens, payload), ids ascending."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(it):
        encoder, shard, block = kept(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, parts, held = [], [], 0
        end = np.array([end_id], "<u4")

        def file():
            lengths, ids = [len(p) for p in parts], np.concatenate(parts)
            row = [shard], [block], [len(ids)], [to_file(doc_ids, lengths, ids)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _FILES.types)], schema=_FILES)

        for batch in it:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.concatenate([encoder.ids(text), end])
                if held and held + len(ids) > block_ids:
                    yield file()
                    doc_ids, parts, held, block = [], [], 0, block + 1
                doc_ids.append(doc_id)
                parts.append(ids)
                held += len(ids)
        if held:
            yield file()

    return saved(ordered.mapInArrow(run, "shard int, block int, n_tokens long, payload binary"))


def digests(files: DataFrame) -> DataFrame:
    """Reads files back: doc_id, start, n_tokens and ids_crc32 of every document."""
    sizes = files.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row a shard and a file, thousands of times fewer than documents.
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = sizes.select("shard", "block", (F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")).alias("block_start"))
    starts = inside.join(before, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("base"))

    def run(it):
        for batch in it:
            for shard, block, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "payload"))):
                doc_ids, lengths, matrix = from_file(payload)
                ids, ends = matrix.ids(), np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                crcs = [crc_of(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array([shard] * len(crcs), pa.int32()), pa.array([block] * len(crcs), pa.int32()), pa.array(begins), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                    names=["doc_id", "shard", "block", "inside", "n_tokens", "ids_crc32"],
                )

    read = files.select("shard", "block", "payload").mapInArrow(run, "doc_id long, shard int, block int, inside long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
