"""Token-ID output: one wavelet matrix per shard, answering access, count and occurrence look-ups from its file.

Bit plane by bit plane, from the highest bit, the ids are split stably: zeros first, then ones. Each plane keeps its
bits and the number of ones before every block, so rank is one look-up and a count inside a block, and select is a
binary search over blocks. A shard's bytes are the planes, compressed, with the documents' ids and lengths before them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandscope.llm.common import id_and_text, ship, with_offsets
from demandscope.llm.tokenize import encoder, resolve
from demandscope.session import staging_root

SHARD_TOKENS = 1 << 21  # a shard closes with the document that reaches this many ids
BLOCK = 512
MAGIC = b"WMX1"
_HEAD = struct.Struct("<4sIQI")


class WaveletMatrix:
    """Sequence of ids below 2**bits."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray]):
        self.n, self.bits, self.planes = n, bits, planes
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, current = [], ids
        for level in range(bits - 1, -1, -1):
            ones = ((current >> level) & 1).astype(bool)
            planes.append(np.packbits(ones))
            current = np.concatenate([current[~ones], current[ones]])
        return cls(len(ids), bits, planes)

    @property
    def ranks(self) -> list[np.ndarray]:
        """Ones before each block of each plane; the last entry is the plane's total."""
        if self._ranks is None:
            self._ranks = []
            for plane in self.planes:
                padded = np.zeros(-(-max(self.n, 1) // BLOCK) * (BLOCK // 8), dtype=np.uint8)
                padded[:plane.size] = plane
                per_block = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
                self._ranks.append(np.concatenate([[0], np.cumsum(per_block)]))
        return self._ranks

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, rest = divmod(i, BLOCK)
        ones = int(self.ranks[level][block])
        if rest:
            at = block * (BLOCK // 8)
            ones += int(np.unpackbits(self.planes[level][at:at + BLOCK // 8])[:rest].sum())
        return ones

    def _zeros(self, level: int) -> int:
        return self.n - int(self.ranks[level][-1])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = int(self.planes[level][i >> 3] >> (7 - (i & 7))) & 1
            ones = self._rank1(level, i)
            i = self._zeros(level) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` is among the first ``i`` ids."""
        low, high = self._span(token, i)
        return high - low

    def _span(self, token: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            ones = self._rank1(level, low), self._rank1(level, high)
            if token >> (self.bits - 1 - level) & 1:
                low, high = (self._zeros(level) + x for x in ones)
            else:
                low, high = low - ones[0], high - ones[1]
        return low, high

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of occurrence ``k`` (from 0) of ``token``; -1 if there is none."""
        low, high = self._span(token, self.n)
        if not 0 <= k < high - low:
            return -1
        at = low + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select_bit(level, bit, at - self._zeros(level) if bit else at)
        return at

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        ranks = self.ranks[level]
        before = ranks if bit else np.arange(ranks.size) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        at = block * (BLOCK // 8)
        bits = np.unpackbits(self.planes[level][at:at + BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids in order: the splits undone from the lowest plane up."""
        current = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            zeros = self.n - int(np.count_nonzero(ones))
            merged = np.empty_like(current)
            merged[~ones] = current[:zeros]
            merged[ones] = current[zeros:] | current.dtype.type(1 << (self.bits - 1 - level))
            current = merged
        return current

    def to_bytes(self) -> bytes:
        return b"".join(x.tobytes() for x in self.planes)


def write_shard(ids: np.ndarray, lengths: np.ndarray, bits: int) -> bytes:
    body = lengths.astype("<i8").tobytes() + WaveletMatrix.build(ids, bits).to_bytes()
    return _HEAD.pack(MAGIC, bits, len(ids), len(lengths)) + zstandard.ZstdCompressor(level=1).compress(body)


def read_shard(blob: bytes) -> tuple[np.ndarray, WaveletMatrix]:
    """Lengths of the documents and the matrix of their ids."""
    magic, bits, n, docs = _HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a wavelet shard")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[_HEAD.size:]), dtype=np.uint8)
    lengths, size = body[:8 * docs].view("<i8"), -(-n // 8)
    planes = [body[8 * docs + k * size:8 * docs + (k + 1) * size] for k in range(bits)]
    return lengths, WaveletMatrix(n, bits, planes)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2,
                 shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards in ascending id order and read their table: task, shard, n_tokens, doc_ids, blob."""
    ship(docs.sparkSession)
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kind = ordered.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(resolve(tokenizer))
        bits = max(1, (max(encode.tokenizer.get_vocab_size() - 1, end_id)).bit_length())
        end = encode.to_bytes([end_id])
        task, shard = TaskContext.get().partitionId(), 0
        ids, names, total = [], [], 0

        def out() -> pa.RecordBatch:
            lengths = np.array([len(x) // encode.dtype.itemsize for x in ids], dtype=np.int64)
            blob = write_shard(np.frombuffer(b"".join(ids), encode.dtype), lengths, bits)
            doc_ids = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int64()), pa.array([shard], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([blob], pa.binary())],
                names=["task", "shard", "n_tokens", "doc_ids", "blob"])

        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids.append(encode.encode(text) + end)
                total += len(ids[-1]) // encode.dtype.itemsize
                if total >= shard_tokens:
                    names.append(batch.column(0).slice(first, i + 1 - first))
                    yield out()
                    ids, names, total, shard, first = [], [], 0, shard + 1, i + 1
            names.append(batch.column(0).slice(first))
        if ids:
            yield out()

    shards = ordered.mapInArrow(run, T.StructType([
        T.StructField("task", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("blob", T.BinaryType())]))
    shards.write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)
    return docs.sparkSession.read.parquet(path)


def token_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    Documents lie in ascending id order; null ids come first, equal ids by text. Null and empty texts are just the end
    id. No rows give no shards and no rows; other columns are not read.
    """
    path = path or f"{staging_root(docs.sparkSession)}/demandscope/wavelet-{uuid.uuid4().hex}"
    shards = write_tokens(docs, path, tokenizer, end_id, id_col=id_col, text_col=text_col)
    kind = shards.schema["doc_ids"].dataType.elementType
    offsets = with_offsets(shards, ["task", "shard"], "n_tokens", "wavelet-offsets")
    based = shards.join(offsets, ["task", "shard"]).select("base", "doc_ids", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, matrix = read_shard(batch.column(2)[i].as_py())
                wide = matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(wide[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[i].values, pa.array(batch.column(0)[i].as_py() + ends - lengths),
                     pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.mapInArrow(run, T.StructType([
        T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType())]))
