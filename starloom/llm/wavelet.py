"""Token ids in wavelet-matrix files: compressed bit planes that answer access, counting and search in place."""

import functools
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import arrow_schema, batches_of, running_before, to_batch
from starloom.llm.tokens import encoder, vocabulary_size
from starloom.scratch import staged

MAGIC = b"WAVELET1"
HEAD = struct.Struct("<8sBQQ")  # magic, planes, tokens, documents
BLOCK_BITS = 1 << 16
SHARD_TOKENS = 1 << 20


def pack(ids: np.ndarray, lengths: np.ndarray, planes: int) -> bytes:
    """A file of ``ids``, the tokens of documents of these ``lengths`` one after the other, in ``planes`` bits each.

    Layout: head; the length in bytes of the compressed document lengths; per plane the number of its zero bits; per
    plane and block the ones before it in the plane and the place of the compressed block; then the compressed parts.
    Plane 0 holds the highest bits in the order of the tokens; the next plane holds the next bits, all
    tokens with a zero before all with a one, each kind in its former order; and so on.
    """
    level = np.ascontiguousarray(ids, np.uint16 if planes <= 16 else np.uint32)
    blocks = -(-len(level) // BLOCK_BITS)
    compress = zstandard.ZstdCompressor(level=1).compress
    zeros, ones_before, places, parts, at = [], [], [], [], 0
    for plane in range(planes):
        bits = level & level.dtype.type(1 << (planes - 1 - plane)) != 0
        packed = np.packbits(bits, bitorder="little")
        ones = [int(np.count_nonzero(bits[b * BLOCK_BITS : (b + 1) * BLOCK_BITS])) for b in range(blocks)]
        ones_before += [0, *np.cumsum(ones)[:-1]] if blocks else []
        zeros.append(len(level) - sum(ones))
        for b in range(blocks):
            parts.append(compress(packed[b * BLOCK_BITS // 8 : (b + 1) * BLOCK_BITS // 8].tobytes()))
            places.append(at)
            at += len(parts[-1])
        level = np.concatenate([np.compress(~bits, level), np.compress(bits, level)])
    table = compress(np.asarray(lengths, np.uint32).tobytes())
    return b"".join(
        [
            HEAD.pack(MAGIC, planes, len(ids), len(lengths)),
            struct.pack("<Q", len(table)),
            np.array(zeros, np.uint64).tobytes(),
            np.array(ones_before, np.uint64).tobytes(),
            np.array([*places, at], np.uint64).tobytes(),
            table,
            *parts,
        ]
    )


class WaveletFile:
    """Reads what ``pack`` made; blocks are decompressed when they are asked for."""

    def __init__(self, data: bytes):
        magic, self.planes, self.tokens, documents = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet file")
        self.blocks = -(-self.tokens // BLOCK_BITS)
        (table_size,) = struct.unpack_from("<Q", data, HEAD.size)
        at = HEAD.size + 8
        self.zeros = np.frombuffer(data, np.uint64, self.planes, at).astype(np.int64)
        at += 8 * self.planes
        shape = (self.planes, self.blocks)
        self.ones_before = np.frombuffer(data, np.uint64, self.planes * self.blocks, at).astype(np.int64).reshape(shape)
        at += 8 * self.planes * self.blocks
        self.places = np.frombuffer(data, np.uint64, self.planes * self.blocks + 1, at).astype(np.int64)
        at += 8 * len(self.places)
        self._decompress = zstandard.ZstdDecompressor().decompress
        self.lengths = np.frombuffer(self._decompress(data[at : at + table_size]), np.uint32)
        if len(self.lengths) != documents:
            raise ValueError("damaged wavelet file")
        self._data, self._start = data, at + table_size
        self._bits = functools.lru_cache(maxsize=64)(self._read_bits)

    def _packed(self, plane: int, block: int) -> bytes:
        i = plane * self.blocks + block
        return self._decompress(self._data[self._start + self.places[i] : self._start + self.places[i + 1]])

    def _read_bits(self, plane: int, block: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self._packed(plane, block), np.uint8), bitorder="little")

    def _ones(self, plane: int, position: int) -> int:
        """Rank: the one bits of a plane before ``position``."""
        block, rest = divmod(position, BLOCK_BITS)
        if block == self.blocks:
            return self.tokens - int(self.zeros[plane])
        return int(self.ones_before[plane, block]) + int(np.count_nonzero(self._bits(plane, block)[:rest]))

    def _select(self, plane: int, bit: int, rank: int) -> int:
        """The position of the ``rank``-th (from 0) bit of this value in a plane."""
        before = self.ones_before[plane]
        if not bit:
            before = np.arange(self.blocks) * BLOCK_BITS - before
        block = int(np.searchsorted(before, rank, "right")) - 1
        inside = np.flatnonzero(self._bits(plane, block) == bit)
        return block * BLOCK_BITS + int(inside[rank - int(before[block])])

    def access(self, position: int) -> int:
        """The token at ``position``."""
        if not 0 <= position < self.tokens:
            raise IndexError(position)
        token = 0
        for plane in range(self.planes):
            block, rest = divmod(position, BLOCK_BITS)
            bit = int(self._bits(plane, block)[rest])
            ones = self._ones(plane, position)
            position = int(self.zeros[plane]) + ones if bit else position - ones
            token = 2 * token + bit
        return token

    def _interval(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the last plane's order holds the occurrences of ``token`` among positions ``low`` to ``high``."""
        if token >> self.planes:
            return 0, 0
        for plane in range(self.planes):
            ones = self._ones(plane, low), self._ones(plane, high)
            if token >> (self.planes - 1 - plane) & 1:
                low, high = (int(self.zeros[plane]) + n for n in ones)
            else:
                low, high = low - ones[0], high - ones[1]
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often ``token`` occurs at positions from ``low`` up to, not including, ``high``."""
        low, high = self._interval(token, low, self.tokens if high is None else high)
        return high - low

    def occurrence(self, token: int, rank: int) -> int:
        """The position of the ``rank``-th occurrence (from 0) of ``token``."""
        low, high = self._interval(token, 0, self.tokens)
        if not 0 <= rank < high - low:
            raise IndexError(rank)
        position = low + rank
        for plane in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - plane) & 1
            position = self._select(plane, bit, position - bit * int(self.zeros[plane]))
        return position

    def all(self) -> np.ndarray:
        """All tokens in order."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        level = np.zeros(self.tokens, kind)
        for plane in range(self.planes - 1, -1, -1):
            packed = b"".join(self._packed(plane, b) for b in range(self.blocks))
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.tokens, bitorder="little").view(bool)
            above = np.empty_like(level)
            above[np.flatnonzero(~bits)] = level[: self.zeros[plane]]
            above[np.flatnonzero(bits)] = level[self.zeros[plane] :] | kind(1 << (self.planes - 1 - plane))
            level = above
        return level


def write_files(
    docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode every text, append ``end_id``, and write wavelet files in ascending order of the ids to ``path``.

    A row of the table at ``path`` is a file: ``part`` and ``file`` give the order, ``ids`` the documents,
    ``tokens`` their number of tokens, ``content`` the bytes. Spark's writer stores them, so the files of a
    lost or repeated task never appear, in whatever store ``path`` is. A task sorts a range of documents and closes a
    file after the document that reaches ``shard_tokens``: memory is bounded by that and the longest text.

    A null text counts as empty: it has its end id. Null ids come first; rows with equal ids are ordered by their
    texts' hash. Other columns are not read. An empty table gives no files.
    """
    planes = (max(vocabulary_size(vocabulary), end_id + 1) - 1).bit_length()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"part int, file int, ids array<{kind}>, tokens bigint, content binary"
    out_schema = arrow_schema(schema)
    end = np.array([end_id], np.uint32)

    def encode(batches):
        part, file, ids, held, lengths, tokens = TaskContext.get().partitionId(), 0, [], [], [], 0

        def closed():
            columns = [[part], [file], [ids], [tokens], [pack(np.concatenate(held), np.array(lengths), planes)]]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=out_schema)

        encode = encoder(vocabulary)
        for batch in batches:
            own_ids = batch.column("id").to_pylist()
            for own_id, own in zip(own_ids, encode.ids(batch.column("text")), strict=True):
                ids.append(own_id)
                held += [own, end]
                lengths.append(len(own) + 1)
                tokens += len(own) + 1
                if tokens >= shard_tokens:
                    yield closed()
                    file, ids, held, lengths, tokens = file + 1, [], [], [], 0
        if ids:
            yield closed()

    files = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, schema)
    # A row is large: look at the size after each, and leave the bytes, compressed already, as they are.
    files.write.options(
        **{
            "compression": "uncompressed",
            "parquet.block.size": 16 << 20,
            "parquet.block.size.row.check.min": 1,
            "parquet.block.size.row.check.max": 4,
            "parquet.page.size.row.check.min": 1,
            "parquet.enable.dictionary": "false",
        }
    ).parquet(path)


def read_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """A row per document of the files at ``path``: the id, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids_crc32`` (of its ids as little-endian unsigned 32-bit integers), decoded from the planes."""
    files = spark.read.parquet(path)
    parts = running_before(files.groupBy("part").agg(F.sum("tokens").alias("n")), "n", "before_part", ["part"])
    sizes = running_before(files.select("part", "file", "tokens"), "tokens", "before_file", ["file"], ["part"])
    starts = sizes.join(parts, "part").select(
        F.col("part").alias("p"), F.col("file").alias("f"), (F.col("before_part") + F.col("before_file")).alias("base")
    )
    starts = staged(starts, "wavelet-starts")
    kind = files.schema["ids"].dataType.elementType.simpleString()
    schema = f"part int, file int, id {kind}, inside bigint, n_tokens bigint, ids_crc32 bigint"
    out_schema = arrow_schema(schema)

    def decode(batches):
        for batch in batches:
            for part, file, ids, content in zip(*(batch.column(c) for c in ("part", "file", "ids", "content")), strict=True):
                reader = WaveletFile(content.as_py())
                tokens = memoryview(reader.all().astype("<u4")).cast("B")
                ends = np.cumsum(reader.lengths, dtype=np.int64)
                begins = ends - reader.lengths
                crcs = [zlib.crc32(tokens[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * n, pa.int32()),
                        pa.array([file.as_py()] * n, pa.int32()),
                        ids.values,
                        pa.array(begins),
                        pa.array(reader.lengths.astype(np.int64)),
                        pa.array(crcs, pa.int64()),
                    ],
                    schema=out_schema,
                )

    documents = files.select("part", "file", "ids", "content").mapInArrow(decode, schema)
    same_file = (F.col("part") == F.col("p")) & (F.col("file") == F.col("f"))
    return documents.join(starts, same_file).select(
        F.col("id").alias(id_col), (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def count_tokens(spark: SparkSession, path: str, tokens: Sequence[int]) -> DataFrame:
    """How often each of ``tokens`` occurs in all files at ``path``: ``token`` and ``n``, zero if it does not.

    A file answers from two ranks per plane, so few of its blocks are decompressed and no text is decoded. Each token
    is returned once; without files or tokens the result is empty or zero alike.
    """
    wanted = sorted(set(tokens))
    schema = "token bigint, n bigint"
    out_schema = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                reader = WaveletFile(content.as_py())
                yield to_batch([(token, reader.count(token)) for token in wanted], out_schema)

    asked = spark.createDataFrame([(token, 0) for token in wanted], schema)
    counted = spark.read.parquet(path).select("content").mapInArrow(run, schema)
    return asked.unionByName(counted).groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, path: str, token: int, id_col: str = "doc_id") -> DataFrame:
    """Every occurrence of ``token`` in the files at ``path``: the document's id and ``offset``, its place among the ids there.

    A file decompresses only the blocks on the ways to the occurrences. Rows are in no order; none if the token does not occur.
    """
    files = spark.read.parquet(path).select("ids", "content")
    schema = f"id {files.schema['ids'].dataType.elementType.simpleString()}, offset bigint"
    out_schema = arrow_schema(schema)

    def places(batches):
        for batch in batches:
            for ids, content in zip(batch.column("ids"), batch.column("content"), strict=True):
                reader, ids = WaveletFile(content.as_py()), ids.as_py()
                ends = np.cumsum(reader.lengths, dtype=np.int64)
                for rank in range(reader.count(token)):
                    place = reader.occurrence(token, rank)
                    own = int(np.searchsorted(ends, place, "right"))
                    yield ids[own], place - int(ends[own]) + int(reader.lengths[own])

    def run(batches):
        yield from batches_of(places(batches), out_schema, 4096)

    return files.mapInArrow(run, schema).withColumnRenamed("id", id_col)
