"""Token ids as binary shards with Elias-Fano coded document boundaries.

``write_token_shards`` orders documents by id over range partitions and lets every task write one
file: all ids one after another (16 or 32 bits each), then the document ends and the document ids
as two Elias-Fano sequences, then a footer. A boundary costs about 2 + log2(mean length) bits;
``select`` finds one through 32-bit samples without a 64-bit table. A task writes under a name of
its own attempt and returns a manifest row; Spark commits the manifest, so files of lost or repeated
attempts are never read. ``read_token_shards`` returns one row per document, read from the files.

Nulls: a null text is an empty one (only the end id is written); a null doc_id is kept and sorts
first. Rows with equal ids keep a fixed order (by a hash of the text, then the text). An empty table
gives no shards and an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import array
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmine.llm.common import partition_count, scratch_dir, sliced, text_batches, text_or_empty, worker_cache

MAGIC = b"GMTOKEF1"
FOOTER = "<8sIIQQQqQQ"  # magic, id bytes, -, documents, null ids, tokens, first id, bytes of ends, bytes of ids
#: Every so many ones of the upper bits, their position is kept.
SAMPLE = 256
#: Documents whose ids are in memory at once when a shard is read.
READ_AT_ONCE = 4096
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


class EliasFano:
    """A non-decreasing sequence of unsigned integers in about 2 + log2(universe / n) bits each."""

    HEAD = "<QBQQQ"

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        planes = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        if ones[-1] >= 2**32:
            raise ValueError("a shard holds at most 2**32 bits of boundaries; use more shards")
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, np.packbits(planes.astype(np.uint8)), np.packbits(bits), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = struct.pack(self.HEAD, self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, n_low, n_high, n_samples = struct.unpack_from(cls.HEAD, raw)
        at = struct.calcsize(cls.HEAD)
        low = np.frombuffer(raw, np.uint8, n_low, at)
        high = np.frombuffer(raw, np.uint8, n_high, at + n_low)
        return cls(n, low_bits, low, high, np.frombuffer(raw, np.uint32, n_samples, at + n_low + n_high))

    def _lower(self, i: int) -> int:
        first = i * self.low_bits
        last = first + self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (last + 7) // 8])[first % 8 : first % 8 + self.low_bits]
        return sum(int(b) << k for k, b in enumerate(bits))

    def select(self, i: int) -> int:
        """The i-th value: the sample before it, then a scan over the few ones that follow."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = start // 8, start % 8
        while True:
            bits = np.unpackbits(self.high[byte : byte + 128])
            ones = np.flatnonzero(bits[skip:]) + skip
            if left < len(ones):
                return ((byte * 8 + int(ones[left]) - i) << self.low_bits) | self._lower(i)
            left -= len(ones)
            byte, skip = byte + 128, 0

    def rank(self, x: int) -> int:
        """How many values are at most x: the document a token position lies in, given the ends."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.select(mid) <= x else (low, mid)
        return low

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint64)
        upper = (np.flatnonzero(np.unpackbits(self.high)) - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        planes = np.unpackbits(self.low, count=self.n * self.low_bits).reshape(self.n, self.low_bits).astype(np.uint64)
        return upper | (planes << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


#: Texts that hold one of these are encoded as they are: white space that is not a single blank or line break between words.
_ODD_SPACE = ("  ", " \n", "\n ", "\n\n", *[c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"])
#: Pieces a worker remembers; frequent ones come early, so a full memory takes no more.
_REMEMBERED = 1_500_000


class PieceEncoder:
    """Ids of whole texts, equal to the tokenizer's, with pieces between blanks encoded once.

    A byte-level tokenizer never joins a word to the blank or line break after it, so a text of
    single blanks and line breaks is the concatenation of its pieces. Anything else, and a text
    that holds a special token, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else 4
        self.code, self.dtype = ("H", np.dtype("<u2")) if self.width == 2 else ("I", np.dtype("<u4"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = self.tokenizer.pre_tokenizer
        self.by_piece = type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space and self.tokenizer.normalizer is None
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.line_break = self._direct("\n")

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _join(self, known: dict[str, bytes], pieces: list[str], before: str) -> bytes:
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            new = list({p for p in pieces if p not in known})
            coded = self.tokenizer.encode_batch_fast([before + p for p in new], add_special_tokens=False)
            fresh = {p: array.array(self.code, e.ids).tobytes() for p, e in zip(new, coded, strict=True)}
            if len(known) + len(fresh) <= _REMEMBERED:
                known.update(fresh)
                return b"".join(map(known.__getitem__, pieces))
            return b"".join([known.get(p) or fresh[p] for p in pieces])

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_piece or text[0] in " \n" or text[-1] in " \n" or any(s in text for s in _ODD_SPACE) or any(s in text for s in self.special):
            return self._direct(text)
        out = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(self._join(self.first, [head], "") + self._join(self.later, rest, " "))
        return self.line_break.join(out)


def _encoder(path: str) -> PieceEncoder:
    cache = worker_cache("piece_encoders")
    if path not in cache:
        cache[path] = PieceEncoder(path)
    return cache[path]


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Write ids of all documents in ascending doc_id order; returns the committed manifest.

    ``tokenizer`` is a path that exists on every executor; None takes the public 50k vocabulary there.
    """
    spark = docs.sparkSession
    fs_uri = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer or _default_tokenizer())
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        fs, root = pa.fs.FileSystem.from_uri(_arrow_uri(fs_uri))
        task = TaskContext.get()
        path = f"{root}/shard-{task.partitionId():06d}-{task.taskAttemptId()}-{os.urandom(4).hex()}.tok"
        out, ends, ids, nulls, at = None, [], [], 0, 0
        for batch in sliced(batches, "text", 1 << 24):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(path)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encode(text) + end
                out.write(raw)
                at += len(raw) // encode.width
                ends.append(at)
                if doc is None:
                    nulls += 1
                else:
                    ids.append(doc)
        if out is None:
            return
        base = ids[0] if ids else 0
        offsets = np.array(ids, dtype=np.int64).astype(np.uint64) - np.int64(base).astype(np.uint64)
        sections = EliasFano.of(np.array(ends, np.uint64)).to_bytes(), EliasFano.of(offsets).to_bytes()
        for part in sections:
            out.write(part)
        out.write(struct.pack(FOOTER, MAGIC, encode.width, 0, len(ends), nulls, at, base, len(sections[0]), len(sections[1])))
        out.close()
        columns = [[task.partitionId()], [path], [len(ends)], [at]]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["shard", "path", "n_docs", "n_tokens"])

    n = shards or partition_count(spark)
    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _arrow_uri(uri: str) -> str:
    """Hadoop writes ``file:/x`` for ``file:///x``."""
    return re.sub(r"^file:/+", "file:///", uri)


class TokenShard:
    """One file: ids of a document by select on its boundaries, or all of them in one pass."""

    def __init__(self, path: str, fs: pa.fs.FileSystem | None = None):
        fs = fs or pa.fs.LocalFileSystem()
        self.file = fs.open_input_file(path)
        size, tail = self.file.size(), struct.calcsize(FOOTER)
        magic, self.width, _, self.n_docs, self.nulls, self.n_tokens, self.base, n_ends, n_ids = struct.unpack(FOOTER, self.file.read_at(tail, size - tail))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        at = self.n_tokens * self.width
        self.ends = EliasFano.from_bytes(self.file.read_at(n_ends, at))
        self.ids = EliasFano.from_bytes(self.file.read_at(n_ids, at + n_ends))

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def tokens(self, i: int) -> np.ndarray:
        first, last = self.bounds(i)
        return np.frombuffer(self.file.read_at((last - first) * self.width, first * self.width), self.dtype)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.ids.select(i - self.nulls)

    def doc_ids(self) -> list[int | None]:
        values = (self.ids.all() + np.int64(self.base).astype(np.uint64)).astype(np.int64)
        return [None] * self.nulls + values.tolist()


def read_token_shards(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files the manifest names.

    ``start`` counts the ids of all documents before; offsets of shards come from one row per shard.
    """
    spark: SparkSession = manifest.sparkSession
    uri = _arrow_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = TokenShard(path, fs)
                ends, ids = shard.ends.all().astype(np.int64), shard.doc_ids()
                starts = np.concatenate([[0], ends[:-1]])
                for first in range(0, len(ends), READ_AT_ONCE):
                    part = slice(first, first + READ_AT_ONCE)
                    s, e = starts[part], ends[part]
                    raw = np.frombuffer(shard.file.read_at(int(e[-1] - s[0]) * shard.width, int(s[0]) * shard.width), shard.dtype).astype("<u4")
                    own = [raw[a:b] for a, b in zip((s - s[0]).tolist(), (e - s[0]).tolist(), strict=True)]
                    columns = [pa.array(ids[part], pa.int64()), pa.array(s + base), pa.array(e - s), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], e - s[0]]), pa.int32()), pa.array(raw.astype(np.int32))))
                    yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "path", before.alias("base")).repartition(partition_count(spark), "shard")
    return shards.select("path", "base").mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the shards to the shared folder and return the digest per document read back from them."""
    folder = scratch_dir(docs.sparkSession) + "/tokens"
    return read_token_shards(write_token_shards(docs, folder, tokenizer), folder)
