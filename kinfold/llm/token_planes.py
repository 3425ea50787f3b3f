"""Token ids in bit-plane-shuffled shard files.

Documents are dealt by ranges of doc_id, each task tokenises its range in order
and streams the ids into one shard.  A shard is a run of blocks of
``block_ids`` ids (the last may be shorter); a block's ids, as unsigned 32-bit
integers, are transposed into four byte planes or 32 bit planes and each plane
is one zstandard frame.  A footer holds the chunk index (place and plane sizes
of each block, its crc32) and the document index (doc_id and first id of each
document), so that one document can be read without the others.

    magic | planes of block 0 | planes of block 1 | ... | footer | footer size, 8 bytes | magic

Only sums of whole shards are needed to number ids across shards: one row per
shard.  Texts are cut at ASCII white space and between letters and the points after
them, where the tokenizer's rules cut anyway, and each distinct piece of a
batch is encoded once.

Cases: a null text is empty; an empty text has the end id alone; rows that
share a doc_id are ordered by text, all of them written; null ids come first
and are read as null; an empty table has no shards; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .storage import materialize, new_dir, partitions

MAGIC = b"KFPLANE1"
BLOCK_IDS = 1 << 16
PLANES = ("byte", "bit")
END_ID = 2
#: Pieces whose ids a worker remembers between batches.
REMEMBERED = 500_000
#: Documents encoded at a time.
AT_ONCE = 5000
#: Latin letters, then points: between the two every letter-run pre-tokenizer cuts.
_CUT = r"^(?P<stem>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<tail>[.,;:!?]*)$"

_MANIFEST = "path string, shard int, n_ids bigint, n_docs bigint, bytes bigint"
_DOCS = "shard int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [p.tobytes() for p in raw]
    return [np.packbits(p >> b & 1).tobytes() for p in raw for b in range(8)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes]).reshape(4, 8, n)
        raw = np.zeros((4, n), np.uint8)
        for b in range(8):
            raw |= bits[:, b] << b
    return np.ascontiguousarray(raw.T).reshape(-1).view("<u4")


class ShardWriter:
    def __init__(self, out, block_ids: int, kind: str, level: int):
        self.out, self.block_ids, self.kind = out, block_ids, kind
        self.z = zstandard.ZstdCompressor(level=level)
        self.waiting, self.n_waiting, self.n_ids, self.at = [], 0, 0, len(MAGIC)
        self.index, self.doc_ids, self.doc_starts = [], [], []
        out.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.doc_starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block_ids:
            every = np.concatenate(self.waiting)
            whole = len(every) - len(every) % self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(every[i : i + self.block_ids])
            self.waiting, self.n_waiting = [every[whole:]], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.z.compress(p) for p in to_planes(ids, self.kind)]
        data = b"".join(planes)
        self.out.write(data)
        self.index.append([self.at, len(ids), zlib.crc32(data), [len(p) for p in planes]])
        self.at += len(data)

    def close(self) -> int:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        known = np.array([i is not None for i in self.doc_ids], bool)
        footer = json.dumps({"planes": self.kind, "block_ids": self.block_ids, "n_ids": self.n_ids, "blocks": self.index, "n_docs": len(known)}).encode()
        ids = np.array([i or 0 for i in self.doc_ids], "<i8")
        footer = struct.pack("<q", len(footer)) + footer + np.array(self.doc_starts, "<i8").tobytes() + ids.tobytes() + np.packbits(known).tobytes()
        footer = self.z.compress(footer)
        self.out.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        self.out.close()
        return self.at + len(footer) + 16


class ShardReader:
    """Reads a shard's documents, all in turn or one by its place."""

    def __init__(self, source):
        self.source, size = source, source.size()
        self.z = zstandard.ZstdDecompressor()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a whole shard")
        (n,) = struct.unpack("<q", tail[:8])
        footer = self.z.decompress(source.read_at(n, size - 16 - n))
        (n,) = struct.unpack("<q", footer[:8])
        self.meta, docs = json.loads(footer[8 : 8 + n]), self.meta_docs(footer[8 + n :], json.loads(footer[8 : 8 + n])["n_docs"])
        self.starts, self.doc_ids, self.known = docs

    @staticmethod
    def meta_docs(data: bytes, n: int):
        return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n), np.unpackbits(np.frombuffer(data, np.uint8, offset=16 * n), count=n).astype(bool)

    def block(self, i: int) -> np.ndarray:
        at, n, crc, sizes = self.meta["blocks"][i]
        data = self.source.read_at(sum(sizes), at)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block {i} is damaged")
        ends = np.cumsum(sizes)
        return from_planes([self.z.decompress(data[e - s : e]) for s, e in zip(sizes, ends, strict=True)], n, self.meta["planes"])

    def ids(self, lo: int, hi: int) -> np.ndarray:
        size = self.meta["block_ids"]
        parts = [self.block(i) for i in range(lo // size, -(-hi // size))]
        return np.concatenate(parts)[lo - lo // size * size :][: hi - lo] if parts else np.zeros(0, "<u4")

    def ends(self) -> np.ndarray:
        return np.append(self.starts[1:], self.meta["n_ids"])

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.ends()[i]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id, ids) of each, every block decoded once."""
        held, base, nxt = np.zeros(0, "<u4"), 0, 0
        for doc, known, lo, hi in zip(self.doc_ids.tolist(), self.known, self.starts.tolist(), self.ends().tolist(), strict=True):
            parts = [held[lo - base :]]
            have = len(parts[0])
            while have < hi - lo:
                parts.append(self.block(nxt))
                have, nxt = have + len(parts[-1]), nxt + 1
            held, base = np.concatenate(parts) if len(parts) > 1 else parts[0], lo
            yield (doc if known else None), lo, held[: hi - lo]


class PieceEncoder:
    """Ids of texts by way of their pieces between ASCII white space.

    A piece of Latin letters with points after it is cut once more, before the
    points, where the tokenizer cuts too.  Pieces keep their ids in one flat
    array; a worker remembers those it met first, which are the frequent ones.
    """

    def __init__(self, tokenizer_json: str, end_id: int, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.remembered = Tokenizer.from_str(tokenizer_json), end_id, remembered
        # Only a tokenizer that lowers letters may be given them lowered.
        self.lowers = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("Q") == "q"
        self.place: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of new pieces."""
        ids, sizes = [], []
        for i in range(0, len(pieces), 20_000):
            for e in self.tokenizer.encode_batch_fast(pieces[i : i + 20_000], add_special_tokens=False):
                x = e.ids
                ids += x
                sizes.append(len(x))
        return np.array(ids, "<u4"), np.array(sizes, np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, begin, size) of the pieces."""
        at = np.array([self.place.get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(at < 0)
        names = [pieces[i] for i in new]
        flat, size = self._encoded(names)
        begin = len(self.flat) + np.cumsum(size) - size
        own_begin, own_size = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        old = at >= 0
        own_begin[old], own_size[old] = self.begin[at[old]], self.size[at[old]]
        own_begin[new], own_size[new] = begin, size
        every = np.concatenate([self.flat, flat])
        room = self.remembered - len(self.place)
        if room > 0 and len(names):
            n = len(self.place)
            self.place.update(zip(names[:room], range(n, n + room), strict=False))
            kept = size[:room]
            self.flat = np.concatenate([self.flat, flat[: kept.sum()]])
            self.begin, self.size = np.concatenate([self.begin, begin[:room]]), np.concatenate([self.size, kept])
        return every, own_begin, own_size

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, with the end id."""
        pieces = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = pc.list_flatten(pieces).dictionary_encode()
        cut = pc.extract_regex(words.dictionary, pattern=_CUT)
        plain = cut.is_valid()
        stem, tail = pc.if_else(plain, pc.struct_field(cut, 0), words.dictionary), pc.if_else(plain, pc.struct_field(cut, 1), "")
        if self.lowers:
            stem = pc.if_else(plain, pc.ascii_lower(stem), stem)
        stem, tail = stem.dictionary_encode(), tail.dictionary_encode()
        names = stem.dictionary.to_pylist() + tail.dictionary.to_pylist()
        flat, begin, size = self._pieces(names)
        parts = np.stack([np.asarray(stem.indices), np.asarray(tail.indices) + len(stem.dictionary)], 1).astype(np.int64)
        code = np.asarray(words.indices)
        ends = np.cumsum(np.asarray(pc.list_value_length(pieces)).astype(np.int64))
        end = np.array([self.end_id], "<u4")
        for lo, hi in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            part = parts[code[lo:hi]].reshape(-1)
            n = size[part]
            stop = np.cumsum(n)
            at = np.repeat(begin[part] - stop + n, n)
            at += np.arange(len(at))
            yield np.append(flat[at], end)


_encoders: dict[int, PieceEncoder] = {}


def _write(batches, folder, tokenizer, end_id, block_ids, kind, level):
    encoder = _encoders.get(tokenizer.id) or _encoders.setdefault(tokenizer.id, PieceEncoder(tokenizer.value, end_id))
    partition, writer, uri = TaskContext.get().partitionId(), None, None
    for batch in batches:
        for lo in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(lo, AT_ONCE)
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text")), strict=True):
                if writer is None:
                    uri, out = files.create(folder, partition, 0, ".ids")
                    writer = ShardWriter(out, block_ids, kind, level)
                writer.add(doc_id, ids)
    if writer is not None:
        size = writer.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([uri]), pa.array([partition], pa.int32()), pa.array([writer.n_ids], pa.int64()), pa.array([len(writer.doc_ids)], pa.int64()), pa.array([size], pa.int64())],
            names=["path", "shard", "n_ids", "n_docs", "bytes"],
        )


def _read(batches):
    for batch in batches:
        for path, shard in zip(batch.column("path").to_pylist(), batch.column("shard").to_pylist(), strict=True):
            with files.open_random(path) as source:
                rows = [(shard, doc, lo, len(ids), zlib.crc32(ids.tobytes())) for doc, lo, ids in ShardReader(source).documents()]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "doc_id", "place", "n_tokens", "ids_crc32"])


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, folder: str | None = None, block_ids: int = BLOCK_IDS, planes: str = "byte", level: int = 3) -> DataFrame:
    """Write the shards below ``folder``; returns their manifest, shard numbers ascending with doc_id."""
    if planes not in PLANES:
        raise ValueError(f"planes: one of {PLANES}")
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "ids")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())  # one file of fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions(spark), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), F.col("text"))
    written = rows.mapInArrow(lambda batches: _write(batches, folder, TokenizerText(tokenizer), end_id, block_ids, planes, level), _MANIFEST)
    return materialize(written, "ids-manifest")


class TokenizerText:
    """A broadcast tokenizer file and the key under which a worker keeps its encoder."""

    def __init__(self, broadcast):
        self._broadcast = broadcast

    @property
    def value(self) -> str:
        return self._broadcast.value

    @property
    def id(self) -> int:
        return zlib.crc32(self.value.encode())


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it in all shards), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    # One row per shard: as many rows as the write had tasks.
    base = manifest.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("base"))
    rows = manifest.select("path", "shard").repartition(partitions(spark)).mapInArrow(_read, _DOCS)
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
