"""Token-ID output: fixed-width bit packing with block offsets (operator 1).

Each shard file holds the documents of one range of doc_id in ascending order:

    magic "LMPACK01"
    blocks   ids packed in `bits` bits each, least significant bit first;
             every block but the last holds `block_ids` ids, byte-aligned
    doc ids  int64 each, then one validity byte each (0: doc_id is null)
    starts   uint64 each, n_docs + 1: first id of each document in the shard
    offsets  uint64 each, n_blocks + 1: byte position of each block
    footer   struct FOOTER, whose last field is the magic again

A block is unpacked by numpy without loops over ids, and any id range is read
by seeking to its blocks alone.  `bits` is the least that holds the vocabulary.

Shards are written under a name of the task attempt and then renamed, with
equal bytes at every attempt, so lost executors and speculative copies are
harmless.
"""

from __future__ import annotations

import gc
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, wordhash

MAGIC = b"LMPACK01"
FOOTER = struct.Struct("<IIIQQQQQQ8s")  # bits, vocabulary, block_ids, n_docs, n_ids, n_blocks, at: docs, starts, offsets; magic
BLOCK_IDS = 8192

_TOKENIZERS: dict = {}


def tokenizer(path: str):
    common.one_thread()
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def bits_for(vocabulary: int) -> int:
    """The least width that holds ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype("<u4").reshape(-1, 1) >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class ShardWriter:
    """Writes one shard to a binary stream; holds one block of ids and the document table."""

    def __init__(self, out, vocabulary: int, block_ids: int = BLOCK_IDS) -> None:
        self.out, self.vocabulary, self.block_ids, self.bits = out, vocabulary, block_ids, bits_for(vocabulary)
        self.docs: list[int | None] = []
        self.starts, self.offsets = [0], [len(MAGIC)]
        self.parts: list[np.ndarray] = []
        self.waiting = 0
        out.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.parts.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            rest = np.concatenate(self.parts)
            whole = len(rest) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(rest[i : i + self.block_ids])
            self.parts, self.waiting = [rest[whole:]], len(rest) - whole

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.parts))
        at = self.offsets[-1]
        n = len(self.docs)
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is not None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(FOOTER.pack(self.bits, self.vocabulary, self.block_ids, n, self.starts[-1], len(self.offsets) - 1, at, at + 9 * n, at + 9 * n + 8 * (n + 1), MAGIC))


class ShardReader:
    """Random access to a shard in a seekable binary stream."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.seek(0, io.SEEK_END)
        source.seek(size - FOOTER.size)
        self.bits, self.vocabulary, self.block_ids, self.n_docs, self.n_ids, self.n_blocks, docs, starts, offsets, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of packed ids")
        source.seek(docs)
        self.doc_ids = np.frombuffer(source.read(8 * self.n_docs), "<i8")
        self.valid = np.frombuffer(source.read(self.n_docs), np.uint8).astype(bool)
        self.starts = np.frombuffer(source.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(source.read(8 * (self.n_blocks + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end - 1 of the shard, from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        base, parts = int(self.offsets[first]), []
        if self.block_ids * self.bits % 8 == 0:  # full blocks touch: unpack them as one
            n = min(self.n_ids, (last + 1) * self.block_ids) - first * self.block_ids
            parts.append(unpack(data, int(n), self.bits))
        else:
            for b in range(first, last + 1):
                n = min(self.n_ids - b * self.block_ids, self.block_ids)
                parts.append(unpack(data[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], int(n), self.bits))
        return np.concatenate(parts)[start - first * self.block_ids : end - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves; the other bytes take the
    code points from 256 on, in order.
    """
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: chr(256 + hidden.index(b) if b in hidden else b) for b in range(256)}


class Encoder:
    """tokenizers' ids of whole texts, as little-endian unsigned 32-bit integers.

    Byte-level pre-tokenisation always cuts before a single space, and on both
    sides of a single line break, that stand between other characters; it also
    cuts between letters and punctuation.  What lies between such cuts is
    encoded by the library once and remembered.  A text in which white space
    meets other white space, or that holds a special token's string, goes to the
    library whole, as does every text if the tokenizer normalises or
    pre-tokenises in another way.
    """

    #: Pieces in a generation of the memory.  When the young one is full it
    #: becomes the old one, so pieces that come often stay.
    MOST = 450_000
    #: ASCII punctuation that may end a word; the apostrophe is left out as it also begins a suffix.
    MARKS = ".,;:!?*$%&#|()-/\"[]{}<>=+_~@^`"

    def __init__(self, path: str) -> None:
        self.t = tokenizer(path)
        how = json.loads(self.t.to_str())
        pre = how["pre_tokenizer"] or {}
        self.pieces = not how["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.special = [x["content"] for x in how["added_tokens"]]
        self.letters = byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _one(self, piece: str) -> bytes:
        """Ids of letters or marks, with a space before them or none, or of any other piece."""
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece)
            if ids is None:
                if piece.isalpha() or (piece[0] == " " and piece[1:].isalpha()):  # one pre-token: the model alone does
                    found = [x.id for x in self.t.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
                    ids = struct.pack(f"<{len(found)}I", *found)
                else:
                    ids = self.whole(piece)
            self.young[piece] = ids
        return ids

    def _learn(self, pieces: set[str]) -> None:
        """Make all pieces known that can be encoded alone."""
        if len(self.young) + len(pieces) > self.MOST:
            self.young, self.old = {}, self.young
        for p in pieces.difference(self.young):
            core = p.removeprefix(" ")
            if p == "\n" or core and not core[0].isspace() and not core[-1].isspace():
                word = p.rstrip(self.MARKS)
                if len(word) < len(p) and word[-1:].isalpha():
                    self.young[p] = self._one(word) + self._one(p[len(word) :])
                else:
                    self._one(p)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the texts' pieces should fit into a generation."""
        cut = [t.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if self.pieces and "\0" not in t and not any(s in t for s in self.special) else None for t in texts]
        self._learn(set().union(*(pieces for pieces in cut if pieces)))
        out, get = [], self.young.__getitem__
        for text, pieces in zip(texts, cut, strict=True):
            try:
                out.append(b"".join(map(get, pieces)) if pieces else self.whole(text))
            except KeyError:
                out.append(self.whole(text) if text else b"")
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Give up what this worker remembers of tokenising; reused workers would keep it through all later jobs."""
    if _ENCODERS or _TOKENIZERS:
        _ENCODERS.clear()
        _TOKENIZERS.clear()
        gc.collect()
        common.give_back()


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = 2, shards: int | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Tokenise docs (doc_id, text) and write shards to folder, a URI that pyarrow can write.

    Documents lie in ascending doc_id order, null first; rows that share a
    doc_id lie in the order of a hash of their text.  A null text is empty; each
    document ends with end_id.  Other columns are ignored.  Returns a row for
    each shard: shard, path, n_docs, n_ids.  No rows give no shards.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards or common.partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        shard, encode, end = TaskContext.get().partitionId(), encoder(tokenizer_path), struct.pack("<I", end_id)
        fs, path = pafs.FileSystem.from_uri(folder)
        name, attempt = f"{path}/shard-{shard:06d}.ids", f"{path}/.{shard:06d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(attempt) as out:
            w = ShardWriter(out, tokenizer(tokenizer_path).get_vocab_size(), block_ids)
            batch, head = head, None
            while batch is not None:
                for a, b in wordhash.slices(batch.column("text")):
                    part = batch.slice(a, b - a)
                    for doc_id, got in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                        w.add(doc_id, np.frombuffer(got + end, "<u4"))
                batch = part = None
                common.give_back()
                batch = next(batches, None)
            w.close()
        fs.move(attempt, name)
        common.give_back()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/shard-{shard:06d}.ids"], "n_docs": [len(w.docs)], "n_ids": [w.starts[-1]]})

    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return common.written(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """A row for each document of write_shards()' files: doc_id, start, n_tokens, ids_crc32, shard.

    start counts the ids of all documents before it, over all shards.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        release()  # all shards are written by now
        parts = []
        for shard, path, base in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "base")), strict=True):
            fs, at = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(at) as source:
                r = ShardReader(source)
                ids, counts, crcs = np.zeros(0, np.uint32), np.diff(r.starts), []
                got = lo = 0
                for i in range(r.n_docs):
                    if r.starts[i + 1] > got:  # read ahead, whole documents
                        lo = int(r.starts[i])
                        j = max(i + 1, int(np.searchsorted(r.starts, lo + (1 << 20), "right")) - 1)
                        got = int(r.starts[j])
                        ids = r.ids(lo, got).astype("<u4")
                    crcs.append(zlib.crc32(ids[r.starts[i] - lo : r.starts[i + 1] - lo].tobytes()))
                parts.append(
                    pa.table({
                        "doc_id": pa.array(r.doc_ids, pa.int64(), mask=~r.valid), "start": r.starts[:-1] + base, "n_tokens": counts,
                        "ids_crc32": pa.array(crcs, pa.int64()), "shard": np.full(r.n_docs, shard),
                    })
                )
        return pa.concat_tables(parts).combine_chunks().to_batches()[0]

    spread = shards.withColumn("base", before).repartition(common.partitions(shards.sparkSession), "shard")
    return common.arrow_map(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write docs to fresh shards in the work folder and read them back."""
    return read_shards(write_shards(docs, common.new_folder(spark, "ids"), tokenizer_path, **options))
