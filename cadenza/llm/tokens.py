"""Operator 3: token ids in patched frame-of-reference shards.

Shard file (little endian)
  8 bytes   magic b"CDZPFOR1"
  blocks    each of up to BLOCK ids: u32 least id | u8 width | u8 0 | u16 ids | u16 exceptions |
            ids less the least one in `width` bits, least significant bit first, padded to a byte |
            u16 position of each exception | u32 full difference of each exception
  tables    i64 document id [docs] | u8 id is null [docs] | u64 first token [docs + 1] | u64 block start [blocks + 1]
  footer    u64 docs | u64 tokens | u64 blocks | u64 position of the tables | u32 crc32 of tables | magic
A reader finds document d from the footer alone: its first token gives the block, the block
table the byte, so a range read decodes only the blocks it needs.

The width of a block is the bit length of its PERCENTILE-th percentile difference; larger
differences keep their low bits in place and their whole value in the exception list.

Contract of `write_tokens` / `read_tokens`: null text counts as empty and yields the end id
alone; rows are written in ascending id order (null ids first, ties by text hash) or, with `places`, as they lie, so repeated
ids are separate consecutive documents; an empty table writes no shard and reads as an empty
table; very long texts are encoded whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, documents, fresh_path
from .textcore import ASCII_SPACE, U, chunks, mix, text_buffers, trimmed

MAGIC = b"CDZPFOR1"
BLOCK = 1024
PERCENTILE = 97
#: A shard is closed once it holds this many tokens (a document is never split).
SHARD_TOKENS = 16_000_000
#: Places in a task's table of pieces (40 bytes each), and ids of remembered pieces after which it starts anew.
SLOTS = 1 << 19
REMEMBERED_IDS = 5_000_000
#: Pieces that the library encodes in one call; its results are large.
ENCODED_AT_ONCE = 4096

_FOOTER = struct.Struct("<QQQQI8s")
_HEAD = struct.Struct("<IBBHH")
MANIFEST = "file long, first long, path string, docs long, tokens long, bytes long"


# ---------------------------------------------------------------- encoding texts

#: A public pattern of word-level BPE tokenizers: contractions, runs of letters, single digits, runs of the rest.
RUNS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}


def _steps(spec: dict | None, key: str) -> list[dict]:
    return [] if not spec else spec[key] if spec.get("type") == "Sequence" else [spec]


def splits_at_space(tokenizer_json: str) -> bool:
    """Whether white space always separates tokens and leaves none, so pieces can be encoded alone."""
    spec = json.loads(tokenizer_json)
    split = _steps(spec.get("pre_tokenizer"), "pretokenizers")
    first = split[0] if split else {}
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    return (
        first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and "\\s" in str(first.get("pattern")) and not any(s.get("add_prefix_space") for s in split)
        and all(s.get("type") in _LOCAL or s == spaces for s in _steps(spec.get("normalizer"), "normalizers"))
        and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens", []))
    )


def splits_in_runs(tokenizer_json: str) -> bool:
    """Whether, beyond that, texts are lower-cased and split by RUNS, so runs within a piece can be encoded alone."""
    spec = json.loads(tokenizer_json)
    split = _steps(spec.get("pre_tokenizer"), "pretokenizers")
    return (splits_at_space(tokenizer_json) and split[0].get("pattern") == {"Regex": RUNS}
            and all(s.get("type") == "ByteLevel" and s.get("use_regex") is False for s in split[1:])
            and any(s.get("type") == "Lowercase" for s in _steps(spec.get("normalizer"), "normalizers")))


_SPACE, _LETTER, _DIGIT, _REST, _WHOLE = range(5)


class Splitter:
    """Cuts a batch of texts into pieces that the tokenizer treats alone.

    Pieces between white space always; within them runs of letters, single digits and runs of other characters where
    `runs` is set and the piece has only ASCII and Latin-1 letters, no apostrophe (contractions) and
    no first character of an added token.  Other pieces stay whole and are left to the library.
    """

    def __init__(self, runs: bool, first_of_added: bytes):
        self.runs = runs
        self.kind = np.full(256, _WHOLE, dtype=np.uint8)
        self.kind[list(ASCII_SPACE)] = _SPACE
        if runs:
            self.kind[33:127] = _REST
            self.kind[48:58] = _DIGIT
            self.kind[65:91] = self.kind[97:123] = _LETTER
            self.kind[[39, *first_of_added]] = _WHOLE
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def pieces(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of the pieces in place, starts, stops)."""
        kind = self.kind[raw]
        if self.runs and len(raw):
            lead = np.flatnonzero(raw[:-1] == 0xC3)
            after = raw[lead + 1]
            ok = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
            lead, after = lead[ok], after[ok]
            kind[lead] = kind[lead + 1] = _LETTER
            odd = np.flatnonzero(kind == _WHOLE)
            folded = self.fold[raw]
            upper = lead[after <= 0x9E] + 1
            folded[upper] = raw[upper] + 0x20
            if len(odd):
                starts, stops = self._cut(kind != _SPACE, ends)
                hit = np.zeros(len(starts), dtype=bool)
                hit[np.searchsorted(starts, odd, side="right") - 1] = True
                change = np.zeros(len(raw) + 1, dtype=np.int8)
                np.add.at(change, starts[hit], 1)
                np.add.at(change, stops[hit], -1)
                whole = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
                kind[whole] = _WHOLE
                folded[whole] = raw[whole]
            raw = folded
        return raw, *self._cut(kind, ends)

    @staticmethod
    def _cut(kind: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.ones(len(kind) + 1, dtype=bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) if kind.dtype != bool else kind[1:] != kind[:-1]
        edge[ends] = True
        at = np.flatnonzero(edge)
        starts, stops = at[:-1], at[1:]
        held = kind[starts] != _SPACE
        return starts[held], stops[held]


class Encoder:
    """Texts to u32 ids by the tokenizers library; pieces are looked up by their bytes in a table of fixed size.

    A piece of up to LONGEST bytes is three 64-bit numbers (its bytes and its length), compared in full.  A piece
    has two places in the table; if both are taken the first is given up.  Pieces that aren't found, once each
    for a batch, and longer ones are encoded by the library.
    """

    LONGEST = 23

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = f.read()
        self.library = Tokenizer.from_str(spec)
        self.splitter = None
        if splits_at_space(spec):
            added = {t["content"].encode()[0] for t in json.loads(spec).get("added_tokens", []) if t["content"]}
            self.splitter = Splitter(splits_in_runs(spec), bytes(added))
        self.forget()

    def forget(self) -> None:
        """Empties the table; most of its pages are untouched until they are used."""
        self.keys = np.zeros((SLOTS, 3), dtype=U)
        self.at = np.zeros(SLOTS, dtype=np.int64)
        self.size = np.zeros(SLOTS, dtype=np.int64)
        self.pool = np.zeros(1 << 16, dtype="<u4")
        self.used = 0

    def _store(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Appends the ids of pieces to the pool: (positions, sizes)."""
        size = np.array([len(x) for x in found], dtype=np.int64)
        need = self.used + int(size.sum())
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, 2 * len(self.pool)) - len(self.pool), "<u4")])
        self.pool[self.used : need] = [i for x in found for i in x]
        at = self.used + np.cumsum(size) - size
        self.used = need
        return at, size

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(texts), ENCODED_AT_ONCE):
            out += [x.ids for x in self.library.encode_batch_fast(texts[i : i + ENCODED_AT_ONCE], add_special_tokens=False)]
        return out

    def _find(self, keys: np.ndarray, slots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The slot that holds each key, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for slot in slots:
            s = slot[rest]
            held = self.keys[s]
            ok = (held[:, 0] == keys[rest, 0]) & (held[:, 1] == keys[rest, 1]) & (held[:, 2] == keys[rest, 2])
            out[rest[ok]] = s[ok]
            rest = rest[~ok]
        return out

    def _places(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position in the pool and number of ids of every piece."""
        at, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        length = stops - starts
        short = np.flatnonzero(length <= self.LONGEST)
        if len(short):
            wide = np.concatenate([raw, np.zeros(24, np.uint8)])
            view = np.ndarray(len(raw) + 16, dtype="<u8", buffer=wide, strides=(1,))
            keys = np.empty((len(short), 3), dtype=U)
            for j in range(3):
                left = np.clip(length[short] - 8 * j, 0, 8)
                keys[:, j] = view[np.minimum(starts[short] + 8 * j, len(raw) + 8)] & _MASKS[left]
            keys[:, 2] |= length[short].astype(U) << U(56)
            mixed = mix(keys[:, 0] ^ mix(keys[:, 1] ^ mix(keys[:, 2])))
            slots = (mixed & U(SLOTS - 1)).astype(np.int64), (mixed >> U(40) & U(SLOTS - 1)).astype(np.int64)
            found = self._find(keys, slots)
            hit = np.flatnonzero(found >= 0)  # read before new pieces take their places
            at[short[hit]], size[short[hit]] = self.at[found[hit]], self.size[found[hit]]
            miss = np.flatnonzero(found < 0)
            if len(miss):
                _, first, where = np.unique(mixed[miss], return_index=True, return_inverse=True)
                same = (keys[miss] == keys[miss[first]][where]).all(axis=1)
                if not same.all():  # two pieces of one hash: every missed piece on its own
                    first, where = np.arange(len(miss)), np.arange(len(miss))
                new = miss[first]
                a, b = starts[short[new]], stops[short[new]]
                flat = raw.tobytes()
                new_at, new_size = self._store(self.library_ids([flat[i:j].decode() for i, j in zip(a.tolist(), b.tolist(), strict=True)]))
                at[short[miss]], size[short[miss]] = new_at[where], new_size[where]
                slot = np.where(self.keys[slots[0][new], 2] == 0, slots[0][new], slots[1][new])
                slot = np.where(self.keys[slot, 2] == 0, slot, slots[0][new])
                slot, one = np.unique(slot, return_index=True)  # pieces of one batch may want the same place
                self.keys[slot], self.at[slot], self.size[slot] = keys[new[one]], new_at[one], new_size[one]
        long = np.flatnonzero(length > self.LONGEST)
        if len(long):
            flat = raw.tobytes()
            each = [flat[i:j].decode() for i, j in zip(starts[long].tolist(), stops[long].tolist(), strict=True)]
            at[long], size[long] = self._store(self.library_ids(each))
        return at, size

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, number of ids of each text); null texts are empty."""
        if self.splitter is None:
            found = [[*x, end_id] for x in self.library_ids([t or "" for t in column.to_pylist()])]
            size = np.array([len(x) for x in found], dtype=np.int64)
            return np.fromiter((i for x in found for i in x), "<u4", int(size.sum())), size
        if self.used > REMEMBERED_IDS:
            self.forget()
        raw, ends = text_buffers(column)
        raw, starts, stops = self.splitter.pieces(raw, ends)
        at, size = self._places(raw, starts, stops)
        (end,), _ = self._store([[end_id]])
        first = np.searchsorted(starts, ends)
        at, size = np.insert(at, first[1:], end), np.insert(size, first[1:], 1)
        cut = first[1:] + np.arange(1, len(ends))  # one end id more for each row before
        total = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(at - total[:-1], size) + np.arange(total[-1])
        return self.pool[where], np.diff(np.concatenate([[0], total[cut]]))


_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U)
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- blocks

def pack_block(ids: np.ndarray) -> bytes:
    least = int(ids.min())
    diff = (ids - np.uint32(least)).astype(np.uint32)
    rank = min(len(diff) - 1, len(diff) * PERCENTILE // 100)
    width = int(np.partition(diff, rank)[rank]).bit_length()
    over = np.flatnonzero(diff >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    if width == 16:
        body = diff.astype("<u2").tobytes()
    elif width:
        bits = (diff[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        body = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    else:
        body = b""
    return (
        _HEAD.pack(least, width, 0, len(diff), len(over)) + body
        + over.astype("<u2").tobytes() + diff[over].astype("<u4").tobytes()
    )


def unpack_block(raw: memoryview) -> np.ndarray:
    least, width, _, n, n_over = _HEAD.unpack_from(raw)
    at = _HEAD.size
    size = (n * width + 7) // 8
    if width == 16:
        diff = np.frombuffer(raw, "<u2", n, at).astype(np.uint32)
    elif width:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * width, bitorder="little")
        diff = bits.reshape(n, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    else:
        diff = np.zeros(n, dtype=np.uint32)
    at += size
    over = np.frombuffer(raw, "<u2", n_over, at)
    diff[over] = np.frombuffer(raw, "<u4", n_over, at + 2 * n_over)
    return diff + np.uint32(least)


class ShardWriter:
    def __init__(self, sink):
        self.sink = sink
        self.sink.write(MAGIC)
        self.at = len(MAGIC)
        self.rest = b""
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.blocks: list[int] = []
        self.tokens = 0

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents one after the other: their ids together, and how many each has."""
        self.doc_ids += doc_ids
        self.sizes += sizes.tolist()
        self.tokens += len(ids)
        self.rest += ids.astype("<u4").tobytes()
        if len(self.rest) >= 4 * BLOCK:
            self._flush(len(self.rest) // (4 * BLOCK) * BLOCK)

    def _flush(self, n: int) -> None:
        ids, self.rest = np.frombuffer(self.rest[: 4 * n], "<u4"), self.rest[4 * n :]
        out = []
        for i in range(0, n, BLOCK):
            block = pack_block(ids[i : i + BLOCK])
            self.blocks.append(self.at)
            self.at += len(block)
            out.append(block)
        self.sink.write(b"".join(out))

    def close(self) -> int:
        if self.rest:
            self._flush(len(self.rest) // 4)
        starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype("<u8")
        tables = (
            np.array([x or 0 for x in self.doc_ids], "<i8").tobytes()
            + np.array([x is None for x in self.doc_ids], np.uint8).tobytes()
            + starts.tobytes() + np.array([*self.blocks, self.at], "<u8").tobytes()
        )
        foot = _FOOTER.pack(len(self.doc_ids), self.tokens, len(self.blocks), self.at, zlib.crc32(tables), MAGIC)
        self.sink.write(tables + foot)
        return self.at + len(tables) + len(foot)


class ShardReader:
    """Documents of one shard file, by position; reads the tables, then only the blocks it needs."""

    def __init__(self, source, size: int):
        self.source = source
        foot = self._bytes(size - _FOOTER.size, _FOOTER.size)
        docs, self.tokens, blocks, at, crc, magic = _FOOTER.unpack(foot)
        if magic != MAGIC or bytes(self._bytes(0, 8)) != MAGIC:
            raise ValueError("not a token shard")
        tables = self._bytes(at, size - _FOOTER.size - at)
        if zlib.crc32(tables) != crc:
            raise ValueError("damaged tables in a token shard")
        ids = np.frombuffer(tables, "<i8", docs)
        null = np.frombuffer(tables, np.uint8, docs, 8 * docs)
        self.doc_ids = [None if n else int(x) for x, n in zip(ids, null, strict=True)]
        self.starts = np.frombuffer(tables, "<u8", docs + 1, 9 * docs).astype(np.int64)
        self.blocks = np.frombuffer(tables, "<u8", blocks + 1, 9 * docs + 8 * (docs + 1)).astype(np.int64)

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def tokens_between(self, first: int, last: int) -> np.ndarray:
        if last <= first:
            return np.zeros(0, np.uint32)
        lo, hi = first // BLOCK, (last - 1) // BLOCK + 1
        raw = memoryview(self._bytes(int(self.blocks[lo]), int(self.blocks[hi] - self.blocks[lo])))
        cut = self.blocks[lo : hi + 1] - self.blocks[lo]
        ids = np.concatenate([unpack_block(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
        return ids[first - lo * BLOCK : last - lo * BLOCK]

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first token, ids) of each document; about `at_once` tokens are decoded together."""
        d = 0
        while d < len(self.doc_ids):
            e = max(int(np.searchsorted(self.starts, self.starts[d] + at_once, "right")) - 1, d + 1)
            held = self.tokens_between(int(self.starts[d]), int(self.starts[e]))
            for i in range(d, e):
                a, b = self.starts[i] - self.starts[d], self.starts[i + 1] - self.starts[d]
                yield self.doc_ids[i], int(self.starts[i]), held[a:b]
            d = e


# ---------------------------------------------------------------- Spark

def _runs(rows: pa.RecordBatch, in_place: bool) -> Iterator[tuple[int | None, int, pa.RecordBatch]]:
    """(file, first row, rows) of each stretch of rows of one file; (None, 0, rows) if files don't matter."""
    if not in_place:
        yield None, 0, rows
        return
    files = rows.column("file").to_numpy()
    cut = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(files[a]), rows.column("at")[a].as_py(), rows.slice(a, b - a)


def _write_partition(folder: str, tokenizer: str, end_id: int, in_place: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        enc = encoder(tokenizer)
        shards, writer, sink, head = [], None, None, {}

        def close() -> None:
            size = writer.close()
            sink.close()
            shards.append(head | {"docs": len(writer.doc_ids), "tokens": writer.tokens, "bytes": size})

        for batch in batches:
            for some in chunks(batch):
                for file, first, rows in _runs(some, in_place):
                    ids, sizes = enc.encode(rows.column("text"), end_id)
                    if writer is not None and (writer.tokens >= SHARD_TOKENS or (in_place and file != head["file"])):
                        close()
                        writer = None
                    if writer is None:
                        name = f"{root}/part-{part:06d}-{len(shards):06d}-{attempt}.pfor"
                        head = {"file": file, "first": first, "path": name} if in_place else {"file": part, "first": len(shards), "path": name}
                        sink = store.open_output_stream(name)
                        writer = ShardWriter(sink)
                    writer.add(rows.column("id").to_pylist(), sizes, ids)
        if writer is not None:
            close()
        _encoders.clear()  # the worker stays beside the next stages
        if shards:
            yield pa.RecordBatch.from_pylist(shards, schema=pa.schema([
                ("file", pa.int64()), ("first", pa.int64()), ("path", pa.string()),
                ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    return trimmed(run)


def write_tokens(df: DataFrame, folder: str, tokenizer: str, end_id: int, scratch: Scratch,
                 id_col: str = "doc_id", text_col: str = "text", places: tuple[Column, Column] | None = None) -> DataFrame:
    """Writes the shards under `folder` (any URI pyarrow opens) and returns their manifest, one row a shard.

    Shards in order of (file, first) are the documents in order.  By default the rows are range-partitioned and
    sorted by id.  With `places`, the number of a row's file and its number in it, rows stay where they
    lie: a partition reads files in stretches, each stretch has shards of its own, and nothing is shuffled.
    A task that is run again writes files of another name; only those of
    the attempt that Spark accepts are in the manifest.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                     *[c.cast("long").alias(n) for c, n in zip(places or (), ("file", "at"))])
    if places is None:
        order = ["id", F.xxhash64("text")]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.keep(rows.mapInArrow(_write_partition(folder, tokenizer, end_id, places is not None), MANIFEST), "manifest")


def _read_shards(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                with store.open_input_file(shard["path"]) as source:
                    out = [
                        (doc_id, shard["base"] + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        for doc_id, first, ids in ShardReader(source, shard["bytes"]).documents()
                    ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                    names=["id", "start", "n_tokens", "ids_crc32"])

    return trimmed(run)


def read_tokens(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the shard files.

    start is the number of ids of all documents before it: the manifest's running sum (one row a
    shard, so at SHARD_TOKENS ids a shard it stays small) plus the shard's own table.
    """
    shards = manifest.withColumn(
        "base", F.coalesce(F.sum("tokens").over(Window.orderBy("file", "first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = max(1, manifest.count())
    rows = shards.repartition(n, F.col("file"), F.col("first")).mapInArrow(
        _read_shards(folder), "id long, start long, n_tokens long, ids_crc32 long")
    return rows.withColumnRenamed("id", id_col)


def tokenized(df: DataFrame, tokenizer: str, end_id: int, places: tuple[Column, Column] | None = None) -> DataFrame:
    """Encodes, writes and reads back a table of documents."""
    spark = df.sparkSession
    folder = fresh_path(spark, "shards")
    manifest = write_tokens(df, folder, tokenizer, end_id, Scratch(spark), places=places)
    return read_tokens(manifest, folder)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the 49k word BPE and end id 1."""
    return tokenized(documents(spark, sf_dir), word_bpe(), 1)
