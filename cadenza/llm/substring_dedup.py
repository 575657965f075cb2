"""Operator 2: substring dedup by relative Lempel-Ziv parsing against an index of all documents.

Every document is a reference block, indexed by the fingerprints of its `window`-word windows.  For each
fingerprint that has two places the index holds the first and the last one, so every place has an address (document, word)
that isn't itself.  A document is parsed greedily: at the first word whose window has an address, the block's words there are
compared with the document's and a factor is extended for as long as the words are equal.  Where it
ends, the windows that stick out of it are looked up in turn, so a repeated window that lies across two factors starts one
of its own and none is lost.  Factors of `window` words at least are the duplicate spans.  So a fingerprint only
proposes; every factor is confirmed on the words of its reference block.

Reference blocks reach a document in slices of SLICE words (and the window - 1 after them); it gets those slices of
other documents that its addresses point into, adjacent ones are put together, and its own words serve for its own repeats.

The index is pruned before it is built.  The seed of a window is the least hash of the SEED-word
runs inside it, so equal windows have equal seeds, and a document has one seed for about
(window - SEED) / 2 words.  Only windows whose seed occurs twice in the corpus enter the index.

Hot groups.  Equal documents are found by a digest of their word sequence and parsed once (copies of
`window` words or more are removed whole); in a document each fingerprint is indexed once; seeds and
fingerprints are counted by partial aggregates; addresses of hot fingerprints and hot slices are broadcast
(`keyed_join`).  No group is gathered; what meets in one row is a document, its addresses and slices, in proportion to its length.

Contract of `substring_duplicates` (one row per input row): null or empty text has no words
(0, 0, hash of nothing); texts under `window` words lose nothing; repeated rows, also of one id,
count as further places; null ids are documents like any other; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, documents, keyed_join, rows_of
from .textcore import SPACED, U, Words, _power_tables, chunks, gram_hashes, mix, text_buffers, trimmed

#: Words of the runs that give a window its seed.
SEED = 8
#: Words of a reference block that are sent together.
SLICE = 64
EMPTY = hashlib.sha256(b"").hexdigest()


def sequence_digests(words: Words) -> list[bytes]:
    """128-bit digest of the whole word sequence of every row."""
    power, inverse = _power_tables(len(words.hash) + 1)
    first, out = words.first, []
    for salt in (U(0x243F6A8885A308D3), U(0x13198A2E03707344)):
        total = np.zeros(len(words.hash) + 1, dtype=U)
        np.cumsum(mix(words.hash ^ salt) * power[: len(words.hash)], dtype=U, out=total[1:])
        out.append(mix((total[first[1:]] - total[first[:-1]]) * inverse[first[:-1]] + words.n_words.astype(U)))
    return [pair.tobytes() for pair in np.stack(out, axis=1)]


def window_seeds(words: Words, window: int) -> np.ndarray:
    """Seed of the window that starts at each word (meaningful at `words.within(window)`)."""
    runs = gram_hashes(words.hash, min(SEED, window))
    need = window - min(SEED, window) + 1
    low, have = runs, 1
    while have < need:
        step = min(have, need - have)
        if len(low) <= step:  # fewer words than a window
            return low[:0]
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def seed_places(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed, row) of every place of a seed: a run is a seed if it is the least of some window that holds it,
    so it equals the greatest of the least values of the windows that hold it."""
    size = min(SEED, window)
    need = window - size + 1
    runs = gram_hashes(words.hash, size)
    low = np.zeros(max(0, len(words.hash) - window + 1), dtype=U)
    at = words.within(window)
    if not len(at):
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    low[at] = window_seeds(words, window)[at]
    high = np.concatenate([np.zeros(need - 1, dtype=U), low, np.zeros(need - 1, dtype=U)])
    have = 1
    while have < need:
        step = min(have, need - have)
        high = np.maximum(high[: len(high) - step], high[step:])
        have += step
    place = np.flatnonzero((high == runs) & (high > 0))
    return runs[place], words.row[place]


def _outline(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts = part.column("text").to_pylist()
                words = Words(*text_buffers(part.column("text")), SPACED)
                seed, row = seed_places(words, window)
                order = np.lexsort((seed, row))
                seed, row = seed[order], row[order]
                head = np.ones(len(seed), dtype=bool)
                head[1:] = (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])
                where = np.flatnonzero(head)
                total = np.diff(np.append(where, len(seed)))
                repeat = np.minimum(total, 2)
                seed, row = np.repeat(seed[where], repeat), np.repeat(row[where], repeat)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("key"), pa.array(words.n_words, pa.int64()), pa.array(sequence_digests(words), pa.binary()),
                     pa.array([hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in texts]),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(seed.view(np.int64)))],
                    names=["id", "key", "n_words", "doc", "sha", "seeds"])

    return run


def fingerprints(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the window that starts at each word (meaningful at `words.within(window)`)."""
    return gram_hashes(words.hash, window), gram_hashes(mix(words.hash ^ U(0xA4093822299F31D0)), window)


def _index_rows(window: int):
    """(x, y, no, start, last): each distinct window fingerprint of a document with a repeated seed, its first and last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(*text_buffers(part.column("text")), SPACED)
                seeds, (x, y) = window_seeds(words, window), fingerprints(words, window)
                docs, digests = part.column("doc").to_pylist(), sequence_digests(words)
                lists = part.column("seeds")
                out = []
                for i in range(part.num_rows):
                    a, b = words.first[i], words.first[i + 1] - window + 1
                    if docs[i] != digests[i] or b <= a:
                        continue
                    wanted = lists[i].values.to_numpy(zero_copy_only=False).view(U)
                    at = np.flatnonzero(np.isin(seeds[a:b], wanted))
                    order = at[np.lexsort((at, y[a:b][at], x[a:b][at]))]
                    new = np.ones(len(order), dtype=bool)
                    new[1:] = (x[a:b][order[1:]] != x[a:b][order[:-1]]) | (y[a:b][order[1:]] != y[a:b][order[:-1]])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(order)) - 1
                    start = order[first]
                    out.append((x[a:b][start], y[a:b][start], np.full(len(start), i), start, order[last]))
                if out:
                    x, y, row, start, last = (np.concatenate(z) for z in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), part.column("no").take(pa.array(row)),
                         pa.array(start.astype(np.int32)), pa.array(last.astype(np.int32))],
                        names=["x", "y", "no", "start", "last"])

    return run


def _slices(window: int):
    """(no, slice, words) of the wanted slices of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                digests = sequence_digests(Words(*text_buffers(part.column("text")), SPACED))
                out = []
                for no, doc, digest, text, wanted in zip(part.column("no").to_pylist(), part.column("doc").to_pylist(), digests,
                                                         part.column("text").to_pylist(), part.column("slices").to_pylist(), strict=True):
                    if doc == digest:
                        pieces = text.encode().split()
                        out += [(no, i, b" ".join(pieces[i * SLICE : (i + 1) * SLICE + window - 1])) for i in wanted]
                columns = list(zip(*out, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["other", "slice", "words"])

    return run


class Blocks:
    """The words of reference blocks that a document has slices of."""

    def __init__(self, slices: list[tuple[int, int, bytes]]):
        self.starts: dict[int, list[int]] = {}
        self.words: dict[int, list[list[bytes]]] = {}
        before = None
        for other, i, raw in sorted(slices):
            pieces = raw.split()
            if before == (other, i - 1):
                held = self.words[other][-1]
                del held[(i - self.starts[other][-1] // SLICE) * SLICE :]
                held += pieces
            else:
                self.starts.setdefault(other, []).append(i * SLICE)
                self.words.setdefault(other, []).append(pieces)
            before = (other, i)

    def at(self, other: int, word: int) -> tuple[list[bytes], int]:
        """The words of the stretch that holds a word, and its place in them."""
        n = bisect_right(self.starts.get(other, []), word) - 1
        return (self.words[other][n], word - self.starts[other][n]) if n >= 0 else ([], 0)


def common_words(a: list[bytes], i: int, b: list[bytes], j: int) -> int:
    """How many words are equal from a[i] and b[j] on."""
    n, step = 0, 32
    while a[i + n : i + n + step] == b[j + n : j + n + step] and i + n < len(a) and j + n < len(b):
        n += min(step, len(a) - i - n, len(b) - j - n)
        step *= 2
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return n


def parse(pieces: list[bytes], own: int, addresses: list[tuple[int, int, int]], blocks: Blocks, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (first word, words, other, other word) from (start, other, word) addresses by start."""
    out: list[tuple[int, int, int, int]] = []
    covered_to = -1  # windows that start before this word lie in the last factor
    for start, other, word in addresses:
        if start < covered_to:
            continue
        block, j = (pieces, word) if other == own else blocks.at(other, word)
        n = common_words(pieces, start, block, j)
        if n >= window:
            out.append((start, n, other, word))
            covered_to = start + n - window + 1
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in some span."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change)[:n] > 0


def _factor_documents(window: int):
    span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("other", pa.int64()), ("other_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(*text_buffers(part.column("text")), SPACED)
                x, y = fingerprints(words, window)
                docs, digests = part.column("doc").to_pylist(), sequence_digests(words)
                texts, entries, numbers = part.column("text").to_pylist(), part.column("entries"), part.column("no").to_pylist()
                slices = part.column("blocks")
                out = []
                for i in range(part.num_rows):
                    a, b = words.first[i], words.first[i + 1]
                    if docs[i] != digests[i]:
                        continue
                    ex, ey, first_no, first_word, last_no, last_word = (
                        entries[i].values.field(j).to_numpy(zero_copy_only=False) for j in range(6))
                    own_x, own_y = x[a : b - window + 1], y[a : b - window + 1]
                    order = np.argsort(ex.view(U), kind="stable")
                    known = ex.view(U)[order]
                    place = order[np.minimum(np.searchsorted(known, own_x), len(known) - 1)]
                    at = np.flatnonzero((ex.view(U)[place] == own_x) & (ey.view(U)[place] == own_y))
                    entry, own = place[at], numbers[i]
                    # The first place, unless that is the window itself.
                    itself = (first_no[entry] == own) & (first_word[entry] == at)
                    other = np.where(itself | ((first_no[entry] == own) & (last_no[entry] != own)), last_no[entry], first_no[entry])
                    word = np.where(itself | ((first_no[entry] == own) & (last_no[entry] != own)), last_word[entry], first_word[entry])
                    pieces = texts[i].encode().split()
                    held = slices[i].as_py() or []
                    blocks = Blocks([(h["other"], h["slice"], h["words"]) for h in held])
                    factors = parse(pieces, own, list(zip(at.tolist(), other.tolist(), word.tolist(), strict=True)), blocks, window)
                    spans = np.array([(f[0], f[1]) for f in factors], dtype=np.int64).reshape(-1, 2)
                    gone = covered(spans[:, 0], spans[:, 1], int(b - a))
                    kept = b" ".join([w for w, g in zip(pieces, gone.tolist(), strict=True) if not g])
                    out.append((docs[i], int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                                [{"first": f, "words": n, "other": r, "other_word": w} for f, n, r, w in factors], kept.decode()))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                types = [pa.binary(), pa.int64(), pa.string(), span, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                                 names=["doc", "n_removed", "kept_sha256", "factors", "kept"])

    return run


_FACTORED = ("doc binary, n_removed long, kept_sha256 string, "
             "factors array<struct<first:bigint,words:bigint,other:bigint,other_word:bigint>>, kept string")


def factored(df: DataFrame, window: int, scratch: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outline of every row, copies of each document, factors of documents that have any); `other` in factors numbers the documents."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn(
        "key", F.coalesce("id", F.xxhash64("text")))
    outline = scratch.keep(
        docs.mapInArrow(trimmed(_outline(window)), "id long, key long, n_words long, doc binary, sha string, seeds array<long>"), "outline")
    # Each word sequence has a number and is parsed once, in its row of least key; that row is found by (key, digest), which no
    # group of copies shares.
    long = outline.where(F.col("n_words") >= window)
    copies = scratch.keep(
        long.groupBy("doc").agg(F.count("*").alias("copies"), F.min("key").alias("key")).withColumn("no", F.monotonically_increasing_id()), "copies")
    copied = copies.where("copies > 1").select("doc", "copies")
    once = long.select("doc", "key", "seeds").join(copies.select("doc", "key", "no"), ["key", "doc"])
    seeds = scratch.keep(once.dropDuplicates(["no"]).select("no", F.explode("seeds").alias("seed")), "seeds")
    repeated = scratch.keep(seeds.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    named = copies.select("no", "key", "doc")
    lists = scratch.keep(
        keyed_join(seeds, repeated, ["seed"], "n", seeds.count()).groupBy("no").agg(F.collect_set("seed").alias("seeds")).join(named, "no"), "lists")
    scratch.drop("seeds", "repeated")

    texts = docs.select("key", "text")

    def with_text(wanted: DataFrame) -> DataFrame:
        """wanted (key, doc, ...) with texts of that key; the digest tells texts apart where a key has several."""
        return rows_of(texts, wanted.select("key").distinct(), "key").join(wanted, "key")

    index = scratch.keep(
        with_text(lists).mapInArrow(trimmed(_index_rows(window)), "x long, y long, no long, start int, last int"), "index")
    twice = scratch.keep(
        index.groupBy("x", "y")
        .agg(F.count("*").alias("n"), F.min(F.struct("no", "start")).alias("a"), F.max(F.struct("no", F.col("last").alias("start"))).alias("b"))
        .where("a != b"), "twice")
    hits = scratch.keep(
        keyed_join(index.select("x", "y", "no"), twice, ["x", "y"], "n", index.count())
        .select("no", "x", "y", F.col("a.no").alias("first"), F.col("a.start").alias("first_word"), F.col("b.no").alias("last"), F.col("b.start").alias("last_word")), "hits")
    scratch.drop("index", "twice")
    entries = hits.groupBy("no").agg(F.collect_list(F.struct("x", "y", "first", "first_word", "last", "last_word")).alias("entries"))
    # The slices of other documents that addresses point into.
    away = F.col("first") != F.col("no")
    far = scratch.keep(
        hits.where("first != no or last != no")
        .select("no", F.when(away, F.col("first")).otherwise(F.col("last")).alias("other"),
                F.floor(F.when(away, F.col("first_word")).otherwise(F.col("last_word")) / SLICE).cast("int").alias("slice")).distinct(), "far")
    wanted = scratch.keep(far.groupBy("other", "slice").agg(F.count("*").alias("n")), "wanted")
    sources = wanted.groupBy("other").agg(F.collect_list("slice").alias("slices")).withColumnRenamed("other", "no").join(named, "no")
    slices = with_text(scratch.keep(sources, "sources")).mapInArrow(
        trimmed(_slices(window)), "other long, slice int, words binary").dropDuplicates(["other", "slice"])
    slices = scratch.keep(slices.join(wanted, ["other", "slice"]), "slices")
    blocks = keyed_join(far, slices, ["other", "slice"], "n", far.count()).groupBy("no").agg(
        F.collect_list(F.struct("other", "slice", "words")).alias("blocks"))
    keyed = scratch.keep(entries.join(blocks, "no", "left").join(named, "no"), "entries")
    scratch.drop("hits", "far", "wanted", "sources", "slices")
    found = with_text(keyed).select("no", "doc", "text", "entries", "blocks").mapInArrow(trimmed(_factor_documents(window)), _FACTORED)
    return outline, copied, found.dropDuplicates(["doc"])


def substring_duplicates(df: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, n_factors) per row."""
    outline, copied, found = factored(df, window, Scratch(df.sparkSession), id_col, text_col)
    # One table of fates and one join with it, which Spark can split where many rows are copies of one text.
    parsed = found.select("doc", "n_removed", "kept_sha256", F.size("factors").alias("n_factors")).join(copied, "doc", "left_anti")
    fates = parsed.unionByName(copied.select(
        "doc", F.lit(None).cast("long").alias("n_removed"), F.lit(EMPTY).alias("kept_sha256"), F.lit(1).alias("n_factors")))
    known = F.col("kept_sha256").isNotNull()
    return outline.select("id", "n_words", "doc", "sha").join(fates, "doc", "left").select(
        F.col("id").alias(id_col), "n_words",
        F.when(known, F.coalesce("n_removed", "n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("n_factors", F.lit(0)).alias("n_factors"))


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words = Words(*text_buffers(part.column("text")), SPACED)
            yield part.append_column("doc", pa.array(sequence_digests(words), pa.binary()))


def without_duplicates(df: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) per row: the kept words joined by one space where something was removed, else the text itself."""
    _, copied, found = factored(df, window, Scratch(df.sparkSession), id_col, text_col)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _with_digest, "id long, text string, doc binary")
    fates = texts.join(copied, "doc", "left").join(found.select("doc", "kept"), "doc", "left")
    return fates.select(
        F.col("id").alias(id_col), F.when(F.col("copies").isNotNull(), F.lit("")).otherwise(F.coalesce("kept", "text")).alias(text_col))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 35 words over the whole documents table."""
    return substring_duplicates(documents(spark, sf_dir), window=35)
