"""Operator 7: toxicity from the nearest labelled examples, by exact TF-IDF cosine.

Terms are words (A-Z folded) and word beginnings of 4 to 8 bytes, each with its ordinal: the
j-th occurrence in a text is a term of its own, so a term's frequency is coded in unary and two texts share the lesser
of their frequencies.  A text's vector holds all its terms that occur in some example; terms that no example
has can't add to a similarity.  The weight of a term is its inverse document frequency, counted over
all documents, times its relevance, which is estimated on the sample: FLOOR, or more the surer it is (likelihood ratio)
that the term goes with label 1.  No term is left out.

Examples are the first EXAMPLES of the sample's rows of each label.  They lie in an inverted index whose postings are cut into
blocks of examples, with the largest weight of each term in each block; postings of terms that stand in many
examples are kept as rows of a matrix.  A query reads blocks by decreasing bound and leaves out those
whose bound cannot reach the k-th best similarity, so the k nearest examples are exact (in single precision).
Votes are weighted by similarity; a monotone fit of the examples' leave-one-out votes turns them into probabilities.

Contract of `scored`: null and empty texts and texts that share no term with an example get the
share of label 1 among the sample's rows; equal texts and repeated rows get equal
results; of equally near examples the first one counts; a labelled id with several texts is learned from one of them (least
hash); no labelled row of both labels: score 0, or 1 if all are label 1; an empty table gives an empty result; whole
texts of any length are read; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore
from .sampling import HELD_OUT, bounded_sample, fold
from .shared import documents
from .textcore import ALNUM_LOWER, U, Words, chunks, mix, text_buffers, trim, trimmed

#: Labelled rows of each label that relevance is estimated on, and those of them that are examples, at most.
PER_LABEL = 2000
EXAMPLES = 500
BEGINNINGS = (4, 5, 6, 7, 8)
#: Relevance of a term: at least FLOOR; 1 from a likelihood ratio of SURE.
FLOOR = 0.05
SURE = 25.0
NEIGHBOURS = 24
BLOCK = 50
#: Terms of so many examples are kept as matrix rows.
COMMON = 32
#: Texts searched for together.
QUERIES = 128
THRESHOLD = 0.3


def word_terms(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For whole words and each beginning: (row, term hash) arrays."""
    words = Words(raw, ends, ALNUM_LOWER)
    power, inverse = textcore._power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=U)
    np.cumsum(ALNUM_LOWER.value[raw] * power[: len(raw)], dtype=U, out=total[1:])
    size = words.stops - words.starts
    yield words.row, words.hash
    for n in BEGINNINGS:
        at = np.flatnonzero(size >= n)
        start = words.starts[at]
        yield words.row[at], mix((total[start + n] - total[start]) * inverse[start] + U(1000 + n))


class Vocabulary:
    """The terms of the examples.  Term p with ordinal j (from 0) is column first[p] + j, up to the most that an example has."""

    BITS = 20

    def __init__(self, values: np.ndarray, most: np.ndarray):
        """values: ascending hashes; most: the greatest frequency of each in an example."""
        self.values, self.most = values, most.astype(np.int64)
        self.first = (np.cumsum(self.most) - self.most).astype(np.int64)
        self.size = int(self.most.sum())
        self.start = np.searchsorted(values >> U(64 - self.BITS), np.arange((1 << self.BITS) + 1).astype(U)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in hashes, their terms) of the known ones."""
        top = (hashes >> U(64 - self.BITS)).astype(np.int64)
        at, stop = self.start[top].astype(np.int64), self.start[top + 1].astype(np.int64)
        where = np.flatnonzero(at < stop)
        at, stop, hits, terms = at[where], stop[where], [], []
        while len(where):
            ok = self.values[at] == hashes[where]
            hits.append(where[ok])
            terms.append(at[ok])
            at = at + 1
            more = ~ok & (at < stop)
            where, at, stop = where[more], at[more], stop[more]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(hits), np.concatenate(terms)

    def columns(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of each known term of each text, ascending."""
        raw, ends = text_buffers(part.column("text"))
        held = []
        for rows, hashes in word_terms(raw, ends):
            at, terms = self.find(hashes)
            held.append(rows[at].astype(U) << U(32) | terms.astype(U))
        both = np.sort(np.concatenate(held))
        if not len(both):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.arange(len(both))
        new = np.ones(len(both), dtype=bool)
        new[1:] = both[1:] != both[:-1]
        ordinal = place - np.maximum.accumulate(np.where(new, place, 0))
        rows, terms = (both >> U(32)).astype(np.int64), (both & U(0xFFFFFFFF)).astype(np.int64)
        keep = ordinal < self.most[terms]
        return rows[keep], self.first[terms[keep]] + ordinal[keep]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class BlockMaxIndex:
    """Exact k nearest examples by dot product.

    Examples are cut into blocks of neighbours in the order given.  An entry is a (column, block) with the largest weight of the
    column's postings in the block and the range of those postings; columns with COMMON postings and more are
    matrix rows instead.  A query reads blocks by decreasing bound, the sum of its weights times those
    maxima, and stops when the next bound is below the k-th best similarity.
    """

    def __init__(self, example: np.ndarray, column: np.ndarray, weight: np.ndarray, columns: int, n: int, block: int = BLOCK, common: int | None = None):
        self.n, self.block, self.blocks = n, block, max(1, -(-n // block))
        common = COMMON if common is None else common
        order = np.lexsort((example, column))
        example, column, weight = example[order], column[order], weight[order].astype(np.float32)
        held = np.bincount(column, minlength=columns)
        wide = held >= common
        self.dense = np.full(columns, -1, dtype=np.int32)
        self.dense[wide] = np.arange(int(wide.sum()))
        width = self.blocks * block
        matrix = np.zeros((int(wide.sum()), width), dtype=np.float32)
        many = wide[column]
        matrix[self.dense[column[many]], example[many]] = weight[many]
        self.matrix = np.ascontiguousarray(matrix.reshape(-1, self.blocks, block).transpose(1, 0, 2))  # block, column, example
        self.matrix_most = matrix.reshape(-1, self.blocks, block).max(axis=2)
        example, column, weight = example[~many], column[~many], weight[~many]
        cell = column * self.blocks + example // block
        new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        self.example, self.weight = example.astype(np.int32), weight
        self.post = np.append(new, len(cell)).astype(np.int64)
        self.entry_block = (cell[new] % self.blocks).astype(np.int32)
        self.entry_most = np.maximum.reduceat(weight, new) if len(new) else np.zeros(0, np.float32)
        self.entry = np.searchsorted(cell[new], np.arange(columns + 1) * self.blocks).astype(np.int64)

    def nearest(self, query: np.ndarray, columns: np.ndarray, weights: np.ndarray, queries: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, similarity, example) of each query's k best with similarity over 0, by query and similarity, ties by example.

        query, columns, weights: the vectors of all queries, ascending by query; blocks are read for all queries that need them together.
        """
        weights = weights.astype(np.float32)
        row = self.dense[columns]
        in_matrix = row >= 0
        vectors = np.zeros((queries, self.matrix.shape[1]), dtype=np.float32)
        vectors[query[in_matrix], row[in_matrix]] = weights[in_matrix]
        query, columns, weights = query[~in_matrix], columns[~in_matrix], weights[~in_matrix]
        size = self.entry[columns + 1] - self.entry[columns]
        entries = _ranges(self.entry[columns], size)
        weight, owner = np.repeat(weights, size), np.repeat(query, size)
        cell = owner * self.blocks + self.entry_block[entries]
        bounds = vectors @ self.matrix_most
        bounds += np.bincount(cell, weight * self.entry_most[entries], minlength=queries * self.blocks).reshape(queries, -1)
        order = np.argsort(-bounds, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(self.blocks)[None, :], axis=1)
        width = self.blocks * self.block
        sims = np.zeros((queries, width), dtype=np.float32)
        at, step, floor = 0, 4, np.zeros(queries, dtype=np.float32)
        while at < self.blocks:
            need = (place >= at) & (place < at + step) & (bounds > 0) & (bounds * 1.0001 + 1e-6 >= floor[:, None])
            if not need.any():
                break
            some = np.flatnonzero(need.ravel()[cell])
            own = entries[some]
            size = self.post[own + 1] - self.post[own]
            posts = _ranges(self.post[own], size)
            where = np.repeat(owner[some] * width, size) + self.example[posts]
            sims += np.bincount(where, np.repeat(weight[some], size) * self.weight[posts], minlength=queries * width).reshape(queries, width).astype(np.float32)
            for b in np.flatnonzero(need.any(axis=0)):
                who = np.flatnonzero(need[:, b])
                sims[who, b * self.block : (b + 1) * self.block] += vectors[who] @ self.matrix[b]
            at, step = at + step, 2 * step
            if width > k:
                floor = np.partition(sims, width - k, axis=1)[:, width - k]
        query, example = np.nonzero((sims >= floor[:, None]) & (sims > 0))
        found = sims[query, example]
        order = np.lexsort((example, -found, query))
        query, found, example = query[order], found[order], example[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k  # examples as near as the k-th come by number
        return query[keep], found[keep].astype(np.float64), example[keep]


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least-squares non-decreasing fit: knots and values."""
    order = np.argsort(x, kind="stable")
    stack: list[list[float]] = []  # mean, weight, first x, last x
    for i in order:
        stack.append([float(y[i]), float(w[i]), float(x[i]), float(x[i])])
        while len(stack) > 1 and (stack[-2][0] >= stack[-1][0] or stack[-2][3] == stack[-1][2]):
            b, a = stack.pop(), stack.pop()
            total = a[1] + b[1]
            stack.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2], b[3]])
    return np.array([v for s in stack for v in (s[2], s[3])]), np.array([v for s in stack for v in (s[0], s[0])])


@dataclass
class ToxicityModel:
    none: float = 0.0  # share of label 1 among the sample's rows
    vocabulary: Vocabulary | None = None
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of each column
    index: BlockMaxIndex | None = None
    label: np.ndarray | None = None  # of each example
    stands_for: np.ndarray | None = None  # labelled rows that an example stands for
    example_ids: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def votes(self, query: np.ndarray, columns: np.ndarray, queries: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distance-weighted share of label 1 among each query's nearest (NaN if it has none), and (query, example) of those.

        own: query n is example own + n, which doesn't vote for itself."""
        weight = self.weight[columns]
        norm = np.sqrt(np.bincount(query, weight**2, minlength=queries))
        query, sims, found = self.index.nearest(query, columns, weight / norm[query], queries, NEIGHBOURS + (own is not None))
        if own is not None:
            other = query + own != found
            query, sims, found = query[other], sims[other], found[other]
        near = np.minimum(sims, 1.0)
        close = near**3 / (1.05 - near) * self.stands_for[found]
        total = np.bincount(query, close, minlength=queries)
        up = np.bincount(query, close * self.label[found], minlength=queries)
        return np.where(total > 1e-15, up / np.maximum(total, 1e-300), np.nan), query, found

    def scores(self, part: pa.RecordBatch) -> tuple[np.ndarray, list[list[int]]]:
        """Score and evidence of each text."""
        n = part.num_rows
        score, evidence = np.full(n, self.none), [[] for _ in range(n)]
        if self.index is None:
            return score, evidence
        rows, columns = self.vocabulary.columns(part)
        for a in range(0, n, QUERIES):
            m = min(QUERIES, n - a)
            lo, hi = np.searchsorted(rows, [a, a + m])
            raw, query, found = self.votes(rows[lo:hi] - a, columns[lo:hi], m)
            known = ~np.isnan(raw)
            score[a : a + m][known] = np.interp(raw[known], *self.knots)
            first = np.arange(len(query)) - np.searchsorted(query, query) < 3
            for q, i in zip(query[first].tolist(), self.example_ids[found[first]].tolist(), strict=True):
                evidence[a + q].append(i)
        return score, evidence


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct terms and their frequencies."""
    for batch in batches:
        for part in chunks(batch):
            kinds = list(word_terms(*text_buffers(part.column("text"))))
            rows, hashes = np.concatenate([r for r, _ in kinds]), np.concatenate([h for _, h in kinds])
            order = np.argsort(rows, kind="stable")
            cut = np.searchsorted(rows[order], np.arange(part.num_rows + 1))
            both = [np.unique(hashes[order[a:b]], return_counts=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), pa.array([t.astype("<u8").tobytes() for t, _ in both], pa.binary()),
                 pa.array([c.astype("<u4").tobytes() for _, c in both], pa.binary())],
                names=["id", "label", "terms", "times"])


def _document_frequencies(held):
    """(column, documents) of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        total = np.zeros(known.size, dtype=np.int64)
        for batch in batches:
            for part in chunks(batch):
                total += np.bincount(known.columns(part)[1], minlength=known.size)
        some = np.flatnonzero(total)
        for a in range(0, len(some), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some[a : a + (1 << 16)].astype(np.int32)), pa.array(total[some[a : a + (1 << 16)]])], names=["c", "n"])

    return trimmed(run)


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio statistic of terms in a of n1 and b of n0 rows; 0 where label 1 isn't the likelier."""

    def part(x, n, p):
        q = x / n
        hit = np.where(x > 0, x * np.log(np.maximum(q, 1e-300) / p), 0.0)
        return hit + np.where(x < n, (n - x) * np.log(np.maximum(1 - q, 1e-300) / np.maximum(1 - p, 1e-300)), 0.0)

    p = np.maximum(a + b, 1e-9) / (n1 + n0)
    return np.where(a * n0 > b * n1, 2 * (part(a, n1, p) + part(b, n0, p)), 0.0)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        per_label: int = PER_LABEL, examples: int = EXAMPLES) -> ToxicityModel:
    """Learns from at most per_label rows of each label outside the held-out fold; document frequencies are of all rows of df."""
    spark = df.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(
        (fold("id") != HELD_OUT) & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    drawn, counts = bounded_sample(known, "id", "label", per_label)
    if not drawn:
        return ToxicityModel()
    picked = spark.createDataFrame(drawn, "id long, label int")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = (
        texts.join(F.broadcast(picked), "id")
        .groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .mapInArrow(_frequencies, "id long, label int, terms binary, times binary").toPandas())
    place = {i: n for n, (i, _) in enumerate(drawn)}  # the order of the draw
    rows = rows.assign(place=rows["id"].map(place)).sort_values("place")
    label = rows["label"].to_numpy()
    size = {y: int((label == y).sum()) for y in (0, 1)}
    if not size[0] or not size[1]:
        return ToxicityModel(none=float(bool(size[1])))
    terms = [np.frombuffer(x, "<u8") for x in rows["terms"]]
    times = [np.frombuffer(x, "<u4").astype(np.int64) for x in rows["times"]]

    chosen = np.concatenate([np.flatnonzero(label == y)[:examples] for y in (0, 1)])
    values, where = np.unique(np.concatenate([terms[i] for i in chosen]), return_inverse=True)
    none = counts[1] / (counts[0] + counts[1])
    if not len(values):
        return ToxicityModel(none=none)
    most = np.zeros(len(values), dtype=np.int64)
    np.maximum.at(most, where, np.concatenate([times[i] for i in chosen]))
    vocabulary = Vocabulary(values, most)

    def columns(i: int) -> np.ndarray:
        at, known_terms = vocabulary.find(terms[i])
        held = np.minimum(times[i][at], most[known_terms])
        return np.sort(_ranges(vocabulary.first[known_terms], held))

    with_term = {y: np.zeros(vocabulary.size, dtype=np.int64) for y in (0, 1)}
    for i in range(len(label)):
        with_term[label[i]][columns(i)] += 1
    relevance = np.clip((likelihood_ratio(with_term[1], with_term[0], size[1], size[0]) / SURE) ** 2, FLOOR, 1.0)
    rows = rows[["id", "place"]]
    own = {int(i): columns(int(i)) for i in chosen}
    del terms, times, where
    trim()
    held = spark.sparkContext.broadcast(vocabulary)
    found = texts.mapInArrow(_document_frequencies(held), "c int, n long").groupBy("c").agg(
        F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(vocabulary.size)
    frequency[found["c"].to_numpy()] = found["n"].to_numpy()
    weight = np.log((1 + df.count()) / (1 + frequency)) * relevance
    weight = np.maximum(weight, 1e-6)
    held.destroy()
    del found, frequency, with_term, relevance
    trim()

    # Neighbours in the index share their strongest terms, which keeps block bounds low.
    full = [int(i) for i in chosen if len(own[int(i)])]
    full.sort(key=lambda i: (label[i], int(own[i][np.argmax(weight[own[i]])]), rows["place"].iloc[i]))
    size_of = np.array([len(own[i]) for i in full])
    column = np.concatenate([own[i] for i in full])
    example = np.repeat(np.arange(len(full)), size_of)
    norm = np.sqrt(np.bincount(example, weight[column] ** 2))
    stands = {y: counts[y] / max(1, int((label[chosen] == y).sum())) for y in (0, 1)}
    model = ToxicityModel(none, vocabulary, weight, BlockMaxIndex(example, column, weight[column] / norm[example], vocabulary.size, len(full)),
                          label[full].astype(float), np.array([stands[label[i]] for i in full]), rows["id"].to_numpy()[full])
    raw = []
    for a in range(0, len(full), QUERIES):
        lo, hi = np.searchsorted(example, [a, a + QUERIES])
        raw.append(model.votes(example[lo:hi] - a, column[lo:hi], min(QUERIES, len(full) - a), a)[0])
    raw = np.concatenate(raw)
    model.knots = monotone(np.where(np.isnan(raw), none, raw), model.label, model.stands_for)
    return model


def scored(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted, evidence) per row; evidence: ids of the nearest labelled examples."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in chunks(batch):
                score, evidence = m.scores(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32)),
                     pa.array(evidence, pa.list_(pa.int64()))],
                    names=["id", "score", "predicted", "evidence"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), "id long, score double, predicted int, evidence array<long>").withColumnRenamed("id", id_col)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the labels outside the held-out fold, applied to all documents."""
    docs = documents(spark, sf_dir)
    model = fit(docs, documents(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
