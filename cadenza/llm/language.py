"""Operator 5: language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed byte n-grams (A-Z folded, other ASCII
characters but letters one gap); a linear softmax over that average gives the language.  Both are
trained by stochastic gradient descent in numpy on a bounded sample: PER_LANGUAGE rows of each
language, LEARNED in all; the number of languages isn't bounded.  Scores are softmax probabilities under a temperature fitted on rows kept
apart.  As softmax must choose some language, a second signal tells texts of other languages and
gibberish: the share of a text's three-byte grams that no learned text holds, drawn towards the
usual share in short texts.  A text is rejected if its score is under, or that share over, the
threshold beyond which REJECT_SHARE of the calibration rows are; nothing else bounds the thresholds.  Scores are
calibrated on the rows kept apart, unseen shares on all learned rows, each against the others.

As the score is linear in the average, embeddings times output weights is one table with a
row for each bucket (kept apart if there are more languages than dimensions), and scoring is a gather and a sum for each
text, over the whole text.

Contract of `identified`: null texts and texts without a letter get `und`, score 0 and are
rejected; no labelled row at all: everything is `und`, and only texts without a letter are rejected; equal texts get equal results, so do
repeated rows; rows with null language are never learned from; an empty table gives an empty
result; an id with several texts of one language is learned from one of them (least hash); equally likely languages: the one
that sorts first; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import HELD_OUT, bounded_sample, fold
from .shared import documents
from .textcore import chunks, text_buffers, trimmed

#: Labelled rows that are learned from, at most: of each language, and of all (with very many languages each has fewer).
PER_LANGUAGE = 400
LEARNED = 20_000
BUCKETS = 1 << 15
DIMENSION = 16
GRAMS = (2, 3, 4)
REJECT_SHARE = 0.002
#: Grams with the usual share of unseen ones that are added to each text.
USUAL_GRAMS = 32

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_K = np.array([0, 0, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def gram_buckets(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram size: (bucket of every gram, number of grams of every row)."""
    flat = _FOLD[raw].astype(np.uint32)
    size = np.diff(ends)
    for n in GRAMS:
        m = len(flat) - n + 1
        counts = np.maximum(size - n + 1, 0)
        if m <= 0:
            yield np.zeros(0, np.int64), counts
            continue
        code = flat[:m].copy()
        for j in range(1, n):
            code |= flat[j : j + m] << np.uint32(8 * j)
        bucket = (code * _K[n]) >> np.uint32(32 - 15)
        inside = np.ones(m, dtype=bool)
        for j in range(1, n):  # grams that cross the end of a row
            at = ends[1:-1] - j
            inside[at[(at >= 0) & (at < m)]] = False
        yield bucket[inside].astype(np.int64), counts


def row_sums(table: np.ndarray, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of table rows over the grams, number of grams) of every row."""
    n = len(ends) - 1
    total, count = np.zeros((n, table.shape[1])), np.zeros(n)
    for bucket, sizes in gram_buckets(raw, ends):
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
            total[full] += np.add.reduceat(table[bucket], starts, axis=0)
        count += sizes
    return total, count


def three_grams(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, folded bytes as one number) of every three-byte gram."""
    flat = _FOLD[raw].astype(np.uint32)
    m = max(0, len(flat) - 2)
    code = flat[:m] | flat[1 : m + 1] << np.uint32(8) | flat[2 : m + 2] << np.uint32(16)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    inside = row[:m] == row[2 : m + 2]
    return row[:m][inside], code[inside]


def has_letter(raw: np.ndarray, ends: np.ndarray, texts: pa.Array) -> np.ndarray:
    plain = np.zeros(256, dtype=bool)
    plain[65:91] = plain[97:123] = True
    seen = np.concatenate([[0], np.cumsum(plain[raw])])
    found = seen[ends[1:]] > seen[ends[:-1]]
    for i in np.flatnonzero(~found & (np.diff(ends) > 0)):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return found


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): embeddings times output weights; with `head`, embeddings alone
    bias: np.ndarray
    temperature: float
    threshold: float
    seen: np.ndarray | None = None  # a bit for each three-byte gram
    usual: float = 0.0  # share of unseen grams in a learned text, by the others
    most_unseen: float = 1.0
    head: np.ndarray | None = None  # (DIMENSION, languages) output weights

    def unseen(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Share of unseen grams of each text, beside USUAL_GRAMS usual ones."""
        row, code = three_grams(raw, ends)
        new = (self.seen[code >> np.uint32(3)] >> (code & np.uint32(7)).astype(np.uint8)) & 1 == 0
        n = len(ends) - 1
        return (np.bincount(row[new], minlength=n) + USUAL_GRAMS * self.usual) / (np.bincount(row, minlength=n) + USUAL_GRAMS)

    def rejected(self, score: np.ndarray, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (score < self.threshold) | (self.unseen(raw, ends) > self.most_unseen)

    def scores(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total, count = row_sums(self.table, raw, ends)
        mean = total / np.maximum(count, 1)[:, None]
        z = ((mean if self.head is None else mean @ self.head) + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int,
          epochs: int = 8, least_steps: int = 300, rate: float = 8.0, batch: int = 16, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SGD on (buckets, weights) rows: the embeddings, the output weights and the bias."""
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, DIMENSION)) * 0.1).astype(np.float64)
    out = rng.standard_normal((DIMENSION, n_labels)) * 0.5
    bias = np.zeros(n_labels)
    per_epoch = -(-len(features) // batch)
    epochs = max(epochs, -(-least_steps // per_epoch))  # small samples are gone through more often
    steps, done = epochs * per_epoch, 0
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            step = rate * (1 - done / steps)
            done += 1
            sizes = [len(features[r][0]) for r in rows]
            index = np.concatenate([features[r][0] for r in rows])
            weight = np.concatenate([features[r][1] for r in rows])
            owner = np.repeat(np.arange(len(rows)), sizes)
            mean = np.add.reduceat(emb[index] * weight[:, None], np.concatenate([[0], np.cumsum(sizes)])[:-1], axis=0)
            z = mean @ out + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = z / z.sum(axis=1, keepdims=True)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error /= len(rows)
            back = error @ out.T
            out -= step * (mean.T @ error)
            bias -= 0.1 * step * error.sum(axis=0)
            np.subtract.at(emb, index, step * weight[:, None] * back[owner])
    return emb, out, bias


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's buckets and their shares of its grams (at most BUCKETS entries, whatever its length)."""
    for batch in batches:
        for part in chunks(batch):
            raw, ends = text_buffers(part.column("text"))
            held, share, grams, times = [], [], [], []
            row, code = three_grams(raw, ends)
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            per_gram = [(b, np.concatenate([[0], np.cumsum(c)])) for b, c in gram_buckets(raw, ends)]
            for i in range(part.num_rows):
                own = np.concatenate([b[c[i] : c[i + 1]] for b, c in per_gram])
                values, counts = np.unique(own, return_counts=True)
                held.append(values.astype("<u4").tobytes())
                share.append((counts / max(1, len(own))).astype("<f4").tobytes())
                values, counts = np.unique(code[at[i] : at[i + 1]], return_counts=True)
                grams.append(values.astype("<u4").tobytes())
                times.append(counts.astype("<u4").tobytes())
            columns = [pa.array(x, pa.binary()) for x in (held, share, grams, times)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("lang"), *columns], names=["id", "lang", "buckets", "shares", "grams", "times"])


def seen_grams(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float, float]:
    """(bits of the grams of all texts, usual share unseen, threshold) from each text's (distinct grams, their counts)."""
    once, twice = np.zeros(1 << 24, dtype=bool), np.zeros(1 << 24, dtype=bool)
    for grams, _ in texts:
        twice[grams] |= once[grams]
        once[grams] = True
    new = np.array([times[~twice[grams]].sum() for grams, times in texts])  # grams of no other text
    size = np.array([times.sum() for _, times in texts])
    usual = float(new.sum() / max(1, size.sum()))
    shares = np.sort((new + USUAL_GRAMS * usual) / (size + USUAL_GRAMS))
    return np.packbits(once, bitorder="little"), usual, max(usual, float(shares[len(shares) - 1 - int(len(shares) * REJECT_SHARE)]))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from at most per_language labelled rows of each language outside the held-out fold."""
    labelled = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col(text_col).isNotNull() & (fold("id") != HELD_OUT))
    drawn, counts = bounded_sample(labelled, "id", "lang", per_language, LEARNED)
    languages = sorted(counts)
    if not drawn:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    spark = df.sparkSession
    picked = spark.createDataFrame(drawn, "pick long, of string")
    texts = (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .join(F.broadcast(picked), (F.col("id") == F.col("pick")) & (F.col("lang") == F.col("of")), "left_semi")
        .where("text is not null")
        .groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    )
    rows = texts.mapInArrow(_sparse, "id long, lang string, buckets binary, shares binary, grams binary, times binary").toPandas()
    rows = rows.sort_values(["id", "lang"], kind="stable")
    rows = rows[rows["buckets"].str.len() > 0]
    features = [(np.frombuffer(b, "<u4").astype(np.int64), np.frombuffer(s, "<f4").astype(np.float64))
                for b, s in zip(rows["buckets"], rows["shares"], strict=True)]
    if not features:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    labels = rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    apart = np.arange(len(features)) % 4 == 3 if len(features) >= 8 else np.zeros(len(features), dtype=bool)
    emb, out, bias = train([f for f, x in zip(features, apart, strict=True) if not x], labels[~apart], len(languages))
    check = np.flatnonzero(apart) if apart.any() else np.arange(len(features))
    z = np.array([(emb[features[i][0]] * features[i][1][:, None]).sum(axis=0) for i in check]) @ out + bias
    own = labels[check]

    def likelihood(t: float) -> float:
        e = z / t - (z / t).max(axis=1, keepdims=True)
        return float((e[np.arange(len(own)), own] - np.log(np.exp(e).sum(axis=1))).mean())

    temperature = max(np.geomspace(0.25, 16, 49), key=likelihood)
    p = np.exp(z / temperature - (z / temperature).max(axis=1, keepdims=True))
    top = np.sort((p / p.sum(axis=1, keepdims=True)).max(axis=1))
    threshold = float(top[int(len(top) * REJECT_SHARE)])
    distinct = rows.drop_duplicates(["grams", "times"])  # a copy would hide what is rare
    seen = seen_grams([(np.frombuffer(g, "<u4"), np.frombuffer(t, "<u4").astype(np.int64))
                       for g, t in zip(distinct["grams"], distinct["times"], strict=True)])
    table, head = (emb @ out, None) if len(languages) <= DIMENSION else (emb, out)
    return LanguageModel(languages, table.astype(np.float32), bias, float(temperature), threshold, *seen, head)


def identified(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) per row."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            for part in chunks(batch):
                raw, ends = text_buffers(part.column("text"))
                known = has_letter(raw, ends, part.column("text"))
                best, score, rejected = np.full(len(known), len(m.languages)), np.zeros(len(known)), ~known
                if m.languages:
                    p = m.scores(raw, ends)
                    best, score = np.where(known, p.argmax(axis=1), best), np.where(known, p.max(axis=1), score)
                    rejected |= m.rejected(score, raw, ends)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(names[best], pa.string()), pa.array(score, pa.float64()),
                     pa.array(rejected)],
                    names=["id", "lang_pred", "score", "rejected"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the labelled documents outside the held-out fold, applied to all documents."""
    docs = documents(spark, sf_dir)
    return identified(docs, fit(docs)).select(
        "doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows that aren't rejected, with all their columns; nothing is shuffled."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in chunks(batch, text_col):
                raw, ends = text_buffers(part.column(text_col))
                keep = has_letter(raw, ends, part.column(text_col))
                if m.languages:
                    keep &= ~m.rejected(m.scores(raw, ends).max(axis=1), raw, ends)
                yield part.filter(pa.array(keep))

    return df.mapInArrow(trimmed(run), df.schema)
