"""The registered queries on the smallest tables: SQL twins, brute force, the pipeline."""

import zlib

import brute
import pytest
from support import DATA, same

from cadenza.llm import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="session")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    same(QUERIES[name](spark, DATA), db, SQL[name])


def test_op2(spark, rows):
    got = QUERIES["op2_substring_dedup"](spark, DATA).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute.substring(rows, 35)


def test_op3(spark, rows):
    from tokenizers import Tokenizer

    from cadenza.llm.tokens import word_bpe

    got = QUERIES["op3_tokens"](spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == brute.tokens(rows, Tokenizer.from_file(word_bpe()))


def test_op5_held_out_accuracy(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_language"](spark, DATA).join(d, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_op6(spark, rows):
    """Payloads padded, stored and measured by hand."""
    import hashlib
    import struct

    got = {r.doc_id: r for r in QUERIES["op6_media"](spark, DATA).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, (len(raw) + 575) // 576 * 576) - len(raw))
        wav = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (
            len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(wav), hashlib.sha256(wav).hexdigest())
        assert r.feature.startswith(f"audio/wav;bits=8;channels=1;rate=8000;frames={len(payload)};")


def test_op7_shape(spark, rows):
    tox = QUERIES["op7_toxicity"](spark, DATA).collect()
    assert len(tox) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in tox)


def test_op10(spark, db):
    """The order of blocks by a simulation, slot by slot, of earliest deadlines first among the released."""
    from fractions import Fraction
    from math import ceil, floor, isqrt

    from cadenza.llm import mixing

    sizes = dict(db.execute("SELECT source, count(*) FROM documents GROUP BY 1").fetchall())
    share = mixing.shares({s: n**0.5 for s, n in sizes.items()}, mixing.PERIOD)
    assert sum(share.values()) == mixing.PERIOD
    total = sum(n**0.5 for n in sizes.values())
    assert all(abs(share[s] - n**0.5 / total * mixing.PERIOD) < 1 for s, n in sizes.items()) and isqrt(4) == 2
    got = QUERIES["op10_mixing"](spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(x[0] for x in db.execute("SELECT doc_id FROM documents").fetchall())
    blocks = {}
    for r in got:
        blocks.setdefault((r.source, r.block), []).append(r)
    last = {s: max(b for x, b in blocks if x == s) for s in sizes}
    for (s, b), held in blocks.items():
        assert sorted(r.place for r in held) == list(range(mixing.BLOCK_DOCS if b < last[s] else sizes[s] - b * mixing.BLOCK_DOCS))
        assert len({(r.slot, r.release, r.deadline) for r in held}) == 1
    at = {(s, b): held[0] for (s, b), held in blocks.items()}
    names = sorted(sizes, key=lambda s: (s is not None, s or ""))
    weight, done = {s: Fraction(share[s], mixing.PERIOD) for s in names}, dict.fromkeys(names, 0)
    for slot in range(max(r.slot for r in got) + 1):
        ready = [(ceil((done[s] + 1) / weight[s]), i, s) for i, s in enumerate(names) if floor(done[s] / weight[s]) <= slot]
        deadline, _, s = min(ready)
        if (s, done[s]) in at:
            r = at[s, done[s]]
            assert (r.slot, r.release, r.deadline) == (slot, floor(done[s] / weight[s]), deadline)
        done[s] += 1


def test_op9(spark, rows):
    from cadenza.llm.licenses import PHRASES

    got = {r.doc_id: r for r in QUERIES["op9_licenses"](spark, DATA).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.phrases(t, PHRASES)


def test_pipeline(spark, db):
    """Each stage against brute force on its predecessor's rows."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from cadenza.llm.shared import Scratch
    from cadenza.llm.tokens import word_bpe

    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "tokens"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    items = db.execute("SELECT item_id, text FROM benchmark").fetchall()
    pairs = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    def step(name, df):
        out = Scratch(spark).keep(stages[name](spark, df, DATA), name)
        assert out.columns == columns or name == "tokens"
        return out

    docs = step("language", docs)
    before = pairs(docs)
    docs = step("near_dedup", docs)
    keep = {r[0] for r in brute.near(before, 5, 80) if r[3]}
    assert sorted(pairs(docs)) == sorted(x for x in before if x[0] in keep)
    before = pairs(docs)
    docs = step("decontaminate", docs)
    bad = {r[0] for r in brute.contaminated(before, items, 10) if r[5]}
    assert bad and sorted(pairs(docs)) == sorted(x for x in before if x[0] not in bad)
    before = pairs(docs)
    docs = step("mix", docs)
    assert sorted(pairs(docs)) == sorted(before)
    at = {r.doc_id: (r.f, r.i) for r in docs.selectExpr("doc_id", "_metadata.file_name f", "_metadata.row_index i").collect()}
    order = sorted(at, key=at.get)
    from cadenza.llm.mixing import mixed

    planned = {r.doc_id: (r.slot, r.place) for r in mixed(docs).collect()}
    assert order == sorted(planned, key=planned.get)
    got = sorted(map(tuple, step("tokens", docs).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    text, tok = dict(before), Tokenizer.from_file(word_bpe())
    want = [brute.tokens([(i, text[i])], tok)[0] for i in order]
    assert [(d, n, c) for _, d, n, c in got] == [(d, n, c) for d, _, n, c in want]


def test_pipeline_judges_rows_not_ids(spark):
    """Null and repeated ids: copies and contaminated rows go, clean rows that share their id stay."""
    import corpus_pipeline
    from cases import prose

    stages, passage = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{DATA}/benchmark.parquet").where("text is not null").first().text
    a, b, c, d = (prose(40 + i, 80) for i in range(4))
    like = spark.read.parquet(f"{DATA}/documents.parquet").schema
    texts = [(None, a), (None, a), (None, b), (5, b), (5, c), (5, c), (6, d), (3, d)]

    def frame(rows):
        return spark.createDataFrame([tuple({"doc_id": i, "text": t, "source": "s"}.get(f.name) for f in like) for i, t in rows], like)

    def pairs(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    assert pairs(stages["near_dedup"](spark, frame(texts), DATA)) == sorted([(None, a), (5, b), (5, c), (3, d)], key=str)
    rows = [(None, passage), (None, a), (5, "lead " + passage), (5, b), (6, passage), (7, c)]
    assert pairs(stages["decontaminate"](spark, frame(rows), DATA)) == sorted([(None, a), (5, b), (7, c)], key=str)
    assert pairs(stages["mix"](spark, frame(texts), DATA)) == sorted(texts, key=str)


def test_pipeline_handles_awkward_rows(docs, nothing, spark, db):
    """Nulls, ties, repeated rows, very long texts and clashing columns: each stage keeps exactly the rows it should."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from cadenza.llm import language
    from cadenza.llm.tokens import word_bpe

    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DATA).count() == 0, name
    items = [x[0] for x in db.execute("SELECT text FROM benchmark WHERE text IS NOT NULL ORDER BY item_id LIMIT 2").fetchall()]
    extra = spark.createDataFrame([(70, items[0]), (None, items[1]), (70, "clean words")], "doc_id long, text string")
    frame = docs.unionByName(docs.limit(3)).unionByName(extra, allowMissingColumns=True)
    frame = spark.createDataFrame(frame.collect(), frame.schema).repartition(3)  # limit() may take other rows each time
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)

    model = language.fit(frame)
    judged = language.identified(frame.select("doc_id", "text"), model).collect()
    kept = stages["language"](spark, frame, DATA)
    assert kept.columns == frame.columns and kept.count() == sum(not r.rejected for r in judged)
    assert {t for _, t in pairs(kept)} == {t for i, t in rows if any(c.isalpha() for c in t or "")} - {
        t for _, t in rows if not language.accepted(spark.createDataFrame([(t,)], "text string"), model).count()}

    numbered = [(n, t) for n, (_, t) in enumerate(rows)]
    groups = {}
    for n, _, component, _ in brute.near(numbered, 5, 80):
        groups.setdefault(component, []).append(n)
    least = [min(rows[n][0] if rows[n][0] is not None else float("inf") for n in g) for g in groups.values()]
    got = pairs(stages["near_dedup"](spark, frame, DATA))
    assert sorted(i if i is not None else float("inf") for i, _ in got) == sorted(least)
    assert all(x in rows for x in got)

    benchmark = db.execute("SELECT item_id, text FROM benchmark").fetchall()
    bad = {n for n, *_, hit in brute.contaminated(numbered, benchmark, 10) if hit}
    assert bad and pairs(stages["decontaminate"](spark, frame, DATA)) == sorted((x for n, x in enumerate(rows) if n not in bad), key=str)

    assert pairs(stages["mix"](spark, frame, DATA)) == sorted(rows, key=str)

    tok = Tokenizer.from_file(word_bpe())
    want = sorted((brute.tokens([(0, t)], tok)[0][2:] for _, t in rows), key=str)
    coded = stages["tokens"](spark, frame, DATA).collect()
    assert sorted(((r.n_tokens, r.ids_crc32) for r in coded), key=str) == want
    at = 0
    for start, n in sorted((r.start, r.n_tokens) for r in coded):
        assert start == at
        at += n
