"""Each operator on awkward documents against brute force, and on empty tables."""

import hashlib
import io
import json
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from cases import cases, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from support import DATA

from cadenza.llm import decontaminate, language, licenses, media, mixing, near_dedup, sketch, substring_dedup, textcore, tokens, toxicity, url_filter
from cadenza.llm.components import components


def listed(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


CASES = cases()


# ------------------------------------------------------------------ text core


@given(st.lists(st.text(alphabet=st.sampled_from("aB é\n\t.1\x00ß"), max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_match_regex(texts):
    w = textcore.Words(*textcore.text_buffers(pa.array(texts, pa.string())), textcore.SPACED)
    a = textcore.Words(*textcore.text_buffers(pa.array(texts, pa.string())), textcore.ALNUM_LOWER)
    raw = "".join(texts).encode()
    assert [raw[x:y].decode() for x, y in zip(w.starts, w.stops, strict=True)] == [x for t in texts for x in brute.SPACED.findall(t)]
    assert [raw[x:y].decode().translate(brute.LOWER) for x, y in zip(a.starts, a.stops, strict=True)] == [
        x for t in texts for x in brute.ALNUM.findall(t.translate(brute.LOWER))]
    known = {}
    for h, x, y in zip(a.hash.tolist(), a.starts, a.stops, strict=True):
        assert known.setdefault(raw[x:y].decode().translate(brute.LOWER), h) == h
    assert len(set(known.values())) == len(known)


def test_sketches_estimate_similarity():
    r = np.random.default_rng(0)
    base = r.integers(1, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(base), np.unique(np.concatenate([base[:360], r.integers(1, 2**63, 40, dtype=np.uint64)])), np.unique(base[:3]), np.zeros(0, np.uint64)]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    k = sketch.sketches(np.concatenate(sets), ends, 600)
    assert abs((k[0] == k[1]).mean() - 360 / 440) < 0.06
    assert (k[3] == 0).all() and (k[2] == sketch.sketches(sets[2], np.array([0, 3]), 600)[0]).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(7, 7), (None, 3)]
    found, _ = components(spark, spark.createDataFrame(edges, "a long, b long"), "a", "b")
    got = dict(tuple(r) for r in found.collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
    none, _ = components(spark, spark.createDataFrame([], "a long, b long"), "a", "b")
    assert none.count() == 0


# ------------------------------------------------------------------ 1


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, nothing, k, percent):
    got = listed(near_dedup.near_duplicates(docs, k, percent), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near(CASES, k, percent)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """More members than a block: every pair is still verified."""
    base, r, rows = prose(9, 80).split(), random.Random(3), []
    for i in range(300):
        w = list(base)
        for j in r.sample(range(80), r.randrange(1, 6)):
            w[j] = f"new{i}x{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    got = listed(near_dedup.near_duplicates(df, 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near(rows + rows[:5], 3, 85)


@pytest.mark.parametrize(("block", "pivots", "heavy"), [(4, 2, 1), (8, 3, 3), (128, 8, 4000)])
def test_near_duplicates_chains_pivots_and_hot_keys(spark, monkeypatch, block, pivots, heavy):
    """Chains of drifting copies, where most links are between members that no pivot reaches, with all hot paths."""
    from cadenza.llm import shared

    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    monkeypatch.setattr(shared, "HEAVY", heavy)
    monkeypatch.setattr(shared, "LIGHT", 3 if heavy < 10 else 256)
    rows, r = [], random.Random(7)
    for chain in range(4):
        w = prose(60 + chain, 60).split()
        for i in range(22):
            rows.append((100 * chain + i, " ".join(w)))
            w[r.randrange(60)] = f"drift{chain}x{i}"
    r.shuffle(rows)
    got = listed(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near(rows, 3, 85)


def test_near_duplicates_of_repeated_ids(spark):
    """All texts of an id give it links, also when another id stands for the same texts."""
    a, b, c = prose(71, 90), prose(72, 90), prose(73, 90)
    rows = [(1, a), (2, b), (3, a + " tail"), (3, b + " tail"), (3, None), (4, c), (5, c), (5, ""), (6, c + " end"), (7, None), (7, "one"), (8, "one")]
    got = listed(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near(rows, 3, 85)
    assert {i: x for i, _, x, _ in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7}


# ------------------------------------------------------------------ 2


def test_substring_duplicates(spark, docs, nothing):
    got = listed(substring_dedup.substring_duplicates(docs, 35), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring(CASES, 35)
    assert substring_dedup.substring_duplicates(nothing).count() == 0
    kept = {r.doc_id: r.text for r in substring_dedup.without_duplicates(docs.where("doc_id in (1, 7, 13)"), 35).collect()}
    assert kept[7] == "one" and kept[13] == "lead tail" and kept[1] == ""


def test_substring_periodic_and_repeated_ids(spark):
    rows = [(i, "a b c d e " * n + f"t{i}") for i, n in enumerate(range(6, 14))] + [(50, prose(5, 50)), (50, prose(6, 50)), (51, prose(5, 50)[:250])]
    got = listed(substring_dedup.substring_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 35), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring(rows, 35)


def test_factors_are_greedy():
    """A factor goes on as long as words are equal; windows that stick out of it are looked up; clashes make no factor."""
    words = lambda t: t.encode().split()
    doc = words("a b c d e f g h i j k l m n o p")
    blocks = substring_dedup.Blocks([(7, 0, b"z z a b c d e f"), (9, 2, b"e f g h i j k l q"), (4, 0, b"m n o x")])
    assert blocks.at(9, 2 * substring_dedup.SLICE + 1) == (words("e f g h i j k l q"), 1)
    at = [(i, 7, 2 + i) for i in range(3)] + [(i, 9, 2 * substring_dedup.SLICE + i - 4) for i in range(4, 9)] + [(12, 4, 0)]
    assert substring_dedup.parse(doc, 1, at, blocks, 4) == [(0, 6, 7, 2), (4, 8, 9, 2 * substring_dedup.SLICE)]
    twice = words("u v w u v w u v w")
    assert substring_dedup.parse(twice, 1, [(0, 1, 3), (3, 1, 0), (4, 1, 1)], substring_dedup.Blocks([]), 3) == [(0, 6, 1, 3), (4, 5, 1, 1)]


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=40), max_size=4), st.integers(2, 6))
@settings(max_examples=60, deadline=None)
def test_factors_cover_what_repeats(texts, k):
    """Parsing with first and last places covers exactly the words of repeated windows."""
    from collections import defaultdict

    docs = [[w.encode() for w in t] for t in texts]
    places = defaultdict(list)
    for no, w in enumerate(docs):
        for i in range(len(w) - k + 1):
            places[tuple(w[i : i + k])].append((no, i))
    want = [x[2] for x in sorted(brute.substring([(i, " ".join(t)) for i, t in enumerate(texts)], k))]
    for no, w in enumerate(docs):
        at, slices = [], []
        for i in range(len(w) - k + 1):
            held = places[tuple(w[i : i + k])]
            if len(held) > 1:
                at.append((i, *(held[0] if held[0] != (no, i) else held[-1])))
        for other, u in enumerate(docs):
            n = substring_dedup.SLICE
            slices += [(other, j, b" ".join(u[j * n : (j + 1) * n + k - 1])) for j in range(-(-len(u) // n))]
        factors = substring_dedup.parse(w, no, at, substring_dedup.Blocks(slices), k)
        gone = {x for f, n, _, _ in factors for x in range(f, f + n)}
        assert len(gone) == want[no]
        for f, n, other, word in factors:
            assert w[f : f + n] == docs[other][word : word + n] and (other, word) != (no, f)


# ------------------------------------------------------------------ 3


def test_tokens_round_trip(docs, nothing):
    from tokenizers import Tokenizer

    path = tokens.word_bpe()
    got = listed(tokens.tokenized(docs, path, 1).where("doc_id is not null"), "doc_id", "n_tokens", "ids_crc32")
    want = brute.tokens([c for c in CASES if c[0] is not None], Tokenizer.from_file(path))
    assert got == sorted(((i, n, c) for i, _, n, c in want), key=str)
    rows = sorted(tuple(r) for r in tokens.tokenized(docs.where("doc_id is not null"), path, 1).select("start", "n_tokens", "doc_id").collect())
    assert [r[0] for r in rows] == [s for _, s, _, _ in want] and [r[2] for r in rows] == sorted(r[2] for r in rows)
    assert tokens.tokenized(nothing, path, 1).count() == 0


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = tokens.Encoder(path)
    texts = [t for _, t in CASES][:18]
    assert enc.splitter is None
    assert_encodes(enc, texts)


def assert_encodes(enc, texts):
    ids, size = enc.encode(pa.array(texts, pa.string()), 1)
    want = [[*x, 1] for x in enc.library_ids([t or "" for t in texts])]
    assert ids.tolist() == [i for x in want for i in x] and size.tolist() == [len(x) for x in want]


NASTY = [
    "it's we'll 'SOMETHING don't IT'S", "a b c ÀÉ×÷ñ ß ÿ Ÿ İstanbul", "<|endoftext|> x<|startoftext|>y <b>B</b>", None, "", "  ",
    "123abc45.6,7!!x\x00y \x1cz\x1f q", "é" * 40 + " " + "a" * 23 + " " + "b" * 24 + " " + "C" * 100, "é ´` Ç̧ e\u0301", "ΑΣ ΟΔΟΣ 中文 ½ ² ①",
    "\x85a\x0bb\x0cc\u00a0d\u2003e", "ÃÃ̃ x́y á", "A" * 5000,
]


def test_pieces_are_encoded_like_whole_texts(tmp_path, monkeypatch):
    """Also with a table so small that pieces take each other's places, and from tokenizers that keep case or split otherwise."""
    path = tokens.word_bpe()
    for slots, ids in ((1 << 19, 5_000_000), (8, 40)):
        monkeypatch.setattr(tokens, "SLOTS", slots)
        monkeypatch.setattr(tokens, "REMEMBERED_IDS", ids)
        enc = tokens.Encoder(path)
        assert enc.splitter.runs
        for _ in range(3):
            assert_encodes(enc, NASTY + [t for _, t in CASES])
    monkeypatch.undo()
    spec = json.loads(open(path, encoding="utf-8").read())
    cased = spec | {"normalizer": {"type": "NFC"}}
    odd = spec | {"normalizer": {"type": "Prepend", "prepend": "x"}}
    for name, s, runs in (("cased", cased, False), ("odd", odd, None)):
        (tmp_path / name).write_text(json.dumps(s), encoding="utf-8")
        enc = tokens.Encoder(str(tmp_path / name))
        assert (enc.splitter and enc.splitter.runs) == runs
        assert_encodes(enc, NASTY + [t for _, t in CASES])


@given(st.lists(st.text(alphabet="aZé×Ñ'’<|> .,7½\u00a0\u0301\n", max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_text_is_encoded_like_the_library(texts):
    assert_encodes(tokens.encoder(tokens.word_bpe()), texts)


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_blocks_round_trip(values):
    a = np.array(values, dtype=np.uint32)
    assert (tokens.unpack_block(memoryview(tokens.pack_block(a))) == a).all()


def test_shard_damage_is_seen():
    sink = io.BytesIO()
    w = tokens.ShardWriter(sink)
    w.add([5, None], np.array([3000, 0]), np.arange(3000, dtype="<u4"))
    size = w.close()
    r = tokens.ShardReader(sink, size)
    assert [(i, s, len(x)) for i, s, x in r.documents()] == [(5, 0, 3000), (None, 3000, 0)]
    assert (r.tokens_between(1020, 1030) == np.arange(1020, 1030)).all()
    raw = bytearray(sink.getvalue())
    raw[-60] ^= 1
    with pytest.raises(ValueError, match="damaged|not a token"):
        tokens.ShardReader(io.BytesIO(bytes(raw)), size)


# ------------------------------------------------------------------ 4


def test_contamination(spark, docs, nothing):
    a = CASES[0][1]
    items = [(1, " ".join(a.split()[20:45])), (2, "ONE"), (3, None), (4, "!!"), (10, " ".join(a.split()[20:45])), (None, "y z")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, 10).withColumn("sha", F.sha2(F.array_join("item_ids", ","), 256))
    want = brute.contaminated(CASES, [x for x in items if x[0] is not None], 10)
    assert listed(got, "doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated") == want
    assert decontaminate.contamination(nothing, bench).count() == 0
    clean = decontaminate.contamination(docs, bench.where("false"))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(CASES)


def test_contamination_judges_rows_and_counts_unnamed_items(spark):
    passage = prose(21, 30)
    bench = spark.createDataFrame([(1, "zzz yyy"), (None, passage)], "item_id long, text string")
    rows = [(None, "a " + passage), (None, "clean one"), (7, passage + " b c"), (7, "clean text two"), (8, "zzz yyy " + passage)]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench, 10, unnamed=True)
    assert listed(got, "doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated") == sorted([
        (None, 31, 30, 1, [], True), (None, 2, 0, 0, [], False), (7, 32, 30, 1, [], True), (7, 3, 0, 0, [], False),
        (8, 32, 32, 2, ["1"], True)], key=str)


def test_contamination_plan_has_no_python(docs, spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = decontaminate.contamination(docs, bench)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


# ------------------------------------------------------------------ 5


def test_language_learns_and_rejects(spark, nothing):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(d)
    got = language.identified(d, model).join(d.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "é"), (None, "the and of")], "doc_id long, text string")
    rows = {r.doc_id: r for r in language.identified(odd, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].rejected and rows[i].score == 0 for i in (1, 2, 3))
    assert rows[4].lang_pred != "und" and rows[None].lang_pred == "en"
    assert {r.text for r in language.accepted(odd, model).collect()} >= {"the and of"}
    none = language.fit(nothing)
    assert {r.lang_pred for r in language.identified(odd, none).collect()} == {"und"}
    assert language.identified(nothing, model).count() == 0


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.",
]


@pytest.mark.parametrize("languages", [("en", "de", "es", "fr"), ("en", "de"), ("en",)])
def test_language_rejects_foreign_and_gibberish(spark, languages):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("lang").isin(*languages))
    model = language.fit(d)
    r = random.Random(4)
    gibberish = ["".join(r.choice("bcdfghjklmnpqrstvwxz  ") for _ in range(200)) for _ in range(20)]
    planted = spark.createDataFrame(list(enumerate(FOREIGN + gibberish)), "doc_id long, text string")
    assert language.identified(planted, model).where("not rejected").count() == 0
    assert language.accepted(planted, model).count() == 0
    held = d.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    got = language.identified(held, model)
    assert got.where("rejected").count() <= 0.03 * got.count()


def test_language_never_sees_held_out_rows(spark):
    """Rows of the held-out fold with nonsense labels change nothing."""
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    spoiled = d.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    a, b = language.fit(d), language.fit(spoiled)
    assert a.languages == b.languages and np.array_equal(a.table, b.table)


def test_language_of_many_languages(spark):
    """A thousand languages of four texts each, more than the model has dimensions."""
    def word(i):
        return "".join("bcdfghklmn"[int(c)] + "aeiou"[int(c) % 5] for c in f"{i:03d}")

    rows = [(4 * i + j, f"{word(i)} {word(i)}x{j} {word(i)}", f"l{i:03d}") for i in range(1000) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.fit(df, per_language=2)
    assert len(model.languages) == 1000 and model.head is not None
    got = language.identified(df, model).join(df.select("doc_id", "lang"), "doc_id")
    assert got.count() == 4000 and got.where("lang = lang_pred").count() > 400  # a guess gets 4


def test_language_scores_like_brute_force(spark, docs):
    """Averages, softmax and rejection by plain loops, on awkward and repeated rows; equal texts get equal results."""
    model = language.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    fold = [97 + b - 65 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)]
    k = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}

    def scored(t):
        raw = [fold[b] for b in (t or "").encode()]
        total, count = np.zeros(len(model.languages)), 0
        for n in (2, 3, 4):
            for i in range(len(raw) - n + 1):
                code = sum(raw[i + j] << (8 * j) for j in range(n))
                total += model.table[(code * k[n] & 0xFFFFFFFF) >> 17]
                count += 1
        z = (total / max(count, 1) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        grams = [raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16 for i in range(len(raw) - 2)]
        new = sum(not model.seen[g >> 3] >> (g & 7) & 1 for g in grams)
        unseen = (new + language.USUAL_GRAMS * model.usual) / (len(grams) + language.USUAL_GRAMS)
        if not any(c.isalpha() for c in t or ""):
            return "und", 0.0, True
        return model.languages[int(p.argmax())], float(p.max()), bool(p.max() < model.threshold or unseen > model.most_unseen)

    rows = language.identified(docs.unionByName(docs), model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    want = {t: scored(t) for t in {r.text for r in rows}}
    for r in rows:
        assert (r.lang_pred, r.rejected) == (want[r.text][0], want[r.text][2]) and abs(r.score - want[r.text][1]) < 1e-5


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from cadenza.llm import shared

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(SimpleNamespace(conf=conf, sparkContext=context))


# ------------------------------------------------------------------ 6


def test_media_round_trip(docs, nothing):
    got = {r.doc_id: r for r in media.stored_payloads(docs).collect()}
    for i, t in CASES:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_sha256 == hashlib.sha256(media.pack(payload)).hexdigest()
        assert r.feature.startswith("audio/wav;bits=8;channels=1;")
    assert media.stored_payloads(nothing).count() == 0


def test_sniffing_corrects_and_carves(spark):
    import gzip
    import struct

    def png():
        def chunk(k, d):
            return struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))

        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")

    wav, zipped = media.pack(b"abc"), gzip.compress(b"hello")
    rows = [(1, png(), "image/jpeg"), (2, b"noise" + png() + zipped + b"!", "text/plain"), (3, b"\x89PNG\r\n\x1a\nbroken", "image/png"), (4, None, "x"), (5, b"", None), (6, wav, "audio/wav")]
    df = spark.createDataFrame(rows, "k int, body binary, declared string").withColumn("embedded", F.lit("clash"))
    got = {r.k: r for r in media.sniffed(df, "body", "declared").collect()}
    assert got[1].sniffed_type == "image/png" and got[1].type_corrected
    assert [(e.type) for e in got[2].embedded] == ["image/png", "application/gzip"] and got[2].sniffed_type == "text/plain"
    spans = [(e.start, e.end, e.type) for e in got[2].embedded]
    assert [x for _, x in media.carve(rows[1][1], spans)] == [png(), zipped]
    assert got[3].embedded == [] and got[4].sniffed_type == "x" and got[5].sniffed_type is None and not got[6].type_corrected


def test_media_scans_are_linear():
    """Thousands of heads without an end, and an inflating stream, are read once."""
    import time
    import zlib as z

    s = media.Sniffer()
    for head in (b"%PDF-1", b"PK\x03\x04", b"\xff\xd8\xff\xda"):
        start = time.time()
        assert s.media((head + b"x" * 30) * 40_000) == []
        assert time.time() - start < 5
    packer = z.compressobj(9, z.DEFLATED, 31)
    bomb = packer.compress(b"\0" * (1 << 26)) + packer.flush()
    assert s.media(b"lead" + bomb + b"tail") == [(4, 4 + len(bomb), "application/gzip")]


# ------------------------------------------------------------------ 7


def test_toxicity(spark, nothing):
    d, y = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(d, y)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "clean words here"), (None, "clean words here")], "doc_id long, text string")
    rows = toxicity.scored(odd, model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, None)}) == 1
    assert toxicity.scored(nothing, model).count() == 0
    assert toxicity.fit(d, y.where("false")).none == 0.0


def test_toxicity_held_out_accuracy(spark):
    words = ["calm", "tree", "river", "stone", "cloud", "light", "paper", "green"]
    r = random.Random(1)
    rows = []
    for i in range(800):
        w = [r.choice(words) + r.choice("abcdefgh") for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            for j in r.sample(range(60), 3):
                w[j] = r.choice(["vile", "nasty", "rotten"])
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    got = toxicity.scored(df, model).join(df.select("doc_id", "toxic"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    assert got.count() > 100 and got.where("predicted = toxic").count() == got.count()
    assert all(len(x.evidence) for x in got.where("toxic = 1").collect())


@given(st.lists(st.lists(st.tuples(st.integers(0, 12), st.floats(0.1, 3)), min_size=1, max_size=5), min_size=1, max_size=60), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_block_max_search_is_exact(raw, k):
    def unit(v):
        d = dict(v)
        n = sum(w * w for w in d.values()) ** 0.5
        return [(t, w / n) for t, w in d.items()]

    vectors = [unit(v) for v in raw]
    query = dict(vectors[0])
    flat = [(i, t, w) for i, v in enumerate(vectors) for t, w in dict(v).items()]
    sims = [(round(sum(w * dict(v).get(t, 0) for t, w in query.items()), 9), i) for i, v in enumerate(vectors)]
    want = [s for s, _ in sorted(((s, i) for s, i in sims if s > 0), key=lambda x: (-x[0], x[1]))[:k]]
    for common in (2, 5, 10**9):
        index = toxicity.BlockMaxIndex(*(np.array(x) for x in zip(*flat, strict=True)), 13, len(vectors), block=3, common=common)
        again = [np.array(list(query)) for _ in range(3)]  # three equal queries at once
        who, got, at = index.nearest(np.repeat(np.arange(3), len(query)), np.concatenate(again), np.array(list(query.values()) * 3), 3, k)
        assert (got[who == 0] == got[who == 2]).all() and (at[who == 0] == at[who == 2]).all()
        got, at = got[who == 1], at[who == 1]
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-5)
        assert np.allclose([dict(sims_by(sims))[i] for i in at.tolist()], got, atol=1e-5)


def sims_by(sims):
    return [(i, s) for s, i in sims]


def brute_toxicity(rows, labels):
    """Scores by plain dictionaries; rows: (id, text), labels: (id, label) of rows that are learned from, all of them examples."""
    from collections import Counter

    def vector(t):
        held, out = Counter(), set()
        for w in brute.ALNUM.findall((t or "").translate(brute.LOWER)):
            raw = w.encode()
            for x in [(0, raw), *((n, raw[:n]) for n in toxicity.BEGINNINGS if len(raw) >= n)]:
                held[x] += 1
                out.add((*x, held[x]))
        return out

    vec = {i: vector(t) for i, t in rows}
    known = set().union(*(vec[i] for i, _ in labels))
    y = dict(labels)
    n = {v: sum(x == v for x in y.values()) for v in (0, 1)}
    weight = {}
    for t in known:
        a, b = (sum(t in vec[i] for i in y if y[i] == v) for v in (1, 0))
        g = float(toxicity.likelihood_ratio(np.array([a]), np.array([b]), n[1], n[0])[0])
        df = sum(t in v for v in vec.values())
        weight[t] = max(1e-6, float(np.log((1 + len(rows)) / (1 + df))) * min(1.0, max(toxicity.FLOOR, (g / toxicity.SURE) ** 2)))
    vec = {i: v & known for i, v in vec.items()}
    norm = {i: sum(weight[t] ** 2 for t in v) ** 0.5 for i, v in vec.items()}

    def vote(i, leave=None):
        sims = sorted(((sum(weight[t] ** 2 for t in vec[i] & vec[j]) / (norm[i] * norm[j]), j) for j in y if j != leave and vec[i] & vec[j]), reverse=True)[: toxicity.NEIGHBOURS]
        close = [min(s, 1.0) ** 3 / (1.05 - min(s, 1.0)) for s, _ in sims]
        return sum(c * y[j] for c, (_, j) in zip(close, sims, strict=True)) / sum(close) if sims else None

    full = [i for i in y if vec[i]]
    knots = toxicity.monotone(np.array([vote(i, i) for i in full]), np.array([y[i] for i in full], float), np.ones(len(full)))
    return {i: n[1] / (n[0] + n[1]) if (v := vote(i)) is None else float(np.interp(v, *knots)) for i in vec}


def test_toxicity_like_brute_force(spark):
    """Terms, frequencies, relevance, votes and calibration, on texts of random words with repeats, very long ones and copies."""
    r, rows = random.Random(5), []
    for i in range(160):
        n = r.choice([0, 3, 30, 60, 90]) if i != 7 else 4000
        w = [r.choice(["calm", "river", "stones", "greenery", "paper"]) + r.choice(["", "s", "ing", "x"]) + r.choice("abcdefg") for _ in range(n)]
        if i % 4 == 0 and w:
            w[:: max(1, len(w) // 4)] = [r.choice(["vileness", "vilely", "rottenest"]) for _ in w[:: max(1, len(w) // 4)]]
        rows.append((i, " ".join(w) if n or i % 2 else None))
    rows.append((900, "words that nobody knows 12345"))
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    y = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scored(df, toxicity.fit(df, y)).collect()}
    want = brute_toxicity(rows, [(i, int(i % 4 == 0)) for i in range(160) if fold(i) != 2])
    # Equally near examples beyond the k-th may differ, which moves a vote a little.
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in got) < 0.05
    assert np.mean([abs(got[i] - want[i]) < 1e-3 for i in got]) > 0.95


def test_toxicity_of_awkward_rows(spark, docs, nothing):
    """Nulls, clashing columns, repeated rows and ids, very long texts: one row each, equal texts equal scores."""
    y = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0) for i in range(20)] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    twice = docs.unionByName(docs)
    model = toxicity.fit(twice, y)
    rows = toxicity.scored(twice, model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert toxicity.scored(twice, model).count() == 2 * docs.count()
    by_text = {}
    for x in rows:
        by_text.setdefault(x.text or "", set()).add((x.score, x.predicted))
    assert all(len(v) == 1 for v in by_text.values())
    assert toxicity.fit(nothing, y).index is None


# ------------------------------------------------------------------ 8


@given(st.lists(st.text(alphabet="ab/.*?", min_size=1, max_size=12), min_size=1, max_size=40), st.lists(st.text(alphabet="ab/.", max_size=14), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_automaton_matches_regex(globs, strings):
    import re

    def pattern(g):
        out, i = "", 0
        while i < len(g):
            if g[i] == "*":
                double = g[i : i + 2] == "**"
                out += ".*" if double else "[^/]*"
                i += 1 + double
                continue
            out += "[^/]" if g[i] == "?" else re.escape(g[i])
            i += 1
        return re.compile(out, re.S)

    got = url_filter.WildcardAutomaton(globs).run([s.encode() for s in strings])
    want = [[bool(pattern(g).fullmatch(s)) for g in globs] for s in strings]
    assert got.tolist() == want


def test_urls(spark):
    rows = [(1, None, 0), (2, "no scheme", 0), (3, "HTTP://WWW.Example.com/en/X?q#f", 0), (4, "http://a.net/es/" + "x" * 100_000, 0), (4, "http://net/fr/", 0), (5, "x://?", 0), (None, "http://com/", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, host int")
    got = [tuple(r)[:2] + tuple(r)[3:] for r in url_filter.judged(df, url_filter.RULES, url_filter.OWN, "block").collect()]
    assert (3, "www.example.com", "www.example.com/en/", "allow") in got and (1, "", None, "block") in got and (5, "", None, "block") in got
    assert (4, "a.net", "net/es/", "block") in got and (4, "net", "net/fr/", "block") in got and (None, "com", "com/", "allow") in got
    assert url_filter.judged(df.where("false"), url_filter.RULES).count() == 0


# ------------------------------------------------------------------ 9


def test_licenses(spark, docs, nothing):
    extra = [(100, "Foo\nReleased under the MIT License.\nand MIT license"), (101, "Licensed under CC BY-NC 4.0."), (102, licenses.TEMPLATES[1][1].replace("free of charge", "free")),
             (103, "apache license gpl general public license " * 3), (104, "licence of the mit")]
    df = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, "en") for i, t in extra], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in licenses.scanned(df).collect()}
    for i, t in CASES + extra:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.phrases(t, licenses.PHRASES)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[101].labels == "cc-by-nc" and got[102].labels == "mit" and got[104].labels == "" and got[0].labels == ""
    assert licenses.scanned(nothing).count() == 0


def test_licenses_chain_across_changes(spark):
    mit = licenses.TEMPLATES[1][1].split()
    half = len(mit) // 2
    line = "this line was put in by hand".split()
    texts = [
        " ".join(["Copyright of somebody.", *mit[:half], "altered", *mit[half + 1 :], "and more"]),
        " ".join([*mit[:half], *line, *mit[half:]]),
        " ".join([*mit[:16], "altered", *mit[17:33], "altered", *mit[34:]]),
        " ".join([*mit[:half], *(["far"] * 200), *mit[half:]]),  # too far apart
        " ".join([*mit[half:], "altered", *mit[:half]]),  # the wrong order
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(df).collect()}
    assert [got[i].labels for i in range(5)] == ["mit", "mit", "mit", "", ""]
    n = len(licenses.words_of(" ".join(mit)))
    assert (got[0].score, got[1].score) == ((n - 1) / n, n / (n + len(line)))
    best = max(got[0].spans, key=lambda s: s.cover)
    assert (best.first, best.last) == (3, 2 + n)


@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.sampled_from("abcx"), max_size=25))
@settings(max_examples=80, deadline=None)
def test_matching_statistics(templates, text):
    auto = licenses.LicenseAutomaton([("l", " ".join(t)) for t in templates], [])
    ids = [auto.ids.get(w.encode(), -1) for w in text]
    known = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    want = [max([n for n in range(e + 2) if n == 0 or tuple(text[e + 1 - n : e + 1]) in known]) for e in range(len(text))]
    assert [n for _, n in auto.stream(ids)] == want


# ------------------------------------------------------------------ 10


@given(st.lists(st.integers(1, 50), min_size=1, max_size=8))
@settings(max_examples=40, deadline=None)
def test_schedule_is_fair(weights):
    share = mixing.shares({f"s{i}": float(w) for i, w in enumerate(weights)}, 200)
    assert sum(share.values()) == 200
    done = dict.fromkeys(share, 0)
    for t, (s, j, release, deadline, slot) in enumerate(mixing.period_schedule(share)):
        assert slot == t and release <= slot < deadline and j == done[s] + 1
        done[s] += 1
        assert all(abs(done[x] - share[x] * (t + 1) / 200) < 1 for x in share)


def test_mixing(spark, docs, nothing):
    got = mixing.mixed(docs.unionByName(docs.limit(2)), {"s0": 3.0, "s1": 1.0}, period=40, block=2)
    rows = got.collect()
    assert len(rows) == len(CASES) + 2 and len({(r.slot, r.place) for r in rows}) == len(rows)
    assert all(r.release <= r.slot < r.deadline and 0 <= r.place < 2 for r in rows)
    for s in {r.source for r in rows}:
        own = sorted((r.slot, r.place) for r in rows if r.source == s)
        assert sorted((r.block, r.place) for r in rows if r.source == s) == [(i // 2, i % 2) for i in range(len(own))]
    assert mixing.mixed(nothing).count() == 0


def test_mixing_of_many_sources(spark, monkeypatch):
    """More sources than a fixed limit of 2000, one of them large; broadcast or written, the schedule is the same."""
    rows = [(i, f"site{i % 6000}" if i % 2 else "large") for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mixed(df).collect()
    assert sorted(r.doc_id for r in got) == list(range(12_000)) and len({(r.slot, r.place) for r in got}) == 12_000
    assert all(r.release <= r.slot < r.deadline for r in got)
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", 10)
    monkeypatch.setattr(mixing, "SLOTS_A_SOURCE", 9)
    again = mixing.mixed(df).collect()
    assert sorted(r.doc_id for r in again) == list(range(12_000)) and all(r.release <= r.slot < r.deadline for r in again)
    share = mixing.shares({**{f"s{i}": 1.0 for i in range(2500)}, "large": 1e6}, 12_500)
    assert sum(share.values()) == 12_500 and min(share.values()) == 1 and share["large"] == 10_000


def test_mixing_matches_a_plain_simulation(spark):
    rows = [(i, f"s{i % 7 if i % 3 else 0}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mixed(df, {"s0": 1.0, "s1": 2.0}, other=0.5, period=100, block=4).collect()
    order = {r.doc_id: (r.slot, r.place) for r in got}
    hashes = {r.doc_id: r.h for r in df.withColumn("h", F.xxhash64(F.lit("mix"), "doc_id")).collect()}
    share = mixing.shares({**{f"s{i}": 0.5 for i in range(7)}, "s0": 1.0, "s1": 2.0}, 100)
    pattern = mixing.period_schedule(share)
    queue = {s: sorted((i for i, x in rows if x == s), key=lambda i: (hashes[i], i)) for s in share}
    want, t = {}, 0
    while any(queue.values()):
        s = pattern[t % 100][0]
        for place in range(min(4, len(queue[s]))):
            want[queue[s].pop(0)] = (t, place)
        t += 1
    assert order == want
