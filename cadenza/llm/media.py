"""Operator 6: media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a stored
file.  Each hit is only a candidate: a validator for its format follows the structure (chunk
lengths, checksums, field ranges) and says where the file ends, or rejects it.  A valid file at
offset 0 that fills the bytes corrects a wrong declared type; valid files elsewhere are embedded
media and can be carved out.

`pack` stores any bytes as 8-bit PCM in a WAV container, `unpack` gives them back by way of the sniffer.

Contract of `stored_payloads`: null text counts as empty; the payload is the UTF-8 text with bytes
255 up to a positive multiple of UNIT; equal texts give equal values; repeated rows and null
ids give one row each; an empty table gives an empty result; very long texts are stored whole;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, documents
from .textcore import chunks

UNIT = 576
#: Bytes that are read or inflated at once.
PIECE = 1 << 16
RATE = 8000
_FMT = struct.Struct("<4sI4s4sIHHIIHH4sI")

class Marks:
    """Places of the markers that end or confirm a file, found in the same pass as the magic bytes."""

    def __init__(self, places: dict[bytes, list[int]]):
        self.places = places

    def first(self, marker: bytes, at: int, stop: int | None = None) -> int:
        """The marker's first place from `at` on (and before `stop`), or -1."""
        held = self.places.get(marker, [])
        i = bisect_left(held, at)
        return held[i] if i < len(held) and (stop is None or held[i] + len(marker) <= stop) else -1


# ---------------------------------------------------------------- validators: end of the file that starts at `at`, or None


def _riff(b: bytes, at: int, marks: Marks) -> int | None:
    if len(b) < at + 12 or b[at + 8 : at + 12] not in (b"WAVE", b"AVI ", b"WEBP"):
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    pos, seen = at + 12, 0
    while pos + 8 <= end:
        size = int.from_bytes(b[pos + 4 : pos + 8], "little")
        if pos + 8 + size > end:
            return None
        pos += 8 + size + (size & 1)
        seen += 1
    return end if seen and pos in (end, end + 1) else None


def _png(b: bytes, at: int, marks: Marks) -> int | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, kind = int.from_bytes(b[pos : pos + 4], "big"), b[pos + 4 : pos + 8]
        end = pos + 12 + size
        if end > len(b) or (first and (kind != b"IHDR" or size != 13)):
            return None
        if zlib.crc32(b[pos + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return end
        pos, first = end, False
    return None


def _gif(b: bytes, at: int, marks: Marks) -> int | None:
    if len(b) < at + 14:
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while pos < len(b):
        mark = b[pos]
        if mark == 0x3B:
            return pos + 1
        if mark == 0x21:
            pos += 2
        elif mark == 0x2C and pos + 10 <= len(b):
            local = b[pos + 9]
            pos += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def _jpeg(b: bytes, at: int, marks: Marks) -> int | None:
    pos = at + 2
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        if mark == 0xDA:
            end = marks.first(b"\xff\xd9", pos)
            return end + 2 if end >= 0 else None
        if mark < 0xC0 or mark == 0xFF:
            return None
        size = int.from_bytes(b[pos + 2 : pos + 4], "big")
        if size < 2:
            return None
        pos += 2 + size
    return None


def _bmp(b: bytes, at: int, marks: Marks) -> int | None:
    if len(b) < at + 30:
        return None
    size, offset, header = (int.from_bytes(b[at + i : at + i + 4], "little") for i in (2, 10, 14))
    planes, depth = (int.from_bytes(b[at + i : at + i + 2], "little") for i in (26, 28))
    ok = header in (12, 40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return at + size if ok and 14 + header <= offset <= size and at + size <= len(b) else None


def _gzip(b: bytes, at: int, marks: Marks) -> int | None:
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    inflate, pos, rest = zlib.decompressobj(31), at, b""
    try:
        while not inflate.eof:
            if not rest:
                if pos >= len(b):
                    return None
                rest = b[pos : pos + PIECE]
                pos += len(rest)
            inflate.decompress(rest, PIECE)  # at most PIECE bytes of output at once
            rest = inflate.unconsumed_tail
    except zlib.error:
        return None
    return pos - len(inflate.unused_data)


def _pdf(b: bytes, at: int, marks: Marks) -> int | None:
    end = marks.first(b"%%EOF", at)
    return end + 5 if end >= 0 and marks.first(b"startxref", at, end) >= 0 and b[at + 5 : at + 6].isdigit() else None


def _zip(b: bytes, at: int, marks: Marks) -> int | None:
    end = marks.first(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, offset = (int.from_bytes(b[end + i : end + i + 4], "little") for i in (12, 16))
    stop = end + 22 + int.from_bytes(b[end + 20 : end + 22], "little")
    return stop if offset + size == end - at and b[at + offset : at + offset + 4] == b"PK\x01\x02" and stop <= len(b) else None


def _ogg(b: bytes, at: int, marks: Marks) -> int | None:
    pos = at
    while b[pos : pos + 5] == b"OggS\0" and pos + 27 <= len(b):
        n = b[pos + 26]
        pos += 27 + n + sum(b[pos + 27 : pos + 27 + n])
    return pos if at < pos <= len(b) else None


#: type, magic bytes, validator (fixed values of the public formats)
FORMATS: list[tuple[str, bytes, Callable[[bytes, int, Marks], int | None]]] = [
    ("riff", b"RIFF", _riff),
    ("image/png", b"\x89PNG\r\n\x1a\n", _png),
    ("image/gif", b"GIF87a", _gif),
    ("image/gif", b"GIF89a", _gif),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg),
    ("image/bmp", b"BM", _bmp),
    ("application/gzip", b"\x1f\x8b\x08", _gzip),
    ("application/pdf", b"%PDF-", _pdf),
    ("application/zip", b"PK\x03\x04", _zip),
    ("application/ogg", b"OggS", _ogg),
]
#: Markers that validators look for behind the magic bytes.
MARKERS = [b"\xff\xd9", b"%%EOF", b"startxref", b"PK\x05\x06"]
_RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}


class Sniffer:
    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for i, (_, magic, _) in enumerate(FORMATS):
            self.automaton.add_word(magic.decode("latin-1"), i)
        for i, marker in enumerate(MARKERS):
            self.automaton.add_word(marker.decode("latin-1"), -1 - i)
        self.automaton.make_automaton()

    def media(self, raw: bytes) -> list[tuple[int, int, str]]:
        """(start, end, type) of every structurally valid file; one inside an earlier one's container is kept too."""
        found, heads = [], []
        places: dict[bytes, list[int]] = {m: [] for m in MARKERS}
        for last, i in self.automaton.iter(raw.decode("latin-1")):
            if i >= 0:
                heads.append((last - len(FORMATS[i][1]) + 1, i))
            else:
                marker = MARKERS[-1 - i]
                places[marker].append(last - len(marker) + 1)
        marks = Marks(places)
        for at, i in heads:
            kind, _, validate = FORMATS[i]
            end = validate(raw, at, marks)
            if end is not None:
                found.append((at, end, _RIFF_TYPES[raw[at + 8 : at + 12]] if kind == "riff" else kind))
        return sorted(found)

    def sniff(self, raw: bytes, declared: str | None) -> tuple[str | None, list[tuple[int, int, str]]]:
        """(type, embedded media): the type of the file that fills the bytes, else the declared one."""
        found = self.media(raw)
        whole = next((x for x in found if x[0] == 0 and x[1] == len(raw)), None)
        return (whole[2] if whole else declared), [x for x in found if x is not whole]


def carve(raw: bytes, embedded: list[tuple[int, int, str]]) -> list[tuple[str, bytes]]:
    return [(kind, raw[a:b]) for a, b, kind in embedded]


# ---------------------------------------------------------------- payloads as 8-bit samples


def pack(payload: bytes) -> bytes:
    """A mono 8-bit PCM WAV file whose samples are the payload."""
    pad = len(payload) & 1
    head = _FMT.pack(b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def unpack(media: bytes, kind: str | None) -> tuple[bytes, str]:
    """The samples and a description, following the chunks of a WAV file."""
    if kind != "audio/wav":
        raise ValueError("not a WAV file")
    pos, about = 12, ""
    while pos + 8 <= len(media):
        name, size = media[pos : pos + 4], int.from_bytes(media[pos + 4 : pos + 8], "little")
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, pos + 8)
            about = f"bits={bits};channels={channels};rate={rate}"
        elif name == b"data":
            return media[pos + 8 : pos + 8 + size], f"{about};frames={size}"
        pos += 8 + size + (size & 1)
    raise ValueError("no samples")


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            made = [padded(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([n for n, _ in made], pa.int64()),
                 pa.array(["application/octet-stream"] * len(made)), pa.array([pack(p) for _, p in made], pa.binary())],
                names=["id", "n_bytes", "declared", "media"])


_FEATURES = ("id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
             "media_bytes long, media_sha256 string, feature string")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sniffer = Sniffer()
    for batch in batches:
        out = []
        for media, declared in zip(batch.column("media"), batch.column("declared").to_pylist(), strict=True):
            raw = media.as_py()
            kind, embedded = sniffer.sniff(raw, declared)
            payload, about = unpack(raw, kind)
            inner = ",".join(f"{k}@{a}+{b - a}" for a, b, k in embedded) or "none"
            out.append((
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw),
                hashlib.sha256(raw).hexdigest(), f"{kind};{about};declared={declared};embedded={inner}"))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
            names=[x.split()[0] for x in _FEATURES.split(", ")])


def stored_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as media under a wrong declared type, reads it back, sniffs and measures it."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stored = Scratch(df.sparkSession).keep(
        rows.mapInArrow(_store, "id long, n_bytes long, declared string, media binary"), "media")
    return stored.mapInArrow(_features, _FEATURES).withColumnRenamed("id", id_col)


def sniffed(df: DataFrame, media_col: str, declared_col: str) -> DataFrame:
    """Any table with a binary column: adds `sniffed_type`, `type_corrected` and `embedded` (start, end, type).

    Null bytes give the declared type and no embedded media; columns of these names are replaced."""
    df = df.drop("sniffed_type", "type_corrected", "embedded")
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string())]))
        for batch in batches:
            found = [sniffer.sniff(m, d) if m is not None else (d, [])
                     for m, d in zip(batch.column(media_col).to_pylist(), batch.column(declared_col).to_pylist(), strict=True)]
            changed = [k != d for (k, _), d in zip(found, batch.column(declared_col).to_pylist(), strict=True)]
            inner = [[{"start": a, "end": b, "type": k} for a, b, k in e] for _, e in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([k for k, _ in found], pa.string()), pa.array(changed), pa.array(inner, spans)],
                names=[*batch.schema.names, "sniffed_type", "type_corrected", "embedded"])

    ddl = "sniffed_type string, type_corrected boolean, embedded array<struct<start:bigint,end:bigint,type:string>>"
    from pyspark.sql.types import StructType

    return df.mapInArrow(run, StructType([*schema.fields, *StructType.fromDDL(ddl).fields]))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as an 8-bit WAV file, stored, read back and sniffed."""
    return stored_payloads(documents(spark, sf_dir))
