"""Media columns: signature sniffing, type correction and carving.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a blob;
the format's validator then walks its structure and gives its length, or rejects the hit.
A valid hit at the start gives the blob's true type, whatever was declared; valid hits
further on are embedded media, and are carved if no earlier one holds them.

``store`` and ``load`` keep any payload losslessly as unsigned 8-bit mono PCM in a RIFF
file, of which ``load`` reads the samples back through the validator's walk.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNIT = 192
SAMPLE_RATE = 8000
UNTYPED = "application/octet-stream"

# ---------------------------------------------------------------- validators
# Each takes (blob, start, marks) and returns the length of a whole file there, or None.


class Marks:
    """Where byte strings stand in a blob. What one validator has found the next ones, whose
    files start further on, don't look for again."""

    def __init__(self, blob: bytes) -> None:
        self.blob = blob
        self.found: dict[bytes, tuple[int, int]] = {}
        self.streams: dict[int, int | None] = {}
        self.endless: set[int] = set()  # Ogg pages whose run has no last page

    def next(self, mark: bytes, at: int) -> int:
        """The first place from ``at`` on, -1 if there is none."""
        since, place = self.found.get(mark, (0, -2))
        if place == -2 or at < since or -1 < place < at:
            since, place = self.found[mark] = at, self.blob.find(mark, at)
        return place

    def deflated(self, at: int) -> int | None:
        """The end of a deflated stream with its checksum and length; None if it isn't whole."""
        if at not in self.streams:
            self.streams[at] = self._deflated(at)
        return self.streams[at]

    def _deflated(self, at: int) -> int | None:
        b, unpack, check, size = self.blob, zlib.decompressobj(-15), 0, 0
        try:
            for place in range(at, len(b), 1 << 14):
                rest = b[place : place + (1 << 14)]
                while rest and not unpack.eof:
                    out = unpack.decompress(rest, 1 << 20)
                    check, size = zlib.crc32(out, check), size + len(out)
                    rest = unpack.unconsumed_tail
                if unpack.eof:
                    stop = min(place + (1 << 14), len(b)) - len(unpack.unused_data)
                    return stop + 8 if b[stop : stop + 8] == struct.pack("<II", check, size % (1 << 32)) else None
        except zlib.error:
            pass
        return None


def _riff(b: bytes, at: int, marks: Marks) -> int | None:
    if len(b) < at + 12:
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    place, kinds = at + 12, []
    while place + 8 <= end:
        kinds.append(b[place : place + 4])
        size = int.from_bytes(b[place + 4 : place + 8], "little")
        place += 8 + size + size % 2
    if place not in (end, end + 1) or not kinds or b[at + 8 : at + 12] == b"WAVE" and not {b"fmt ", b"data"} <= set(kinds):
        return None
    return end - at


def _png(b: bytes, at: int, marks: Marks) -> int | None:
    place = at + 8
    while place + 12 <= len(b):
        size = int.from_bytes(b[place : place + 4], "big")
        kind, stop = b[place + 4 : place + 8], place + 12 + size
        if stop > len(b) or (place == at + 8) != (kind == b"IHDR") or kind == b"IHDR" and size != 13 or zlib.crc32(b[place + 4 : stop - 4]) != int.from_bytes(b[stop - 4 : stop], "big"):
            return None
        if kind == b"IEND":
            return stop - at
        place = stop
    return None


def _gif(b: bytes, at: int, marks: Marks) -> int | None:
    if b[at : at + 6] not in (b"GIF87a", b"GIF89a") or len(b) < at + 13:
        return None
    flags = b[at + 10]
    place = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while place < len(b):
        if b[place] == 0x3B:
            return place + 1 - at
        if b[place] == 0x21:
            place = blocks(place + 2)
        elif b[place] == 0x2C and place + 10 <= len(b):
            own = b[place + 9]
            place = blocks(place + 11 + (3 << (own & 7) + 1 if own & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int, marks: Marks) -> int | None:
    place = at + 2
    while place + 4 <= len(b) and b[place] == 0xFF:
        kind, size = b[place + 1], int.from_bytes(b[place + 2 : place + 4], "big")
        if size < 2 or place + 2 + size > len(b):
            return None
        place += 2 + size
        if kind == 0xDA:  # entropy-coded data up to the next marker that is no stuffing or restart
            while (place := b.find(b"\xff", place)) >= 0 and place + 1 < len(b):
                mark = b[place + 1]
                if mark == 0xD9:
                    return place + 2 - at
                if mark and not 0xD0 <= mark <= 0xD7:
                    break
                place += 2
            else:
                return None
    return None


def _bmp(b: bytes, at: int, marks: Marks) -> int | None:
    if len(b) < at + 26:
        return None
    size, zero, data, head = struct.unpack_from("<IIII", b, at + 2)
    return size if zero == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= data <= size <= len(b) - at else None


def _gzip(b: bytes, at: int, marks: Marks) -> int | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    flags, place = b[at + 3], at + 10
    if flags & 4:
        place += 2 + int.from_bytes(b[place : place + 2], "little")
    for text in (8, 16):  # a name and a comment, each up to a zero byte
        if flags & text:
            place = marks.next(b"\0", place) + 1
            if not place:
                return None
    stop = marks.deflated(place + (2 if flags & 2 else 0))
    return stop - at if stop else None


def _zip(b: bytes, at: int, marks: Marks) -> int | None:
    end = marks.next(b"PK\5\6", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, offset, comment = struct.unpack_from("<IIH", b, end + 12)
    stop = end + 22 + comment
    return stop - at if at + offset + size == end and stop <= len(b) and b[at + offset : at + offset + 4] in (b"PK\1\2", b"PK\5\6") else None


def _pdf(b: bytes, at: int, marks: Marks) -> int | None:
    """Up to the last end mark before the next file's header: a linearised or updated file
    has several."""
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return None
    header = marks.next(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, header if header >= 0 else len(b))
    start = marks.next(b"startxref", at)
    return end + 5 - at if 0 <= start < end else None


def _ogg(b: bytes, at: int, marks: Marks) -> int | None:
    place, last, pages = at, False, []
    while not last and place not in marks.endless and place + 27 <= len(b) and b[place : place + 5] == b"OggS\0":
        pages.append(place)
        n = b[place + 26]
        last = bool(b[place + 5] & 4)
        place += 27 + n + sum(b[place + 27 : place + 27 + n])
    if last and place <= len(b):
        return place - at
    marks.endless.update(pages)  # a run is the same from each of its pages on
    return None


def _flac(b: bytes, at: int, marks: Marks) -> int | None:
    place = at + 4
    if len(b) < at + 42 or b[place] & 0x7F:
        return None
    while place + 4 <= len(b):
        final, size = b[place] & 0x80, int.from_bytes(b[place + 1 : place + 4], "big")
        place += 4 + size
        if final:  # frames have no total length; they go on to the end of the blob
            return len(b) - at if place + 2 <= len(b) and b[place] == 0xFF and b[place + 1] & 0xFE == 0xF8 else None
    return None


# Magic bytes of public formats, their types and the validator of each.
SIGNATURES: dict[bytes, tuple[str, Callable[[bytes, int, Marks], int | None]]] = {
    b"RIFF": ("riff", _riff),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF8": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"BM": ("image/bmp", _bmp),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
    b"PK\x03\x04": ("application/zip", _zip),
    b"%PDF-": ("application/pdf", _pdf),
    b"OggS": ("audio/ogg", _ogg),
    b"fLaC": ("audio/flac", _flac),
}
RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}

_automata: list = []


def automaton():
    """Of the magic bytes, as Latin-1 strings; one per Python process."""
    if not _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic in SIGNATURES:
            a.add_word(magic.decode("latin-1"), magic)
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def media_at(blob: bytes, magic: bytes, at: int, marks: Marks | None = None) -> tuple[int, int, str] | None:
    """(start, length, type) of the valid file whose magic stands at ``at``."""
    kind, validate = SIGNATURES[magic]
    length = validate(blob, at, marks or Marks(blob))
    if length is None:
        return None
    return at, length, RIFF_TYPES[blob[at + 8 : at + 12]] if kind == "riff" else kind


def sniff(blob: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The blob's true type (None: no valid file at its start) and what it embeds.

    Embedded media don't overlap: the earlier, and of one start the first found, wins.
    """
    true, carved, free, marks = None, [], 1, Marks(blob)
    for last, magic in automaton().iter(blob.decode("latin-1")):
        at = last + 1 - len(magic)
        if at and at < free:
            continue
        if found := media_at(blob, magic, at, marks):
            if at == 0:
                true = true or found[2]
            else:
                carved.append(found)
                free = at + found[1]
    return true, carved


def corrected(declared: str | None, true: str | None) -> str:
    """The type to go by: what the bytes show, else what was declared."""
    return true or declared or UNTYPED


# ---------------------------------------------------------------- store and load


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


def store(payload: bytes) -> bytes:
    """A RIFF/WAVE file of the payload as unsigned 8-bit mono samples."""
    odd = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(odd), b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", len(payload))
    return head + payload + odd


def load(blob: bytes) -> bytes:
    """The samples of a file by ``store``; ValueError if it isn't a whole WAVE file."""
    if blob[:4] != b"RIFF" or _riff(blob, 0, Marks(blob)) is None or blob[8:12] != b"WAVE":
        raise ValueError("not a whole WAVE file")
    at = 12
    while blob[at : at + 4] != b"data":
        at += 8 + (size := int.from_bytes(blob[at + 4 : at + 8], "little")) + size % 2
    return blob[at + 8 : at + 8 + int.from_bytes(blob[at + 4 : at + 8], "little")]


def features(samples: bytes, true: str | None, carved: list[tuple[int, int, str]]) -> str:
    """Type, count and types of carved media, mean, deviation, entropy and zero crossings."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    level = np.arange(256)
    mean = float((n * level).sum() / len(x))
    deviation = float(np.sqrt((n * (level - mean) ** 2).sum() / len(x)))
    high = x >= 128
    crossings = int((high[1:] != high[:-1]).sum())
    return f"type={true or UNTYPED};carved={len(carved)}:{'+'.join(sorted({k for _, _, k in carved}))};mean={mean:.4f};dev={deviation:.4f};bits={float(-(p * np.log2(p)).sum()):.4f};cross={crossings}"


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the stored form) of each whole text; null as empty."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                raw = common.utf8_texts(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array([store(padded(t)) for t in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def inspect(stored: DataFrame) -> DataFrame:
    """Sniff, read back and describe each stored blob."""
    common.ship(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for cell in batch.column("media"):
                blob = cell.as_py()
                payload = load(blob)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-16:]))
                out["media_bytes"].append(len(blob))
                out["media_sha256"].append(hashlib.sha256(blob).hexdigest())
                out["feature"].append(features(payload, *sniff(blob)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v) for v in out.values())], ["doc_id", "n_bytes", *out])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(run, schema)


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text, write the media, read them back and describe them.

    Null text: as empty, that is 192 spaces. Repeated rows stay apart; equal texts give
    equal values. An empty table gives no rows; other columns are ignored.
    """
    return inspect(common.written(store_texts(docs), "media"))


def describe_blobs(blobs: DataFrame, blob: str = "blob", declared: str | None = None) -> DataFrame:
    """Any blob column: adds true_type, carved (start, length, type) and the type to go by.

    A null blob has no type and embeds nothing. Rows stay one by one; a column of a new
    column's name is replaced; an empty table gives no rows.
    """
    common.ship(blobs.sparkSession)
    blobs = blobs.drop(*(c for c in blobs.columns if c.lower() in ("true_type", "fixed_type", "carved") and c != blob))
    keep = blobs.columns
    part = T.StructType().add("start", "long").add("length", "long").add("type", "string")
    schema = T.StructType([*blobs.schema, T.StructField("true_type", T.StringType()), T.StructField("fixed_type", T.StringType()), T.StructField("carved", T.ArrayType(part))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            found = [sniff(x or b"") for x in batch.column(blob).to_pylist()]
            said = batch.column(declared).to_pylist() if declared else [None] * len(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t for t, _ in found], pa.string()), pa.array([corrected(d, t) for d, (t, _) in zip(said, found)]), pa.array([[dict(zip(("start", "length", "type"), c)) for c in cs] for _, cs in found], kind)], [*keep, "true_type", "fixed_type", "carved"])

    return blobs.mapInArrow(run, schema)
