"""Carving: files with several end marks, side by side, and in time in proportion."""

import gzip
import random
import time
import zlib

from braidflow.llm import media_columns

PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF\n2 0 obj\nendobj\nstartxref\n40\n%%EOF"


def test_a_pdf_goes_on_to_its_last_end_mark():
    assert media_columns.sniff(PDF) == ("application/pdf", [])
    blob = b"x" + PDF + b"junk" + PDF + b" more %%E"
    assert media_columns.sniff(blob) == (None, [(1, len(PDF), "application/pdf"), (5 + len(PDF), len(PDF), "application/pdf")])
    assert media_columns.sniff(b"%PDF-1.4 %%EOF startxref")[0] is None and media_columns.sniff(b"%PDF-x startxref %%EOF")[0] is None


def test_gzip_members_of_any_length_are_carved_whole():
    rng = random.Random(1)
    for n in (0, 10, 5_000, 200_000):
        packed = gzip.compress(rng.randbytes(n))
        for tail in (b"", b"tail", b"t" * 20_000):
            assert media_columns.sniff(b"head" + packed + tail) == (None, [(4, len(packed), "application/gzip")])
        assert media_columns.sniff(b"head" + packed[:-1]) == (None, [])
    bomb = gzip.compress(b"\0" * 50_000_000)
    assert media_columns.sniff(bomb)[0] == "application/gzip"


def test_time_is_in_proportion():
    sick = b"\x89PNG\r\n\x1a\n" + (500_000).to_bytes(4, "big") + b"IHDR"
    for unit in (b"%PDF-1.4 ", b"PK\3\4", b"\x1f\x8b\x08", b"\x1f\x8b\x08\0\0\0\0\0\0\3", sick, b"RIFF\xff\0\0\0WAVE", b"GIF89a", b"OggS\0", b"OggS\0\0" + b"\0" * 21, b"OggS\0\0" + b"\0" * 20 + b"\1\5ogg..", b"BM", b"\xff\xd8\xff", b"fLaC"):
        blob = unit * (1_000_000 // len(unit))
        began = time.monotonic()
        media_columns.sniff(blob)
        assert time.monotonic() - began < 10, unit


def test_features_by_hand():
    assert media_columns.features(b"\0\xff" * 96, None, []) == "type=application/octet-stream;carved=0:;mean=127.5000;dev=127.5000;bits=1.0000;cross=191"
    assert zlib.crc32(media_columns.load(media_columns.store(b"abc"))) == zlib.crc32(b"abc")
