"""PDF and Word files made and read."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from textloom.sources import office
from textloom.sources.readers import binary

TEXTS = ["plain text (with) \\ marks", "Ünï çödé 日本 🙂\nsecond line\n\nfourth", "x" * 5000, "endobj stream 1 0 obj <</Type /Page>>"]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trips(text):
    assert office.read(office.make_docx(text)) == {"kind": "docx", "pages": [text], "created": None, "error": None}
    flat = [text.replace("\n\n", "\n"), "two"]  # an empty line shows nothing
    assert office.read(office.make_pdf(flat, "D:20240102")) == {"kind": "pdf", "pages": flat, "created": "D:20240102", "error": None}


def test_foreign_files():
    """Strings with escapes, lists with gaps, simple fonts, object streams, pages out of order, lengths by reference."""
    one = b"BT /F1 9 Tf (Hello \\(you\\)\\041) Tj 0 -12 Td [(Wo) -20 (rld) -400 (caf\\351)] TJ ET"
    two = zlib.compress(b"BT (second) Tj T* <7061676520> Tj (three) ' ET")
    inner = b"5 0 6 41 << /Type /Page /Parent 2 0 R /Contents 8 0 R >> << /Type /Page /Parent 2 0 R /Contents [7 0 R] >>"
    first = inner.index(b"<<")
    inner = b"5 0 6 %d " % (inner.index(b"<<", first + 3) - first) + inner[first:]
    first = inner.index(b"<<")
    parts = [
        b"2 0 obj << /Type /Pages /Kids [6 0 R 5 0 R] /Count 2 >> endobj", b"7 0 obj << /Length %d >>\nstream\n%s\nendstream endobj" % (len(one), one),
        b"8 0 obj << /Filter /FlateDecode /Length 9 0 R >>\nstream\r\n" + two + b"\nendstream endobj", b"9 0 obj %d endobj" % len(two),
        b"10 0 obj << /Type /ObjStm /N 2 /First %d /Length %d >>\nstream\n%s\nendstream endobj" % (first, len(inner), inner),
    ]
    assert office.read(b"%PDF-1.7\n" + b"\n".join(parts))["pages"] == ["Hello (you)!\nWorld café", "second\npage \nthree"]


def test_broken_files_are_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(office.make_pdf(["one", "two"]))
    (tmp_path / "b.docx").write_bytes(office.make_docx("three\nfour"))
    (tmp_path / "c.txt").write_bytes("fünf".encode())
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 nothing here")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4 trailer << /Encrypt 3 0 R >>")
    (tmp_path / "f.docx").write_bytes(b"PK\3\4 not a zip")
    (tmp_path / "g.bin").write_bytes(b"\xff\xfe\xff")
    rows = binary(spark, str(tmp_path)).select(F.regexp_extract("path", "([a-z])[.][a-z]+$", 1).alias("k"), office.pages("content").alias("x")).select("k", "x.*", office.marked(F.col("x.pages")).alias("m")).collect()
    got = {r["k"]: r for r in rows}
    assert got["a"]["pages"] == ["one", "two"] and got["a"]["m"] == "[page 1]\none\n[page 2]\ntwo" and got["b"]["pages"] == ["three\nfour"] and got["c"]["pages"] == ["fünf"]
    assert all(got[k]["pages"] is None and got[k]["error"] for k in "defg") and "ncrypted" in got["e"]["error"]
    assert spark.createDataFrame([(None,)], "c binary").select(office.pages("c")["error"]).first()[0]
