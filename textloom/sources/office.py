"""PDF and Word files as pages of text, and such files made of texts; the standard library alone.

A PDF's pages come in the order of its page tree, from plain and compressed streams and object streams; characters by a font's table to
Unicode where it has one. Encrypted files and pictures of text give an error and no pages: nothing is guessed.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
READ = StructType([StructField("kind", StringType()), StructField("pages", ArrayType(StringType())), StructField("created", StringType()), StructField("error", StringType())])

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n")
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
#: Strings, hexadecimal strings, lists, names, numbers and operators of a page's content.
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]*|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word file, one a line, those of tables too."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in body.iter(f"{_WORD}p"):
        out.append("".join((x.text or "") if x.tag == f"{_WORD}t" else {"tab": "\t", "br": "\n", "cr": "\n"}.get(x.tag.removeprefix(_WORD), "") for x in p.iter()))
    return "\n".join(out)


class Pdf:
    """Objects by number, each as its dictionary's text and its decoded stream."""

    def __init__(self, content: bytes):
        if not content.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        if re.search(rb"/Encrypt\b", content):
            raise ValueError("encrypted")
        self.objects: dict[int, tuple[bytes, bytes]] = {}
        at = 0
        while m := _OBJECT.search(content, at):
            number, body, at = int(m[1]), m[2], m.end()
            if s := _STREAM.search(body):
                begin = m.start(2) + s.end()
                length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", body[: s.start()])
                end = begin + int(length[1]) if length else content.find(b"endstream", begin)
                head, raw = body[: s.start()], content[begin:end]
                at = max(at if not length else 0, content.find(b"endobj", end) + 6)
                self.objects[number] = (head, self._decoded(head, raw))
            else:
                self.objects[number] = (body, b"")
        for head, data in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", head):
                first, n = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"First", b"N"))
                told = list(map(int, data[:first].split()))[: 2 * n]
                ends = [*told[3::2], len(data) - first]
                for number, a, b in zip(told[::2], told[1::2], ends):
                    self.objects.setdefault(number, (data[first + a : first + b], b""))

    @staticmethod
    def _decoded(head: bytes, raw: bytes) -> bytes:
        if b"/FlateDecode" in head:
            return zlib.decompressobj().decompress(raw)
        return b"" if b"/Filter" in head else raw

    def refs(self, head: bytes, key: bytes) -> list[int]:
        """Numbers that a key refers to, one or a list."""
        m = re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % key, head)
        return [int(x) for x in _REF.findall(m[1])] if m else []

    def page_numbers(self) -> list[int]:
        kind = lambda n: re.search(rb"/Type\s*/(Pages?)\b", self.objects.get(n, (b"", b""))[0])
        roots = [n for n in self.objects if (m := kind(n)) and m[1] == b"Pages" and not self.refs(self.objects[n][0], b"Parent")]
        out, todo, seen = [], roots[::-1], set()
        while todo:
            n = todo.pop()
            if n in seen or not (m := kind(n)):
                continue
            seen.add(n)
            if m[1] == b"Page":
                out.append(n)
            else:
                todo += self.refs(self.objects[n][0], b"Kids")[::-1]
        return out

    def fonts(self, head: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """A page's fonts by name: bytes of a code, and the table to Unicode. Resources may be the page's or an ancestor's."""
        while True:
            for n in self.refs(head, b"Resources"):
                head += self.objects.get(n, (b"", b""))[0]
            for n in self.refs(head, b"Font"):
                head += b"/Font <<" + self.objects.get(n, (b"", b""))[0] + b">>"
            if b"/Font" in head or not (up := self.refs(head, b"Parent")) or up[0] not in self.objects:
                break
            head = self.objects[up[0]][0]
        out = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", head.partition(b"/Font")[2]):
            font = self.objects.get(int(n), (b"", b""))[0]
            if tables := self.refs(font, b"ToUnicode"):
                out[name] = (2 if re.search(rb"/Type0\b", font) else 1, unicode_table(self.objects.get(tables[0], (b"", b""))[1]))
        return out

    def page(self, number: int) -> str:
        head = self.objects[number][0]
        content = b"\n".join(self.objects.get(n, (b"", b""))[1] for n in self.refs(head, b"Contents"))
        return shown(content, self.fonts(head))


def unicode_table(cmap: bytes) -> dict[int, str]:
    """Codes to characters of a table to Unicode."""
    text, out = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace"), {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[int(code, 16)] = text(to)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            first = text(to)
            for k in range(int(high, 16) - int(low, 16) + 1):
                out[int(low, 16) + k] = first[:-1] + chr(ord(first[-1]) + k)
    return out


def _bytes(token: bytes) -> bytes:
    """What a string token stands for."""
    if token[:1] == b"<":
        h = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.S)


def shown(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    """The text that a page's operators show; moves to another line are line breaks, wide gaps within one are spaces."""
    out, stack, font, listed = [], [], (1, None), None

    def said(token: bytes) -> str:
        raw, (width, table) = _bytes(token), font
        if table is None:
            return raw.decode("cp1252", "replace")
        return "".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for token in _TOKEN.findall(content):
        first = token[:1]
        if first == b"[":
            listed = []
        elif first == b"]":
            stack, listed = [listed or []], None
        elif first in b"(</" or first in b"-+.0123456789":
            (stack if listed is None else listed).append(token)
        else:
            if token == b"Tf" and len(stack) >= 2:
                font = fonts.get(stack[-2][1:], (1, None))
            elif token in (b"Td", b"TD") and len(stack) >= 2 and float(stack[-1]) != 0 or token in (b"T*", b"Tm", b"ET"):
                line()
            elif token in (b"Tj", b"'", b'"') and stack:
                if token != b"Tj":
                    line()
                out.append(said(stack[-1]))
            elif token == b"TJ" and stack and isinstance(stack[-1], list):
                out.append("".join(said(x) if x[:1] in b"(<" else " " if float(x) < -200 else "" for x in stack[-1]))
            stack = []
    return "".join(out).strip("\n")


def read(content: bytes | None) -> dict:
    """kind, pages, created (as the file says it) and error of a file's bytes; a text file is one page."""
    out = {"kind": "text", "pages": None, "created": None, "error": None}
    try:
        if content is None:
            raise ValueError("no content")
        if content[:4] == b"%PDF":
            out["kind"] = "pdf"
            pdf = Pdf(content)
            out["pages"] = [pdf.page(n) for n in pdf.page_numbers()]
            said = re.search(rb"/CreationDate\s*\((D:[^)]*)\)", content)
            out["created"] = said[1].decode("latin-1") if said else None
            if not any(out["pages"]):
                raise ValueError("no text: pages may be pictures")
        elif content[:4] == b"PK\3\4":
            out["kind"] = "docx"
            out["pages"] = [docx_text(content)]
        else:
            out["pages"] = [content.decode("utf-8")]
    except Exception as e:  # a broken file is a row, not a failed job
        out["pages"], out["error"] = None, f"{type(e).__name__}: {e}"[:200]
    return out


@F.pandas_udf(READ)
def pages(contents: pd.Series) -> pd.DataFrame:
    """Files' bytes as kind, pages, created and error."""
    return pd.DataFrame([read(None if c is None else bytes(c)) for c in contents], columns=READ.names, dtype=object)


def marked(parts: Column, mark: str = "[page %d]") -> Column:
    """Pages as one text, each after a line that gives its number."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.format_string(mark, i + 1), F.lit("\n"), p)), "\n")


def make_docx(text: str) -> bytes:
    """A Word file of a text's lines."""
    clean = re.sub("[\0-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]", "", text)
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in clean.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def make_pdf(parts: list[str], created: str | None = None) -> bytes:
    """A PDF with a page for each text, in one font whose codes are the characters that occur."""
    codes = {c: i + 1 for i, c in enumerate(sorted(set("".join(parts)) - {"\n"}))}
    hexed = lambda s: "".join(f"{codes[c]:04x}" for c in s)
    table = "\n".join(f"<{i:04x}> <{c.encode('utf-16-be', 'surrogatepass').hex()}>" for c, i in codes.items())
    stream = lambda head, data: f"<< {head} /Filter /FlateDecode /Length {len(z := zlib.compress(data.encode()))} >>\nstream\n".encode() + z + b"\nendstream"
    kids = " ".join(f"{6 + 2 * i} 0 R" for i in range(len(parts)))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Kids [{kids}] /Count {len(parts)} /Resources << /Font << /F1 3 0 R >> >> >>".encode(),
        b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /BaseFont /Any /ToUnicode 4 0 R >>",
        stream("", f"beginbfchar\n{table}\nendbfchar"),
        f"<< {f'/CreationDate ({created})' if created else ''} >>".encode(),
    ]
    for i, text in enumerate(parts):
        lines = " T*\n".join(f"<{hexed(x)}> Tj" for x in text.split("\n"))
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {7 + 2 * i} 0 R >>".encode(), stream("", f"BT /F1 12 Tf 14 TL 72 720 Td {lines} ET")]
    out = b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (i + 1, x) for i, x in enumerate(objects))
    return out + b"\ntrailer << /Root 1 0 R /Info 5 0 R >>\n%%EOF\n"


@F.pandas_udf(BinaryType())
def pdf_file(parts: pd.Series, created: pd.Series) -> pd.Series:
    return pd.Series([make_pdf(list(p), d) for p, d in zip(parts, created)])


@F.pandas_udf(BinaryType())
def docx_file(texts: pd.Series) -> pd.Series:
    return texts.map(make_docx)
