"""Document formats over ``binaryFile`` rows.

Kind detection is Column expressions.  Parsing containers has no built-in:
``extracting`` and ``emitting`` make Arrow UDFs around small parsers, the
``ADAPTERS`` by kind, to which a caller may add others; detection between them
stays native.  Every adapter gives one text with separators and a list of
segments (start, end, locator), and puts a changed text back piece by piece; a
changed number of pieces is an error.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .. import fixed

_SEGMENT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("locator", T.StringType())])
EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("segments", T.ArrayType(_SEGMENT)), T.StructField("error", T.StringType())])
EMITTED = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])


def read_documents(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """Files below a folder: path, content, kind; the extension decides, else the bytes."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    if extensions:
        df = df.where(ext.isin(*[e.lower().lstrip(".") for e in extensions]))
    return df.withColumn("kind", F.coalesce(kind_of_extension(ext), sniff(F.col("content"))))


def kind_of_extension(ext: Column) -> Column:
    out = F.lit(None).cast("string")
    for e, k in fixed.SEGMENT_EXTENSIONS.items():
        out = F.when(F.lower(ext) == e, k).otherwise(out)
    return out


def sniff(content: Column) -> Column:
    """The kind that a document's first bytes show; plain text otherwise."""
    latin = lambda n: F.decode(F.substr(content, F.lit(1), F.lit(n)), "ISO-8859-1")
    window, head = latin(4096), F.lower(latin(64))
    return (
        F.when(window.startswith("%PDF-"), "PDF")
        .when(window.startswith("PK\x03\x04") & window.contains("word/"), "DOCX")
        .when(window.startswith("PK\x03\x04") & window.contains("xl/"), "XLSX")
        .when(head.contains("<!doctype html") | head.contains("<html"), "HTML")
        .when(F.decode(content, "ISO-8859-1").rlike(r"\A[ \t\n\f\r]*[{\[]"), "JSON")
        .when(content.isNotNull(), "TXT")
    )


def output_extension(kind: Column) -> Column:
    return F.when(kind == "PDF", "txt").otherwise(F.lower(kind))


class DocumentError(ValueError):
    """A document that cannot be read or put back."""


# A template is what stays as it is; leaves are (locator, text) pieces that may change.

_HTML = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?i:!doctype).*?(?:>|\Z)"""
    r"""|<(?i:(script|style))(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z)(?:.*?</(?i:\1)[^>]*(?:>|\Z)|.*\Z)"""
    r"""|<(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z)""",
    re.S,
)


def html_pieces(source: str) -> list[tuple[int, int]]:
    """Ranges of the text between tags, comments, doctype, CDATA, scripts and styles."""
    out, at = [], 0
    for m in _HTML.finditer(source):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(source):
        out.append((at, len(source)))
    return out


def xml_pieces(source: str, tag: str) -> list[tuple[int, int]]:
    """Ranges of the bodies of all elements of this name that have one."""
    return [m.span(1) for m in re.finditer(rf"<{re.escape(tag)}(?:[ /][^>]*)?(?<!/)>(.*?)</{re.escape(tag)}>", source, re.S)]


_ENTITY = re.compile(r"&(?:(amp|lt|gt|quot|apos)|#[xX]([0-9A-Fa-f]+)|#([0-9]+));")


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}[m[1]]
        n = int(m[2], 16) if m[2] else int(m[3])
        return chr(n) if n < 0x110000 else m[0]

    return _ENTITY.sub(one, s)


def escape(s: str) -> str:
    return html.escape(s, quote=True).replace("&#x27;", "&apos;")


def json_leaves(value, pointer: str = "") -> list[tuple[str, str]]:
    """(pointer, text) of every string of a JSON value, by sorted keys."""
    if isinstance(value, str):
        return [(pointer, value)]
    if isinstance(value, dict):
        return [x for k in sorted(value) for x in json_leaves(value[k], f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}")]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in json_leaves(v, f"{pointer}/{i}")]
    return []


def json_with(value, leaves: dict[str, str], pointer: str = ""):
    """The JSON value with its strings replaced by pointer."""
    if isinstance(value, str):
        return leaves[pointer]
    if isinstance(value, dict):
        return {k: json_with(v, leaves, f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}") for k, v in value.items()}
    if isinstance(value, list):
        return [json_with(v, leaves, f"{pointer}/{i}") for i, v in enumerate(value)]
    return value


def _office(content: bytes, kind: str) -> list[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if kind == "DOCX":
            names = ["word/document.xml"]
        else:
            names = sorted((n for n in z.namelist() if n == "xl/sharedStrings.xml" or n.startswith("xl/worksheets/sheet")), key=lambda n: (n != "xl/sharedStrings.xml", n))
        return [(n, z.read(n).decode("utf-8")) for n in names]


def leaves_of(content: bytes, kind: str) -> tuple[list[tuple[str, str]], str]:
    """((locator, text) pieces, the separator after or between them)."""
    if kind == "HTML":
        s = content.decode("utf-8")
        return [(f"node {i}", s[a:b]) for i, (a, b) in enumerate(html_pieces(s))], fixed.ROW_END
    if kind == "JSON":
        return json_leaves(json.loads(content)), fixed.ROW_END
    if kind in ("DOCX", "XLSX"):
        tag, out = ("w:t" if kind == "DOCX" else "t"), []
        for name, body in _office(content, kind):
            out += [(f"{name} {i}", unescape(body[a:b])) for i, (a, b) in enumerate(xml_pieces(body, tag))]
        return [x for x in out if kind == "XLSX" or x[1] != ""], fixed.ROW_END
    if kind == "PDF":
        raise DocumentError("reading PDF needs a PDF package, which is not installed")
    return [("whole", content.decode("utf-8"))], ""


def extract_text(content: bytes, kind: str) -> tuple[str, list[tuple[int, int, str]]]:
    if kind == "CSV":
        text, segments = "", []
        parts, at = [], 0
        for r, row in enumerate(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""))):
            for c, cell in enumerate(row):
                segments.append((at, at + len(cell), f"{r},{c}"))
                parts.append(cell + fixed.CELL_END)
                at += len(cell) + 1
            parts.append(fixed.ROW_END)
            at += 1
        return "".join(parts), segments
    leaves, separator = leaves_of(content, kind)
    segments, at = [], 0
    for where, body in leaves:
        segments.append((at, at + len(body), where))
        at += len(body) + len(separator)
    return separator.join(body for _, body in leaves), segments


def emit_bytes(content: bytes, kind: str, changed: str) -> bytes:
    """The document with its pieces taken from the changed text."""
    if kind in ("TXT", "MD", "PDF"):
        return changed.encode()
    if kind == "CSV":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        for row in changed.rstrip(fixed.ROW_END).split(fixed.ROW_END):
            if row:
                cells = row.split(fixed.CELL_END)
                writer.writerow(cells[:-1] if cells[-1] == "" else cells)
        return out.getvalue().encode()
    leaves, separator = leaves_of(content, kind)
    new = changed.split(separator) if leaves else []
    if len(new) != len(leaves) or (kind == "HTML" and not leaves):
        raise DocumentError(f"{kind}: {len(leaves)} pieces became {len(new)}")
    if kind == "JSON":
        return json.dumps(json_with(json.loads(content), dict(zip((p for p, _ in leaves), new, strict=True))), indent=2, ensure_ascii=False).encode()
    if kind == "HTML":
        source = content.decode()
        return _splice(source, html_pieces(source), new).encode()
    tag, at, parts = ("w:t" if kind == "DOCX" else "t"), 0, {}
    for name, body in _office(content, kind):
        ranges = [r for r in xml_pieces(body, tag) if kind == "XLSX" or unescape(body[slice(*r)]) != ""]
        parts[name] = _splice(body, ranges, [escape(x) for x in new[at : at + len(ranges)]])
        at += len(ranges)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as z:
        for item in old.infolist():
            z.writestr(item, parts[item.filename].encode() if item.filename in parts else old.read(item.filename), compress_type=item.compress_type)
    return out.getvalue()


def _emit_kind(kind: str, content: bytes, changed: str) -> bytes:
    return emit_bytes(content, kind, changed)


def _splice(source: str, ranges: list[tuple[int, int]], new: list[str]) -> str:
    out, at = [], 0
    for (a, b), x in zip(ranges, new, strict=True):
        out += [source[at:a], x]
        at = b
    return "".join(out) + source[at:]


@dataclass(frozen=True)
class Adapter:
    """How a kind of document is read, (text, segments) of its bytes, and how a changed text is put back."""

    extract: Callable[[bytes], tuple[str, list[tuple[int, int, str]]]]
    emit: Callable[[bytes, str], bytes]


ADAPTERS = {kind: Adapter(partial(extract_text, kind=kind), partial(_emit_kind, kind)) for kind in dict.fromkeys(fixed.SEGMENT_EXTENSIONS.values())}


def extracting(adapters: dict[str, Adapter] = ADAPTERS):
    """A column function (content, kind) -> text and segments; a document that cannot be read has an error and no text."""

    @pandas_udf(EXTRACTED)
    def run(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
        rows = []
        for c, k in zip(content, kind, strict=True):
            try:
                text, segments = adapters[k].extract(bytes(c))
                rows.append((text, [{"start": a, "end": b, "locator": w} for a, b, w in segments], None))
            except Exception as e:  # noqa: BLE001 - the error is the row's result
                rows.append((None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "segments", "error"])

    return run


def emitting(adapters: dict[str, Adapter] = ADAPTERS):
    """A column function (content, kind, changed text) -> new content, or an error."""

    @pandas_udf(EMITTED)
    def run(content: pd.Series, kind: pd.Series, changed: pd.Series) -> pd.DataFrame:
        rows = []
        for c, k, t in zip(content, kind, changed, strict=True):
            try:
                rows.append((adapters[k].emit(bytes(c), t) if t is not None else None, None))
            except Exception as e:  # noqa: BLE001 - the error is the row's result
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["content", "error"])

    return run
