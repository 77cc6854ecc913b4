"""Text of PDF files whose pages are Flate streams: strings and kerned arrays of the show operators."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shipping import ship

STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
SHOWN = re.compile(rb"\[((?:\\.|\((?:\\.|[^\\)])*\)|[^\]])*)\]\s*TJ|(\((?:\\.|[^\\)])*\))\s*(?:Tj|'|\")|(T\*|T[dDm]\b|ET)", re.S)
LITERAL = re.compile(rb"\(((?:\\.|[^\\)])*)\)|(-?\d+(?:\.\d+)?)", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
GAP = -180.0


def _plain(raw: bytes) -> str:
    return ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else NAMED.get(m[1], m[1]), raw).decode("latin-1")


def text(data: bytes) -> str:
    """Lines of text; a kerning gap as wide as a blank is one."""
    lines: list[str] = [""]
    for packed in STREAM.findall(data):
        try:
            page = zlib.decompress(packed)
        except zlib.error:
            page = packed if b"BT" in packed else b""
        for array, single, move in SHOWN.findall(page):
            if move:
                if lines[-1]:
                    lines.append("")
            elif single:
                lines[-1] += _plain(single[1:-1])
            else:
                for literal, gap in LITERAL.findall(array):
                    lines[-1] += " " if gap and float(gap) < GAP else _plain(literal) if not gap else ""
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def texts(files: DataFrame) -> DataFrame:
    """files (path, content) to (path, text)."""
    ship(files.sparkSession)

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        return content.map(lambda b: text(b or b""))

    return files.select("path", read("content").alias("text"))


def build(lines: list[str]) -> bytes:
    """A PDF of one page with these lines, for tests."""
    shown = b"\n".join(b"T* (" + x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("latin-1") + b") Tj" for x in lines)
    packed = zlib.compress(b"BT /F1 9 Tf 12 TL\n" + shown + b"\nET")
    return b"%PDF-1.4\n1 0 obj << /Length " + str(len(packed)).encode() + b" /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n%%EOF"
