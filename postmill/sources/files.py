"""Files: text of unknown encoding, documents in archives, and the limits that turn bad ones into rows with warnings."""

from __future__ import annotations

import codecs
import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

FILE_LIMIT, TEXT_LIMIT = 12 << 20, 500_000
#: Limits of an archive: entries, all bytes, bytes of one, and ratio beyond 1 MB (fixed values).
ENTRIES, INFLATED, ONE_ENTRY, RATIO = 2000, 48 << 20, 16 << 20, 100
RESULT = StructType([StructField("text", StringType()), StructField("warnings", ArrayType(StringType())), StructField("method", StringType())])
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(data: bytes) -> tuple[str, list[str]]:
    """UTF-16 by its mark, else UTF-8, else GB18030, else UTF-8 with replacements and a warning."""
    if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return data.decode("utf-16", "replace"), []
    for name in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(name), []
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace"), ["encoding unknown"]


def document_text(data: bytes) -> str:
    """Paragraphs, then table rows joined by ' | ', of a word-processing archive within the limits."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        if len(infos) > ENTRIES or sum(i.file_size for i in infos) > INFLATED or any(i.flag_bits & 1 or i.file_size > ONE_ENTRY or (i.file_size > 1 << 20 and i.file_size > RATIO * max(1, i.compress_size)) for i in infos):
            raise ValueError("suspicious archive")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    rows = [" | ".join(text(c) for c in r.iter(f"{_W}tc")) for t in body.findall(f"{_W}tbl") for r in t.iter(f"{_W}tr")]
    return "\n".join([x for x in map(text, body.findall(f"{_W}p")) if x.strip()] + rows)


def extract(path: str, data: bytes) -> dict:
    """Text, warnings and method; never an exception, and no text with method unavailable or failed."""
    end = path.rsplit(".", 1)[-1].lower()
    if len(data) > FILE_LIMIT:
        return {"text": "", "warnings": ["file too large"], "method": "failed"}
    try:
        if end in ("txt", "md", "csv", "json"):
            text, warnings = decode(data)
            method = "text"
        elif end == "docx":
            text, warnings, method = document_text(data), [], "docx"
        else:
            return {"text": "", "warnings": [f"no reader for .{end}"], "method": "unavailable"}
    except Exception as e:  # a damaged file is a row with a warning
        return {"text": "", "warnings": [str(e)[:200]], "method": "failed"}
    if len(text) > TEXT_LIMIT:
        text, warnings = text[:TEXT_LIMIT], [*warnings, "text cut"]
    return {"text": text, "warnings": warnings, "method": method}


@F.pandas_udf(RESULT)
def extract_file(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(p, bytes(c)) for p, c in zip(path, content, strict=True)], columns=["text", "warnings", "method"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, text, warnings, method) of the files in a folder."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"), extract_file("path", "content").alias("x")).select("path", "length", "sha256", "x.*")
