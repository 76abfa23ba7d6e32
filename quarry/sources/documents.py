"""Office documents as text and metadata titles, on the standard library.

Files come from ``spark.read.format("binaryFile")``.  docx, xlsx and pptx are
zips of XML; PDF has a reader of its own, whatever else is installed.  doc, xls
and ppt have no reader and give an empty text.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import _normal
from quarry.sources.pdf import Pdf


def xml_text(body: bytes, tags: set[str]) -> str:
    """Text of the elements with those local names; empty if it is no XML."""
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return ""
    return _normal(" ".join(e.text or "" for e in root.iter() if isinstance(e.tag, str) and e.tag.rsplit("}", 1)[-1] in tags))


def _parts(body: bytes, pattern: str) -> list[bytes]:
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        return [z.read(n) for n in sorted(z.namelist()) if re.fullmatch(pattern, n)]


def _sheet_cells(body: bytes) -> str:
    shared: list[str] = []
    for part in _parts(body, "xl/sharedStrings.xml"):
        shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(part) if si.tag.endswith("}si")]
    out = []
    for part in _parts(body, r"xl/worksheets/sheet\d+\.xml"):
        for cell in (c for c in ElementTree.fromstring(part).iter() if c.tag.endswith("}c")):
            value = "".join(e.text or "" for e in cell.iter() if e.tag.endswith(("}v", "}t")))
            out.append(shared[int(value)] if cell.get("t") == "s" and value else value)
    return _normal(" ".join(x for x in out if x))


def document_text(body: bytes, filetype: str) -> str:
    kind = (filetype or "").lower()
    try:
        if kind == "pptx":
            return _normal(" ".join(xml_text(p, {"t"}) for p in _parts(body, r"ppt/(?:slides/slide|notesSlides/notesSlide)\d+\.xml")))
        if kind == "docx":
            root = ElementTree.fromstring(_parts(body, "word/document.xml")[0])
            return _normal(" ".join("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith("}p")))
        if kind == "xlsx":
            return _sheet_cells(body)
        if kind == "pdf":
            return _normal(Pdf(body).text())
        return "" if kind in ("doc", "xls", "ppt") else _normal(body.decode("utf-8", errors="ignore"))
    except Exception:  # a broken file is an empty document
        return ""


def metadata_title(body: bytes, filetype: str) -> str:
    kind = (filetype or "").lower()
    if kind not in ("docx", "pptx", "pdf"):
        return ""
    try:
        if kind == "pdf":
            return _normal(Pdf(body).title())
        return xml_text(_parts(body, "docProps/core.xml")[0], {"title"})
    except Exception:
        return ""


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("title", T.StringType())]))
def extract(body: pd.Series, filetype: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(document_text(b or b"", k), metadata_title(b or b"", k)) for b, k in zip(body, filetype, strict=True)], columns=["text", "title"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, filetype, text, metadata_title) of the files under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.withColumn("filetype", F.lower(F.substring_index("path", ".", -1)))
    return rows.select("path", "filetype", extract("content", "filetype").alias("x")).select("path", "filetype", "x.text", F.col("x.title").alias("metadata_title"))
