"""Resume file intake in bulk.

Input is the ``binaryFile`` shape (path, content). The suffix gate and blank check are
Spark expressions; only DOCX rows reach Python, where ``mapInArrow`` reads the
document XML (standard-library zip + XML, body-level paragraphs joined by newlines,
stripped), ``FILES_AT_ONCE`` files at a time, so that a worker's memory doesn't grow with
the batches it is sent. PDF text extraction needs a codec library that is not available here: PDF
files are reported, not read.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOC_XML = "word/document.xml"
FILES_AT_ONCE = 256     # files whose texts or bytes a worker holds as Python objects


def docx_text(data: bytes) -> str:
    """Body-level paragraphs, run text (tabs and breaks kept), joined by '\\n', stripped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read(DOC_XML))
    body = root.find(f"{W}body")
    paras = []
    for p in ([] if body is None else body.findall(f"{W}p")):
        parts = []
        for el in p.iter():
            if el.tag == f"{W}t":
                parts.append(el.text or "")
            elif el.tag == f"{W}tab":
                parts.append("\t")
            elif el.tag in (f"{W}br", f"{W}cr"):
                parts.append("\n")
        paras.append("".join(parts))
    return "\n".join(paras).strip()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, FILES_AT_ONCE):
            yield batch.slice(at, FILES_AT_ONCE)


def _parse_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the text of rows that have content, or the name of the error."""
    for part in _slices(it):
        texts, errs = [], []
        for content in part.column("content"):
            text = err = None
            if content.is_valid:
                try:
                    text = docx_text(content.as_py())
                except Exception as e:  # noqa: BLE001 - a bad file is a per-row outcome
                    err = type(e).__name__
            texts.append(text)
            errs.append(err)
        yield pa.RecordBatch.from_arrays([part.column("path"), pa.array(texts, pa.string()), pa.array(errs, pa.string())],
                                         names=["path", "raw_text", "error"])


def intake(files: DataFrame) -> DataFrame:
    """path, file_name, status ('accepted' | 'unsupported type' | 'pdf reader not available' |
    'unreadable' | 'no text'), raw_text (accepted rows only) of every file. A file is known by
    its path; names may repeat. All files go one way, and only the bytes of DOCX files reach
    Python."""
    def is_type(suffix: str):
        return F.lower(F.col("path")).endswith(suffix)

    out = files.select("path", F.when(is_type(".docx"), F.col("content")).alias("content")).mapInArrow(
        _parse_batches, "path string, raw_text string, error string")
    status = (F.when(is_type(".pdf"), F.lit("pdf reader not available"))
              .when(~is_type(".docx"), F.lit("unsupported type"))
              .when(F.col("raw_text").isNull(), F.lit("unreadable"))
              .when(F.col("raw_text") == "", F.lit("no text"))
              .otherwise(F.lit("accepted")))
    accepted = status == "accepted"
    return out.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), status.alias("status"),
                      F.when(accepted, F.col("raw_text")).alias("raw_text"),
                      # Appended resumes start with no extracted skills
                      F.when(accepted, F.array().cast("array<string>")).alias("extracted_skills"))


def resume_rows(checked: DataFrame, uploads: DataFrame, as_of) -> DataFrame:
    """The rows that accepted uploads append to the resumes table: an id derived from
    the upload's path, the uploading user (``uploads``: path, user_id), the text, no skills
    yet, the time. Uploads of the same file name are rows of their own."""
    ok = checked.filter(F.col("status") == "accepted").join(uploads.select("path", "user_id"), "path")
    return ok.select(F.sha2("path", 256).alias("id"), "user_id", "file_name", "raw_text",
                     "extracted_skills", F.lit(as_of).cast("timestamp_ntz").alias("created_at"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """S10 scan: files as (path, content) rows."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


# ---- DOCX writer used to derive test files from text tables ---------------------

_CT = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
       '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
       '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
       '<Default Extension="xml" ContentType="application/xml"/>'
       '<Override PartName="/word/document.xml" ContentType="application/'
       'vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
_RELS = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
         '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
         '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
         'relationships/officeDocument" Target="word/document.xml"/></Relationships>')


def _esc(s: str) -> str:
    return (s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            .replace("\r", "&#13;"))


def docx_bytes(text: str) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_esc(line)}</w:t></w:r></w:p>'
                   for line in text.split("\n"))
    doc = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
           f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _CT)
        z.writestr("_rels/.rels", _RELS)
        z.writestr(DOC_XML, doc)
    return buf.getvalue()


def _build_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(it):
        content = [docx_bytes(t.as_py() or "") for t in part.column("text")]
        yield pa.RecordBatch.from_arrays([part.column("path"), pa.array(content, pa.binary())], names=["path", "content"])


def as_files(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, content) rows holding each text as a DOCX document."""
    return df.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInArrow(
        _build_batches, "path string, content binary")
