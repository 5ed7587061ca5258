"""Format detection from content: magic bytes, archive listing, text test; a name only tells text types apart."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmark.operators.parsers import DOCX, XLSX

#: Magic bytes, archive folders and text extensions with their media types.
MAGIC = (
    ("255044462D", "application/pdf"),
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("424D", "image/bmp"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("7B5C727466", "application/rtf"),
    ("D0CF11E0A1B11AE1", "application/x-ole-storage"),
)
ZIP_MAGIC = ("504B0304", "504B0506", "504B0708")
FOLDERS = (("word/", DOCX), ("xl/", XLSX), ("ppt/", "application/vnd.openxmlformats-officedocument.presentationml.presentation"))
EXTENSIONS = {"md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "text": "text/plain", "csv": "text/csv", "json": "application/json", "html": "text/html", "htm": "text/html"}
SAMPLE, PRINTABLE = 8192, 0.85


def zip_type(data: bytes) -> str:
    """Media type of an archive by what it lists; one that can't be read is a plain archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            for folder, media_type in FOLDERS:
                if any(n.startswith(folder) for n in names):
                    return media_type
            if "mimetype" in names:
                return z.read("mimetype").decode("ascii", "ignore").strip() or "application/zip"
    except (zipfile.BadZipFile, OSError, RuntimeError):
        pass
    return "application/zip"


@F.pandas_udf(StringType())
def _zip_type(contents: pd.Series) -> pd.Series:
    return contents.map(lambda x: None if x is None else zip_type(bytes(x)))


def _starts(content: Column, magic: str) -> Column:
    return F.startswith(content, F.unhex(F.lit(magic)))


def looks_like_text(content: Column) -> Column:
    """A UTF-16 mark, or no NUL and (nearly) UTF-8 in the first bytes, or mostly printable ASCII."""
    sample = F.substring(content, 1, SAMPLE)
    size = F.octet_length(sample)
    valid = lambda cut: F.expr("true") if cut is None else F.is_valid_utf8(F.substring(sample, F.lit(1), F.greatest(size - cut, F.lit(0))).cast("string"))
    latin = F.decode(sample, "ISO-8859-1")
    printable = F.length(F.regexp_replace(latin, "[^\\x20-\\x7e\\t\\n\\r]", ""))
    utf8 = valid(0) | valid(1) | valid(2) | valid(3)
    return _starts(content, "FFFE") | _starts(content, "FEFF") | (~F.contains(sample, F.unhex(F.lit("00"))) & (utf8 | (printable > PRINTABLE * size)))


def detect(content: Column, filename: Column) -> Column:
    """Media type of the bytes.  Only archives go through Python."""
    known = F.lit(None).cast("string")
    out = None
    for magic, media_type in MAGIC:
        out = F.when(_starts(content, magic), media_type) if out is None else out.when(_starts(content, magic), media_type)
    is_zip = _starts(content, ZIP_MAGIC[0]) | _starts(content, ZIP_MAGIC[1]) | _starts(content, ZIP_MAGIC[2])
    extension = F.when(F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1)))
    by_name = known
    for ext, media_type in EXTENSIONS.items():
        by_name = F.when(extension == ext, media_type).otherwise(by_name)
    return out.when(is_zip, _zip_type(F.when(is_zip, content))).when(looks_like_text(content), F.coalesce(by_name, F.lit("text/plain"))).when(content.isNotNull(), "application/octet-stream")


def detect_text(text: Column, filename: Column | None = None) -> Column:
    """``detect`` for content that is known to be text and no archive: JVM expressions alone."""
    content = F.encode(text, "UTF-8")
    out = None
    for magic, media_type in MAGIC:
        out = F.when(_starts(content, magic), media_type) if out is None else out.when(_starts(content, magic), media_type)
    by_name = F.lit(None).cast("string")
    if filename is not None:
        extension = F.when(F.contains(filename, F.lit(".")), F.lower(F.substring_index(filename, ".", -1)))
        for ext, media_type in EXTENSIONS.items():
            by_name = F.when(extension == ext, media_type).otherwise(by_name)
    return out.when(looks_like_text(content), F.coalesce(by_name, F.lit("text/plain"))).when(content.isNotNull(), "application/octet-stream")


def mismatch_warning(declared: Column, detected: Column) -> Column:
    """The warning of a declared type that the bytes contradict, else null."""
    message = F.concat(F.lit("declared "), declared, F.lit(" but the content is "), detected)
    return F.when(declared.isNotNull() & (declared != detected), F.struct(F.lit("media_type_mismatch").alias("code"), message.alias("message"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("block_id")))
