"""Files as tables: discovery, fingerprints, kinds, decoding."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import extension_of

#: File extensions by artifact kind; others are text.
KINDS = {
    "oracle": (".sql", ".pks", ".pkb", ".prc", ".fnc", ".trg", ".pck", ".vw", ".vws", ".pkg", ".tps"),
    "powerbuilder": (".srw", ".sru", ".srf", ".srm", ".srj", ".srd", ".pbl"),
    "markdown": (".md",),
    "pdf": (".pdf",),
    "docx": (".docx",),
    "config": (".yaml", ".yml", ".json", ".ini"),
}
#: Media types by extension; others are text/plain.
MEDIA = {".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".json": "application/json", ".md": "text/markdown"}


def artifact_kind(extension: Column) -> Column:
    out = F.lit("text")
    for kind, extensions in KINDS.items():
        out = F.when(extension.isin(*extensions), kind).otherwise(out)
    return out


def media_type(extension: Column) -> Column:
    out = F.lit("text/plain")
    for ending, media in MEDIA.items():
        out = F.when(extension == ending, media).otherwise(out)
    return out


def discover(spark: SparkSession, root: str, extensions: list[str], ignore: list[str] = (), most_bytes: int = 50 << 20) -> DataFrame:
    """Files under a root: relative_path, extension, artifact_kind, media_type, size_bytes, modified_at, content, sha256, status.

    Patterns of ``ignore`` are globs on the relative path, in which * also crosses folders. Files over ``most_bytes`` are rows with status
    FILE_TOO_LARGE and without content; their bytes are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/+", "/")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    relative = F.substring(path, F.char_length(base) + 2, F.char_length(path))
    kept = files.withColumn("relative_path", relative).withColumn("extension", extension_of(F.col("relative_path")))
    kept = kept.filter(F.col("extension").isin(*[x.lower() for x in extensions]))
    for pattern in ignore:
        kept = kept.filter(~F.col("relative_path").rlike(f"(?s)^{fnmatch.translate(pattern).removeprefix('(?s:').removesuffix(')\\Z').removesuffix(')\\z')}$"))
    fits = F.col("length") <= most_bytes
    return kept.select(
        "relative_path",
        "extension",
        artifact_kind(F.col("extension")).alias("artifact_kind"),
        media_type(F.col("extension")).alias("media_type"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.when(fits, F.col("content")).alias("content"),
        F.when(fits, F.sha2("content", 256)).alias("sha256"),
        F.when(fits, "found").otherwise("FILE_TOO_LARGE").alias("status"),
    )


def decode(files: DataFrame, encodings: tuple[str, ...] = ("utf-8", "cp1252", "latin-1")) -> DataFrame:
    """Adds text, encoding and warning to files by content: a byte-order mark decides, else the first encoding that fits strictly.
    Nothing fits: text is null and warning TEXT_DECODE_FAILED."""

    def text_of(data: bytes | None) -> tuple[str | None, str | None, str | None]:
        if data is None:
            return None, None, None
        marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
        for encoding in [e for mark, e in marks if data.startswith(mark)] or encodings:
            try:
                return data.decode(encoding), encoding, "LOW_CONFIDENCE_ENCODING" if encoding == "latin-1" else None
            except UnicodeDecodeError:
                continue
        return None, None, "TEXT_DECODE_FAILED"

    @F.pandas_udf("text string, encoding string, warning string")
    def decoded(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_of(x) for x in content], columns=["text", "encoding", "warning"])

    return files.withColumn("_d", decoded("content")).select(*files.columns, "_d.*")


def docx_blocks(files: DataFrame) -> DataFrame:
    """Headings, paragraphs and table rows of .docx contents, in order: relative_path, ordinal, kind, level, text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import xml.etree.ElementTree as ET
        import zipfile

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        said = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
        for frame in frames:
            rows: list[tuple] = []
            for path, content in zip(frame["relative_path"], frame["content"], strict=True):
                try:
                    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
                except (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError):
                    rows.append((path, 0, "error", None, "DOCX_UNREADABLE"))
                    continue
                found: list[tuple] = []
                for node in body if body is not None else ():
                    if node.tag == f"{w}p" and said(node).strip():
                        style = node.find(f"{w}pPr/{w}pStyle")
                        name = style.get(f"{w}val", "") if style is not None else ""
                        level = int(name[-1]) if name.lower().startswith("heading") and name[-1].isdigit() else None
                        found.append(("heading" if level else "paragraph", level, said(node).strip()))
                    elif node.tag == f"{w}tbl":
                        found += [("table_row", None, " | ".join(said(c).strip() for c in row.iter(f"{w}tc"))) for row in node.iter(f"{w}tr")]
                rows += [(path, i, *x) for i, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=["relative_path", "ordinal", "kind", "level", "text"]).astype({"level": "Int32"})

    return files.select("relative_path", "content").mapInPandas(run, "relative_path string, ordinal int, kind string, level int, text string")


def snapshot_write(df: DataFrame, folder: str, version: int) -> str:
    """Write a table's next version beside the earlier ones; a version is never overwritten, so readers keep theirs."""
    path = f"{folder.rstrip('/')}/version={version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path
