"""Files: text decoding with fallbacks, tables to text, uploads by extension, dataset and archive exports."""

from __future__ import annotations

import io

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings in the order they are tried.
ENCODINGS = ["utf-8", "cp1251", "latin-1", "utf-16"]
TEXT, TABLE, BINARY = ("txt", "md", "markdown", "json", "html", "htm", "log"), ("csv", "tsv"), ("xlsx", "xls", "pdf", "docx")


def decode(data: bytes, encodings: list[str] | None = None) -> str:
    """The text in the first encoding that fits."""
    for e in encodings or ENCODINGS:
        try:
            return data.decode(e)
        except UnicodeError:
            continue
    raise ValueError("the bytes fit none of the encodings")


def table_text(frame: pd.DataFrame, most_rows: int | None = None) -> str:
    """'Row N: column: value, ...' lines of the cells that are not blank, each cut at 500 characters."""
    out = []
    for n, row in enumerate(frame.head(most_rows).itertuples(index=False) if most_rows else frame.itertuples(index=False), 1):
        cells = [(str(c).strip(), str(v).strip()) for c, v in zip(frame.columns, row) if not pd.isna(v) and str(v).strip()]
        if cells:
            out.append(f"Row {n}: " + ", ".join(f"{c}: {v[:500] + '...' if len(v) > 500 else v}" for c, v in cells))
    return "\n".join(out)


def parse(name: str, data: bytes) -> str | None:
    """Text of an upload by its extension; null where the library for it is not installed."""
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if kind in TEXT:
        return decode(data)
    if kind in TABLE:
        return table_text(pd.read_csv(io.StringIO(decode(data)), sep="\t" if kind == "tsv" else ",", dtype=str))
    try:
        if kind in ("xlsx", "xls"):
            return table_text(pd.read_excel(io.BytesIO(data), dtype=str))
        if kind == "pdf":
            from pypdf import PdfReader

            return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)
        if kind == "docx":
            from docx import Document

            return "\n\n".join(p.text for p in Document(io.BytesIO(data)).paragraphs if p.text.strip())
    except ImportError:
        return None
    raise ValueError(f"files of kind {kind!r} are not supported")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, text and error of every file under a folder, read by Spark and parsed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    texts.append(parse(p, c))
                    errors.append(None if texts[-1] is not None else "no library for this kind of file")
                except ValueError as e:
                    texts.append(None)
                    errors.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return files.mapInArrow(run, "path string, text string, error string")


def jsonl(df: DataFrame, path: str, where: Column | None = None) -> None:
    """Rows as JSON lines, nulls kept."""
    out = df if where is None else df.where(where)
    out.select(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def front_matter(**fields: Column) -> Column:
    """A YAML head of JSON scalars."""
    value = lambda c: F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", "")
    return F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{k}: "), F.coalesce(value(v), F.lit("null"))) for k, v in fields.items()], F.lit("---"), F.lit(""))


def export_markdown(docs: DataFrame, path: str) -> DataFrame:
    """Documents as Markdown files under path/source_type=..., and the manifest (source_type, n) that tells what is there."""
    body = F.concat(front_matter(title=F.col("title"), source_id=F.col("source_id"), url=F.col("url"), author=F.col("author")), F.coalesce("content", F.lit("")))
    docs.select("source_type", body.alias("value")).write.mode("overwrite").partitionBy("source_type").text(path)
    return docs.groupBy("source_type").agg(F.count("*").alias("n"))
