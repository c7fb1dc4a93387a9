"""Text files as rows, whatever their encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Encodings in the order tried, and the least share of printable characters.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
PRINTABLE = 0.85


def readable(text: str) -> bool:
    return not text or "\x00" not in text and sum(c.isprintable() or c in "\n\r\t" for c in text) >= PRINTABLE * len(text)


def decode(data: bytes) -> tuple[str | None, str | None]:
    """(text, encoding), or (None, None) if no encoding gives readable text; UTF-16 only with its mark."""
    wide = ("utf-16",) if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ()
    for name in (*ENCODINGS, *wide):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if readable(text):
            return text, name
    return None, None


def decoded(content: Column | str) -> Column:
    """A struct of text and encoding, null where no encoding gives readable text."""

    @F.pandas_udf("text string, encoding string")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if c is None else decode(bytes(c)) for c in content], columns=["text", "encoding"])

    return run(content)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text, encoding of every file under path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), decoded("content").alias("d")).select("file", "d.text", "d.encoding")


def from_map(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """file, text of texts at hand."""
    return spark.createDataFrame(sorted(files.items()), "file string, text string")
