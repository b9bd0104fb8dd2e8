"""Texts as relations: Parquet columns, whole files in many encodings, statistics.

A text relation has ``doc_id`` and ``text``. Null texts have no suffixes and are
left out; the empty text has one suffix, its terminator.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one character in memory: Spark strings are Unicode, the wide build.
CHARACTER_BYTES = 4


class EncodingError(ValueError):
    """A text that its encoding cannot express."""


def texts_of(spark: SparkSession, sf_dir: str, table: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text of a Parquet table; only the two columns are read."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())


def transcode(df: DataFrame, encoding: str = "UTF-8", content: str = "content") -> DataFrame:
    """``text`` decoded from a binary column; malformed bytes are an error.

    Spark's own charsets stay in the JVM; any other codec that Python knows runs
    as an Arrow UDF.
    """
    name = codecs.lookup(encoding).name
    native = {"utf-8": "UTF-8", "ascii": "US-ASCII", "iso8859-1": "ISO-8859-1", "utf-16-be": "UTF-16BE", "utf-16-le": "UTF-16LE", "utf-16": "UTF-16"}
    if name in native:
        return df.withColumn("text", F.decode(F.col(content), native[name])).drop(content)

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode(name))

    return df.withColumn("text", decode(F.col(content))).drop(content)


def encode_text(df: DataFrame, encoding: str, text: str = "text", out: str = "content") -> DataFrame:
    """The reverse of ``transcode``: characters that the encoding lacks are an error."""
    name = codecs.lookup(encoding).name

    @F.pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.encode(name))

    return df.withColumn(out, encode(F.col(text)))


def read_texts(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """One whole text per file under ``path``: doc_id (by path order of a hash), path, text."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return transcode(files, encoding).withColumn("doc_id", F.xxhash64("path")).select("doc_id", "path", "text")


def text_stats(texts: DataFrame) -> DataFrame:
    """Bytes, characters, bytes per character, and memory for the indexed text."""
    n, size = F.length("text").cast("long"), F.octet_length("text").cast("long")
    return texts.select(
        "doc_id", size.alias("n_bytes"), n.alias("n_chars"),
        F.when(n > 0, size / n).alias("bytes_per_char"),
        ((n + 3) * CHARACTER_BYTES).alias("memory_bytes"),
        F.when(size > 0, (n + 3) * CHARACTER_BYTES * F.lit(100.0) / size).alias("memory_percent"),
    )


def letter_counts(texts: DataFrame) -> DataFrame:
    """(key, letter, n) of a key and a text: how often each task's texts of a key have each letter, to be summed.

    A task has one row for each key and letter, however long its texts are.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        counts = {}
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.bincount(np.frombuffer((value.as_py() or "").encode("utf-32-le", "surrogatepass"), np.uint32))
                own = counts.setdefault(key, np.zeros(0x110000, np.int64))
                own[: len(found)] += found
        for key, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array([chr(c) for c in at], pa.string()), pa.array(own[at])], names)

    key, names = texts.columns[0], [texts.columns[0], "letter", "n"]
    return texts.mapInArrow(run, f"{key} string, letter string, n long")
