"""Shared helpers: the shared folder, written tables, column selection and text slices for Arrow tasks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: whitespace of the word pattern [^\x20\x09-\x0D]+ ; bytes.split() splits at exactly these
BLANKS = " \t\n\x0b\x0c\r"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver was started from another folder."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors share (``spark.checkpoint.dir``).

    Where the setting is missing, a temporary folder serves a session of one machine; a
    cluster without the setting is an error."""
    importable(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="surgelens-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    importable(df.sparkSession)
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for intermediate values that clash with none of the frame's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def text_rows(docs: DataFrame, keep: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string): the two columns most operators read; null text is empty."""
    importable(docs.sparkSession)
    return docs.select(F.col(keep).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of a row's id and text, 128 bits as two hashes: repeated ids with other texts stay apart, and
    unlike rows of any number of documents do not meet."""
    half = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    return F.unhex(F.concat(half(doc_id, text), half(text, F.lit(1), doc_id)))


def text_slices(batches: Iterable, chars: int = 2_000_000, rows: int = 2_000) -> Iterator:
    """Cut Arrow batches into slices of bounded text size (one row at least), for bounded memory."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            before = size[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(size, before + chars, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def schema(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)
