"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.session import ensure_checkpoint_dir

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut there,
    and an executor lost later costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a Spark context: they need not have it installed."""
    import echoline

    top = os.path.dirname(os.path.abspath(echoline.__file__))
    name = f"echoline-{spark.sparkContext.applicationId}.zip"
    if any(os.path.basename(f) == name for f in spark.sparkContext._python_includes or []):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="echoline-"), name)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("echoline", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def words_of(col: Column) -> Column:
    """Words of a text (null: no words): runs of anything but blank, \\t, \\n, \\v, \\f and \\r."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), SPACE_RUN), "")


def ascii_folded(col: Column) -> Column:
    """A string that two texts share exactly if they are equal but for the case of A-Z.

    For comparing and hashing only: the UTF-8 bytes are read as Latin-1 and lower-cased.  That
    also maps the lead bytes C0-DE to E0-FE, but a lead byte of the first kind has one
    continuation byte after it and one of the second kind has two or three, so no two
    different texts meet.  Much faster than ``ascii_lower`` on long texts.
    """
    return F.lower(F.decode(col.cast("binary"), "ISO-8859-1"))


def map_texts(df: DataFrame, column: str, make: Callable[[], Callable[[list[str]], dict]], schema: str, slice_bytes: int = 4_000_000, keep: bool = False) -> DataFrame:
    """All columns of ``df`` but ``column`` (with ``keep``: that too), and those that ``make()(texts)`` returns (null is passed as empty).

    ``make`` runs once a task.  Arrow batches are handed on in slices of about ``slice_bytes``
    of text, so that long texts don't add up; the other columns pass through as they are.
    """
    kept = [c for c in df.columns if keep or c != column]
    fields = df.select(*kept).schema
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = batch.column(at).to_pylist()
            start = size = 0
            for end, text in enumerate(texts, 1):
                size += len(text or "")
                if size >= slice_bytes or end == len(texts):
                    made = work([t or "" for t in texts[start:end]])
                    part = batch.slice(start, end - start)
                    columns = [part.column(i) for i in range(part.num_columns) if keep or i != at]
                    names = [n for i, n in enumerate(part.schema.names) if keep or i != at]
                    new = [v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]
                    yield pa.RecordBatch.from_arrays(columns + new, names + list(made))
                    start, size = end, 0

    return arrow_map(df, run, out)
