"""Sources: long-form grids, sample files, file listings."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.frames import COORDS, need, present
from gridspark.operators.filters import canonical_coords, filter_bbox, filter_time

log = logging.getLogger(__name__)

# Columns of a sample file.
SAMPLE_COLUMNS = ("CHL", "PP", "KD490", "DIATO", "DINO", "CDM", "BBP")
SEPARATORS = {"csv": ",", "txt": "\t"}


def canonical(df: DataFrame) -> DataFrame:
    """Lower-case names, ``lat``/``lon`` coordinates, NaN as NULL."""
    df = canonical_coords(df)
    lower = {c: c.lower() for c in df.columns if c != c.lower()}
    if lower:
        df = df.withColumnsRenamed(lower)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def read_grid(spark: SparkSession, path: str | Sequence[str], variables: Sequence[str] | None = None,
              time_range: tuple | None = None, bbox: dict | None = None, fmt: str = "parquet",
              schema: str | T.StructType | None = None) -> DataFrame:
    """A long-form grid; variables that are not in the file are reported, not fatal.

    Time and box filters sit on the raw coordinate columns and reach the scan.
    """
    if fmt not in ("parquet", "csv", "orc"):
        raise ValueError(f"unsupported grid format '{fmt}'")
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        raise ValueError("a CSV grid needs an explicit schema")
    df = reader.format(fmt).load(path)
    if "year" in df.columns and "time" in df.columns:  # the folders of write_grid, no variable
        if time_range:
            first, last = (F.year(F.to_date(F.lit(str(t)[:10]))) for t in time_range)
            df = df.where(F.col("year").between(first, last))
        df = df.drop("year")
    return narrow(df, variables, time_range, bbox)


def narrow(df: DataFrame, variables: Sequence[str] | None = None, time_range: tuple | None = None,
           bbox: dict | None = None) -> DataFrame:
    """The selection part of ``read_grid`` for any raw grid."""
    df = canonical_coords(df)
    if time_range:
        df = filter_time(df, *time_range)
    if bbox:
        df = filter_bbox(df, bbox)
    df = canonical(df)
    if variables is not None:
        gone = [v for v in variables if not present(df, [v])]
        if gone:
            log.warning("variables not found: %s", ", ".join(gone))
        df = df.select(*present(df, COORDS), *present(df, variables))
    return df


def read_grids(spark: SparkSession, folder: str, glob: str = "*.parquet", fmt: str = "parquet") -> DataFrame:
    """All readable grid files of a folder as one grid with the union of their variables.

    ``files_without_rows`` tells which files gave nothing.
    """
    reader = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
              .option("ignoreCorruptFiles", True).option("mergeSchema", True))
    return canonical(reader.format(fmt).load(folder))


def files_without_rows(spark: SparkSession, folder: str, glob: str = "*.parquet", fmt: str = "parquet") -> DataFrame:
    """``path, size_bytes`` of the files that ``read_grids`` took no row from: unreadable or empty ones."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    listed = reader.format("binaryFile").load(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("length").alias("size_bytes"))
    read = (reader.option("ignoreCorruptFiles", True).option("mergeSchema", True).format(fmt).load(folder)
            .select(F.col("_metadata.file_path").alias("path")).distinct())
    return listed.join(read, "path", "left_anti")


def read_samples(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Delimited samples; keeps the known columns and requires CHL.

    Columns are matched by header name whatever their order; only the header line is
    looked at to find them.
    """
    if fmt not in SEPARATORS:
        raise ValueError(f"unsupported sample format '{fmt}'")
    # with enforceSchema off, files of one folder with other headers are an error, not mixed up
    raw = (spark.read.option("header", True).option("sep", SEPARATORS[fmt]).option("inferSchema", False)
           .option("enforceSchema", False).csv(path))
    need(raw, "CHL")
    return raw.select(*[F.nanvl(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(None)).alias(c.lower())
                        for c in present(raw, SAMPLE_COLUMNS)])


#: Stores that tasks open by themselves, and what the opener calls them.
STREAMED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}
CHUNK = 1 << 20  # bytes of a file held at a time
SMALL = 4 << 20  # bytes; the scan counts the opening of a file as so many
TASK_FILES, TASK_BYTES = 1000, 128 << 20  # that a task reads on average where files are small


def _open(path: str):
    """The bytes of a file of one of the ``STREAMED`` stores, from wherever the task runs."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"), compression=None)
    host, _, name = rest[2:].partition("/")
    store, base = fs.FileSystem.from_uri(f"{STREAMED[scheme]}://{host}/")
    return store.open_input_stream(f"{base.rstrip('/')}/{name}", compression=None)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sums = []
        for path in batch["path"]:
            digest = hashlib.md5(usedforsecurity=False)
            with _open(path) as file:
                while chunk := file.read(CHUNK):
                    digest.update(chunk)
            sums.append(digest.hexdigest())
        yield batch.assign(md5=sums)


def _by_tasks(listed: DataFrame) -> DataFrame:
    """Listed files, dealt out anew if they are small: the scan takes few a task then, and a Python task costs more than those."""
    slots = listed.sparkSession.sparkContext.defaultParallelism
    files, size = listed.coalesce(4 * slots).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if size >= files * SMALL:
        return listed
    return listed.repartition(max(-(-files // TASK_FILES), -(-size // TASK_BYTES), min(files, slots)))


def file_inventory(spark: SparkSession, folder: str, glob: str = "*", checksum: bool = True) -> DataFrame:
    """Name, size, modification time, type and MD5 of every file in a folder.

    Without ``checksum`` the contents are not read.  Tasks get paths and read their files in chunks, so a file may have
    any size; the scan deals files to tasks by size, and small ones are brought together.  Files of stores outside
    ``STREAMED`` are read by Spark as rows, which holds for files up to 2 GB each.  Spark's file sources pass over files
    without bytes, so those are not listed.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(folder))
    listed, md5 = files.drop("content"), []
    if checksum:
        md5 = ["md5"]
        head = listed.select("path").first()
        if head is None or head["path"].split(":")[0] in STREAMED:
            listed = _by_tasks(listed).mapInPandas(_digests, "path string, modificationTime timestamp, length long, md5 string")
        else:
            listed = files.withColumn("md5", F.md5("content")).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    return listed.select(
        name.alias("filename"), (F.col("length") / (1024 * 1024)).alias("size_mb"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
        F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).alias("type"), *md5)
