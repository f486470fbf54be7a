"""Shared scratch folder, written intermediate tables and stored path tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can read, named by `spark.checkpoint.dir`.

    Only a local session, where every task runs on this machine, may fall back
    to a folder made here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="statewalk-")
    return _local_folders[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table.

    The plan behind a later step starts at a file scan: its lineage and its
    filters do not grow from round to round, its size is known to the optimizer,
    and a lost executor costs nothing that was computed before.
    """
    spark = df.sparkSession
    location = scratch_path(spark, "step")
    df.write.parquet(location)
    return spark.read.schema(df.schema).parquet(location)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; cheaper per round than `cut`.

    A checkpoint keeps the constraints of the plan behind it.  They grow with
    every join, so this is for loops whose rounds only project, union and
    aggregate.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def bucketed_name(spark: SparkSession) -> str:
    """The name of a bucketed table yet to be written; the scope in force drops it."""
    name = f"bucketed_{uuid.uuid4().hex}"
    if scopes := _scopes.get(spark.sparkContext.applicationId):
        scopes[-1].tables.append(name)
    return name


def add_bucketed(
    df: DataFrame,
    name: str,
    columns: list[str],
    buckets: int,
    group_bytes: int | None = None,
    group_rows: int | None = None,
    distinct: bool = False,
) -> None:
    """Write `df` in sorted buckets of `columns`, as further files if the table is there.

    `distinct` drops equal rows where they meet, in their bucket, without a further shuffle.
    """
    spark = df.sparkSession
    placed = df.repartition(buckets, *columns)
    # the writer sorts by (bucket, columns), hashing the columns for every comparison; rows that are in
    # order already take it one comparison each, and the filter keeps this sort from being dropped for the writer's
    placed = (placed.distinct() if distinct else placed).sortWithinPartitions(*columns).where(F.spark_partition_id() >= 0)
    writer = placed.write.mode("append").bucketBy(buckets, *columns).sortBy(*columns)
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    if not spark.catalog.tableExists(name):
        writer = writer.option("path", scratch_path(spark, name))
    writer.saveAsTable(name)


def write_bucketed(df: DataFrame, columns: list[str], buckets: int, group_bytes: int | None = None, group_rows: int | None = None, distinct: bool = False) -> DataFrame:
    """Write `df` in buckets of `columns`; a join on them reads it unshuffled."""
    name = bucketed_name(df.sparkSession)
    add_bucketed(df, name, columns, buckets, group_bytes, group_rows, distinct)
    return df.sparkSession.table(name)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; the scope in force owns it."""
    folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if scopes := _scopes.get(spark.sparkContext.applicationId):
        scopes[-1].folders.append(folder)
    return folder


class Scope:
    """Folders and tables written while the scope is in force; all but what is kept go at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders, self.tables = spark, [], []

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the rows so that they outlive the scope."""
        kept = cut(df)
        self.release(self.folders[-1])
        return kept

    def release(self, folder: str) -> None:
        """Let a folder written within the scope outlive it."""
        scopes = _scopes[self.spark.sparkContext.applicationId]
        self.folders.remove(folder)
        if len(scopes) > 1:
            scopes[-2].folders.append(folder)

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for folder in self.folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


_scopes: dict[str, list[Scope]] = {}


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scope]:
    """A scope that drops what is written within it; results go out by its `keep`.

    Only for work whose result depends on nothing else that was written.
    Scopes nest; what an inner one keeps belongs to the outer one.
    """
    stack = _scopes.setdefault(spark.sparkContext.applicationId, [])
    scope = Scope(spark)
    stack.append(scope)
    try:
        yield scope
    finally:
        stack.remove(scope)
        scope.drop()


def save_paths(paths: DataFrame, location: str, sep: str = " ") -> None:
    """Store (state, path) for later lookups, clustered by state.

    The path is kept as one text: half the width of an array of strings when a
    lookup has to hold the table in memory.
    """
    path_texts(paths, sep).write.mode("errorifexists").parquet(location)


def load_paths(spark: SparkSession, location: str, sep: str | None = " ") -> DataFrame:
    """Read stored paths; `sep=None` leaves the path as text."""
    schema = "state string, path_text string"
    stored = spark.read.schema(schema).parquet(location)
    if sep is None:
        return stored
    from statewalk.functions.text import split_tokens

    return stored.select("state", split_tokens(F.col("path_text"), sep).alias("path"))


# --- published tables -------------------------------------------------------

MANIFEST = "manifest.json"


def _file_system(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def publish(df: DataFrame, location: str, content: str) -> DataFrame:
    """Write `df` under `location` for other sessions, all of it or nothing.

    The rows go to a folder of their own; only when they are complete, a
    manifest with their number, schema and `content`, which says what they are,
    is put in place by one rename.  If another session was first, its table holds.
    """
    spark = df.sparkSession
    folder = f"{location.rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    rows = spark.read.schema(df.schema).parquet(folder).count()
    said = {"folder": folder.rsplit("/", 1)[1], "rows": rows, "schema": json.loads(df.schema.json()), "content": content}
    files, target = _file_system(spark, f"{location.rstrip('/')}/{MANIFEST}")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    files.rename(draft, target)
    return published(spark, location, content)


def published(spark: SparkSession, location: str, content: str) -> DataFrame | None:
    """The table published at `location`; None if there is none, an error if it is another one or torn."""
    files, path = _file_system(spark, f"{location.rstrip('/')}/{MANIFEST}")
    if not files.exists(path):
        return None
    lines = spark.read.text(path.toString(), wholetext=True).first()
    try:
        said = json.loads(lines[0]) if lines else {}
        schema = StructType.fromJson(said["schema"])
        folder, expected, what = said["folder"], said["rows"], said["content"]
    except (ValueError, KeyError) as error:
        raise ValueError(f"{location} has a manifest that cannot be read") from error
    if what != content:
        raise ValueError(f"{location} holds {what!r}, not {content!r}")
    rows = spark.read.schema(schema).parquet(f"{location.rstrip('/')}/{folder}")
    found = rows.count()
    if found != expected:
        raise ValueError(f"{location} is torn: {found} rows of {expected}")
    return rows


def path_texts(paths: DataFrame, sep: str = " ") -> DataFrame:
    """(state, path_text) of (state, path), clustered by state."""
    return paths.select("state", F.array_join("path", sep).alias("path_text")).repartitionByRange("state").sortWithinPartitions("state")


def bucket_paths(paths: DataFrame, buckets: int | None = None, sep: str = " ") -> DataFrame:
    """Store (state, path) in sorted buckets of the state: lookups then move their entries only."""
    spark = paths.sparkSession
    if buckets is None:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return write_bucketed(paths.select("state", F.array_join("path", sep).alias("path_text")), ["state"], buckets)
