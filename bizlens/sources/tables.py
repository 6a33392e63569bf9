"""Table scans and sinks.

Tables are addressed either by a path (parquet by default) or by a catalog
name.  A plain overwrite is Spark's own: it deletes the old files before it
writes, so a job that fails half way leaves no table.  Rebuilds are therefore
*published*: the rows go to a fresh version folder, and only when all of them
are written does one small marker make that version the current one.  A failed
rebuild leaves the old rows readable, and tables published together appear
together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


#: Folder of the markers of a published table: ``<number>.<version>``; the greatest number is current.
MARKERS = "_published"
#: Versions that stay: the current one, and one for readers that have resolved the marker before.
KEEP = 2


def _folder(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a folder in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, version) of the published versions of ``root``, oldest first."""
    fs, at = _folder(spark, f"{root}/{MARKERS}")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted((int(n), v) for n, _, v in (x.partition(".") for x in names) if n.isdigit() and v)


def published_path(spark: SparkSession, root: str, name: str = "data") -> str | None:
    """Folder of the current version of a published table, or None."""
    versions = _versions(spark, root.rstrip("/"))
    return f"{root.rstrip('/')}/{versions[-1][1]}/{name}" if versions else None


def publish(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet", keep: int = KEEP) -> str:
    """Write ``tables`` (name -> rows) as one new version below ``root``; returns the version.

    Nothing of the current version is touched before every table is written.
    The swap is the creation of one empty marker file, which is atomic in file
    systems and object stores alike.  A failure on the way removes the new
    version and leaves the old one current; so does a driver that dies (its
    folder has no marker and no reader sees it).  Versions beyond ``keep`` go.
    """
    if not tables:
        raise ValueError("nothing to publish")
    root, version = root.rstrip("/"), f"_version-{uuid.uuid4().hex}"
    spark = next(iter(tables.values())).sparkSession
    fs, at = _folder(spark, f"{root}/{version}")
    try:
        for name, df in tables.items():
            df.write.format(fmt).save(f"{root}/{version}/{name}")
    except BaseException:
        fs.delete(at, True)
        raise
    versions = _versions(spark, root)
    number = versions[-1][0] + 1 if versions else 1
    marker = _folder(spark, f"{root}/{MARKERS}/{number:012d}.{version}")[1]
    fs.mkdirs(marker.getParent())
    fs.create(marker, False).close()
    for n, old in (versions + [(number, version)])[:-keep]:
        fs.delete(_folder(spark, f"{root}/{MARKERS}/{n:012d}.{old}")[1], False)
        fs.delete(_folder(spark, f"{root}/{old}")[1], True)
    return version


def read_table(spark: SparkSession, ref: str, fmt: str = "parquet", name: str = "data") -> DataFrame:
    """Scan a table by path (``fmt`` reader) or by catalog name.

    Of a published path, the current version is read; ``name`` picks one of the
    tables that were published together.
    """
    if "/" in ref or ref.endswith(f".{fmt}"):
        return spark.read.format(fmt).load(published_path(spark, ref, name) or ref)
    return spark.table(ref)


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one of the driver's tables under ``sf_dir``."""
    return spark.read.parquet(table_path(sf_dir, name))


def write_table(df: DataFrame, ref: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: Iterable[str] | None = None) -> None:
    """Overwrite or append.  A path writes files, a name saves a table.

    An append to a published path adds to its current version.  An overwrite
    that fails loses the old rows: use ``rebuild_table`` where they matter.
    """
    if "/" in ref and mode == "append":
        ref = published_path(df.sparkSession, ref) or ref
    writer = df.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in ref:
        writer.save(ref)
    else:
        writer.saveAsTable(ref)


def write_colocated(df: DataFrame, name: str, key: str, path: str | None = None, buckets: int | None = None, fmt: str = "parquet") -> DataFrame:
    """S3 for tables that are joined often: saved under a catalog name in buckets of ``key``, sorted by it, and read back.

    Tables written with one number of buckets join on the key (J1 to J3, J6)
    without a shuffle: rows move once, when they are written, not in every
    query.  ``buckets`` is the session's shuffle partitions unless given; take
    about one per 200 MB of the largest table.  The rows are dealt to the
    buckets before they are written, so a bucket is one file.  ``path`` makes it
    an external table in a shared folder.  The name must be new: a table that
    queries read is replaced by ``rebuild_table`` or under another name.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, key).write.format(fmt).bucketBy(n, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return spark.table(name)


def rebuild_table(df: DataFrame, ref: str, fmt: str = "parquet") -> None:
    """Replace all rows of a table; the old ones stay readable until the new ones are complete.

    ``df`` may read the table that it replaces.  A path is published (read it
    with ``read_table``).  A catalog name becomes an external table whose
    location moves to the new version; its schema must stay as it is.
    """
    if "/" in ref:
        publish({"data": df}, ref, fmt)
        return
    spark = df.sparkSession
    root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tables/{ref}"
    if not spark.catalog.tableExists(ref):
        publish({"data": df}, root, fmt)
        spark.read.format(fmt).load(published_path(spark, root)).limit(0).write.format(fmt).option("path", f"{root}/_schema").saveAsTable(ref)
    elif [(f.name, f.dataType) for f in spark.table(ref).schema] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError(f"the rows do not have the columns of {ref}")
    else:
        publish({"data": df}, root, fmt)
    spark.sql(f"ALTER TABLE {ref} SET LOCATION '{published_path(spark, root)}'")
    spark.catalog.refreshTable(ref)


def fan_out_together(df: DataFrame, root: str, targets: Mapping[str, list[str] | None], fmt: str = "parquet") -> str:
    """Publish the full row under one name and projections under others, so that all sinks appear at once.

    The input is persisted so that every sink holds the same rows.
    """
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return publish({name: cached if cols is None else cached.select(*cols) for name, cols in targets.items()}, root, fmt)
    finally:
        cached.unpersist()


def fan_out(df: DataFrame, targets: Mapping[str, list[str] | None], mode: str = "append",
            fmt: str = "parquet") -> None:
    """Write the full row to one sink and projections to others.

    ``targets`` maps a table ref to the columns it receives (``None`` = all).
    The input is persisted once so both sinks see the same rows without
    recomputing the upstream plan (which may be nondeterministic, e.g. a
    ``current_timestamp`` stamp).
    """
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for ref, cols in targets.items():
            write_table(cached if cols is None else cached.select(*cols), ref, mode=mode, fmt=fmt)
    finally:
        cached.unpersist()


def enforce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a declared schema: names, order and types.

    Missing columns become typed nulls; extra columns are dropped.  A null
    arriving in a field declared non-nullable raises an error when the row is
    computed (the check runs inside the job, not on the driver).
    """
    present = set(df.columns)
    cols: list[Column] = []
    for field in schema.fields:
        c = F.col(field.name).cast(field.dataType) if field.name in present else F.lit(None).cast(field.dataType)
        if not field.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"null in non-nullable column {field.name}")).cast(field.dataType))
        cols.append(c.alias(field.name))
    return df.select(*cols)
