"""The folder all machines share, and tables kept there between passes.

Multi-pass operators cut their lineage by writing a table below
``spark.checkpoint.dir`` and reading it back. A lost executor then costs only the
tasks it was running; nothing lives on a single machine.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, deleted at its end.
    Where the setting is absent a temporary folder serves a local master (tests, a
    laptop); a cluster raises, as no other machine could read what is written."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not base:
            if not re.match(r"local(\[.*)?$", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        _roots[app] = f"{base.rstrip('/')}/tidemark-{app}"
        atexit.register(_drop, spark, _roots[app])
    return _roots[app]


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        remove(spark, path)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file systems, as any store allows."""
    target, system = _file_system(spark, path)
    system.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _file_system(spark, path)
    return bool(system.exists(target))


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written to the shared folder and read back, once and for all."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_text(path: str, spark: SparkSession | None = None) -> str:
    """A small file, whole: through Hadoop's file systems where there is a session,
    from the local disk otherwise."""
    if spark is None:
        with open(path, encoding="utf-8") as f:
            return f.read()
    target, system = _file_system(spark, path)
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str, spark: SparkSession | None = None) -> None:
    """Writes a small file, as ``read_text`` reads it."""
    if spark is None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    target, system = _file_system(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
