"""Writers: sanitised documents, versioned outputs, per-video partitions."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from kinolake.sources.readers import child, file_system, stored_versions


def _clean(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast(kind)).otherwise(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _clean(x, kind.elementType)) if _has_floats(kind) else c
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda k, v: _clean(v, kind.valueType)) if _has_floats(kind) else c
    if isinstance(kind, T.StructType) and _has_floats(kind):
        fields = F.struct(*[_clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), fields)
    return c


def _has_floats(kind: T.DataType) -> bool:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_floats(kind.valueType)
    return isinstance(kind, T.StructType) and any(_has_floats(f.dataType) for f in kind.fields)


def sanitise(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, at any depth."""
    return df.select(*[_clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def write_doc(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    sanitise(df).write.format(fmt).mode(mode).save(path)


def save_versioned(df: DataFrame, folder: str) -> int:
    """Append as the next version (1 for the first) and return its number; several writers may do so at once.

    Tasks write to a staging folder that readers do not see. Only when all have committed is a number claimed, by
    creating a file that must not exist yet, and the staged folder renamed to that version; of two writers one
    moves on to the next number. A write that fails leaves neither a version nor staged files. The partition column is the version, so
    reading the latest prunes all others.
    """
    spark = df.sparkSession
    root, files = file_system(spark, folder)
    staged = child(spark, root, f"_staged-{uuid.uuid4().hex}")
    try:
        sanitise(df).write.parquet(staged.toString())
        return _publish(spark, files, root, staged)
    finally:
        files.delete(staged, True)


def _claim(files, claim) -> bool:
    """Whether this writer is the one that made ``claim``."""
    try:
        if files.getUri().getScheme() == "file":  # the local file system of a single machine: only mkdir is exclusive
            os.mkdir(claim.toUri().getPath())
        else:
            files.create(claim, False).close()
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as exc:
        if "FileAlreadyExists" in exc.java_exception.getClass().getName():
            return False
        raise


def _publish(spark: SparkSession, files, root, staged) -> int:
    version = max(stored_versions(spark, root.toString()), default=0) + 1
    while True:
        claim, target = child(spark, root, f"_claim-{version}"), child(spark, root, f"version={version}")
        if _claim(files, claim) and not files.exists(target):
            if not files.rename(staged, target):
                files.delete(claim, True)
                raise OSError(f"version {version} could not be put in place in {root.toString()}")
            return version
        version += 1


def write_per_video(df: DataFrame, path: str) -> None:
    """Replace the stored rows of the projects and videos present in ``df``, keep all others."""
    (sanitise(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("project", "video_id").parquet(path))
