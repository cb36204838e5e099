"""Readers: media listings, project documents, segment files, vectors, versions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinolake.functions import scalars as s

# Media suffixes and the name of a version file.
MEDIA_GLOB, MEDIA_PATTERN = "*.[mM][pPoO][4vV]", r"(?i)\.(mp4|mov)$"
VERSION_FILE, VERSION_PARTITION = r"/v(\d+)\.json$", r"/version=(\d+)/[^/]+$"
VERSION_FOLDER = re.compile(r"version=(\d+)")
VIDEO_IN_PATH = r"/videos/([^/]+)/[^/]+/[^/]+$"


def scan_media(spark: SparkSession, folder: str, with_hash: bool = False, glob: str = MEDIA_GLOB,
               pattern: str = MEDIA_PATTERN) -> DataFrame:
    """Media files of one folder (and of its partition folders) sorted by name; optionally with their content hash.

    Without the hash no file content is read. ``glob`` and ``pattern`` say which names are media.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.filter(F.col("path").rlike(pattern))
    columns = [name.alias("name"), "path", "length", "modificationTime"]
    if with_hash:
        columns.append(s.content_hash(F.col("content"), F.col("length")).alias("video_hash"))
    return rows.select(*columns).orderBy("name")


def read_typed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A document or a list of documents, checked against the schema; bad ones are errors."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def scan_projects(spark: SparkSession, root: str, schema: str, pattern: str = "*/project.json", lines: bool = False) -> DataFrame:
    """Project documents under ``root``; unreadable ones are skipped. A file is a document, or with ``lines`` each of its lines."""
    full = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_bad", T.StringType())])
    rows = (spark.read.schema(full).option("multiLine", not lines).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad").json(f"{root}/{pattern}"))
    return rows.filter("_bad IS NULL AND name IS NOT NULL").drop("_bad").orderBy("name")


def scan_segments(spark: SparkSession, project_folder: str, schema: str, segment_files: str = "videos/*/segments/*.json",
                  description_files: str = "videos/*/descriptions/*.json", video_in_path: str = VIDEO_IN_PATH) -> DataFrame:
    """Segments of a project's videos; videos without a description file are left out whole.

    The video key comes from the path. Description files are listed, not read.
    """
    segments = (spark.read.schema(schema).option("multiLine", True).json(f"{project_folder}/{segment_files}")
                .withColumn("video_hash", F.regexp_extract(F.col("_metadata.file_path"), video_in_path, 1)))
    listed = spark.read.format("binaryFile").load(f"{project_folder}/{description_files}")
    described = listed.select(F.regexp_extract("path", video_in_path, 1).alias("video_hash"))
    return segments.join(described, "video_hash", "left_semi")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors as ``array<float>`` rows."""
    return spark.read.parquet(path)


def list_versions(spark: SparkSession, folder: str, pattern: str = VERSION_FILE) -> DataFrame:
    """Version numbers with their newest file time, ascending; other names are ignored.

    ``pattern`` is ``VERSION_FILE`` for one document per version, or ``VERSION_PARTITION``
    for folders written by ``save_versioned``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    number = F.regexp_extract("path", pattern, 1)
    return (files.select(number.alias("_v"), "modificationTime").filter("_v <> ''")
            .groupBy(F.col("_v").cast("int").alias("version"))
            .agg(F.max("modificationTime").alias("created_at")).orderBy("version"))


def file_system(spark: SparkSession, folder: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def child(spark: SparkSession, parent, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(parent, name)


def stored_versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions in a folder, from the names of its folders alone."""
    root, files = file_system(spark, folder)
    if not files.exists(root):
        return []
    names = (status.getPath().getName() for status in files.listStatus(root))
    return sorted(int(m[1]) for m in map(VERSION_FOLDER.fullmatch, names) if m)


def read_version(spark: SparkSession, folder: str, version: int | str = "latest") -> DataFrame:
    """Rows of one stored version, given as number, ``v`` and number, or ``latest``; no other version is listed."""
    stored = stored_versions(spark, folder)
    wanted = max(stored, default=None) if version == "latest" else int(str(version).lstrip("v"))
    if wanted not in stored:
        raise FileNotFoundError(f"no version {version} in {folder}")
    return spark.read.option("basePath", folder).parquet(f"{folder}/version={wanted}")
