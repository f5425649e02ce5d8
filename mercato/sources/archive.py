"""An archive of compressed files by partition: published in two phases, guarded against partitions that shrink, verified by checksums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versions import Versions

FILES = "part string, path string, n_rows long, length long, sha string, run int"


def _files_of(spark, path: str, schema: str, part: str) -> DataFrame:
    """part, path, n_rows, length, sha of the files under a folder: counted and hashed as they lie there."""
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    rows = spark.read.schema(schema).csv(path).select(F.col(part).cast("string").alias("part"), name.alias("path")).groupBy("part", "path").agg(F.count("*").alias("n_rows"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv.gz").load(path)
    found = found.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "length", F.sha2("content", 256).alias("sha"))
    return rows.join(found, "path")


def publish(store: Versions, df: DataFrame, part: str, spread: int = 1, by: str | None = None) -> DataFrame:
    """Write ``df`` as gzip CSV by ``part`` and make it the archive, but for partitions that would shrink: part, had, has, state.

    First all files are written beside the archive and read back: rows counted, bytes hashed. Then each partition is held against the manifest of the
    last published run: ``new``, ``grown``, ``same``, or ``refused`` where it has fewer rows, which keeps the old files; partitions that do not come
    again are ``kept``. One commit makes the new manifest current; until then, and if the run fails, the archive is the old one. A null
    part is written as Spark's default partition. Each partition's rows go to ``spread`` files, by a hash of ``by``.
    """
    spark = df.sparkSession
    version = store.current()
    stage = f"{store.root}/files-{uuid.uuid4().hex}"
    keys = [F.col(part), *([F.pmod(F.xxhash64(by), F.lit(spread))] if by else [])]
    df.repartition(*keys).write.partitionBy(part).option("compression", "gzip").csv(stage)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != part) + f", `{part}` string"
    fresh = _files_of(spark, stage, schema, part).select("part", "path", "n_rows", "length", "sha", F.lit(version + 1).alias("run"))
    old = store.read("files") if version else spark.createDataFrame([], FILES)
    has, had = (x.groupBy("part").agg(F.sum("n_rows").alias(n)) for x, n in ((fresh, "has"), (old, "had")))
    what = F.when(F.col("has").isNull(), "kept").when(F.col("had").isNull(), "new").when(F.col("has") < F.col("had"), "refused").when(F.col("has") == F.col("had"), "same").otherwise("grown")
    state = has.join(had, "part", "full").withColumn("state", what)
    stays = state.where("state in ('kept', 'refused')").select("part")
    files = fresh.join(stays, "part", "left_anti").unionByName(old.join(stays, "part", "left_semi").select(*fresh.columns))
    number = store.commit({"files": files, "decisions": state.select("part", "had", "has", "state")}, version)
    return store.read("decisions", number)


def archived(store: Versions, schema: str) -> DataFrame:
    """The rows of the current archive, from the files of its manifest alone, with ``part``."""
    spark = store.spark
    paths = [r.path for r in store.read("files").select("path").toLocalIterator()]  # a manifest: a row for each file
    if not paths:
        return spark.createDataFrame([], schema + ", part string")
    rows = spark.read.schema(schema).csv(paths)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), "=([^/=]*)/[^/]*$", 1).alias("part"))


def verify(store: Versions) -> DataFrame:
    """part, path, status of each file of the manifest: ok, damaged (other bytes than were published) or missing."""
    spark = store.spark
    noted = store.read("files").select("part", "path", "length", "sha")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv.gz").load(f"{store.root}/files-*")
    there = there.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), F.sha2("content", 256).alias("is"))
    status = F.when(F.col("is").isNull(), "missing").when(F.col("is") == F.col("sha"), "ok").otherwise("damaged")
    return noted.join(there, "path", "left").select("part", "path", status.alias("status"))
