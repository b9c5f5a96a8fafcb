"""Reading registry snapshots: zone files, DNS query logs and plain lists, and the lake's tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SNAPSHOT = "name string, tld string, label string"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text files, gzipped or not, as latin-1 lines."""
    return spark.read.format("text").load(path).select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("value"))


def read_zone_files(spark: SparkSession, path: str | list[str], tld: str = r"tld=([^/]+)/") -> DataFrame:
    """(value, tld): the lines of zone files, gzipped or not, with the ending that stands in each file's path.

    A compressed file can't be split: one task reads it, line by line, never whole.
    """
    rows = spark.read.format("text").load(path).select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("value"), F.regexp_extract("_metadata.file_path", tld, 1).alias("tld"))
    return rows.filter("tld <> ''")


def write_zone_files(lines: DataFrame, path: str) -> None:
    """Lines (value, tld) as gzipped text, in a folder for each ending."""
    lines.select("value", "tld").write.partitionBy("tld").option("compression", "gzip").text(path)


def stage_buckets(names: DataFrame, path: str, buckets: int, bucket: Callable[[Column, int], Column]) -> None:
    """Names in a folder for each hash bucket, so that a later step takes one at a time. Each is written by one task."""
    names.withColumn("shard", bucket(F.col("name"), buckets)).repartition("shard").write.partitionBy("shard").parquet(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, modified, bytes) of all files below a folder; none is opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


#: What a file loaded leaves behind: where it belongs, and how and when its load ended.
CHECKPOINT = "source string, tld string, snapshot_date string, partition string, shard_key string, status string, loaded_at timestamp"


def pending_files(files: DataFrame, checkpoints: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Files (source, tld, snapshot_date, partition, shard_key) that no run has completed within the last hours, whichever run it was."""
    since = now - F.make_dt_interval(hours=F.lit(hours))
    done = checkpoints.filter((F.col("status") == "completed") & (F.col("loaded_at") > since))
    keys = ["source", "tld", "snapshot_date", "partition", "shard_key"]
    return files.join(done.select(*keys).distinct(), keys, "left_anti")


def zone_names(lines: DataFrame, tld: Column) -> DataFrame:
    """Distinct owner names of a zone below tld: comments, wildcards and the apex are left out.

    A shuffle on the name takes the place of staging files, whatever the zone's size.
    """
    owner = F.rtrim(F.lower(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0))), F.lit("."))
    rows = lines.filter(~F.startswith(F.ltrim("value"), F.lit(";")) & (F.trim("value") != "")).select(owner.alias("name"), tld.alias("tld"))
    return rows.filter((F.col("name") != F.col("tld")) & F.endswith("name", F.concat(F.lit("."), F.col("tld"))) & ~F.startswith("name", F.lit("*"))).dropDuplicates(["name"])


def query_names(log: DataFrame, qname: str, tld: str) -> DataFrame:
    """Distinct registered names of a DNS log: as many labels as the ending has, and one more."""
    n = tld.count(".") + 2
    clean = F.rtrim(F.lower(F.col(qname).cast("string")), F.lit("."))
    rows = log.select(clean.alias("q")).filter(F.endswith("q", F.lit("." + tld)) & ~F.startswith("q", F.lit("*")) & (F.size(F.split("q", r"\.")) >= n))
    return rows.select(F.substring_index("q", ".", -n).alias("name")).distinct()


def list_names(lines: DataFrame) -> DataFrame:
    """Distinct lower-cased names of a plain list, without wildcards."""
    return lines.select(F.lower(F.trim("value")).alias("name")).filter((F.col("name") != "") & ~F.startswith("name", F.lit("*"))).distinct()


def raw_names(lines: DataFrame) -> DataFrame:
    """(domain_norm, domain_raw, domain_raw_b64): one spelling of each name, the smallest; wildcards stay."""
    raw = F.col("value")
    rows = lines.select(F.rtrim(F.lower(F.trim(raw)), F.lit(".")).alias("domain_norm"), raw.alias("domain_raw")).filter("domain_norm <> ''")
    return rows.groupBy("domain_norm").agg(F.min("domain_raw").alias("domain_raw")).withColumn("domain_raw_b64", F.base64(F.encode("domain_raw", "ISO-8859-1")))


def exists(spark: SparkSession, path: str) -> bool:
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    return base.getFileSystem(spark._jsc.hadoopConfiguration()).exists(base)


def lenient_read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Parquet with exactly the given columns: missing ones are null, a missing path is an empty table."""
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.schema(st).parquet(path) if exists(spark, path) else spark.createDataFrame([], st)


def write_lake(df: DataFrame, path: str, *keys: str) -> None:
    """Zstd Parquet in hive-style folders; only the partitions that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def expired_partitions(paths: DataFrame, today: Column, keep_days: int) -> DataFrame:
    """Lake paths older than keep_days; current state has no date and always stays."""
    day = F.to_date(F.nullif(F.regexp_extract("path", r"snapshot_date=(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    return paths.withColumn("snapshot_date", day).filter(F.col("snapshot_date") < F.date_sub(today, keep_days))


RUN_LOG = "run_id string, source string, tld string, snapshot_date string, started_at string, finished_at string, status string, total_snapshot_count long, added_count long, removed_count long, raw_object_key string, error_message string"


def run_log(runs: DataFrame) -> DataFrame:
    """One typed log row for each run; times as ISO text."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    day = F.date_format("started_at", "yyyy-MM-dd")
    return runs.select(
        F.col("id").cast("string").alias("run_id"), "source", "tld", day.alias("snapshot_date"), iso("started_at").alias("started_at"), iso("finished_at").alias("finished_at"), "status",
        F.col("domains_seen").alias("total_snapshot_count"), F.col("domains_inserted").alias("added_count"), F.col("domains_deleted").alias("removed_count"),
        F.concat_ws("/", F.lit("raw"), "source", "tld", day).alias("raw_object_key"), F.col("reason_code").alias("error_message"),
    )


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or on one machine a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a folder of its own and read back, so that what follows doesn't compute it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
