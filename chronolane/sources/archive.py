"""The append-only archive: Parquet by domain, records in, rejects beside them, point-in-time reads out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.timing import ladder, visible
from ..storage import written

DOMAINS = ("PRE_MATCH", "POST_MATCH")
SCHEMA = T.StructType([
    T.StructField("record_id", T.StringType(), False), T.StructField("match_id", T.LongType()), T.StructField("artifact_type", T.StringType()),
    T.StructField("cutoff_profile", T.StringType()), T.StructField("revision", T.IntegerType()), T.StructField("available_at", T.TimestampNTZType()),
    T.StructField("kickoff_at", T.TimestampNTZType()), T.StructField("payload", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("domain", T.StringType()),
])
KEYS = ["match_id", "cutoff_profile", "artifact_type"]


def content_hash() -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", "match_id", "artifact_type", "cutoff_profile", "revision", "payload"), 256))


def checked(records: DataFrame) -> DataFrame:
    """records with reject: what keeps a record out, or null."""
    why = ladder(
        (F.col("record_id").isNull() | F.col("match_id").isNull(), "IDENTITY_MISSING"), (~F.coalesce(F.col("domain").isin(*DOMAINS), F.lit(False)), "UNKNOWN_DOMAIN"),
        (F.col("content_hash") != content_hash(), "HASH_MISMATCH"), ((F.col("domain") == "PRE_MATCH") & (F.col("available_at") >= F.col("kickoff_at")), "POSTMATCH_ONLY"),
        ((F.col("domain") == "POST_MATCH") & (F.col("available_at") < F.col("kickoff_at")), "LABEL_BEFORE_KICKOFF"),
    )
    return records.withColumn("reject", why)


#: Folders by hash of record_id within a domain, so that an append looks for its records in the folders they can be in.
BUCKETS = 32


def bucket() -> Column:
    return F.pmod(F.xxhash64("record_id"), F.lit(BUCKETS)).cast("int")


def _there(spark: SparkSession, path: str) -> bool:
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    return fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """All records with the columns of their folders: append (the batch that wrote them), domain and bucket."""
    if not _there(spark, path):
        return spark.createDataFrame([], T.StructType([*SCHEMA.fields, T.StructField("append", T.StringType()), T.StructField("bucket", T.IntegerType())]))
    return spark.read.schema(T.StructType([*SCHEMA.fields, T.StructField("append", T.StringType()), T.StructField("bucket", T.IntegerType())])).parquet(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All records; filters on domain prune folders, others reach the Parquet scan. An archive that is not there yet is empty."""
    return _files(spark, path).select(*SCHEMA.fieldNames())


def stored(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """record_id and content_hash of the records in some buckets' folders; no others are listed or read."""
    return _files(spark, path).where(F.col("bucket").isin(buckets)).select("record_id", "content_hash")


def append(records: DataFrame, path: str) -> DataFrame:
    """Appends what is new and sound; returns (record_id, outcome): APPENDED, NOOP, CONFLICT or the reason of a reject.

    An equal record again changes nothing, a record_id with other content is a conflict. Repeats within the batch are judged alike.
    A batch is compared with the stored records of its own buckets alone, and writes a folder of its own with a manifest
    (`manifests`), which a verified scan goes by. Batches are to come one at a time: two at once do not see each other.
    """
    spark = records.sparkSession
    # staged twice: neither the batch nor its judgement must be computed again once the archive has grown
    batch = written(checked(records.withColumn("content_hash", F.coalesce("content_hash", content_hash()))).withColumn("bucket", bucket()), "batch")
    own = [r[0] for r in batch.where("reject is null").select("bucket").distinct().collect()]  # BUCKETS at most
    there = stored(spark, path, own).select(F.col("record_id").alias("_id"), F.col("content_hash").alias("_hash"))
    # one shuffle of the sound rows: a record's repeats stand together, the least hash first, and meet what is stored
    w = Window.partitionBy("record_id").orderBy("content_hash")
    sound = batch.where("reject is null").withColumns({"_first": F.first("content_hash").over(w), "_nth": F.row_number().over(w)})
    sound = sound.join(there, F.col("record_id") == F.col("_id"), "left")
    outcome = F.coalesce(F.when(F.col("_hash").isNotNull(), F.when(F.col("_hash") == F.col("content_hash"), "NOOP").otherwise("CONFLICT")), F.when(F.col("content_hash") != F.col("_first"), "CONFLICT"), F.lit("APPENDED"))
    sound = sound.withColumn("outcome", outcome).withColumn("_new", (F.col("outcome") == "APPENDED") & (F.col("_nth") == 1))
    # only what is to be appended keeps its content
    rest = [c for c in SCHEMA.fieldNames() if c != "record_id"]
    told = sound.select("record_id", "outcome", "_new", *(F.when(F.col("_new"), F.col(c)).alias(c) for c in [*rest, "bucket"]))
    refused = batch.where("reject is not null").select("record_id", F.col("reject").alias("outcome"), F.lit(False).alias("_new"))
    judged = written(told.unionByName(refused, allowMissingColumns=True), "judged")
    new = judged.where("_new").select(*SCHEMA.fieldNames(), "bucket")
    if not new.isEmpty():
        folder = f"append={uuid.uuid4().hex}"
        new.repartition("domain", "bucket").write.partitionBy("domain", "bucket").parquet(f"{path.rstrip('/')}/{folder}")
        _seal(spark, path, folder)
    return judged.select("record_id", "outcome")


def manifests_path(path: str) -> str:
    return f"{path.rstrip('/')}.manifests"


def manifest_hash() -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", "record_id", "artifact_ref", "artifact_hash"), 256))


def manifest_rows(records: DataFrame, ref: Column, stated: Column | str) -> DataFrame:
    """record_id, artifact_ref, artifact_hash and manifest_hash; ref is the file, within the archive."""
    return records.select("record_id", ref.alias("artifact_ref"), F.col(stated).alias("artifact_hash") if isinstance(stated, str) else stated.alias("artifact_hash")).withColumn("manifest_hash", manifest_hash())


def _ref() -> Column:
    """The file a record stands in, from its append folder on."""
    return F.regexp_extract("_metadata.file_path", "append=.*$", 0)


def _seal(spark: SparkSession, path: str, folder: str) -> None:
    """Writes the manifest of what one append wrote: which file each record stands in, with the hash of its content."""
    own = spark.read.parquet(f"{path.rstrip('/')}/{folder}")
    manifest_rows(own, _ref(), "content_hash").write.parquet(f"{manifests_path(path)}/{folder}")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """record_id, artifact_ref, artifact_hash and manifest_hash of all that was appended."""
    schema = "record_id string, artifact_ref string, artifact_hash string, manifest_hash string"
    at = manifests_path(path)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(at) if _there(spark, at) else spark.createDataFrame([], schema)


def manifest_states(spark: SparkSession, path: str) -> DataFrame:
    """Each manifest with its record and `manifest_state`: MANIFEST_HASH_MISMATCH, RECORD_MISSING, RECORD_ELSEWHERE (not in the file that is named), ARTIFACT_HASH_MISMATCH (with what the record states, or with what its content gives), or OK.

    A record without a manifest is none of the archive's: an append that broke off leaves such.
    """
    files = _files(spark, path)
    # what one side alone can tell is told before the join, so that its hash is not shuffled
    found = files.withColumns({"_ref": _ref() if _there(spark, path) else F.lit(None).cast("string"), "_true": F.col("content_hash").eqNullSafe(content_hash())})
    found = found.select(F.col("record_id").alias("_id"), "_ref", "_true", *(c for c in SCHEMA.fieldNames() if c != "record_id"))
    both = manifests(spark, path).withColumn("_whole", F.col("manifest_hash").eqNullSafe(manifest_hash())).join(found, F.col("record_id") == F.col("_id"), "left")
    state = ladder(
        (~F.col("_whole"), "MANIFEST_HASH_MISMATCH"), (F.col("_id").isNull(), "RECORD_MISSING"), (~F.col("artifact_ref").eqNullSafe(F.col("_ref")), "RECORD_ELSEWHERE"),
        (~(F.col("artifact_hash").eqNullSafe(F.col("content_hash")) & F.col("_true")), "ARTIFACT_HASH_MISMATCH"), otherwise="OK",
    )
    return both.withColumn("manifest_state", state).drop("_id", "_ref", "_true", "_whole")


def verified_scan(spark: SparkSession, path: str) -> DataFrame:
    """The records that have manifests; the job fails at the first manifest whose record is missing, elsewhere or altered."""
    s = manifest_states(spark, path)
    told = F.concat_ws(" ", F.lit("archive:"), "manifest_state", "record_id")
    sound = F.when(F.col("manifest_state") == "OK", F.col("record_id")).otherwise(F.raise_error(told))
    return s.withColumn("record_id", sound).select(*SCHEMA.fieldNames())


def capture_state(report: DataFrame, session: list[str]) -> DataFrame:
    """CAPTURED, PARTIAL or BLOCKED of a capture session, from its accepted and refused records."""
    good = F.count_if(F.col("outcome").isin("APPENDED", "NOOP"))
    return report.groupBy(*session).agg(good.alias("accepted"), (F.count("*") - good).alias("refused"), F.when(good == F.count("*"), "CAPTURED").when(good > 0, "PARTIAL").otherwise("BLOCKED").alias("state"))


def find(records: DataFrame, cutoff: Column | None = None, **equal) -> DataFrame:
    """Records with the given values (None leaves a column free), as visible at the cutoff. An unknown domain is an error, not an empty result."""
    if equal.get("domain") is not None and equal["domain"] not in DOMAINS:
        raise ValueError(f"unknown domain {equal['domain']}")
    for column, value in equal.items():
        if value is not None:
            records = records.where(F.col(column) == value)
    return records if cutoff is None else visible(records, cutoff, [*KEYS, "domain"])
