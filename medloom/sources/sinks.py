"""Sinks, run metadata, dimensions and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dosha_code, fold_case
from ..functions.text import body_system as canonical_system
from ..operators.skew import dense_index

REBUILT = (
    "dim_dosha", "dim_body_system", "dim_symptom", "symptom_alias", "dim_condition", "bridge_condition_symptom",
    "fact_patient_intake", "fact_prakriti_assessment",
)
METADATA = {
    "meta_run": "run_id string, started_at timestamp, finished_at timestamp, status string, code_version string, config_sha256 string",
    "meta_lineage": "run_id string, source string, origin string, sha256 string, rows_in int, rows_out int, admitted boolean",
    "dq_check": "run_id string, source string, check_name string, value double, threshold double, passed boolean, blocking boolean, detail string",
}
RENAMED = {"meta_lineage": {"kaggle": "origin"}}


def replace_table(df: DataFrame, root: str, name: str, partition_by: list[str] | None = None) -> None:
    """Full refresh of one of the known analytical tables."""
    if name not in REBUILT:
        raise ValueError(f"{name} is not a rebuildable table")
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(f"{root}/{name}")


def append_table(df: DataFrame, root: str, name: str) -> None:
    """Append by column name; columns the caller leaves out are NULL."""
    schema = METADATA[name]
    empty = df.sparkSession.createDataFrame([], schema)
    shaped = empty.unionByName(df, allowMissingColumns=True).select(*[F.col(f.name).cast(f.dataType) for f in empty.schema])
    shaped.write.mode("append").parquet(f"{root}/{name}")


def upgrade(df: DataFrame, name: str) -> DataFrame:
    """Old metadata with renamed columns read under the current names."""
    for old, new in RENAMED.get(name, {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def lineage_rows(run_id: str, sources: dict[str, tuple[DataFrame, DataFrame | None, str, str, bool]]) -> DataFrame:
    """(run_id, source, origin, sha256, rows_in, rows_out, admitted): both counts in one job."""
    out = None
    for name, (raw, kept, origin, sha, admitted) in sources.items():
        n_in = raw.agg(F.count(F.lit(1)).cast("int").alias("rows_in"))
        n_out = (kept.agg(F.count(F.lit(1)).cast("int").alias("rows_out")) if kept is not None else n_in.select(F.lit(0).alias("rows_out")))
        row = n_in.crossJoin(n_out).select(F.lit(run_id).alias("run_id"), F.lit(name).alias("source"), F.lit(origin).alias("origin"),
                                           F.lit(sha).alias("sha256"), "rows_in", "rows_out", F.lit(admitted).alias("admitted"))
        out = row if out is None else out.unionByName(row)
    return out


def register_views(spark: SparkSession, root: str, names: tuple[str, ...] = REBUILT) -> None:
    """Parquet tables as temporary views: the read path is ``spark.sql``."""
    for name in names:
        spark.read.parquet(f"{root}/{name}").createOrReplaceTempView(name)


# --- dimensions ---------------------------------------------------------------------------------------
def surrogate_ids(df: DataFrame, prefix: str, order: list[str], name: str, width: int = 4) -> DataFrame:
    """Add ``prefix-0001`` ids in the order of a stable key."""
    placed = dense_index(df, [F.col(c) for c in order], "_idx")
    number = (F.col("_idx") + 1).cast("string")
    return placed.withColumn(name, F.concat(F.lit(f"{prefix}-"), F.lpad(number, F.greatest(F.lit(width), F.length(number)), "0"))).drop("_idx")


def reference_json(fields: dict[str, str], columns: list[str]) -> Column:
    """JSON of the listed source columns that exist; empty ones are left out."""
    present = [F.col(f"`{v}`").cast("string").alias(k) for k, v in fields.items() if v in columns]
    return F.to_json(F.struct(*present)) if present else F.lit(None).cast("string")


def condition_rows(df: DataFrame, source: str, prefix: str, order: list[str], columns: dict[str, str], reference: dict[str, str], guidance: dict[str, str] | None = None) -> DataFrame:
    """One knowledge base in the shape of the condition dimension."""
    get = lambda k: F.col(f"`{columns[k]}`") if columns.get(k) in df.columns else F.lit(None).cast("string")
    numbered = surrogate_ids(df, prefix, order, "condition_id")
    system = canonical_system(get("system")) if "system" in columns else F.lit("unspecified")
    return numbered.select(
        "condition_id", F.lit(source).alias("source"), get("name").alias("name"), get("modern_equivalent").alias("modern_equivalent"),
        system.alias("body_system"), dosha_code(get("dosha")).alias("dosha"), F.trim(fold_case(get("prognosis"))).alias("prognosis"),
        get("symptoms").alias("symptoms_raw"), get("age").alias("age_text"), get("sex").alias("sex_text"),
        reference_json(reference, df.columns).alias("practitioner_reference"), reference_json(guidance or {}, df.columns).alias("patient_guidance"))


def body_system_dimension(conditions: DataFrame) -> DataFrame:
    return conditions.groupBy("body_system").agg(F.count(F.lit(1)).alias("conditions"))


def overlay(conditions: DataFrame, links: DataFrame | None) -> DataFrame:
    """Licence-restricted codes merged when their table is present, NULL otherwise."""
    if links is None:
        return conditions.withColumn("code", F.lit(None).cast("string"))
    return conditions.join(links.select("condition_id", "code"), "condition_id", "left")


# --- fingerprints -----------------------------------------------------------------------------------------
def fingerprint(df: DataFrame, columns: list[Column] | None = None) -> DataFrame:
    """One row (rows, digest): content digest that ignores row order and layout.

    Row digests are added limb by limb, so the aggregate has a fixed size, needs no sort and is
    combined map-side however many rows or copies there are.
    """
    parts = columns or [F.col(c) for c in df.columns]
    text = F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in parts])
    digest = df.select(F.sha2(text, 256).alias("h"))
    limb = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"l{i}")
    sums = digest.agg(F.count(F.lit(1)).alias("rows"), *[limb(i) for i in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.coalesce(F.col(f"l{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("digest"))


def content_id(tables: dict[str, DataFrame]) -> str:
    """Short id over the digests of all tables of a published snapshot."""
    import hashlib

    digests = [fingerprint(df).first()["digest"] for df in tables.values()]
    return hashlib.sha256("".join(sorted(digests)).encode()).hexdigest()[:12]


def _hadoop(spark: SparkSession, path: str):
    """File system and path of any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def publish(tables: dict[str, DataFrame], root: str, previous: DataFrame | None = None) -> tuple[str, bool]:
    """Write a snapshot; returns its id and whether an earlier benchmark still describes it.

    Each snapshot has a folder named by its content. The manifest, one small file that names the current
    folder, is replaced when all tables are there, so readers see one whole snapshot or the other. An
    existing snapshot is not written again; what an interrupted run left is overwritten.
    """
    spark = next(iter(tables.values())).sparkSession
    ident = content_id(tables)
    files, done = _hadoop(spark, f"{root}/{ident}/_complete")
    if not files.exists(done):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{root}/{ident}/{name}")
        files.create(done, True).close()
    _, fresh = _hadoop(spark, f"{root}/_manifest.{ident}")
    _, manifest = _hadoop(spark, f"{root}/_manifest")
    out = files.create(fresh, True)
    out.write(bytearray(ident.encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(manifest.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, manifest, options)
    same = previous is not None and previous.where(F.col("content_id") == ident).limit(1).count() == 1
    return ident, same


def published(spark: SparkSession, root: str) -> str:
    """Folder of the current snapshot under ``root``."""
    files, manifest = _hadoop(spark, f"{root}/_manifest")
    stream = files.open(manifest)
    ident = bytes(stream.readAllBytes()).decode()
    stream.close()
    return f"{root}/{ident}"
