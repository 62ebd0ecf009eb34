"""Readers and writers.

CSV readers take an explicit schema (no inference pass over the data) and
rename the file's columns to the pipeline's ``country, year, <value>``
names. Parquet is the hand-off format between stages: it keeps types and
lets Catalyst prune columns and push filters into the scan.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .schema import measure_schema, normalise_nan, wide_damage_schema


def read_measure(spark: SparkSession, path: str, entity: str, year: str,
                 value: str, out_value: str) -> DataFrame:
    """One hazard measure CSV → ``country, year, <out_value>``."""
    df = (spark.read.schema(measure_schema(entity, year, value))
          .option("header", True).option("nullValue", "")
          .option("enforceSchema", False)
          .csv(path))
    df = df.withColumnsRenamed({entity: "country", year: "year",
                                value: out_value})
    return normalise_nan(df)


def read_total(spark: SparkSession, path: str, value: str,
               out_value: str) -> DataFrame:
    """Totals CSV whose keys are already ``country, year``."""
    return read_measure(spark, path, "country", "year", value, out_value)


def read_wide_damage(spark: SparkSession, path: str,
                     hazard_cols: list[str]) -> DataFrame:
    """S3: wide economic-damage CSV, one column per hazard."""
    df = (spark.read.schema(wide_damage_schema(hazard_cols))
          .option("header", True).option("nullValue", "")
          .option("enforceSchema", False)
          .csv(path))
    return normalise_nan(df)


BAD_ROW = "_rejected_line"


def read_checked(spark: SparkSession, path: str, schema: T.StructType,
                 names: dict[str, str] | None = None,
                 header: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1–S3 with an account of what could not be read: ``(rows, rejects)``.

    A line that does not fit ``schema`` (an unreadable number, a missing or an
    extra field) is no row; it goes to ``rejects`` as ``path, line, reason``,
    where ``reason`` names the first column that is null in it, or ``fields``
    when all could be read. ``names`` renames columns. The parsed lines are
    written once, because Spark parses only the columns that a plan asks for and
    would find a line sound or not by the question asked.
    """
    whole = T.StructType([*schema.fields, T.StructField(BAD_ROW, T.StringType())])
    read = (spark.read.schema(whole).option("header", header).option("nullValue", "")
            .option("enforceSchema", False).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BAD_ROW).csv(path))
    parsed = stage(read.withColumn("_path", F.input_file_name()), "checked-rows")
    bad = F.col(BAD_ROW)
    reason = F.coalesce(*[F.when(F.col(f"`{f.name}`").isNull(), F.lit(f.name))
                          for f in schema.fields], F.lit("fields"))
    rejects = parsed.where(bad.isNotNull()).select(
        F.col("_path").alias("path"), bad.alias("line"), reason.alias("reason"))
    rows = parsed.where(bad.isNull()).drop(BAD_ROW, "_path").withColumnsRenamed(names or {})
    return normalise_nan(rows), rejects


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Rejected lines per reason."""
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("rejected"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A prior stage's parquet output."""
    return normalise_nan(spark.read.parquet(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """Full overwrite; CSV at the edge, parquet between stages."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def drop_if_exists(df: DataFrame, *cols: str) -> DataFrame:
    """Drop a column only when present (a CSV row-index artefact)."""
    present = [c for c in cols if c in df.columns]
    return df.drop(*present) if present else df


# -- stored artefacts ------------------------------------------------------------

def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists on the session's file system (any scheme)."""
    fs, hpath = _file_system(spark, path)
    return fs.exists(hpath)


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, hpath = _file_system(spark, path)
    if not fs.exists(hpath):
        return None
    source = fs.open(hpath)
    try:
        size = fs.getFileStatus(hpath).getLen()
        return bytes(source.readNBytes(int(size))).decode()
    finally:
        source.close()


def _publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: written beside, then renamed over it."""
    jvm = spark.sparkContext._jvm
    fs, target = _file_system(spark, path)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(
        jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(draft, target, over)


def fingerprint(inputs: Sequence[DataFrame] = (), parameters: object = None) -> str:
    """A digest of the files behind ``inputs`` (name, size and time of change of
    each, one listing per folder), their schemas, and ``parameters``. A frame
    without files counts by its plan."""
    lines = [repr(parameters)]
    for df in inputs:
        lines.append(df.schema.simpleString())
        files = df.inputFiles()
        lines += [] if files else [str(df.semanticHash())]
        for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
            fs, hpath = _file_system(df.sparkSession, folder)
            lines += [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}"
                      for s in sorted(fs.listStatus(hpath), key=lambda s: str(s.getPath()))
                      if not s.getPath().getName().startswith(("_", "."))]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _manifest_path(paths: dict[str, str]) -> str:
    """Beside the first artefact, one for each set of artefacts."""
    own = sorted((k, p.rstrip("/")) for k, p in paths.items())
    mark = hashlib.sha256(json.dumps(own).encode()).hexdigest()[:12]
    return f"{min(p for _, p in own)}.{mark}.manifest.json"


def _read_stored(spark: SparkSession, paths: dict[str, str],
                 inputs: str | None) -> dict[str, DataFrame] | None:
    """The published tables, or None when they are missing, unreadable, or made
    from other inputs."""
    text = _read_text(spark, _manifest_path(paths))
    if text is None:
        return None
    try:
        manifest = json.loads(text)
        if inputs is not None and manifest["inputs"] != inputs:
            return None
        folders = manifest["tables"]
        if not all(path_exists(spark, f"{folders[k]}/_SUCCESS") for k in paths):
            return None
        return {k: read_table(spark, folders[k]) for k in paths}
    except (AnalysisException, PySparkException, ValueError, KeyError):
        return None


def read_or_build(spark: SparkSession, paths: dict[str, str],
                  build: Callable[[], dict[str, DataFrame]] | None,
                  use_cache: bool = True, inputs: str | None = None) -> dict[str, DataFrame]:
    """Return the published artefacts, else build, store and publish them.

    Every build writes to folders of its own (``<path>/<version>``). When all are
    complete, one small manifest names them and replaces the former manifest in
    one step, so readers see the tables of one build: after a crash between two
    writes, those of the build before. With ``inputs`` (see :func:`fingerprint`)
    artefacts of other inputs are built again. The build before the published one
    stays, for readers that opened it; older ones are deleted.

    With ``build=None`` this is the loader-only variant: missing artefacts raise
    ``FileNotFoundError``.
    """
    stored = _read_stored(spark, paths, inputs) if use_cache else None
    if stored is not None:
        return stored
    if build is None:
        raise FileNotFoundError(
            "artefacts not found: " + ", ".join(sorted(paths.values())))
    built, version = build(), uuid.uuid4().hex
    folders = {k: f"{p.rstrip('/')}/{version}" for k, p in paths.items()}
    for k, folder in folders.items():
        write_table(built[k], folder)
    before = json.loads(_read_text(spark, _manifest_path(paths)) or "{}")
    _publish_text(spark, _manifest_path(paths), json.dumps(
        {"tables": folders, "inputs": inputs, "before": before.get("tables", {})}))
    for folder in before.get("before", {}).values():
        fs, hpath = _file_system(spark, folder)
        fs.delete(hpath, True)
    return {k: read_table(spark, folders[k]) for k in paths}
