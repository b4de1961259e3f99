"""Recordings on a file tree: discovery, pairing, path attributes, tolerant columns, rates, clocks, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_FPS = 14.64


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, folder, name, modified, bytes) of the files below a root, from Spark's own listing; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.col("path")
    return files.select(
        path, F.regexp_replace(path, r"/[^/]*$", "").alias("folder"), F.regexp_extract(path, r"([^/]*)$", 1).alias("name"),
        F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"),
    )


def scan_recordings(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """All rows of the trace files below a root, with the file that each came from."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(root).withColumn("path", F.col("_metadata.file_path"))


def pair_files(files: DataFrame, *names: str) -> DataFrame:
    """(folder, one path column per name): folders that hold every one of the named files."""
    found = files.filter(F.col("name").isin(*names)).groupBy("folder").agg(*[F.max(F.when(F.col("name") == n, F.col("path"))).alias(n.split(".")[0]) for n in names])
    return found.dropna(subset=[n.split(".")[0] for n in names])


def path_attributes(df: DataFrame, col: str = "path") -> DataFrame:
    """Adds subject (fish or f and digits), session (high, mid, low), prep (explant or invivo) and label (the last three parts)."""
    p = F.lower(F.col(col))
    subject = F.regexp_extract(p, r"(?:^|[/_\-])(?:fish|f)[_\-]?([0-9]+)", 1)
    session = F.regexp_extract(p, r"(high|mid|low)[_\-]?act", 1)
    parts = F.filter(F.split(F.col(col), "/"), lambda x: x != "")
    return (
        df.withColumn("subject", F.when(subject != "", subject.cast("int")))
        .withColumn("session", F.when(session != "", session))
        .withColumn("prep", F.when(p.contains("explant"), "explant").otherwise("invivo"))
        .withColumn("label", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), "/"))
    )


def _fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    out = []
    for f in schema.fields:
        out.append((prefix + f.name, f.dataType))
        if isinstance(f.dataType, T.StructType):
            out += _fields(f.dataType, f"{prefix}{f.name}.")
    return out


def _path(name: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in name.split(".")))


_NUMBERS = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType)


def matrix_profiles(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., name, place, rows, values, known, spread): every numeric array column, fields of structs included, as one group's matrix.

    How many rows have it, how many values they hold and how many of these are finite, and whether they differ. One
    aggregation looks at all columns.
    """
    arrays = [n for n, t in _fields(df.schema) if isinstance(t, T.ArrayType) and isinstance(t.elementType, _NUMBERS)]
    if not arrays:
        raise ValueError(f"no numeric array in {df.columns}")
    finite = lambda n: F.filter(_path(n).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda e: F.coalesce(F.sum(e), F.lit(0)).cast("long")
    of = [F.struct(F.count(_path(n)).alias("rows"), whole(F.size(_path(n))).alias("values"), whole(F.size(finite(n))).alias("known"), (F.max(F.array_max(finite(n))) - F.min(F.array_min(finite(n)))).alias("spread")).alias(f"p{i}") for i, n in enumerate(arrays)]
    told = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("place"), F.col(f"p{i}").alias("p")) for i, n in enumerate(arrays)])
    return df.groupBy(*by).agg(*of).select(*by, F.explode(told).alias("m")).select(*by, "m.name", "m.place", "m.p.*")


def best_matrix(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """Adds ``out``, the numeric array that scores best in each group, and ``<out>_name``: the one with the most finite values among those that are not flat, the first of the schema on ties."""
    score = F.col("known").cast("double") * F.when(F.coalesce(F.col("spread"), F.lit(0.0)) > 0, 1.0).otherwise(1e-9)
    profiles = matrix_profiles(df, by)
    best = profiles.groupBy(*by).agg(F.max_by("name", F.struct(score.alias("s"), (-F.col("place")).alias("p"))).alias(f"{out}_name"))
    names = [n for n, t in _fields(df.schema) if isinstance(t, T.ArrayType) and isinstance(t.elementType, _NUMBERS)]
    picked = F.coalesce(*[F.when(F.col(f"{out}_name") == n, _path(n).cast("array<double>")) for n in names])
    return df.join(best, by).withColumn(out, picked)


def resolve_column(df: DataFrame, candidates: list[str], out: str, as_type: str = "array<double>", by: list[str] = ["recording_id"]) -> DataFrame:
    """Adds a column from the first candidate that is not null, top-level columns before fields of structs.

    Without any candidate in the schema, each recording gets its ``best_matrix``; without a numeric array it fails.
    """
    known = _fields(df.schema)
    picked = [n for c in candidates for n, _ in sorted(known, key=lambda k: k[0].count(".")) if n.split(".")[-1].lower() == c.lower()]
    if not picked:
        return best_matrix(df, by, out).drop(f"{out}_name")
    return df.withColumn(out, F.coalesce(*[_path(n).cast(as_type) for n in picked]))


def resolve_fps(recordings: DataFrame, sources: list[str], ini: DataFrame | None = None, default: float = DEFAULT_FPS) -> DataFrame:
    """Adds fps: the first positive of the given columns, else the rate in the recording's settings text, else the default.

    ``ini`` holds (folder, text); a rate is the number behind a key such as ``frame.rate`` or ``fps``.
    """
    positive = [F.when(F.col(c).cast("double") > 0, F.col(c).cast("double")) for c in sources if c in recordings.columns]
    if ini is not None:
        rate = F.regexp_extract("text", r"(?im)^\s*(?:[\w.]*frame[._ ]?rate|fps)[\w.]*\s*[=:]\s*([0-9.]+)", 1)
        rates = ini.groupBy("folder").agg(F.max(F.when(rate != "", rate.cast("double"))).alias("_ini"))
        recordings = recordings.join(rates, "folder", "left")
        positive.append(F.when(F.col("_ini") > 0, F.col("_ini")))
    return recordings.withColumn("fps", F.coalesce(*positive, F.lit(default))).drop("_ini")


def latest_file(files: DataFrame, by: list[str], root_rank: Column, alias_rank: Column) -> DataFrame:
    """The file to use per key: by root, then by alias, then the newest, then by path."""
    w = Window.partitionBy(*by).orderBy(root_rank, alias_rank, F.desc("modified"), "path")
    return files.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def time_vector(df: DataFrame, value: str, times: list[str], fps: str = "fps") -> DataFrame:
    """Adds t: the first time array as long as the value array, else (0, 1, ...) / fps; rows without either are left out."""
    n = F.size(value)
    fitting = [F.when(F.size(F.col(c)) == n, F.col(c).cast("array<double>")) for c in times if c in df.columns]
    made = F.when((F.col(fps) > 0) & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda i: i / F.col(fps)))
    return df.withColumn("t", F.coalesce(*fitting, made)).filter(F.col("t").isNotNull())


def write_summary(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Summary tables as Parquet, or CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def split_errors(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, failed): rows of kernels that ran, and the keys and reasons of those that did not."""
    return results.filter("error is null").drop("error"), results.filter("error is not null")
