"""Reading and writing panel tables.

NaN becomes NULL here and nowhere else: later operators rely on NULL only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel import schema as S
from tidepanel.functions.rules import class_of

# Table names below the data root.
TRAIN_FEATURES = "X_train"
TEST_FEATURES = "X_test"
TRAIN_LABELS = "y_train"
KEY_TEMPLATE = "sample_submission"


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in floats}) if floats else df


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a declared schema when the path says so, else Parquet.

    CSV columns are matched by header name, malformed rows fail the job.
    """
    if path.rstrip("/").lower().endswith(".csv"):
        names = spark.read.option("header", True).csv(path).columns
        types = {f.name: f.dataType for f in schema} if schema else {}
        declared = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
        if schema:
            missing = [f.name for f in schema if f.name not in names]
            if missing:
                raise ValueError(f"{path}: missing columns {missing}")
        df = spark.read.schema(declared).option("header", True).option("mode", "FAILFAST").option("nanValue", "NaN").csv(path)
        df = df.select(*[f.name for f in schema]) if schema else df
    else:
        df = spark.read.parquet(path)
        if schema:
            S.require_columns(df, [f.name for f in schema], path)
            df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
    return nan_to_null(df)


class PanelFiles:
    """The four input tables below one root folder (local, HDFS or object store)."""

    def __init__(self, spark: SparkSession, root: str, suffix: str = ".csv"):
        self.spark, self.root, self.suffix = spark, root.rstrip("/"), suffix

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        return read_table(self.spark, f"{self.root}/{name}{self.suffix}", schema)

    def train_features(self) -> DataFrame:
        return self._read(TRAIN_FEATURES, S.PANEL_SCHEMA)

    def test_features(self) -> DataFrame:
        return self._read(TEST_FEATURES, S.PANEL_SCHEMA)

    def train_labels(self) -> DataFrame:
        return self._read(TRAIN_LABELS, S.LABEL_SCHEMA)

    def key_template(self) -> DataFrame:
        return self._read(KEY_TEMPLATE, S.KEY_SCHEMA)


def file_positions(spark: SparkSession, path: str) -> DataFrame:
    """position (from 0), ROW_ID of every row of a written table, in the order of its files.

    A row's place in its split of a file needs no shuffle; the counts of the splits, one row each, are
    summed in the order of file name and offset.
    """
    if path.rstrip("/").lower().endswith(".csv"):
        names = spark.read.option("header", True).csv(path).columns
        raw = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("header", True).option("mode", "FAILFAST").csv(path)
    else:
        raw = spark.read.parquet(path)
    S.require_columns(raw, [S.ROW_ID], path)
    rows = raw.select(
        F.col(S.ROW_ID).cast("long").alias(S.ROW_ID),
        F.col("_metadata.file_path").alias("part"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    earlier = Window.orderBy("part", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("part", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    splits = splits.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return rows.join(splits, ["part", "start"]).select((F.col("ahead") + F.col("at") - F.col("first")).alias("position"), S.ROW_ID)


def write_predictions(df: DataFrame, path: str, single_file: bool = False, like: str | None = None) -> str:
    """Write (ROW_ID, prediction) as CSV with a header.

    Executors write part files in parallel; ``single_file`` funnels all rows
    through one task and is meant for small results only.  ``like`` names a written table whose order of ids is kept;
    ids that it lacks are refused.
    """
    if not path.lower().endswith(".csv"):
        raise ValueError("the name of a prediction file must end with .csv")
    out = df.select(S.ROW_ID, S.PREDICTION)
    if like:
        placed = out.join(file_positions(out.sparkSession, like), S.ROW_ID, "left")
        position = F.coalesce("position", F.raise_error(F.lit(f"ids that are not in {like}")).cast("long"))
        placed = placed.withColumn("position", position)
        out = placed.repartitionByRange("position").sortWithinPartitions("position").select(S.ROW_ID, S.PREDICTION)
    out = out.coalesce(1) if single_file else out
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_sign_predictions(df: DataFrame, score: str, path: str, single_file: bool = False) -> str:
    """Threshold a regression score at 0 and write it keyed by ROW_ID."""
    return write_predictions(df.withColumn(S.PREDICTION, class_of(score)), path, single_file)


def write_panel(df: DataFrame, path: str, files: int | None = None) -> str:
    """Store a panel clustered by date, so that date filters skip row groups.

    Range partitioning on (TS, ROW_ID) splits a hot date over several files.
    """
    keys = [S.TS, S.ROW_ID]
    df = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    df.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return path
