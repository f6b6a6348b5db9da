"""Reading and writing the tables of both flows (SRC-1..4, SNK-1..6).

CSV is read with declared types: inferring them would scan the files twice and
could change with the data. Columns are found by the names in the header, known
aliases included, in any order; others are kept as text. Parquet carries its own
schema. Empty CSV cells and NaN are NULL, and a byte-order mark at the start of a
file is skipped.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed

_LONG_PROFILE_COLUMNS = (
    "missing_disconnects",
    "never_used_device",
    "onboarding_hour",
    "onboarding_month",
    "onboarding_weekday",
    "odd_onboarding",
    "label",
    "anomaly",
)
_TEXT_PROFILE_COLUMNS = ("user", "risk_level")

LOG_COLUMNS = {
    "email": ("user", "date", "to"),
    "logon": ("user", "date", "activity"),
    "file": ("user", "date", "file_name", "activity"),
    "device": ("user", "date", "device"),
    "combined": ("user", "date", "to", "activity", "file_name", "device"),
}
OPTIONAL_LOG_COLUMNS = {"risk_multiplier": T.DoubleType(), "label": T.IntegerType()}


def profile_schema(columns: Iterable[str]) -> T.StructType:
    """Types of profile columns, for the columns a file has."""

    def kind(name: str) -> T.DataType:
        if name in _TEXT_PROFILE_COLUMNS:
            return T.StringType()
        return T.LongType() if name in _LONG_PROFILE_COLUMNS else T.DoubleType()

    return T.StructType([T.StructField(c, kind(c)) for c in columns])


def log_schema(kind: str, extra: Iterable[str] = ()) -> T.StructType:
    fields = [
        T.StructField(c, T.TimestampNTZType() if c == "date" else T.StringType())
        for c in LOG_COLUMNS[kind]
    ]
    return T.StructType(fields + [T.StructField(c, OPTIONAL_LOG_COLUMNS[c]) for c in extra])


def feature_schema(label: bool = False) -> T.StructType:
    """The 36 log features; ratios are doubles, flags and counts whole numbers.

    Counts of a training table can be daily averages, hence doubles.
    """

    def kind(name: str) -> T.DataType:
        return T.IntegerType() if name.endswith("_spike") else T.DoubleType()

    fields = [T.StructField("user", T.StringType())]
    fields += [T.StructField(c, kind(c)) for c in fixed.LOG_FEATURES]
    return T.StructType(fields + ([T.StructField("label", T.IntegerType())] if label else []))


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    strict: bool = True,
    date_format: str | None = None,
) -> DataFrame:
    """CSV with a header, if the path says so, else parquet.

    ``schema`` names the columns that a CSV must have; they come first, in its order.
    A value that does not fit its type raises, or is NULL if not ``strict``. Dates are
    ISO unless ``date_format`` gives a pattern.
    """
    first = path if isinstance(path, str) else path[0]
    if not first.rstrip("/").endswith((".csv", ".csv.gz")):
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    reader = spark.read.option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if date_format:
        reader = reader.option("timestampNTZFormat", date_format)
    if schema is None:
        return reader.csv(path)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    kinds = {f.name: f.dataType for f in schema}
    present = csv_columns(spark.read.option("header", True).csv(first).columns, kinds)
    read = reader.schema(
        T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in present])
    ).csv(path)
    return read.select(
        *[
            F.nullif(F.col(f"`{c}`"), F.lit(float("nan"))).alias(c) if k == T.DoubleType() else F.col(f"`{c}`")
            for c, k in kinds.items()
        ],
        *[F.col(f"`{c}`") for c in present if c not in kinds],
    )


def csv_columns(header: Iterable[str], wanted: Iterable[str]) -> list[str]:
    """Names of a file's columns, in its order: those that are wanted under the wanted
    name, others trimmed. Raises if one is missing or comes twice."""
    wanted = list(wanted)
    by_name = {w.strip().lower(): w for w in wanted}
    found = []
    for name in header:
        plain = name.lstrip("\ufeff").strip()
        low = plain.lower()
        found.append(by_name.get(low) or by_name.get(fixed.COLUMN_ALIASES.get(low)) or plain)
    twice = sorted({c for c in found if found.count(c) > 1})
    missing = [w for w in wanted if w not in found]
    if twice or missing:
        raise ValueError(f"the header lacks {missing} and has several of {twice}")
    return found


def read_profile(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """SRC-1."""
    return read_table(spark, path, profile_schema(columns))


def read_log(
    spark: SparkSession,
    path: str,
    kind: str,
    extra: Iterable[str] = (),
    strict: bool = True,
    date_format: str | None = None,
) -> DataFrame:
    """SRC-2: an email, logon, file, device or combined log.

    If not ``strict``, dates stay as they are written. ``schema.row_problems`` counts and
    ``schema.bad_dates`` shows those that do not fit the ``date_format``, and features read
    the others under ``LogSettings(date_format=..., strict_dates=False)``.
    """
    kinds = log_schema(kind, extra)
    if not strict:
        kinds = T.StructType([
            T.StructField(f.name, T.StringType() if f.name == "date" else f.dataType) for f in kinds
        ])
    return read_table(spark, path, kinds, strict, date_format)


def read_features(spark: SparkSession, path: str, label: bool = False) -> DataFrame:
    """SRC-3."""
    return read_table(spark, path, feature_schema(label))


def write_table(df: DataFrame, path: str, mode: str = "error") -> str:
    """SNK-1..5: a folder of part files, CSV with header or parquet by its name."""
    writer = df.write.mode(mode)
    if path.rstrip("/").endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path
