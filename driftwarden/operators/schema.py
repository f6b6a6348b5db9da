"""Column names and kinds of input tables (SCH-1..14)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import aggregate, col, number, parse_date, with_expressions
from ..session import materialize


def canonical_names(df: DataFrame, aliases: Mapping[str, str] = fixed.COLUMN_ALIASES) -> DataFrame:
    """Trim and lower-case every name and replace known aliases."""
    targets = [aliases.get(c.strip().lower(), c.strip().lower()) for c in df.columns]
    twice = sorted({t for t in targets if targets.count(t) > 1})
    if twice:
        raise ValueError(f"several input columns map to {twice}")
    return df.toDF(*targets)


def detect_kind(columns: Iterable[str]) -> str:
    """The one kind a table is taken for, or ``unknown``."""
    present = {c.strip().lower() for c in columns}
    if present.issuperset(fixed.FEATURE_MARKERS):
        return "features"
    for kind in fixed.DETECTION_ORDER:
        if present.issuperset(fixed.REQUIRED_COLUMNS[kind]):
            return kind
    return "unknown"


def matching_kinds(columns: Iterable[str]) -> list[str]:
    """Every log kind whose columns are present; a combined log matches several."""
    present = set(columns)
    return [k for k in fixed.LOG_KINDS if present.issuperset(fixed.REQUIRED_COLUMNS[k])]


def require_columns(df: DataFrame, kind: str) -> DataFrame:
    if kind not in fixed.REQUIRED_COLUMNS:
        raise ValueError(f"unsupported kind of table: {kind}")
    missing = [c for c in fixed.REQUIRED_COLUMNS[kind] if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns for {kind}: {missing}")
    return df


def filed_under(columns: Iterable[str]) -> list[str]:
    """The kinds that a table feeds: a combined log every kind it has the columns of, any
    other table the one it is detected as. The activity of a file log makes no logon log."""
    columns = {c.strip().lower() for c in columns}
    kind = detect_kind(columns)
    matching = matching_kinds(columns)
    return matching if kind != "features" and len({*matching} - {"logon"}) > 1 else [kind]


def route(inputs: Iterable[DataFrame]) -> dict[str, DataFrame]:
    """Canonicalise many inputs, and union them under the kinds they feed (``filed_under``).
    A combined log comes under each of its kinds with the columns of that kind, activity,
    and what else no kind asks for, such as labels."""
    by_kind: dict[str, list[DataFrame]] = defaultdict(list)
    asked = {c for required in fixed.REQUIRED_COLUMNS.values() for c in required}
    for frame in inputs:
        named = canonical_names(frame)
        kinds = filed_under(named.columns)
        for kind in kinds:
            if kind == "unknown":
                by_kind[kind].append(named)
                continue
            require_columns(named, kind)
            own = {*fixed.REQUIRED_COLUMNS[kind], "activity"}
            kept = [c for c in named.columns if len(kinds) == 1 or c in own or c not in asked]
            by_kind[kind].append(named.select(*kept))
    return {
        kind: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        for kind, frames in by_kind.items()
    }


def _is_bad_date(log: DataFrame, date_format: str | None) -> str:
    """Dates that are text count as bad if they cannot be read; typed ones never do."""
    if dict(log.dtypes)["date"] != "string":
        return "false"
    return f"(date is not null and {parse_date('date', False, date_format)} is null)"


def bad_dates(logs: Mapping[str, DataFrame], date_format: str | None = None) -> DataFrame:
    """The rows whose date cannot be read: kind, user and the date as it was written."""
    return reduce(
        DataFrame.unionByName,
        [
            require_columns(l, k)
            .where(_is_bad_date(l, date_format))
            .selectExpr(f"'{k}' as kind", "`user`", "cast(date as string) as date")
            for k, l in logs.items()
        ],
    )


def row_problems(logs: Mapping[str, DataFrame], date_format: str | None = None) -> DataFrame:
    """Per kind: rows, rows without a user, rows whose date cannot be read, ISO or in the
    given format."""

    def checks(kind: str, log: DataFrame) -> DataFrame:
        return log.selectExpr(
            f"'{kind}' as kind",
            "`user` is null as no_user",
            f"{_is_bad_date(log, date_format)} as bad_date",
        )

    rows = reduce(DataFrame.unionByName, [checks(k, require_columns(l, k)) for k, l in logs.items()])
    return rows.groupBy("kind").agg(
        F.count("*").alias("row_count"),
        F.count_if("no_user").alias("null_users"),
        F.count_if("bad_date").alias("bad_dates"),
    )


def is_ready_features(columns: Iterable[str]) -> bool:
    known = set(columns).intersection(fixed.LOG_FEATURES)
    return len(known) > fixed.READY_FEATURES_ABOVE


def ready_features(df: DataFrame) -> DataFrame:
    """Pass a table of ready features through; anything else is an error."""
    if not is_ready_features(df.columns):
        raise ValueError("not a supported log and not a table of ready features")
    return df


def add_missing(
    df: DataFrame, columns: Sequence[str] = fixed.LOG_FEATURES, default: float | int = 0
) -> DataFrame:
    present = set(df.columns)
    return with_expressions(df, {c: number(default) for c in columns if c not in present})


def model_columns(df: DataFrame, columns: Sequence[str] = fixed.LOG_FEATURES) -> DataFrame:
    """``user`` and the model's features, in order."""
    return df.select("user", *columns)


def align_to(
    df: DataFrame, trained: Sequence[str], keep: Sequence[str] = ("user",)
) -> tuple[DataFrame, list[str], list[str]]:
    """Trained columns in trained order; absent ones are 0.0.

    Also returns the names that were missing and the extra names left out.
    """
    present = set(df.columns)
    missing = sorted(set(trained) - present)
    extra = sorted(present - set(trained) - {"user", "label"})
    aligned = add_missing(df, trained, 0.0).select(*[c for c in keep if c in present], *trained)
    return aligned, missing, extra


def ensure_user(df: DataFrame) -> DataFrame:
    """Give a table without a ``user`` column the ids 0..n-1, in the order of its contents:
    the same rows get the same ids however they are partitioned, and it does not matter
    which of equal rows has which. The table is stored, so that later passes agree.

    Rows are sorted by two hashes of their contents and, so that equal rows spread, by
    where they come from; ranges of that order are counted, and the counts of the ranges
    before are added to the places in each.
    """
    if "user" in df.columns:
        return df
    content = ", ".join(map(col, df.columns))
    order = ["_first", "_second", "_origin"]
    ranged = (
        df.selectExpr("*", f"xxhash64({content}) as _first", f"xxhash64(1, {content}) as _second")
        .withColumn("_origin", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop(*order)
    )
    placed = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.expr("shiftright(_place, 33)").alias("part")
    counts = {r.part: r["count"] for r in placed.groupBy(part).count().collect()}  # one row per partition
    before, total = {}, 0
    for number_ in sorted(counts):
        before[number_] = total
        total += counts[number_]
    offsets = df.sparkSession.createDataFrame(list(before.items()), "part long, _before long")
    return (
        placed.withColumn("part_", F.expr("shiftright(_place, 33)"))
        .join(F.broadcast(offsets), F.col("part_") == F.col("part"))
        .withColumn("user", F.expr(f"cast(_before + (_place & {(1 << 33) - 1}L) as string)"))
        .drop("part_", "part", "_before", "_place")
    )


def keep_last(df: DataFrame, engineered: Mapping[str, str]) -> DataFrame:
    """Add columns; an engineered column replaces an input of the same name."""
    return with_expressions(df, engineered)


def numeric_features(
    df: DataFrame, exclude: Sequence[str] = fixed.NOT_MODEL_FEATURES
) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def drop_identity(df: DataFrame) -> DataFrame:
    return df.drop("user", "label")


def column_or_zero(columns: Iterable[str], name: str) -> str:
    """The column with NULL as 0, or 0 where the table lacks it."""
    return f"coalesce(cast({col(name)} as double), 0D)" if name in columns else "0D"


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its number of NULLs, in a single pass."""
    counted = aggregate(df, {c: f"count_if({col(c)} is null)" for c in df.columns})
    return counted.unpivot([], df.columns, "column_name", "null_count")


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns of a table (RPT-3)."""
    return df.agg(F.count("*").alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns)).cast("long")
    )
