"""Population statistics and what is built on them (AGG-8..12, NRM-1..8).

Statistics are fitted in as few passes as possible, all columns at once, and
come back as a handful of numbers that are used as literals. Nothing here uses
a window without a partition key, which would move all rows into one task.

NaN counts as missing: every operator reads the columns it works on, and gives them back,
with NULL in its place (``without_nan``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import aggregate, as_flag, col, number, with_expressions

# Cells of a factor of e in the first pass of ``quantiles``, and parts of a cell after it.
_CELLS = 1_024
_PARTS = 65_536

_STATISTICS = {
    "n": "count({})",
    "mean": "avg({})",
    "sd": "stddev_samp({})",
    "sd_pop": "stddev_pop({})",
    "lo": "min({})",
    "hi": "max({})",
}


def without_nan(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``columns`` with NULL instead of NaN; only floating point columns change."""
    kinds = {f.name: f.dataType for f in df.schema}
    floats = [c for c in dict.fromkeys(columns) if isinstance(kinds.get(c), (T.DoubleType, T.FloatType))]
    return with_expressions(df, {c: f"nullif({col(c)}, cast('NaN' as {kinds[c].simpleString()}))" for c in floats})


def summarize(
    df: DataFrame, columns: Iterable[str], wanted: Sequence[str] = ("n", "mean", "sd")
) -> dict[str, dict[str, float]]:
    """Statistics of many columns in one aggregate; NULL and NaN are skipped."""
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    row = aggregate(
        without_nan(df, columns), {f"{c}|{s}": _STATISTICS[s].format(col(c)) for c in columns for s in wanted}
    ).first()
    return {c: {s: row[f"{c}|{s}"] for s in wanted} for c in columns}


def summary_table(
    df: DataFrame, columns: Sequence[str], wanted: Sequence[str] = ("n", "mean", "sd")
) -> DataFrame:
    """The same statistics as a lazy table, one row per column."""

    def stats(c: str) -> str:
        parts = [f"'{s}', cast({_STATISTICS[s].format(col(c))} as double)" for s in wanted]
        return f"named_struct({', '.join(parts)})"

    wide = aggregate(without_nan(df, columns), {c: stats(c) for c in columns})
    return wide.unpivot([], list(columns), "column_name", "stats").select("column_name", "stats.*")


# --- exact quantiles ----------------------------------------------------------


def quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]]
) -> dict[str, dict[float, float | None]]:
    """Exact quantiles with linear interpolation; NULL and NaN are skipped.

    Each pass counts the values of some cells, combined on the map side, and goes on with
    the cell that holds a rank, until all values of that cell are equal. Cells of the first
    pass have a width of a thousandth of their values, so that one pass is enough for
    counts, whatever the number of rows, and two for most other columns; those after it cut
    a cell into equal parts. No task holds a column, the driver gets a row for each rank,
    and neither depends on the number of rows.
    """
    columns = list(wanted)
    if not columns:
        return {}
    df = without_nan(df, columns)
    totals, brackets = _first_pass(df, wanted)
    while open_ones := [b for b in brackets if b.low != b.high]:
        brackets = [b for b in brackets if b.low == b.high] + _cut(df, open_ones)
    found = {(b.column, r): b.low for b in brackets for r in b.ranks}
    result: dict[str, dict[float, float | None]] = {c: {} for c in columns}
    for c in columns:
        for p in wanted[c]:
            if c not in totals:
                result[c][p] = None
                continue
            below, above, share = _position(totals[c], p)
            low, high = found[c, below], found[c, above]
            # The weighted sum of the built-in aggregate: it takes infinities and wide ranges.
            result[c][p] = low if share == 0 or low == high else (1 - share) * low + share * high
    return result


def _position(total: int, p: float) -> tuple[int, int, float]:
    """Ranks on either side of a quantile, and its share of the way between them."""
    position = (total - 1) * p
    below = min(int(position), total - 1)
    return below, min(below + 1, total - 1), position - below


@dataclass
class _Bracket:
    """Values ``low..high`` of one column that hold the values of ``ranks``."""

    column: str
    low: float
    high: float
    below: int
    ranks: list[int] = field(default_factory=list)

    def value(self) -> str:
        value = f"cast({col(self.column)} as double)"
        return f"if({value} between {number(self.low)} and {number(self.high)}, {value}, null)"

    def part(self) -> str:
        """Number of the part of equal width; the two ends are parts of their own, so that
        every cut makes the bracket smaller."""
        value, low, high = self.value(), number(self.low), number(self.high)
        width = self.high / 2 - self.low / 2
        inner = "1"
        if math.isfinite(width) and width:
            share = f"({value} / 2 - {number(self.low / 2)}) / {number(width)}"
            inner = f"1 + cast(least(greatest({share}, 0), 0.999999D) * {_PARTS} as bigint)"
        return f"case when {value} = {low} then 0 when {value} = {high} then {_PARTS + 1} else {inner} end"


def _counted(df: DataFrame, entries: Sequence[tuple[str, str]]) -> DataFrame:
    """Cells of (value, part) expressions, by number of the expression: with how many
    values, the smallest and the largest, how many are below, and how many in total."""
    rows = ", ".join(
        f"named_struct('number', {i}, 'value', {value}, 'part', {part})"
        for i, (value, part) in enumerate(entries)
    )
    cells = (
        df.selectExpr(f"inline(filter(array({rows}), x -> x.value is not null))")
        .groupBy("number", "part")
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    whole = Window.partitionBy("number")
    upto = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("below", upto - F.col("n")).withColumn("total", F.sum("n").over(whole))


def _first_pass(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> tuple[dict[str, int], list[_Bracket]]:
    """Numbers of values by column, and brackets of all ranks."""
    columns = list(wanted)

    def entry(c: str) -> tuple[str, str]:
        value = f"cast({col(c)} as double)"
        return value, f"cast(signum({value}) * floor(log1p(abs({value})) * {_CELLS}) as bigint)"

    shares = ", ".join(f"array({', '.join(number(float(p)) for p in wanted[c])})" for c in columns)
    position = "least(cast(floor((total - 1) * p) as bigint), total - 1)"
    rows = (
        _counted(df, [entry(c) for c in columns])
        .selectExpr("*", f"explode(element_at(array({shares}), number + 1)) as p")
        .selectExpr("*", f"explode(array({position}, least({position} + 1, total - 1))) as rank")
        .where("below <= rank and rank < below + n")
        .select("number", "low", "high", "below", "total", "rank")
        .distinct()
        .collect()  # at most two rows for each quantile
    )
    totals, brackets = {}, {}
    for r in rows:
        c = columns[r.number]
        totals[c] = r.total
        brackets.setdefault((c, r.below), _Bracket(c, r.low, r.high, r.below)).ranks.append(r.rank)
    return totals, list(brackets.values())


def _cut(df: DataFrame, brackets: Sequence[_Bracket]) -> list[_Bracket]:
    """The parts of the brackets that hold their ranks."""
    ranks = ", ".join(f"array({', '.join(f'{r - b.below}L' for r in b.ranks)})" for b in brackets)
    rows = (
        _counted(df, [(b.value(), b.part()) for b in brackets])
        .selectExpr("*", f"explode(element_at(array({ranks}), number + 1)) as rank")
        .where("below <= rank and rank < below + n")
        .select("number", "low", "high", "below", "rank")
        .collect()  # a row for each rank
    )
    found: dict[tuple[int, int], _Bracket] = {}
    for r in rows:
        b = brackets[r.number]
        part = found.setdefault((r.number, r.below), _Bracket(b.column, r.low, r.high, b.below + r.below))
        part.ranks.append(b.below + r.rank)
    return list(found.values())


def quantile_table(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> DataFrame:
    """Exact quantiles as a table: column_name, p, value."""
    fitted = quantiles(df, wanted)
    rows = [(c, float(p), fitted[c][p]) for c in wanted for p in wanted[c]]
    return df.sparkSession.createDataFrame(rows, "column_name string, p double, value double")


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    fitted = quantiles(df, {c: [0.5] for c in columns})
    return {c: fitted[c][0.5] for c in columns}


# --- normalisers and flags ----------------------------------------------------


def standard_score(expression: str, stats: Mapping[str, float]) -> str:
    """Distance from the population mean; NULL when the deviation is undefined."""
    spread = f"({number(stats['sd'])} + {number(fixed.ZSCORE_EPSILON)})"
    return f"(({expression} - {number(stats['mean'])}) / {spread})"


def exceeds(expression: str, cut: float | None) -> str:
    """1 where the value is over the cut; 0 if either is undefined."""
    return as_flag(f"{expression} > {number(cut)}")


def unit_range(expression: str, low: float | None, high: float | None) -> str:
    """Min-max to [0, 1]; a range under 1e-9 gives 0."""
    if low is None or high is None or high - low < 1e-9:
        return "0D"
    return f"(({expression} - {number(float(low))}) / {number(float(high) - float(low))})"


def add_zscores(df: DataFrame, outputs: Mapping[str, str]) -> DataFrame:
    """NRM-1, for ``{new column: source column}``."""
    df = without_nan(df, outputs.values())
    stats = summarize(df, outputs.values())
    return with_expressions(df, {o: standard_score(col(c), stats[c]) for o, c in outputs.items()})


def add_quantile_flags(df: DataFrame, outputs: Mapping[str, tuple[str, float]]) -> DataFrame:
    """NRM-2 and NRM-8, for ``{new column: (source column, quantile)}``."""
    wanted: dict[str, list[float]] = {}
    for column, p in outputs.values():
        wanted.setdefault(column, []).append(p)
    df = without_nan(df, wanted)
    cuts = quantiles(df, wanted)
    return with_expressions(df, {o: exceeds(col(c), cuts[c][p]) for o, (c, p) in outputs.items()})


def spike_cut(stats: Mapping[str, float], sigmas: float = fixed.SPIKE_SIGMAS) -> float | None:
    if stats["mean"] is None or stats["sd"] is None:
        return None
    return stats["mean"] + sigmas * stats["sd"]


def add_spikes(df: DataFrame, outputs: Mapping[str, str]) -> DataFrame:
    """NRM-3: over mean + 2 standard deviations of the users present."""
    df = without_nan(df, outputs.values())
    stats = summarize(df, outputs.values())
    return with_expressions(
        df, {o: exceeds(col(c), spike_cut(stats[c])) for o, c in outputs.items()}
    )


def add_unit_range(df: DataFrame, outputs: Mapping[str, str]) -> DataFrame:
    """NRM-4."""
    df = without_nan(df, outputs.values())
    stats = summarize(df, outputs.values(), ("lo", "hi"))
    return with_expressions(
        df, {o: unit_range(col(c), stats[c]["lo"], stats[c]["hi"]) for o, c in outputs.items()}
    )


def robust_scale(df: DataFrame, columns: Sequence[str] = fixed.ROBUST_SCALED) -> DataFrame:
    """NRM-5: distance from the median in interquartile ranges, in place."""
    df = without_nan(df, columns)
    fitted = quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})

    def scaled(c: str) -> str:
        q1, middle, q3 = (fitted[c][p] for p in (0.25, 0.5, 0.75))
        spread = None if q1 is None else (q3 - q1) or 1.0
        return f"(({col(c)} - {number(middle)}) / {number(spread)})"

    return with_expressions(df, {c: scaled(c) for c in columns})


def impute_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NRM-7: gaps become the median of their column; whole columns are left alone."""
    df = without_nan(df, columns)
    row = aggregate(
        df, {"|rows": "count(*)", **{c: f"count({col(c)})" for c in columns}}
    ).first()
    holed = [c for c in columns if row[c] < row["|rows"]]
    middle = medians(df, holed)
    return with_expressions(
        df, {c: f"coalesce(cast({col(c)} as double), {number(middle[c])})" for c in holed}
    )


@dataclass(frozen=True)
class Scaler:
    """NRM-6: means and population standard deviations of model features."""

    columns: tuple[str, ...]
    mean: dict[str, float | None]
    scale: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        stats = summarize(df, columns, ("mean", "sd_pop"))
        return cls(
            tuple(columns),
            {c: stats[c]["mean"] for c in columns},
            {c: stats[c]["sd_pop"] or 1.0 for c in columns},
        )

    def expressions(self) -> dict[str, str]:
        return {
            c: f"((nullif(cast({col(c)} as double), double('NaN')) - {number(self.mean[c])})"
            f" / {number(self.scale[c])})"
            for c in self.columns
        }

    def transform(self, df: DataFrame) -> DataFrame:
        return with_expressions(df, self.expressions())

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, self.mean[c], self.scale[c]) for i, c in enumerate(self.columns)]
        return spark.createDataFrame(
            rows, "position int, feature string, mean double, scale double"
        )

    @classmethod
    def from_table(cls, table: DataFrame) -> Scaler:
        rows = table.orderBy("position").collect()  # one row per feature
        return cls(
            tuple(r.feature for r in rows),
            {r.feature: r.mean for r in rows},
            {r.feature: r.scale for r in rows},
        )
