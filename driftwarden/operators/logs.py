"""Per-user features from event logs (AGG-1..7, JON-1..4, SCR-12).

All logs are reduced to the user, the counted column and a few booleans, put
under each other, and aggregated in one ``groupBy``: each log is shuffled once
after map-side combining, so a user who owns a third of the rows costs no more
than any other. Distinct recipients are counted beside it from bare
(user, recipient) pairs, spread by both.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import (
    after_hours,
    col,
    contains_word,
    critical_activity,
    external_recipient,
    late_night,
    own_ratio,
    parse_date,
    sensitive_file,
    unknown_device,
    weekend,
    with_expressions,
)
from ..session import materialize
from . import schema
from .counting import totals_per_key
from .statistics import exceeds, spike_cut, summarize


@dataclass(frozen=True)
class LogSettings:
    """Words that decide the row flags, and how dates that are text are read."""

    domain: str = fixed.COMPANY_DOMAIN
    failure_word: str = fixed.FAILURE_WORD
    copy_word: str = fixed.COPY_WORD
    usb_word: str = fixed.USB_WORD
    sensitive_extensions: Sequence[str] = fixed.SENSITIVE_EXTENSIONS
    trusted_devices: Sequence[str] = fixed.TRUSTED_DEVICES
    critical_activities: Sequence[str] = fixed.CRITICAL_ACTIVITIES
    date_format: str | None = None
    strict_dates: bool = True


DEFAULTS = LogSettings()


@dataclass(frozen=True)
class LogKind:
    """What one kind of log contributes per user."""

    counted: str
    total: str
    flags: Mapping[str, Callable[[LogSettings], str]]
    ratios: Mapping[str, str]
    spike: str
    distinct: str | None = None
    optional: Mapping[str, str] = field(default_factory=dict)

    @property
    def outputs(self) -> list[str]:
        own = [self.total, *([self.distinct] if self.distinct else []), *self.flags]
        return [*own, *self.ratios, self.spike]


LOGS: dict[str, LogKind] = {
    "email": LogKind(
        counted="to",
        total="email_count",
        distinct="recipient_count",
        flags={
            "external_count": lambda s: external_recipient("`to`", s.domain),
            "late_night_count": lambda s: late_night("`date`"),
            "weekend_count": lambda s: weekend("`date`"),
        },
        ratios={
            "external_ratio": "external_count",
            "late_night_ratio": "late_night_count",
            "weekend_ratio": "weekend_count",
        },
        spike="email_spike",
    ),
    "logon": LogKind(
        counted="date",
        total="login_count",
        flags={
            "late_logins": lambda s: late_night("`date`"),
            "weekend_logins": lambda s: weekend("`date`"),
            "after_hours_logins": lambda s: after_hours("`date`"),
            "failed_logins": lambda s: contains_word("`activity`", s.failure_word),
        },
        ratios={
            "late_login_ratio": "late_logins",
            "weekend_login_ratio": "weekend_logins",
            "after_hours_ratio": "after_hours_logins",
        },
        spike="login_spike",
        optional={"failed_logins": "activity"},
    ),
    "file": LogKind(
        counted="file_name",
        total="file_access_count",
        flags={
            "file_copy_count": lambda s: contains_word("`activity`", s.copy_word),
            "sensitive_file_access": lambda s: sensitive_file(
                "`file_name`", s.sensitive_extensions
            ),
            "after_hours_file_access": lambda s: after_hours("`date`"),
            "weekend_file_access": lambda s: weekend("`date`"),
        },
        ratios={
            "copy_ratio": "file_copy_count",
            "sensitive_ratio": "sensitive_file_access",
            "after_hours_file_ratio": "after_hours_file_access",
        },
        spike="file_spike",
        optional={"file_copy_count": "activity"},
    ),
    "device": LogKind(
        counted="device",
        total="device_activity_count",
        flags={
            "usb_insertions": lambda s: contains_word("`device`", s.usb_word),
            "unknown_device_count": lambda s: unknown_device("`device`", s.trusted_devices),
            "after_hours_device_usage": lambda s: after_hours("`date`"),
            "weekend_device_usage": lambda s: weekend("`date`"),
        },
        ratios={
            "usb_ratio": "usb_insertions",
            "unknown_device_ratio": "unknown_device_count",
            "after_hours_device_ratio": "after_hours_device_usage",
        },
        spike="device_spike",
    ),
}


def dated(log: DataFrame, settings: LogSettings = DEFAULTS) -> DataFrame:
    """Text dates become timestamps; text that is no date raises, or is NULL if dates are
    not strict."""
    if dict(log.dtypes).get("date") != "string":
        return log
    parsed = parse_date("`date`", settings.strict_dates, settings.date_format)
    return with_expressions(log, {"date": parsed})


def _rows(log: DataFrame, kinds: Sequence[str], settings: LogSettings) -> DataFrame:
    """User, per-kind counted marks and booleans of one log."""
    columns: dict[str, str] = {}
    for kind in kinds:
        spec = LOGS[kind]
        columns[f"in_{kind}"] = "true"
        columns[spec.total] = f"{col(spec.counted)} is not null"
        if spec.distinct:
            columns[spec.distinct] = col(spec.counted)
        for name, flag in spec.flags.items():
            needs = spec.optional.get(name)
            absent = needs is not None and needs not in log.columns
            columns[name] = "false" if absent else flag(settings)
    return log.where("`user` is not null").selectExpr(
        "`user`", *[f"{e} as {name}" for name, e in columns.items()]
    )


def _per_user(rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Counts per user, and which logs the user occurs in."""
    totals, distinct = {}, {}
    for kind in kinds:
        spec = LOGS[kind]
        totals[f"in_{kind}"] = f"count_if(in_{kind}) > 0"
        totals |= {name: f"count_if({name})" for name in (spec.total, *spec.flags)}
        if spec.distinct:
            distinct[spec.distinct] = spec.distinct
    return totals_per_key(rows, "user", totals, distinct)


def _with_ratios_and_spikes(counts: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Ratios by own count, and spikes against the users present in each log."""
    counts = materialize(counts)
    totals = {kind: f"if(in_{kind}, {LOGS[kind].total}, null)" for kind in kinds}
    stats = summarize(counts.selectExpr(*[f"{t} as {kind}" for kind, t in totals.items()]), kinds)
    columns: dict[str, str] = {}
    for kind in kinds:
        spec = LOGS[kind]
        columns |= {ratio: own_ratio(part, spec.total) for ratio, part in spec.ratios.items()}
        columns[spec.spike] = exceeds(totals[kind], spike_cut(stats[kind]))
    return with_expressions(counts, columns)


def kind_features(log: DataFrame, kind: str, settings: LogSettings = DEFAULTS) -> DataFrame:
    """AGG-1..4: the nine features of one kind of log."""
    schema.require_columns(log, kind)
    rows = _rows(dated(log, settings), [kind], settings)
    return _with_ratios_and_spikes(_per_user(rows, [kind]), [kind]).select(
        "user", *LOGS[kind].outputs
    )


def log_features(
    logs: DataFrame | Mapping[str, DataFrame],
    settings: LogSettings = DEFAULTS,
    kinds: Sequence[str] | None = None,
) -> DataFrame:
    """The 36 features per user (SCH-4..7, JON-1).

    ``logs`` is one table, whose columns decide which kinds it feeds unless
    ``kinds`` names them, or one table per kind. A table of ready features is
    passed through. Users absent from a log get 0 there, after that log's spike
    statistics were taken over the users present in it.
    """
    if isinstance(logs, DataFrame):
        log = dated(schema.canonical_names(logs), settings)
        chosen = list(kinds) if kinds else schema.matching_kinds(log.columns)
        if not chosen:
            return schema.ready_features(log)
        for kind in chosen:
            schema.require_columns(log, kind)
        rows = _rows(log, chosen, settings)
    else:
        named = {
            k: schema.require_columns(dated(schema.canonical_names(l), settings), k)
            for k, l in logs.items()
        }
        chosen = [k for k in fixed.LOG_KINDS if k in named and (kinds is None or k in kinds)]
        rows = reduce(
            lambda a, b: a.unionByName(b, allowMissingColumns=True),
            [_rows(named[k], [k], settings) for k in chosen],
        )
    features = _with_ratios_and_spikes(_per_user(rows, chosen), chosen)
    return schema.model_columns(schema.add_missing(features)).fillna(0)


def merge_features(frames: Sequence[DataFrame], key: str = "user") -> DataFrame:
    """JON-1 for feature tables that already exist: one row per user of any table.

    A full outer join on a unique key, written as one union and one ``groupBy``:
    a chain of outer joins would shuffle again after every join, because the
    merged key has no known partitioning.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    values = [c for c in stacked.columns if c != key]
    return stacked.groupBy(key).agg(*[F.max(c).alias(c) for c in values]).fillna(0)


# --- threat signals -----------------------------------------------------------


def max_multiplier(log: DataFrame) -> DataFrame:
    """AGG-5."""
    return _users(log).groupBy("user").agg(F.max("risk_multiplier").alias("risk_multiplier"))


def first_activity(
    log: DataFrame, critical: Sequence[str] | None = None, name: str = "activity"
) -> DataFrame:
    """AGG-7, or AGG-6 when ``critical`` limits the activities.

    First means earliest, ties broken by the text. The log is first reduced to
    one row per user and activity, where the aggregation buffer is a timestamp
    and hashing applies; picking the text by date runs on that small rest.
    """
    rows = _users(log).where(F.col("activity").isNotNull())
    if critical is not None:
        rows = rows.where(critical_activity("activity", critical))
    earliest = rows.groupBy("user", "activity").agg(F.min("date").alias("date"))
    return earliest.groupBy("user").agg(
        F.min_by("activity", F.struct("date", "activity")).alias(name)
    )


def threat_signals(log: DataFrame, settings: LogSettings = DEFAULTS) -> DataFrame:
    """Highest multiplier and first (critical) activity per user, in one scan."""
    has_activity = "activity" in log.columns
    partial = []
    if has_activity:
        partial.append(F.min("date").alias("date"))
    if "risk_multiplier" in log.columns:
        partial.append(F.max("risk_multiplier").alias("risk_multiplier"))
    if not partial:
        return _users(log).select("user").distinct()
    keys = ["user", *(["activity"] if has_activity else [])]
    reduced = _users(log).groupBy(*keys).agg(*partial)
    signals = []
    if "risk_multiplier" in log.columns:
        signals.append(F.max("risk_multiplier").alias("risk_multiplier"))
    if has_activity:
        order = F.struct("date", "activity")
        known = F.col("activity").isNotNull()
        critical = F.expr(critical_activity("activity", settings.critical_activities))
        signals.append(
            F.coalesce(
                F.min_by("activity", F.when(critical, order)),
                F.min_by("activity", F.when(known, order)),
            ).alias("activity")
        )
    return reduced.groupBy("user").agg(*signals)


def signal_events(
    logs: Sequence[DataFrame], settings: LogSettings = DEFAULTS
) -> DataFrame | None:
    """User, date, activity and multiplier of all events of the logs that have them."""
    wanted = ("user", "date", "activity", "risk_multiplier")
    frames = []
    for log in map(schema.canonical_names, logs):
        present = [c for c in wanted if c in log.columns]
        if "user" in present and ({"date", "activity"} <= {*present} or "risk_multiplier" in present):
            frames.append(dated(log.select(*present), settings))
    if not frames:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def forward_signals(
    features: DataFrame, log: DataFrame, settings: LogSettings = DEFAULTS
) -> DataFrame:
    """SCR-12: put the signals of the raw log onto the user features.

    Columns that the features already carry are kept and not joined again.
    """
    signals = threat_signals(log, settings)
    new = [c for c in signals.columns if c != "user" and c not in features.columns]
    return join_left(features, signals.select("user", *new)) if new else features


def join_left(left: DataFrame, right: DataFrame, key: str = "user", suffix: str = "") -> DataFrame:
    """JON-2, JON-3, JON-5: left join on the user; clashing names get the suffix."""
    clashes = {c: f"{c}{suffix}" for c in right.columns if c != key and c in left.columns}
    if clashes and not suffix:
        raise ValueError(f"columns on both sides: {sorted(clashes)}")
    return left.join(right.withColumnsRenamed(clashes), on=key, how="left")


def fill_from(
    df: DataFrame, lookup: DataFrame, column: str, source: str | None = None, key: str = "user"
) -> DataFrame:
    """JON-4: fill gaps of one column from a table with one row per key."""
    found = lookup.select(key, F.col(source or column).alias("_found"))
    return (
        df.join(found, on=key, how="left")
        .withColumn(column, F.coalesce(F.col(column), F.col("_found")))
        .drop("_found")
    )


def _users(log: DataFrame) -> DataFrame:
    return log.where(F.col("user").isNotNull())
