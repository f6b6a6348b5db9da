"""Features from user profiles (PIL-A..G, TRN-1, DRV-1..9).

Every population statistic of the five pillars depends on the input columns
only, so one summary and one quantile pass serve all of them; the features are
then plain columns on the same table, with no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from .. import fixed
from ..functions import (
    as_flag,
    as_whole,
    by_cuts,
    clip,
    col,
    number,
    product_of,
    safe_ratio,
    weighted_sum,
    with_expressions,
)
from .schema import keep_last
from .statistics import (
    add_quantile_flags,
    exceeds,
    quantiles,
    robust_scale,
    standard_score,
    summarize,
    unit_range,
    without_nan,
)

_FORMS = {
    "sigma": lambda c: f"{clip(c, 0.0, 5.0)} / 5",
    "unit": lambda c: clip(c, 0.0, 1.0),
    "plain": lambda c: c,
}


def _filled(name: str) -> str:
    return f"coalesce(cast({name} as double), {number(fixed.OPTIONAL_INPUTS.get(name, 0.0))})"


class ProfileFeatures:
    """Columns of the profile features over one fitted population."""

    def __init__(self, profile: DataFrame, pillars: Iterable[str] = fixed.PILLARS):
        present = profile.columns
        absent = {c: number(v) for c, v in fixed.OPTIONAL_INPUTS.items() if c not in present}
        self.profile = without_nan(with_expressions(profile, absent), {*present, *absent})
        self._wanted = self._closure([f for p in pillars for f in fixed.PILLARS[p]])
        self._fit()

    @staticmethod
    def _closure(features: Iterable[str]) -> set[str]:
        """The features and all features they are built from."""
        todo, wanted = list(features), set()
        while todo:
            name = todo.pop()
            if name in wanted:
                continue
            wanted.add(name)
            todo += [f for _, f, _ in fixed.COMPOSITES.get(name, ())]
            todo += fixed.CHAINS.get(name, ())
        return wanted

    def _fit(self) -> None:
        zscores = {o: c for o, c in fixed.PROFILE_ZSCORES.items() if o in self._wanted}
        flags = {o: cp for o, cp in fixed.PROFILE_QUANTILE_FLAGS.items() if o in self._wanted}
        inputs = set(zscores.values()) | {c for c, _ in flags.values()}
        # The rate behind bcc_abuse_flag keeps its gaps, in values and quantile.
        population = self.profile.selectExpr(
            *[c if c == "bcc_usage_rate" else f"{_filled(c)} as {c}" for c in sorted(inputs)]
        )
        self._spread = summarize(population, zscores.values())
        cuts = quantiles(population, {c: [p] for c, p in flags.values()})
        self._cuts = {o: cuts[c][p] for o, (c, p) in flags.items()}

    def column(self, name: str) -> str:
        """One feature, in terms of the input columns."""
        if name in fixed.PROFILE_ZSCORES:
            source = fixed.PROFILE_ZSCORES[name]
            return standard_score(_filled(source), self._spread[source])
        if name in fixed.PROFILE_QUANTILE_FLAGS:
            source, _ = fixed.PROFILE_QUANTILE_FLAGS[name]
            raw = source if source == "bcc_usage_rate" else _filled(source)
            return exceeds(raw, self._cuts[name])
        if name in fixed.COUNT_FLAGS:
            source, count = fixed.COUNT_FLAGS[name]
            return as_flag(f"{_filled(source)} > {count}")
        if name in fixed.COPIED:
            return _filled(fixed.COPIED[name])
        if name in fixed.FILE_SHARES:
            return safe_ratio(_filled(fixed.FILE_SHARES[name]), _filled("total_files_copied"))
        if name == "off_hours_email_ratio":
            sent = product_of([_filled("emails_sent_per_day"), _filled("active_days")])
            return safe_ratio(_filled("emails_sent_off_hours"), sent)
        if name == "risky_filetype_score":
            return clip(self._shares("filetype_exe", "filetype_zip"), 0.0, 1.0)
        if name == "sensitive_doc_ratio":
            return clip(self._shares("filetype_pdf", "filetype_doc"), 0.0, 1.0)
        raise KeyError(name)

    @staticmethod
    def _shares(*types: str) -> str:
        total = _filled("total_files_copied")
        return weighted_sum([(1.0, safe_ratio(_filled(t), total)) for t in types])

    def table(self) -> DataFrame:
        """The profile with the wanted features, each computed once.

        Features go on in three layers, so that composites read the columns
        below them and products read the composites. Several of them replace
        an input, which the first layer no longer needs by then.
        """
        nested = [c for c in fixed.COMPOSITES if c in self._wanted]
        first = [f for f in self._ordered() if f not in fixed.COMPOSITES and f not in fixed.CHAINS]
        df = keep_last(self.profile, {f: self.column(f) for f in first})
        plain = [c for c in nested if not any(f in fixed.COMPOSITES for _, f, _ in fixed.COMPOSITES[c])]
        df = keep_last(df, {c: composite(c) for c in plain})
        chains = [c for c in fixed.CHAINS if c in self._wanted]
        return keep_last(
            df,
            {
                **{c: product_of(fixed.CHAINS[c]) for c in chains},
                **{c: composite(c) for c in nested if c not in plain},
            },
        )

    def _ordered(self) -> list[str]:
        return [f for p in fixed.PILLARS.values() for f in p if f in self._wanted]


def composite(name: str) -> str:
    """A weighted sum of features, clipped to [0, 1]."""
    parts = [(w, _FORMS[form](f)) for w, f, form in fixed.COMPOSITES[name]]
    return clip(weighted_sum(parts), 0.0, 1.0)


def pillar(profile: DataFrame, name: str) -> DataFrame:
    """PIL-A..F: the user and the columns of one pillar."""
    return ProfileFeatures(profile, [name]).table().select("user", *fixed.PILLARS[name])


def profile_features(profile: DataFrame) -> DataFrame:
    """PIL-G: the profile with all 54 features, 16 of them robustly scaled."""
    features = ProfileFeatures(profile)
    return robust_scale(features.table())


# --- training layout ----------------------------------------------------------

def training_layout(
    profile: DataFrame, quantile: float = fixed.TRAINING_SPIKE_QUANTILE
) -> DataFrame:
    """TRN-1: the 36 log features read off a profile, with the label if present."""
    sums = {
        "login_count": "after_hours_logons + weekend_logons",
        "sensitive_file_access": "filetype_pdf + filetype_doc",
        "external_count": as_whole("external_emails_ratio * emails_sent_per_day"),
        "after_hours_file_access": "after_hours_file_copy_ratio * total_files_copied",
    }
    label = ["label"] if "label" in profile.columns else []
    base = profile.selectExpr(
        "`user`",
        *[f"{e} as {t}" for t, e in {**fixed.TRAINING_COPIES, **sums, **fixed.TRAINING_CONSTANTS}.items()],
        *label,
    )
    ratios = {t: safe_ratio(part, whole) for t, (part, whole) in fixed.TRAINING_RATIOS.items()}
    spikes = {t: (c, quantile) for t, c in fixed.TRAINING_SPIKES.items()}
    return add_quantile_flags(with_expressions(base, ratios), spikes).select(
        "user", *fixed.LOG_FEATURES, *label
    )


# --- derived columns (inferred from published data) ---------------------------


def log1p_columns(df: DataFrame, columns: Sequence[str] = fixed.LOG1P_COLUMNS) -> DataFrame:
    """DRV-1."""
    return with_expressions(df, {f"{c}_log": f"log1p({col(c)})" for c in columns})


# DRV-2..7, as (weight, column) sums or plain expressions.
DERIVED = {
    "after_hours_intensity": "after_hours_logons + emails_sent_off_hours"
    " + avg_after_hours_browsing_per_day * active_days",
    "file_risk_composite": weighted_sum(
        [(3.0, "filetype_exe"), (2.0, "filetype_zip"), (10.0, "after_hours_file_copy_ratio")]
    ),
    "email_exfil_score": product_of(
        ["external_emails_ratio", "emails_sent_per_day", "attachment_count_avg"]
    ),
    "device_anomaly_score": weighted_sum(
        [(1.0, "late_hour_device_use"), (2.0, "missing_disconnects"), (1.0, "distinct_pcs_used")]
    ),
    "logon_suspicion": weighted_sum(
        [(1.0, "after_hours_logons"), (1.0, "weekend_logons"), (2.0, "logons_on_other_user_pcs")]
    ),
    "total_risk_score": weighted_sum([(1.0, f"risk_score_{i}") for i in range(1, 6)]),
}


def add_derived(df: DataFrame, names: Sequence[str] = tuple(DERIVED)) -> DataFrame:
    return with_expressions(df, {n: DERIVED[n] for n in names})


def published_risk_score(df: DataFrame, anomaly: str = "anomaly_score") -> DataFrame:
    """DRV-8: reversed min-max of the anomaly score, times 100."""
    stats = summarize(df, [anomaly], ("lo", "hi"))[anomaly]
    low, high = stats["lo"], stats["hi"]
    bounds = (None, None) if low is None else (-high, -low)
    return with_expressions(df, {"risk_score": f"{unit_range(f'-{col(anomaly)}', *bounds)} * 100"})


def published_risk_level(
    df: DataFrame,
    score: str = "risk_score",
    cuts: Sequence[tuple[str, float]] = fixed.PUBLISHED_LEVEL_CUTS,
) -> DataFrame:
    """DRV-9: fixed cuts."""
    return with_expressions(df, {"risk_level": by_cuts(col(score), cuts, "Low")})
