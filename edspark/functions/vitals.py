"""Column helpers for vital signs: tolerant JSON, key fallbacks, sanitising,
shock index and structured model features (Q1, Q2, P17, M1-M3, U2, M26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edspark.schemas import (
    ARRIVAL_MODE_CODES,
    ARRIVAL_MODE_DEFAULT,
    KIOSK_CONSTANTS,
    KIOSK_DEFAULTS,
    MEDIAN_VITALS,
    STRUCTURED_COLUMNS,
    VALID_RANGES,
    VITALS_STRUCT,
    ZERO_IS_MISSING,
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_vitals(text) -> Column:
    """Q1: JSON text -> struct of nullable doubles; null, malformed or
    non-object text gives a struct whose fields are all null.

    A struct (not ``map<string,double>``) is used so one bad value does not
    null the whole record.
    """
    return F.from_json(_c(text), VITALS_STRUCT, {"mode": "PERMISSIVE"})


def first_present(*cols) -> Column:
    """Q2: first non-null value (the dashboard's ``safe_get``)."""
    return F.coalesce(*[_c(c) for c in cols])


def first_truthy(*cols) -> Column:
    """Python ``a or b or c``: null *and zero* fall through to the next
    value; the last value is returned as is."""
    cols = [_c(c) for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cols[:-1]], cols[-1])


def shock_index(hr, sbp, digits: int | None = None) -> Column:
    """M1: HR / SBP, null when HR is null or 0 or SBP is null or <= 0.
    ``digits=2`` is the service form, ``None`` the dashboard form."""
    from edspark.functions.rules import round_half_even

    hr, sbp = _c(hr), _c(sbp)
    si = F.when((hr != 0) & (sbp > 0), hr / sbp)
    return round_half_even(si, digits) if digits is not None else si


def sanitize_value(value, key: str) -> Column:
    """M2 for one key: missing / negative (/ zero for the seven vitals) ->
    median; otherwise clamp into the valid range."""
    v = _c(value).cast("double")
    median = F.lit(MEDIAN_VITALS[key])
    bad = v.isNull() | (v < 0)
    if key in ZERO_IS_MISSING:
        bad = bad | (v == 0)
    lo, hi = VALID_RANGES[key]
    return F.when(bad, median).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def sanitize_vitals(vitals) -> Column:
    """M2 + U2 on a vitals struct: the ten canonical keys are sanitised, every
    other field (``ArrivalMode``, ``O2_Sat``, ``patient_id``) is copied through
    unchanged."""
    s = _c(vitals)
    canonical = [sanitize_value(s[k], k).alias(k) for k in MEDIAN_VITALS]
    others = [s[f.name].alias(f.name) for f in VITALS_STRUCT.fields if f.name not in MEDIAN_VITALS]
    return F.struct(*canonical, *others)


def merge_vitals_map(raw_map, sanitized_struct) -> Column:
    """U2 in map form: keys of ``raw_map`` that are not canonical are kept,
    canonical keys come from the sanitised struct and win."""
    canon = list(MEDIAN_VITALS)
    kept = F.map_filter(_c(raw_map), lambda k, _v: ~k.isin(canon))
    s = _c(sanitized_struct)
    sanitized = F.create_map(*[x for k in canon for x in (F.lit(k), s[k])])
    return F.map_concat(kept, sanitized)


def arrival_mode_code(mode, passthrough=None) -> Column:
    """M3: arrival text -> 1..4 (unknown text -> 3); empty/null text falls back
    to a numeric ``ArrivalMode`` already in the vitals, else 3."""
    m = _c(mode)
    mapped = F.create_map(*[x for k, v in ARRIVAL_MODE_CODES.items() for x in (F.lit(k), F.lit(v))])
    from_text = F.coalesce(mapped[m], F.lit(ARRIVAL_MODE_DEFAULT))
    fallback = _c(passthrough) if passthrough is not None else F.lit(None).cast("double")
    return (F.when(m.isNotNull() & (m != ""), from_text)
            .otherwise(F.coalesce(fallback, F.lit(ARRIVAL_MODE_DEFAULT))))


def structured_features(sanitized, arrival_mode) -> Column:
    """M3: fixed nine-column struct in model order; Pulse falls back to HR and
    Resp to RR with Python truthiness (after sanitising Pulse/Resp are always
    set, so the fallback only fires on unsanitised input)."""
    s = _c(sanitized)
    cols = {
        "Age": s["Age"],
        "Temp": s["Temp"],
        "Pulse": first_truthy(s["Pulse"], F.coalesce(s["HR"], F.lit(MEDIAN_VITALS["Pulse"]))),
        "Resp": first_truthy(s["Resp"], F.coalesce(s["RR"], F.lit(MEDIAN_VITALS["Resp"]))),
        "SBP": s["SBP"],
        "DBP": s["DBP"],
        "O2Sat": s["O2Sat"],
        "PainScale": s["PainScale"],
        "ArrivalMode": arrival_mode_code(arrival_mode, s["ArrivalMode"]),
    }
    return F.struct(*[cols[c].alias(c) for c in STRUCTURED_COLUMNS])


def kiosk_vitals(age, heart_rate, temperature, pain) -> Column:
    """Kiosk payload; 0 or empty age/pulse/temp take the defaults, the
    other vitals are fixed constants.  HR mirrors Pulse."""
    pulse = F.coalesce(F.nullif(_c(heart_rate).cast("double"), F.lit(0.0)), F.lit(KIOSK_DEFAULTS["Pulse"]))
    return F.struct(
        F.coalesce(F.nullif(_c(age).cast("double"), F.lit(0.0)), F.lit(KIOSK_DEFAULTS["Age"])).alias("Age"),
        pulse.alias("Pulse"),
        pulse.alias("HR"),
        F.coalesce(F.nullif(_c(temperature).cast("double"), F.lit(0.0)), F.lit(KIOSK_DEFAULTS["Temp"])).alias("Temp"),
        *[F.lit(v).alias(k) for k, v in KIOSK_CONSTANTS.items()],
        _c(pain).cast("double").alias("PainScale"),
    )
