"""Domain rule helpers, each ``Column -> Column`` and JVM-side (M4-M27, D2-D6,
R1-R3, X6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edspark import schemas as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_even(x, digits: int) -> Column:
    """Round the binary value of a double to ``digits`` (at most 3) decimals,
    halves to even, as Python's ``round`` does: 21/120 = 0.175 is a little
    below the half and gives 0.17.  ``x * 10^d`` would already round, so the
    half is decided without it: x is split into a part of 24 bits and the
    rest, whose products with ``2 * 10^d`` are exact; the first minus
    ``2n + 1`` is exact too where it is near zero, so the sign of the sum is
    that of ``2 * 10^d * x - (2n + 1)``."""
    p = float(10 ** digits)
    c = _c(x).cast("double")
    a = F.abs(c)
    n = F.floor(a * F.lit(p))
    high = a.cast("float").cast("double")
    over = (high * F.lit(2 * p) - (n * 2 + 1).cast("double")) + (a - high) * F.lit(2 * p)
    up = F.when((over > 0) | ((over == 0) & (n % 2 == 1)), F.lit(1)).otherwise(F.lit(0))
    # From 2^43 on a double has no third decimal that could be rounded.
    return F.when(a >= F.lit(2.0 ** 43), c).otherwise(F.signum(c) * (n + up).cast("double") / F.lit(p))


def code_map(mapping: dict) -> Column:
    """A literal ``map`` column from a fixed code table."""
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])


# ---- date / time -----------------------------------------------------------

def epoch_minutes(ts) -> Column:
    """D3: floor(epoch seconds / 60) as bigint."""
    return F.floor(F.unix_micros(_c(ts).cast("timestamp")) / F.lit(60_000_000)).cast("bigint")


def minutes_between(start, end) -> Column:
    """Whole minutes from ``start`` to ``end``, truncated toward zero."""
    micros = F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))
    return (micros / F.lit(60_000_000.0)).cast("int")


def iso_text(ts) -> Column:
    """ISO-8601 text like Python's ``isoformat``: six fraction digits
    when the microsecond part is non-zero, none otherwise."""
    t = _c(ts)
    whole = F.unix_micros(t.cast("timestamp")) % 1_000_000 == 0
    return (F.when(whole, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"))
            .otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))


def walkin_dob(age, as_of) -> Column:
    """1 January of (year of ``as_of`` - age)."""
    return F.make_date(F.year(_c(as_of)) - _c(age).cast("int"), F.lit(1), F.lit(1))


def time_features(ts) -> tuple[Column, Column]:
    """hour/24 and minute/60."""
    t = _c(ts)
    return F.hour(t) / F.lit(24.0), F.minute(t) / F.lit(60.0)


# ---- scoring and tokens ----------------------------------------------------

def priority_score(level, arrival) -> Column:
    """M4: (6 - level) * 100000 + epoch minutes of arrival.  Later arrivals
    score higher inside a level, as in the reference."""
    return (F.lit(6) - _c(level).cast("bigint")) * F.lit(100_000) + epoch_minutes(arrival)


def token_colour(level) -> Column:
    return F.coalesce(code_map(S.COLOR_MAP)[_c(level).cast("int")], F.lit(S.COLOR_DEFAULT))


def int_text(x) -> Column:
    """Integer text of a number, truncated toward zero (Python ``int``)."""
    return _c(x).cast("bigint").cast("string")


def zero_pad(x, width: int) -> Column:
    """``%0<width>d``: pads to ``width`` and, unlike ``lpad``, never cuts."""
    t = int_text(x)
    return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)


def token_text(level, sequence) -> Column:
    """``COL-nnnn``; pads to four digits but never cuts longer numbers."""
    return F.concat(token_colour(level), F.lit("-"), zero_pad(sequence, 4))


# ---- supervised output and routing ----------------------------------------

def pad_probs(probs, n: int = S.N_CLASSES) -> Column:
    """Right-pad a probability array with zeros to length ``n``."""
    p = _c(probs)
    return F.slice(F.concat(p, F.array_repeat(F.lit(0.0), n)), 1, F.greatest(F.size(p), F.lit(n)))


def argmax_level(probs) -> Column:
    """M5: 1-based index of the first maximum."""
    p = _c(probs)
    return F.array_position(p, F.array_max(p)).cast("int")


def route_action(confidence, level, policy_action) -> Column:
    """M6: policy action when confidence < 0.6 or predicted level is 3,
    otherwise the supervised mapping of the level."""
    lvl = _c(level)
    supervised = code_map(S.SUPERVISED_ACTION_BY_LEVEL)[lvl]
    use_policy = (_c(confidence) < S.CONFIDENCE_THRESHOLD) | (lvl == S.RL_LEVEL_INDEX + 1)
    return F.when(use_policy, _c(policy_action).cast("int")).otherwise(supervised).cast("int")


def route_source(confidence, level) -> Column:
    lvl = _c(level)
    use_policy = (_c(confidence) < S.CONFIDENCE_THRESHOLD) | (lvl == S.RL_LEVEL_INDEX + 1)
    return F.when(use_policy, F.lit("RL_Agent")).otherwise(F.lit("Supervised"))


def critical_miss(acuity, action) -> Column:
    """M7: acuity <= 2 routed to action 0 or 1."""
    return (_c(acuity) <= 2) & _c(action).isin(0, 1)


def over_triage(acuity, action, over_actions=(2, 3), low_levels=None) -> Column:
    """Low-acuity routed to a high-acuity area.  Default is the
    evaluation form (acuity >= 4, action 2 or 3); the audit form is
    ``over_actions=(3,), low_levels=(4, 5)``."""
    low = _c(acuity).isin(*low_levels) if low_levels else (_c(acuity) >= 4)
    return low & _c(action).isin(*over_actions)


def correct_allocation(acuity, action) -> Column:
    """M7: <=2 -> {2,3}; 3 -> 2; >=4 -> 1."""
    a, x = _c(acuity), _c(action)
    return (((a <= 2) & x.isin(2, 3)) | ((a == 3) & (x == 2)) | ((a >= 4) & (x == 1)))


def risk_score(o2sat, sbp) -> Column:
    """M9: 0.9 when O2Sat (default 100) < 90 or SBP (default 120) < 90."""
    low = (F.coalesce(_c(o2sat), F.lit(100.0)) < 90) | (F.coalesce(_c(sbp), F.lit(120.0)) < 90)
    return F.when(low, F.lit(0.9)).otherwise(F.lit(0.1))


def queue_occupancy(queue_len) -> Column:
    """[min(q,5)/5, min(max(q-5,0),5)/5, 0.2, 0.2]."""
    q = _c(queue_len).cast("double")
    return F.array(
        F.least(q, F.lit(5.0)) / 5.0,
        F.least(F.greatest(q - 5.0, F.lit(0.0)), F.lit(5.0)) / 5.0,
        F.lit(0.2),
        F.lit(0.2),
    )


def occupancy_ratios(waiting, critical, acute, fast) -> Column:
    """Counts normalised by the batch capacities."""
    return F.array(
        _c(waiting) / F.lit(S.CAPACITY["waiting"]),
        _c(critical) / F.lit(S.CAPACITY["occ_critical"]),
        _c(acute) / F.lit(S.CAPACITY["occ_acute"]),
        _c(fast) / F.lit(S.CAPACITY["occ_fast"]),
    )


def state_vector(probs, risk, occupancy, time_a, time_b) -> Column:
    """probs(5) + risk + zeros(10) + occupancy(4) + time(2) = 22 floats."""
    return F.concat(
        pad_probs(_c(probs).cast("array<double>")),
        F.array(_c(risk).cast("double")),
        F.array_repeat(F.lit(0.0), 10),
        _c(occupancy).cast("array<double>"),
        F.array(_c(time_a).cast("double"), _c(time_b).cast("double")),
    ).cast("array<float>")


# ---- audit labels -----------------------------------------------------------

def age_group(age) -> Column:
    """Null age falls through to the adult band."""
    a = _c(age)
    return (F.when(a < 18, F.lit(S.AGE_PEDIATRIC))
            .when(a > 65, F.lit(S.AGE_GERIATRIC))
            .otherwise(F.lit(S.AGE_ADULT)))


def sex_label(sex) -> Column:
    return F.coalesce(code_map(S.SEX_LABELS)[_c(sex).cast("int")], F.lit(S.SEX_DEFAULT))


def race_label(race) -> Column:
    return F.coalesce(code_map(S.RACE_LABELS)[_c(race).cast("int")], F.lit(S.RACE_DEFAULT))


# ---- handoff rules ----------------------------------------------------------

def trend_status(si) -> Column:
    """Rounded shock index > 0.7 -> deteriorating."""
    return F.when(_c(si) > S.SHOCK_WARNING, F.lit("deteriorating")).otherwise(F.lit("stable"))


def alert_messages(name, si, hr, sbp, o2) -> Column:
    """Ordered alert texts (shock, tachycardia, hypotension, hypoxia);
    zero readings count as absent.  Returns ``array<string>``."""
    n, h, b, o = _c(name), _c(hr), _c(sbp), _c(o2)
    h_ok = h.isNotNull() & (h != 0)
    b_ok = b.isNotNull() & (b != 0)
    o_ok = o.isNotNull() & (o != 0)
    msgs = F.array(
        F.when(_c(si) > S.SHOCK_CRITICAL, F.format_string(S.ALERT_SHOCK, n, _c(si).cast("string"))),
        F.when(h_ok & (h > S.HR_TACHY), F.format_string(S.ALERT_TACHYCARDIA, n, int_text(h))),
        F.when(b_ok & (b < S.SBP_HYPO), F.format_string(S.ALERT_HYPOTENSION, n, int_text(b))),
        F.when(o_ok & (o < S.O2_HYPOXIA), F.format_string(S.ALERT_HYPOXIA, n, int_text(o))),
    )
    return F.filter(msgs, lambda m: m.isNotNull())


def vitals_summary(hr, sbp, o2, rr, has_vitals) -> Column:
    """Non-empty parts joined by `` | ``; "No vitals" when none and
    "No vitals recorded" when the visit has no vitals at all."""
    def part(v, prefix, suffix=""):
        c = _c(v)
        return F.when(c.isNotNull() & (c != 0), F.concat(F.lit(prefix), int_text(c), F.lit(suffix)))
    joined = F.concat_ws(" | ", part(hr, "HR "), part(sbp, "BP "), part(o2, "O2 ", "%"), part(rr, "RR "))
    return (F.when(~_c(has_vitals), F.lit(S.NO_VITALS_RECORDED))
            .when(joined == "", F.lit(S.NO_VITALS))
            .otherwise(joined))


def visit_status(action) -> Column:
    """Bed or fast-track actions start the visit."""
    return (F.when(_c(action).isin("Assign to Bed", "Direct to Fast Track"), F.lit("IN_PROGRESS"))
            .otherwise(F.lit("SCHEDULED")))


def shock_band(si) -> Column:
    """Bands at the 0.7 and 1.0 reference lines."""
    s = _c(si)
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(s > S.SHOCK_CRITICAL, F.lit(">1.0"))
            .when(s > S.SHOCK_WARNING, F.lit(">0.7"))
            .otherwise(F.lit("normal")))


def bed_load(n_patients) -> Column:
    """min(n + 8, 20) / 20."""
    return F.least(_c(n_patients) + S.BED_BASE, F.lit(S.BED_CAPACITY)) / F.lit(float(S.BED_CAPACITY))


def bed_band(load) -> Column:
    lv = _c(load)
    out = F.lit(S.BED_BAND_DEFAULT)
    for limit, label in reversed(S.BED_BANDS):
        out = F.when(lv > limit, F.lit(label)).otherwise(out)
    return out


def arrival_severity(level) -> Column:
    """<=2 critical, 3 warning, else none."""
    lv = _c(level)
    return F.when(lv <= 2, F.lit("critical")).when(lv == 3, F.lit("warning"))


def wait_text(minutes, level) -> Column:
    """Minutes if non-zero, else the band text of the level, else the
    default sentence."""
    m = _c(minutes)
    minutes_text = F.format_string(S.WAIT_MINUTES_TEMPLATE, m.cast("int"))
    return F.when(m.isNotNull() & (m != 0), minutes_text).otherwise(
        F.coalesce(code_map(S.WAIT_ESTIMATES)[_c(level).cast("int")], F.lit(S.WAIT_TEXT_DEFAULT)))


def decision_reward(action, acuity, area_full) -> Column:
    """Reward of one logged decision.  ``area_full`` is whether the
    target area was at capacity before the assignment."""
    a, y, full = _c(action), _c(acuity), F.coalesce(_c(area_full), F.lit(False))
    cost = lambda c: F.when(full, F.lit(c)).otherwise(F.lit(0))
    wait = F.when(y <= 2, F.lit(S.REWARD_WAIT_MISSED)).otherwise(F.lit(S.REWARD_WAIT))
    critical = F.when(y >= 4, F.lit(S.REWARD_CRITICAL_WASTED)).otherwise(F.lit(S.REWARD_CRITICAL)) - cost(S.COST_CRITICAL_FULL)
    fast = F.when(y >= 4, F.lit(S.REWARD_FAST)).otherwise(F.lit(S.REWARD_FAST_MISSED)) - cost(S.COST_FAST_FULL)
    acute = (F.when(y.isin(2, 3), F.lit(S.REWARD_ACUTE)).when(y == 1, F.lit(S.REWARD_ACUTE_MISSED))
             .otherwise(F.lit(S.REWARD_ACUTE_WASTED)) - cost(S.COST_ACUTE_FULL))
    return (F.when(a == 0, wait).when(a == 3, critical).when(a == 1, fast)
            .when(a == 2, acute).when(a == 4, F.lit(S.REWARD_ESCALATE)).otherwise(F.lit(0))).cast("int")
