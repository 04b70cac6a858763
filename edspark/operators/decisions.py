"""Hybrid routing, evaluation and audit (P16, R1, R2, R3, M5-M8, M11, M12,
M13, M22, M23, A8-A12, A18, J5, J7, T8, L7).

Everything is per-row column arithmetic or a small grouped aggregate; the
only wide dependency is the key join of ``fairness_input``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edspark import schemas as S
from edspark.functions import rules as R
from edspark.operators.sequence import BROADCAST_ROWS, clamped_sum, ordered_sequence
from edspark.session import ensure_checkpoint_dir


def prob_array(df: DataFrame, prefix: str = "prob_class_") -> DataFrame:
    """Gather ``prob_class_*`` columns (in the frame's order) into ``probs``;
    uniform 0.2 when there are none (R2)."""
    cols = [c for c in df.columns if prefix in c]
    probs = F.array(*[F.col(c).cast("double") for c in cols]) if cols else F.array_repeat(F.lit(0.2), S.N_CLASSES)
    return df.withColumn("probs", probs)


def hybrid_decisions(inp: DataFrame, probs: str = "probs", acuity: str = "acuity",
                     policy: str = "policy_action", key: str = "row_id") -> DataFrame:
    """Supervised level and confidence from padded
    probabilities (fallback vector when missing), routed to the policy action
    when uncertain or level 3, else mapped from the level; evaluation flag."""
    p = R.pad_probs(F.coalesce(F.col(probs).cast("array<double>"),
                               F.array(*[F.lit(x) for x in S.FALLBACK_PROBS])))
    truth = F.col(acuity).cast("int") if acuity in inp.columns else F.lit(3)  # R2: acuity 3 when absent
    d = inp.select(F.col(key).alias("row_id"), truth.alias("ESI"),
                   F.col(policy).alias("__policy"), p.alias("__p"))
    d = d.withColumn("Sup_Pred", R.argmax_level("__p")).withColumn("Sup_Conf", F.array_max("__p"))
    return d.select(
        "row_id", "ESI", "Sup_Pred", "Sup_Conf",
        R.route_source("Sup_Conf", "Sup_Pred").alias("Source"),
        R.route_action("Sup_Conf", "Sup_Pred", "__policy").alias("Final_Action"),
    ).withColumn("Is_Critical_Miss", R.critical_miss("ESI", "Final_Action"))


def policy_observation(inp: DataFrame, probs: str = "probs", risk: str | None = None) -> DataFrame:
    """The 22-float observation the policy sees in batch mode:
    padded probabilities, risk (0.5 when absent), ten zeros, the fixed batch
    occupancy ratios and time placeholders 0.5, 0.5."""
    st = S.BATCH_ED_STATE
    occ = R.occupancy_ratios(F.lit(float(st["waiting"])), F.lit(float(st["occ_critical"])),
                             F.lit(float(st["occ_acute"])), F.lit(float(st["occ_fast"])))
    rk = F.col(risk) if risk and risk in inp.columns else F.lit(0.5)
    return inp.withColumn("observation", R.state_vector(F.col(probs), rk, occ, F.lit(0.5), F.lit(0.5)))


def decision_flags(dec: DataFrame) -> DataFrame:
    """M7: per-row evaluation flags."""
    return dec.select(
        "row_id", "ESI", "Final_Action",
        R.critical_miss("ESI", "Final_Action").alias("critical_miss"),
        R.over_triage("ESI", "Final_Action").alias("over_triage"),
        R.correct_allocation("ESI", "Final_Action").alias("correct"))


def hybrid_metrics(dec: DataFrame) -> DataFrame:
    """One row of totals and percentages; a rate is 0 when its
    denominator is 0."""
    m = dec.agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.count_if(F.col("Source") == "RL_Agent").alias("rl_interventions"),
        F.count_if(F.col("ESI") <= 2).alias("total_critical"),
        F.count_if(R.critical_miss("ESI", "Final_Action")).alias("critical_misses"),
        F.count_if(F.col("ESI") >= 4).alias("total_low_acuity"),
        F.count_if(R.over_triage("ESI", "Final_Action")).alias("over_triage"),
        F.count_if(R.correct_allocation("ESI", "Final_Action")).alias("correct"))

    def pct(num, den):
        return F.coalesce(F.try_divide(F.col(num) * 100.0, F.col(den)), F.lit(0.0))

    return m.select("*",
                    pct("rl_interventions", "total_patients").alias("rl_intervention_pct"),
                    pct("critical_misses", "total_critical").alias("critical_miss_rate"),
                    pct("over_triage", "total_low_acuity").alias("over_triage_rate"),
                    pct("correct", "total_patients").alias("accuracy"))


def action_names(dec: DataFrame, col: str = "Final_Action", codebook: dict = S.CHART_ACTIONS,
                 default: str = "Unknown", name: str = "Action_Name") -> DataFrame:
    """Code -> label through a fixed (broadcast) code table, with default."""
    table = dec.sparkSession.createDataFrame([(int(k), v) for k, v in codebook.items()],
                                             f"__code int, {name} string")
    return (dec.join(F.broadcast(table), F.col(col) == F.col("__code"), "left").drop("__code")
            .withColumn(name, F.coalesce(F.col(name), F.lit(default))))


def confusion_matrix(dec: DataFrame) -> DataFrame:
    """A10: share of each action inside each true level, chart column order,
    only the actions that occur."""
    counts = action_names(dec).groupBy("ESI", "Action_Name").agg(F.count(F.lit(1)).alias("n"))
    ensure_checkpoint_dir(dec.sparkSession)
    counts = counts.filter(F.col("Action_Name").isin(S.CHART_ORDER)).checkpoint()  # levels x actions rows
    present = {r[0] for r in counts.select("Action_Name").distinct().collect()}
    order = [c for c in S.CHART_ORDER if c in present]
    wide = counts.groupBy("ESI").pivot("Action_Name", order).agg(F.sum("n"))
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in order), F.lit(0))
    return wide.select("ESI", *[(F.coalesce(F.col(f"`{c}`"), F.lit(0)) / total).alias(c) for c in order])


def action_by_source(dec: DataFrame) -> DataFrame:
    """Counts by action and source."""
    return action_names(dec).groupBy("Action_Name", "Source").agg(F.count(F.lit(1)).alias("count"))


def safety_split(dec: DataFrame) -> DataFrame:
    """Safe vs missed among ESI 1-2 (safe = not action 0 or 1)."""
    return (dec.filter(F.col("ESI").isin(1, 2))
            .groupBy((~F.col("Final_Action").isin(0, 1)).alias("Is_Safe"))
            .agg(F.count(F.lit(1)).alias("count")))


def fairness_input(original: DataFrame, results: DataFrame, n: int | None = None) -> DataFrame:
    """Align two frames by ingest row id (an inner key join
    keeps exactly the shorter prefix when both ids are dense), drop the
    results' duplicate ESI, add age group, sex and race labels."""
    orig = original.filter(F.col("ESI").isNotNull())
    if n is not None:
        orig = orig.filter(F.col("row_id") < n)
    res = results.drop("ESI")
    df = orig.join(res, "row_id", "inner")
    df = df.withColumn("Age_Group", R.age_group("Age"))
    df = df.withColumn("Gender_Label", R.sex_label("Sex") if "Sex" in df.columns else F.lit("Unknown"))
    df = df.withColumn("Race_Label", R.race_label("Race") if "Race" in df.columns else F.lit("Unknown"))
    return df


def fairness_rates(df: DataFrame, groups: Sequence[str] = ("Age_Group", "Gender_Label", "Race_Label")) -> DataFrame:
    """Critical-miss rate among ESI 1-2 and strict over-triage rate
    (ESI 4/5 sent to 3) among ESI 4-5, x100, per subgroup of each dimension
    that has more than one value."""
    flags = df.select(
        *groups,
        F.col("ESI").isin(1, 2).alias("__crit"), F.col("ESI").isin(4, 5).alias("__low"),
        F.col("Is_Critical_Miss").cast("double").alias("__miss"),
        R.over_triage("ESI", "Final_Action", over_actions=(3,), low_levels=(4, 5)).cast("double").alias("__over"))
    long = flags.unpivot(["__crit", "__low", "__miss", "__over"], list(groups), "dimension", "group")
    per = long.groupBy("dimension", "group").agg(
        F.count_if("__crit").alias("n_critical"),
        (F.avg(F.when(F.col("__crit"), F.col("__miss"))) * 100).alias("critical_miss_rate"),
        F.count_if("__low").alias("n_low_acuity"),
        (F.avg(F.when(F.col("__low"), F.col("__over"))) * 100).alias("over_triage_rate"))
    several = F.count(F.lit(1)).over(Window.partitionBy("dimension"))  # over one row per subgroup
    return per.withColumn("__k", several).filter(F.col("__k") > 1).drop("__k")


AREA_BY_ACTION = {3: "critical", 2: "acute", 1: "fast"}


def decision_cost(dec: DataFrame, order_col: str = "row_id", discharges: DataFrame | None = None) -> DataFrame:
    """Reward of each logged decision under the environment's rules.
    ``area_full`` = the target area held its capacity before this assignment.
    Occupancy runs in log order and is kept within 0 and the capacity: who
    finds an area full is refused, and each row (``order_col``, ``area``) of
    ``discharges`` frees a place after the decision of its number."""
    area = F.create_map(*[x for k, v in AREA_BY_ACTION.items() for x in (F.lit(k), F.lit(v))])[F.col("Final_Action")]
    cap = F.create_map(*[x for v in AREA_BY_ACTION.values() for x in (F.lit(v), F.lit(S.CAPACITY[f"occ_{v}"]))])
    d = dec.withColumn("area", area)
    moves = d.filter(F.col("area").isNotNull()).select(F.col(order_col).alias("__at"), "area", F.lit(1).alias("__delta"))
    if discharges is not None:
        moves = moves.unionByName(discharges.select(F.col(order_col).alias("__at"), "area", F.lit(-1).alias("__delta")))
    occ = clamped_sum(moves, "__delta", 0, cap[F.col("area")], [F.col("__at"), F.desc("__delta")], ["area"], name="occupancy")
    occ = occ.filter(F.col("__delta") > 0).select(F.col("__at").alias(order_col), F.col("occupancy_held").alias("area_full"))
    out = d.join(occ, order_col, "left").withColumn("area_full", F.coalesce(F.col("area_full"), F.lit(False)))
    return out.withColumn("reward", R.decision_reward("Final_Action", "ESI", "area_full"))


def cost_by_policy(costed: DataFrame) -> DataFrame:
    """Total and mean reward per decision source."""
    return costed.groupBy("Source").agg(F.count(F.lit(1)).alias("decisions"),
                                        F.sum("reward").alias("total_reward"),
                                        F.avg("reward").alias("mean_reward"))


def policy_table(costed: DataFrame) -> DataFrame:
    """L7 (re-aimed): for each (predicted level, area-full flag), the logged
    action with the highest mean reward (ties -> lower action code)."""
    per = costed.groupBy("Sup_Pred", "area_full", "Final_Action").agg(
        F.avg("reward").alias("mean_reward"), F.count(F.lit(1)).alias("n"))
    best = per.groupBy("Sup_Pred", "area_full").agg(
        F.max_by(F.struct("Final_Action", "mean_reward", "n"),
                 F.struct(F.col("mean_reward"), -F.col("Final_Action"))).alias("b"))
    return best.select("Sup_Pred", "area_full", F.col("b.Final_Action").alias("best_action"),
                       F.col("b.mean_reward").alias("mean_reward"), F.col("b.n").alias("support"))


def logged_transitions(costed: DataFrame, state: Sequence[str], order_col: str = "row_id", episode: int = 100) -> DataFrame:
    """(state, action, reward, next_state) of each logged decision; a
    state is a struct of the given columns.  Every ``episode`` decisions in
    log order are an episode, whose last one has no next state.  The numbers
    come from range partitions, and a window holds one episode."""
    numbered = ordered_sequence(costed, [order_col], name="__n")
    held = numbered.select("__n", F.struct(*state).alias("state"), F.col("Final_Action").alias("action"), "reward",
                           F.floor((F.col("__n") - 1) / episode).alias("__episode"))
    following = F.lead("state").over(Window.partitionBy("__episode").orderBy("__n"))
    return held.select("state", "action", "reward", following.alias("next_state"))


MODEL_ROWS = 200_000  # of a transition model, in each of its partitions


def fitted_q(transitions: DataFrame, gamma: float = 0.99, sweeps: int = 100, tolerance: float = 1e-9, together: int = 5) -> DataFrame:
    """Fitted Q iteration over logged transitions: (state, action, n,
    value, best).  A sweep sets the value of a logged pair to the mean of
    reward + gamma * (largest value of the next state); a missing next state,
    or one without a logged action, is worth 0.  After k sweeps a value looks
    k decisions ahead; it ends after ``sweeps``, or once no state's value moved
    by more than ``tolerance`` over the sweeps of one plan.  ``best`` marks the largest value of a state
    (ties: the lowest action).

    The log is read once: a sweep needs only counts and reward sums by (state,
    action, next state), which are combined before the shuffle.  They are
    dealt by state for good, so both groupings of a sweep stay where the rows
    are and only the values by state travel, broadcast if their counted number
    allows.  ``together`` sweeps are one plan; then the values are written."""
    spark = transitions.sparkSession
    ensure_checkpoint_dir(spark)
    model = transitions.groupBy("state", "action", "next_state").agg(F.count(F.lit(1)).alias("n"), F.sum("reward").alias("reward"))
    model = model.checkpoint()
    model = model.repartition(math.ceil(model.count() / MODEL_ROWS) or 1, "state").checkpoint()
    few = model.select("state").distinct().count() <= BROADCAST_ROWS

    def swept(values: DataFrame) -> DataFrame:
        ahead = values.select(F.col("state").alias("next_state"), F.col("value").alias("__ahead"))
        joined = model.join(F.broadcast(ahead) if few else ahead, "next_state", "left")
        backed_up = F.sum(F.col("reward") + gamma * F.col("n") * F.coalesce("__ahead", F.lit(0.0))) / F.sum("n")
        return joined.groupBy("state", "action").agg(F.sum("n").alias("n"), backed_up.alias("value"))

    def largest(q: DataFrame) -> DataFrame:
        return q.groupBy("state").agg(F.max("value").alias("value"))

    values = model.select("state", F.lit(0.0).alias("value")).distinct().checkpoint()
    done = 0
    while done < sweeps - 1:
        k = min(together, sweeps - 1 - done)
        before = values.withColumnRenamed("value", "__before")
        for _ in range(k):
            values = largest(swept(values))
        values, done = values.checkpoint(), done + k
        moved = values.join(before, "state").agg(F.max(F.abs(F.col("value") - F.col("__before")))).first()[0]
        if (moved or 0.0) <= tolerance:
            break
    q = swept(values).checkpoint()
    top = q.groupBy("state").agg(F.max_by("action", F.struct(F.col("value"), -F.col("action"))).alias("__top"))
    return q.join(top, "state").select("state", "action", "n", "value", (F.col("action") == F.col("__top")).alias("best"))


def service_action_label(idx) -> F.Column:
    """Unknown index -> "Move to Waiting Room"."""
    return F.coalesce(R.code_map(S.SERVICE_ACTIONS)[idx], F.lit(S.SERVICE_ACTION_DEFAULT))
