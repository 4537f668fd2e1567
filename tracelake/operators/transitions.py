"""Decision datasets: one row per step of a case, with action, mask and delayed reward."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.numbers import epoch
from ..plans.ranking import percentiles
from ..plans.sequence import ordered, segment_cases
from .cases import ORDER
from .clean import ACTIVITY, CASE, TIME
from .encode import PAD, encode_tokens


@dataclass(frozen=True)
class DecisionSpec:
    """What counts as an action, where it may be taken and how cases are rewarded."""

    # fixed values: default action names and the reward mode
    actions: tuple[str, ...] = ("do_nothing", "contact_headquarters")
    trigger: str = "contact_headquarters"
    noop: str = "do_nothing"
    default_valid: tuple[str, ...] = ("do_nothing",)
    by_last_activity: Mapping[str, Sequence[str]] = field(default_factory=dict)
    mode: str = "all"
    decision_activities: tuple[str, ...] = ()
    reward: str = "terminal_profit_delayed"
    intermediate_reward: float = 0.0
    inclusive: bool = False

    @property
    def trigger_id(self) -> int:
        if self.trigger in self.actions:
            return self.actions.index(self.trigger)
        others = [i for i, name in enumerate(self.actions) if name != self.noop]
        return others[0] if others else 0

    @property
    def noop_id(self) -> int:
        for name in (self.noop, "do_nothing", "NOOP"):
            if name in self.actions:
                return self.actions.index(name)
        return 0


def is_decision_point(last: Column, spec: DecisionSpec) -> Column:
    if spec.mode == "all":
        return F.lit(True)
    if spec.mode == "by_last_activity":
        return F.coalesce(last.isin(list(spec.decision_activities)), F.lit(False))
    return F.lit(False)


def action_mask(last: Column, spec: DecisionSpec) -> Column:
    """Valid actions after ``last``: unknown names are ignored, an all-zero list means the default."""

    def flags(names: Sequence[str]) -> list[int]:
        return [int(a in set(names)) for a in spec.actions]

    def lit(values: Sequence[int]) -> Column:
        return F.array(*[F.lit(v).cast("tinyint") for v in values])

    default = flags(spec.default_valid)
    out = None
    for name, valid in spec.by_last_activity.items():
        values = flags(valid)
        chosen = lit(values if any(values) else default)
        out = F.when(last == name, chosen) if out is None else out.when(last == name, chosen)
    return lit(default) if out is None else out.otherwise(lit(default))


def behavior_action(next_activity: Column, last: Column, spec: DecisionSpec) -> Column:
    """Logged action: the trigger follows (or, when inclusive, also just happened)."""
    hit = next_activity == spec.trigger
    if spec.inclusive:
        hit = hit | (last == spec.trigger)
    return F.when(hit, F.lit(spec.trigger_id)).otherwise(F.lit(spec.noop_id)).cast("int")


def steps(
    log: DataFrame, spec: DecisionSpec, outcome: tuple[str, Column], order: Sequence[str] = ORDER,
    max_len: int | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """Every consecutive pair of prefixes, before decision-point and mask filters.

    ``outcome`` is (fold, expression) over the case, e.g. ("max", flag). One window pass yields
    position, next event, terminal value, trigger count and, with ``max_len``, the token history.
    """
    timed = TIME in log.columns
    seq = ordered(
        log, order,
        lead={"next_activity": F.col(ACTIVITY), **({"next_token": F.col("token_id")} if max_len else {}),
              **({"_next_ts": F.col(TIME)} if timed else {})},
        running={"n_trigger": F.when(F.col(ACTIVITY) == spec.trigger, 1).otherwise(0)},
        history={"_tokens": (F.col("token_id"), max_len)} if max_len else {},
        totals={"outcome": outcome},
    ).where(F.col("t") < F.col("n_events"))
    done = (F.col("t") + 1 == F.col("n_events")).cast("tinyint")
    if spec.reward == "terminal_profit_delayed":
        r = F.when(done == 1, F.coalesce(F.col("outcome").cast("double"), F.lit(0.0))).otherwise(F.lit(float(spec.intermediate_reward)))
    else:
        r = F.lit(0.0)
    valid = action_mask(F.col(ACTIVITY), spec)
    a = behavior_action(F.col("next_activity"), F.col(ACTIVITY), spec)
    cols = [CASE, "t", "n_events", F.col(ACTIVITY).alias("last_activity"), "next_activity", "n_trigger",
            is_decision_point(F.col(ACTIVITY), spec).alias("decision_point"), a.alias("a"), valid.alias("valid_actions"),
            r.alias("r"), done.alias("done"), F.lit(-1.0).alias("propensity"),
            F.coalesce(F.col("outcome").cast("double"), F.lit(0.0)).alias("outcome"), *carry]
    if timed:
        cols += [epoch(F.col(TIME)).alias("ts_last"), epoch(F.col("_next_ts")).alias("ts_next")]
    if max_len:
        cols += ["_tokens", "next_token"]
    return seq.select(*cols)


def build_transitions(
    log: DataFrame, spec: DecisionSpec, outcome: tuple[str, Column], vocab: DataFrame | None = None,
    max_len: int = 50, order: Sequence[str] = ORDER, padding: str = "left", carry: Sequence[str] = (),
) -> DataFrame:
    """Kept transitions. With ``vocab`` the state arrays s, s_mask, s_next, s_next_mask are added.

    The next state is the history plus one token, so arrays cross the shuffle never and the window
    holds each once. Columns a query does not read are pruned with their expressions.
    """
    base = encode_tokens(log, vocab) if vocab is not None else log
    kept = steps(base, spec, outcome, order, max_len if vocab is not None else None, carry).where(
        F.col("decision_point") & (A.at(F.col("valid_actions"), F.col("a")) == 1)).drop("decision_point")
    kept = kept.withColumn("behavior_action", F.col("a"))
    if vocab is None:
        return kept
    nxt = A.last_n(F.concat("_tokens", F.array("next_token")), max_len)
    return kept.withColumns({
        "s": A.pad(F.col("_tokens"), max_len, padding, PAD), "s_mask": A.pad_mask(F.size("_tokens"), max_len, padding),
        "s_next": A.pad(nxt, max_len, padding, PAD), "s_next_mask": A.pad_mask(F.size(nxt), max_len, padding),
    }).drop("_tokens", "next_token")


def drop_counts(all_steps: DataFrame) -> DataFrame:
    """One row: steps, dropped by decision point, dropped by mask, cases whose terminal step was dropped."""
    allowed = A.at(F.col("valid_actions"), F.col("a")) == 1
    kept = F.col("decision_point") & allowed
    return all_steps.agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(~F.col("decision_point")).alias("n_not_decision"),
        F.count_if(F.col("decision_point") & ~allowed).alias("n_masked"), F.count_if(kept).alias("n_kept"),
        F.count_if((F.col("done") == 1) & ~kept).alias("n_lost_terminal"))


def transition_violations(tr: DataFrame, n_actions: int) -> DataFrame:
    """One row of violation counts; all zero on a sound dataset."""
    return tr.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.size("valid_actions") != n_actions).alias("bad_mask_width"),
        F.count_if(~F.col("a").between(0, n_actions - 1)).alias("action_out_of_range"),
        F.count_if(F.coalesce(A.at(F.col("valid_actions"), F.col("a")), F.lit(0)) != 1).alias("invalid_action"),
        F.count_if(~F.col("done").isin(0, 1)).alias("bad_done"),
        F.count_if(F.col("t") < 0).alias("negative_t"))


def transition_stats(tr: DataFrame) -> DataFrame:
    """One row: counts, terminal share, reward moments (population) and terminal percentiles."""
    r, done = F.col("r").cast("double"), F.col("done") == 1
    # with one distinct column Spark groups by case first and merges the other partial results, the deviation's too
    agg = tr.agg(
        F.count(F.lit(1)).alias("n_transitions"), F.count_distinct(CASE).alias("n_cases"), F.sum(F.col("done").cast("long")).alias("d"),
        F.avg(r).alias("reward_mean"), F.stddev_pop(r).alias("reward_std"),
        F.count_if(~done & (r == 0)).alias("z"), F.count_if(done & (r != 0)).alias("nz"))
    n = F.col("n_transitions").cast("double")
    pct = percentiles(tr.where(done).select(r.alias("r")), "r", {"terminal_p50": 0.5, "terminal_p95": 0.95})
    tail = pct.select(F.struct("terminal_p50", "terminal_p95").alias("p")).scalar()
    return agg.withColumn("_p", tail).select(
        "n_transitions", "n_cases", (100.0 * F.col("d") / n).alias("done_pct"), "reward_mean", "reward_std",
        F.col("_p.terminal_p50").alias("terminal_p50"), F.col("_p.terminal_p95").alias("terminal_p95"),
        (100.0 * F.try_divide(F.col("z").cast("double"), n - F.col("d"))).alias("nonterminal_zero_pct"),
        (100.0 * F.try_divide(F.col("nz").cast("double"), F.col("d").cast("double"))).alias("terminal_nonzero_pct"))


def feedback_transitions(
    feedback: DataFrame, features: Sequence[str], min_cases: int = 1, terminal: str = "drop",
    case: str = CASE, order: Sequence[str] = ("t",), max_rows: int = 1_000_000,
) -> DataFrame:
    """Consecutive feedback rows as transitions on the executed action.

    Cases need two rows; ``terminal="emit"`` also keeps the last row with no next state. Fewer than
    ``min_cases`` usable cases yield an empty result.
    """
    vector = F.array(*[F.coalesce(F.try_element_at(F.col("state_features"), F.lit(f)), F.lit(0.0)) for f in features])
    base = segment_cases(feedback.withColumn("s", vector), case, "t", max_rows, order)
    seq = ordered(base, order, case, lead={"s_next": F.col("s"), "_next_t": F.col("t")}, position="_pos", count="n_rows")
    usable = seq.where(F.col("n_rows") >= 2)
    if terminal == "drop":
        usable = usable.where(F.col("_next_t").isNotNull())
    done = F.coalesce(F.col("done"), F.lit(False))
    out = usable.select(
        case, "t", "s", "s_next", F.col("action_executed").cast("int").alias("a"),
        F.when(done, F.coalesce(F.col("reward").cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("r"),
        done.cast("tinyint").alias("done"))
    if min_cases > 1:
        many = feedback.groupBy(case).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") >= 2).alias("c"))
        out = out.withColumn("_c", many.scalar()).where(F.col("_c") >= min_cases).drop("_c")
    return out
