"""What-if reports on the promised delivery date."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.columns import (
    IN_TRANSIT,
    ON_TIME,
    days_between,
    is_on_time,
    rate,
    share_where,
)
from lanewise.functions.reshape import rows_from

LANE = ("carrier", "ship_to_city")
# Shift names, rate labels and policy names stand in published marts.
SHIFTS = {"now": 0, "p1": 1, "p2": 2, "p3": 3, "m1": -1}
RATE_LABELS = {
    "m1": "tighten -1d",
    "now": "current",
    "p1": "relax +1d",
    "p2": "relax +2d",
    "p3": "relax +3d",
}
# (policy, shift, whether it is limited to the target lanes)
POLICIES = (
    ("current", "now", False),
    ("widen_broken_lanes_+1d", "p1", True),
    ("widen_broken_lanes_+2d", "p2", True),
    ("widen_broken_lanes_+3d", "p3", True),
    ("widen_all_lanes_+1d", "p1", False),
    ("widen_all_lanes_+2d", "p2", False),
    ("tighten_all_lanes_-1d", "m1", False),
)


def _zero_if_none(total: Column) -> Column:
    return F.coalesce(total, F.lit(0))


def in_lanes(lanes: Sequence[tuple[str, str]]) -> Column:
    """True on the given (carrier, destination) pairs: one lookup, however many they are."""
    pairs = [F.struct(F.lit(carrier), F.lit(city)) for carrier, city in lanes]
    return F.struct(*LANE).isin(pairs) if pairs else F.lit(False)


def with_flags(shipments: DataFrame, shifts: Mapping[str, int] = SHIFTS) -> DataFrame:
    """Add `ontime_<shift>` to shipments with a known outcome.

    Needs `delivery_status` and `delivery_delay_days`.
    """
    delay = F.col("delivery_delay_days")
    return shipments.filter(F.col("delivery_status") != IN_TRANSIT).withColumns(
        {f"ontime_{name}": is_on_time(delay, days) for name, days in shifts.items()}
    )


def with_delay_days(shipments: DataFrame, orders: DataFrame) -> DataFrame:
    """Shipment rows with the days against the promise and, if `orders` has it, the GMV."""
    extra = [c for c in ("order_gmv",) if c in orders.columns]
    return shipments.join(
        orders.select("order_id", "promised_delivery_date", *extra), "order_id", "left"
    ).select(
        *shipments.columns,
        days_between(F.col("delivered_at"), F.col("promised_delivery_date")).alias(
            "delivery_delay_days"
        ),
        *extra,
    )


def with_order_gmv(shipments: DataFrame, orders: DataFrame) -> DataFrame:
    """The shipment mart with the GMV of its order."""
    return shipments.join(orders.select("order_id", "order_gmv"), "order_id", "left")


def scenario_flags(shipments: DataFrame) -> DataFrame:
    """One row per evaluable shipment: on-time under each shift, and the order GMV."""
    return with_flags(shipments).select(
        "shipment_id",
        "order_id",
        *LANE,
        "delivery_status",
        "delivery_delay_days",
        *[f"ontime_{s}" for s in SHIFTS],
        "order_gmv",
    )


def scenario_label_mismatch(shipments: DataFrame) -> DataFrame:
    """Rows where the numeric rule and the label disagree; must be 0."""
    labelled = F.col("delivery_status") == ON_TIME
    return with_flags(shipments).agg(
        F.count_if(F.col("ontime_now") != labelled).alias("n_mismatch")
    )


def scenario_rates(shipments: DataFrame) -> DataFrame:
    """Market on-time rate under each shift."""
    shares = with_flags(shipments).agg(
        *[share_where(F.col(f"ontime_{s}")).alias(s) for s in RATE_LABELS]
    )
    return rows_from(
        shares,
        [
            {"scenario": F.lit(label), "ontime_rate": F.col(s)}
            for s, label in RATE_LABELS.items()
        ],
    )


def scenario_lanes(flags: DataFrame) -> DataFrame:
    """Per lane: shipments, GMV, and on-time rate and delayed GMV under each shift."""
    return (
        flags.filter(F.col("carrier").isNotNull() & F.col("ship_to_city").isNotNull())
        .groupBy(*LANE)
        .agg(
            F.count(F.lit(1)).alias("shipments"),
            _zero_if_none(F.sum("order_gmv")).alias("gmv"),
            *[share_where(F.col(f"ontime_{s}")).alias(f"ontime_{s}") for s in SHIFTS],
            *[
                _zero_if_none(F.sum(F.when(~F.col(f"ontime_{s}"), F.col("order_gmv")))).alias(
                    f"delayed_gmv_{s}"
                )
                for s in SHIFTS
            ],
        )
        .orderBy(F.desc("delayed_gmv_now"), *LANE)
    )


def scenario_sums(flags: DataFrame) -> DataFrame:
    """Shipments, GMV, on-time shipments and delayed GMV under each shift, per lane.

    Lanes without a name are kept. Sums of disjoint sets of shipments add up.
    """
    return flags.groupBy(*LANE).agg(
        F.count(F.lit(1)).alias("shipments"),
        _zero_if_none(F.sum("order_gmv")).alias("gmv"),
        *[F.count_if(f"ontime_{s}").alias(f"ontime_{s}") for s in SHIFTS],
        *[
            _zero_if_none(F.sum(F.when(~F.col(f"ontime_{s}"), F.col("order_gmv")))).alias(
                f"delayed_gmv_{s}"
            )
            for s in SHIFTS
        ],
    )


def lanes_of_sums(sums: DataFrame) -> DataFrame:
    """`scenario_lanes` from the sums."""
    return (
        sums.filter(F.col("carrier").isNotNull() & F.col("ship_to_city").isNotNull())
        .withColumns({f"ontime_{s}": rate(F.col(f"ontime_{s}"), F.col("shipments")) for s in SHIFTS})
        .orderBy(F.desc("delayed_gmv_now"), *LANE)
    )


def summary_of_sums(
    sums: DataFrame,
    targets: Sequence[tuple[str, str]],
    policies: Sequence[tuple[str, str, bool]] = POLICIES,
) -> DataFrame:
    """`scenario_summary` from the sums: each lane moves by its policy's shift."""
    targeted = in_lanes(targets)

    def of(column: str, shift: str, limited: bool) -> Column:
        moved, now = F.col(f"{column}_{shift}"), F.col(f"{column}_now")
        return F.when(targeted, moved).otherwise(now) if limited else moved

    totals = sums.agg(
        *[
            rate(F.sum(of("ontime", shift, limited)), F.sum("shipments")).alias(f"rate_{i}")
            for i, (_, shift, limited) in enumerate(policies)
        ],
        *[
            _zero_if_none(F.sum(of("delayed_gmv", shift, limited))).alias(f"gmv_{i}")
            for i, (_, shift, limited) in enumerate(policies)
        ],
    )
    return _policy_rows(totals, policies)


def scenario_lanes_top(lanes: DataFrame, k: int = 10) -> DataFrame:
    """The `k` lanes with most delayed GMV today, rates to three places and whole money."""
    money = ["gmv", *[f"delayed_gmv_{s}" for s in SHIFTS]]
    return (
        lanes.orderBy(F.desc("delayed_gmv_now"), *LANE)
        .limit(k)
        .withColumns(
            {f"ontime_{s}": F.bround(f"ontime_{s}", 3) for s in SHIFTS}
            | {c: F.bround(c, 0).cast("long") for c in money}
        )
    )


def scenario_target_lanes(lanes: DataFrame, targets: Sequence[tuple[str, str]]) -> DataFrame:
    """The chosen lanes with what each wider promise takes off the delayed GMV."""
    return lanes.filter(in_lanes(targets)).select(
        *LANE,
        "shipments",
        "gmv",
        *[f"ontime_{s}" for s in SHIFTS],
        *[
            (F.col("delayed_gmv_now") - F.col(f"delayed_gmv_{s}")).alias(f"drop_{s}")
            for s in ("p1", "p2", "p3")
        ],
    )


def scenario_delay_crosstab(
    shipments: DataFrame, targets: Sequence[tuple[str, str]]
) -> DataFrame:
    """Shipments by destination and delay days on the chosen lanes, with `All` margins."""
    days = F.coalesce(F.col("delivery_delay_days").cast("string"), F.lit("Lost"))
    cells = (
        shipments.filter((F.col("delivery_status") != IN_TRANSIT) & in_lanes(targets))
        .select("ship_to_city", days.alias("delay_days"))
        .cube("ship_to_city", "delay_days")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.grouping("ship_to_city").alias("all_cities"),
            F.grouping("delay_days").alias("all_days"),
        )
    )
    return cells.select(
        *[
            F.when(F.col(margin) == 1, F.lit("All")).otherwise(F.col(c)).alias(c)
            for c, margin in (("ship_to_city", "all_cities"), ("delay_days", "all_days"))
        ],
        "n",
    )


def scenario_summary(
    flags: DataFrame,
    targets: Sequence[tuple[str, str]],
    policies: Sequence[tuple[str, str, bool]] = POLICIES,
) -> DataFrame:
    """On-time rate and delayed GMV of every policy, and both against the first policy.

    All policies are aggregates of the same pass, so the comparison is within one row.
    """
    targeted = in_lanes(targets)

    def on_time(shift: str, limited: bool) -> Column:
        moved = F.col(f"ontime_{shift}")
        return F.when(targeted, moved).otherwise(F.col("ontime_now")) if limited else moved

    totals = flags.agg(
        *[
            share_where(on_time(shift, limited)).alias(f"rate_{i}")
            for i, (_, shift, limited) in enumerate(policies)
        ],
        *[
            _zero_if_none(F.sum(F.when(~on_time(shift, limited), F.col("order_gmv")))).alias(
                f"gmv_{i}"
            )
            for i, (_, shift, limited) in enumerate(policies)
        ],
    )
    return _policy_rows(totals, policies)


def _policy_rows(totals: DataFrame, policies: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """One row per policy from the rates and delayed GMV of all, and both against the first."""
    return rows_from(
        totals,
        [
            {
                "scenario": F.lit(name),
                "ontime_rate": F.col(f"rate_{i}"),
                "delayed_gmv": F.col(f"gmv_{i}"),
                "delayed_gmv_vs_today": F.col(f"gmv_{i}") - F.col("gmv_0"),
                "ontime_rate_vs_today": F.col(f"rate_{i}") - F.col("rate_0"),
            }
            for i, (name, _, _) in enumerate(policies)
        ],
    )


def readout_definition_lever(
    summary: DataFrame, current: str = "current", relabelled: str = "widen_all_lanes_+1d"
) -> DataFrame:
    """On-time rate today and with the promise day counted as on time; empty if not both known."""
    rate_of = {
        "current_ontime_rate": current,
        "relabelled_ontime_rate": relabelled,
    }
    picked = summary.agg(
        *[
            F.max(F.when(F.col("scenario") == name, F.col("ontime_rate"))).alias(alias)
            for alias, name in rate_of.items()
        ],
        F.count_if(F.col("scenario") == current).alias("n_current"),
        F.count_if(F.col("scenario") == relabelled).alias("n_relabelled"),
    )
    return picked.filter((F.col("n_current") > 0) & (F.col("n_relabelled") > 0)).select(*rate_of)
