"""Energy accounting, availability, losses and daily / monthly energy.

Everything that sums up records starts from one small base table: turbine, month, flag, status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from windrow.functions.rows import unpivot_row
from windrow.functions.timegrid import date_of
from windrow.params import FarmParams
from windrow.schema import GROSS, PRODUCING

CAUSES = ("Faults", "Maintenance", "Grid outage", "Other")


def energy_base(flagged: DataFrame) -> DataFrame:
    """Records and energies per turbine, month, flag and status code. A row with `n` stands for so many without energy."""
    n = F.sum("n") if "n" in flagged.columns else F.count(F.lit(1))
    return (flagged.groupBy("turbine", "month", "flag", "status")
            .agg(n.alias("n"), F.sum("energy_kwh").alias("e_kwh"),
                 F.sum("expected_energy_kwh").alias("x_kwh")))


def n_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))


def mwh_if(col: str, cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0.0)) / 1000.0


def flag_is(*flags: int) -> Column:
    return F.col("flag").isin(*flags)


def cause_of(p: FarmParams) -> Column:
    c = p.status_codes
    return (F.when(F.col("status").isin(*c.fault), CAUSES[0])
            .when(F.col("status").isin(*c.maintenance), CAUSES[1])
            .when(F.col("status").isin(*c.grid), CAUSES[2]).otherwise(CAUSES[3]))


def energy_accounting(base: DataFrame) -> DataFrame:
    """One row: produced energy, expected energy and lost energy by category (MWh)."""
    return base.agg(
        mwh_if("e_kwh", flag_is(*PRODUCING)).alias("actual_mwh"),
        mwh_if("x_kwh", F.lit(True)).alias("expected_mwh"),
        mwh_if("x_kwh", flag_is(2)).alias("downtime_mwh"),
        mwh_if("x_kwh", flag_is(3)).alias("curtailment_mwh"),
        mwh_if("x_kwh", flag_is(4)).alias("derating_mwh"),
        mwh_if("x_kwh", flag_is(5)).alias("environmental_mwh"),
        mwh_if("x_kwh", flag_is(*GROSS)).alias("gross_mwh"),
        (mwh_if("x_kwh", flag_is(0)) - mwh_if("e_kwh", flag_is(0))).alias("shortfall_mwh"))


def downtime_split(base: DataFrame, p: FarmParams) -> DataFrame:
    """Downtime loss by cause; the three coded causes always, the rest if above 0.01 MWh."""
    down = base.filter(flag_is(2)).withColumn("cause", cause_of(p))
    one = down.agg(*[mwh_if("x_kwh", F.col("cause") == c).alias(f"c{i}")
                     for i, c in enumerate(CAUSES)])
    rows = unpivot_row(one, [(c if c != "Other" else "Other / unspecified", F.col(f"c{i}"))
                             for i, c in enumerate(CAUSES)], ("cause", "loss_mwh"))
    return rows.filter((F.col("cause") != "Other / unspecified") | (F.col("loss_mwh") > 0.01))


def availability_turbine(base: DataFrame, p: FarmParams) -> DataFrame:
    h = p.interval_h
    df = base.groupBy("turbine").agg(
        (F.sum("n") * h).alias("hours"), (n_if(flag_is(2)) * h).alias("downtime_h"),
        (n_if(flag_is(3)) * h).alias("curtailment_h"),
        mwh_if("e_kwh", flag_is(*PRODUCING)).alias("energy_mwh"),
        mwh_if("x_kwh", flag_is(2)).alias("downtime_loss_mwh"),
        mwh_if("x_kwh", flag_is(3)).alias("curtailment_loss_mwh"),
        mwh_if("x_kwh", flag_is(4)).alias("derating_loss_mwh"),
        mwh_if("x_kwh", flag_is(5)).alias("environmental_loss_mwh"))
    usable = F.col("energy_mwh") + F.col("downtime_loss_mwh")
    return df.withColumns({
        "time_avail_pct": 100.0 * (F.col("hours") - F.col("downtime_h")) / F.col("hours"),
        "prod_avail_pct": F.when(usable > 0, 100.0 * F.col("energy_mwh") / usable).otherwise(100.0)})


def availability_farm(per_turbine: DataFrame) -> DataFrame:
    sums = ("energy_mwh", "downtime_loss_mwh", "curtailment_loss_mwh", "derating_loss_mwh",
            "environmental_loss_mwh")
    return per_turbine.agg(F.avg("time_avail_pct").alias("time_avail_pct"),
                           F.avg("prod_avail_pct").alias("prod_avail_pct"),
                           *[F.sum(c).alias(c) for c in sums])


def availability_monthly(base: DataFrame, p: FarmParams) -> DataFrame:
    h = p.interval_h
    produced = F.sum(F.when(flag_is(*PRODUCING), F.col("e_kwh"))) / 1000.0
    df = base.groupBy("month").agg(
        (n_if(flag_is(2)) * h).alias("downtime_h"), (n_if(flag_is(3)) * h).alias("curtailment_h"),
        (F.sum("n") * h).alias("total_h"), produced.alias("energy_mwh"))
    return df.withColumn("time_avail_pct", 100.0 * (1 - F.col("downtime_h") / F.col("total_h")))


def downtime_monthly(base: DataFrame, p: FarmParams) -> DataFrame:
    return (base.filter(flag_is(2)).groupBy("month", cause_of(p).alias("cause"))
            .agg((F.sum("x_kwh") / 1000.0).alias("loss_mwh")))


def downtime_pivot(monthly: DataFrame) -> DataFrame:
    """Month by cause; the causes are a fixed list, so no extra pass looks for them."""
    wide = monthly.groupBy("month").pivot("cause", list(CAUSES)).agg(F.sum("loss_mwh")).na.fill(0.0)
    return wide.select("month", *[F.col(c).alias(c.lower().replace(" ", "_")) for c in CAUSES])


def performance_monthly(base: DataFrame) -> DataFrame:
    return (base.filter(flag_is(0)).groupBy("month")
            .agg((F.sum("e_kwh") / F.greatest(F.sum("x_kwh"), F.lit(1e-9))).alias("performance_ratio")))


def yearly_production(base: DataFrame, p: FarmParams) -> DataFrame:
    """Measured energy, hours and gross energy per year with production."""
    return (base.groupBy(F.substring("month", 1, 4).cast("int").alias("year"))
            .agg(mwh_if("e_kwh", flag_is(*PRODUCING)).alias("measured_mwh"),
                 (n_if(flag_is(*PRODUCING)) * p.interval_h).alias("hours"),
                 (F.sum("x_kwh") / 1000.0).alias("gross_mwh"))
            .filter("hours > 0"))


def loss_matrix(base: DataFrame, wake_by_turbine: DataFrame) -> DataFrame:
    """Losses per turbine in MWh and in percent of the turbine's gross energy."""
    names = {2: "downtime", 3: "curtailment", 4: "derating", 5: "environmental"}
    df = base.groupBy("turbine").agg(
        *[mwh_if("x_kwh", flag_is(f)).alias(f"{n}_mwh") for f, n in names.items()],
        mwh_if("e_kwh", flag_is(*PRODUCING)).alias("energy_mwh"),
        mwh_if("x_kwh", F.lit(True)).alias("g"))
    gross = F.when(F.col("g") == 0, 1e-9).otherwise(F.col("g"))
    df = (df.withColumn("gross_mwh", gross).drop("g")
          .join(wake_by_turbine.select("turbine", F.col("wake_energy_mwh").alias("wake_mwh")),
                "turbine", "left").na.fill(0.0, ["wake_mwh"]))
    return df.withColumns({f"{n}_pct": 100.0 * F.col(f"{n}_mwh") / F.col("gross_mwh")
                           for n in [*names.values(), "wake"]})


def energy_balance(account: DataFrame) -> DataFrame:
    return unpivot_row(account, [
        ("Energy produced (SCADA)", F.col("actual_mwh")),
        ("Downtime loss (faults/maintenance/grid)", F.col("downtime_mwh")),
        ("Curtailment loss", F.col("curtailment_mwh")),
        ("Derating / partial load", F.col("derating_mwh")),
        ("Environmental losses", F.col("environmental_mwh"))], ("metric", "mwh"))


def loss_calculation(account_with_wake: DataFrame) -> DataFrame:
    """Measured losses over the record; `wake_energy_mwh` must be among the columns."""
    return unpivot_row(account_with_wake, [
        ("Availability (downtime)", "sum P(v) dt over downtime", F.col("downtime_mwh")),
        ("Curtailment", "sum P(v) dt over curtailment", F.col("curtailment_mwh")),
        ("Derating", "sum P(v) dt over derated records", F.col("derating_mwh")),
        ("Environmental", "sum P(v) dt over environmental records", F.col("environmental_mwh")),
        ("Wake", "sum (P(v_free) - P(v)) dt", F.col("wake_energy_mwh")),
        ("Turbine performance", "sum (P - P_act) dt - wake",
         F.col("shortfall_mwh") - F.col("wake_energy_mwh"))], ("loss", "formula", "value_mwh"))


def performance_energy(account_with_wake: DataFrame) -> DataFrame:
    """Shortfall of operating records against the curve, without the wake share."""
    return account_with_wake.select(
        "shortfall_mwh", "wake_energy_mwh",
        (F.col("shortfall_mwh") - F.col("wake_energy_mwh")).alias("performance_mwh"))


def daily_gross(flagged: DataFrame) -> DataFrame:
    """Daily gross energy of the farm (MWh)."""
    return (flagged.filter(flag_is(*GROSS)).groupBy(date_of().alias("d"))
            .agg((F.sum("expected_energy_kwh") / 1000.0).alias("e_mwh")))


def monthly_gross(daily: DataFrame, days: float = 30.44, min_days: int = 20,
                  excluded: tuple[str, ...] = ()) -> DataFrame:
    """Monthly energy scaled to a month of `days` days; months with little data are dropped."""
    df = (daily.groupBy(F.date_format("d", "yyyy-MM").alias("month"))
          .agg(F.sum("e_mwh").alias("s"), F.count("e_mwh").alias("n_days"))
          .filter(F.col("n_days") >= min_days))
    if excluded:
        df = df.filter(~F.col("month").isin(*excluded))
    return df.select("month", "n_days", (F.col("s") * days / F.col("n_days")).alias("gross_mwh"))


def worst_turbines(per_turbine: DataFrame, k: int = 3, by: str = "downtime_loss_mwh") -> DataFrame:
    """Top-k report: turbines with the largest downtime loss, or the largest value of another column."""
    top = per_turbine.orderBy(F.col(by).desc(), "turbine").limit(k)
    rank = F.row_number().over(W.orderBy(F.col(by).desc(), "turbine"))
    return top.select("turbine", by, rank.alias("rank"))
