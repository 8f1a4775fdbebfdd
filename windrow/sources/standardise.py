"""Exports to the canonical record layout. Decisions that depend on the data are taken on the whole
input, in one aggregate that runs as a scalar subquery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from windrow.functions.num import angle, clip
from windrow.functions.rows import with_scalars
from windrow.schema import SCADA
from windrow.sources import vocabulary as v
from windrow.sources.columns import ColumnPlan, unit_factor

TEXT_SHARE = 0.3        # share of unreadable numbers beyond which a decimal comma is tried
MW_LIMIT = 100.0


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def number(c: Column, comma: Column | None = None) -> Column:
    """Number or NULL; NaN becomes NULL. With `comma`, decimal commas are read where it is true."""
    plain = c.try_cast("double")
    if comma is not None:
        plain = F.when(comma, F.replace(c.cast("string"), F.lit(","), F.lit(".")).try_cast("double")) \
            .otherwise(plain)
    return F.nanvl(plain, F.lit(None).cast("double"))


def comma_decision(c: Column) -> Column:
    """Aggregate: more than 30 % unreadable as plain numbers, and more readable with a comma.

    Text that reads as a plain number reads the same with the comma rule, so only the rest counts.
    """
    plain = number(c)
    gained = F.count(F.when(plain.isNull(), number(c, F.lit(True))))
    total = F.count(F.lit(1))
    return ((total - F.count(plain)) / total > TEXT_SHARE) & (gained > 0)


DAY_MONTH_YEAR = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})"


def stamp(text: Column, day_first: Column) -> Column:
    """Timestamp from ISO, d.m.y or m/d/y text; NULL if unreadable. No time zone is involved."""
    s = F.trim(text)
    iso = F.when(day_first, F.regexp_replace(s, DAY_MONTH_YEAR, "$3-$2-$1")).otherwise(
        F.regexp_replace(s, DAY_MONTH_YEAR, "$3-$1-$2"))
    iso = F.regexp_replace(iso, r"^(\d{4})[./](\d{1,2})[./](\d{1,2})", "$1-$2-$3")
    # hours and minutes without seconds
    iso = F.regexp_replace(iso, r"^(\S+[ T]\d{1,2}:\d{2})$", "$1:00")
    return F.coalesce(s.try_cast("timestamp_ntz"), iso.try_cast("timestamp_ntz"))


def day_first_decision(text: Column) -> Column:
    """Aggregate: more stamps readable with the day first than with the month first."""
    open_order = F.trim(text).rlike(DAY_MONTH_YEAR)

    def readable(day_first: bool) -> Column:
        return F.count(F.when(open_order, stamp(text, F.lit(day_first))))

    return readable(True) > readable(False)


def status_code(c: Column) -> Column:
    """Code of a text state; numbers pass through, unknown words become NULL."""
    table = F.create_map(*[F.lit(x) for word_and_code in v.STATUS_WORDS.items() for x in word_and_code])
    word = F.lower(F.trim(c.cast("string")))
    return F.coalesce(F.try_element_at(table, word), number(c).try_cast("int"))


def clean_ranges(df: DataFrame) -> DataFrame:
    """Physical bounds and angles within 0..360."""
    return df.withColumns({
        "power_kw": clip(F.col("power_kw"), lo=-100.0), "ws": clip(F.col("ws"), 0.0, 60.0),
        "dir_deg": angle(F.col("dir_deg")), "wind_dir_deg": angle(F.col("wind_dir_deg")),
        "curt_flag": (F.col("curt_flag") > 0).cast("int")})


def mw_decision(power: Column) -> Column:
    """Aggregate: power given in MW without saying so, as no value of the whole input reaches 100."""
    return F.coalesce(F.max(power) < MW_LIMIT, F.lit(False))


OUT = {"power": "power_kw", "ws": "ws", "dir": "dir_deg", "wind_dir": "wind_dir_deg", "temp": "temp_c",
       "status": "status", "curtailment": "curt_flag"}


def standardise(raw: DataFrame, plan: ColumnPlan, tags: tuple[str, ...] = ()) -> DataFrame:
    """Canonical records of an export; `tags` are extra columns to keep."""
    typed = {f.name: f.dataType for f in raw.schema.fields}
    is_text = {c for c in plan.value_columns() if isinstance(typed[c], T.StringType)}
    stamps = [_quoted(c) for c in plan.timestamp]
    native = len(stamps) == 1 and isinstance(typed[plan.timestamp[0]], (T.TimestampNTZType, T.TimestampType,
                                                                        T.DateType))
    text = F.concat_ws(" ", *[F.trim(s.cast("string")) for s in stamps])

    # one pass over the needed columns decides date order, decimal sign and power unit
    asked = [] if native else [day_first_decision(text).alias("day_first")]
    layouts = list(plan.wide.values()) if plan.wide else [plan.fields]
    measured = [(k, c) for cols in layouts for k, c in cols.items() if k != "status"]
    names = {c: f"comma_{i}" for i, (_, c) in enumerate(measured) if c in is_text}
    asked += [comma_decision(_quoted(c)).alias(n) for c, n in names.items()]
    power = [c for k, c in measured if k == "power"]
    asked.append(mw_decision(F.greatest(*[_read(c, c in is_text) * unit_factor("power", c) for c in power],
                                        F.lit(None).cast("double"))).alias("is_mw"))
    keep = list(dict.fromkeys([*plan.timestamp, *([plan.turbine] if plan.turbine else []),
                               *plan.value_columns(), *tags]))
    df = raw.select(*[_quoted(c) for c in keep])
    df = with_scalars(df, df.agg(*asked))

    def value(kind: str, column: str) -> Column:
        c = _quoted(column)
        if kind == "status":
            return status_code(c)
        x = number(c, F.col(names[column]) if column in names else None)
        if kind == "curtailment":
            return F.when(x > 0, 1).otherwise(0)
        if kind == "power":
            x = x * F.when(F.col("is_mw"), 1000.0).otherwise(1.0)
        return x * unit_factor(kind, column)

    when = stamps[0].cast("timestamp_ntz") if native else stamp(text, F.col("day_first"))

    def record(turbine: Column, cols: dict[str, str]) -> Column:
        given = {"turbine": turbine, "timestamp": when, **{OUT[k]: value(k, c) for k, c in cols.items()}}
        return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCADA.fields])

    turbine = F.trim(_quoted(plan.turbine).cast("string")) if plan.turbine else F.lit("T01")
    records = [record(F.lit(t), cols) for t, cols in plan.wide.items()] or [record(turbine, plan.fields)]
    # inline makes wide rows long without a shuffle, and has every cell parsed only once
    df = df.select(*tags, F.inline(F.array(*records)))
    df = df.filter(F.col("timestamp").isNotNull()).select(*SCADA.fieldNames(), *tags)
    return clean_ranges(df)


def _read(column: str, text: bool) -> Column:
    """A cell as number, with decimal commas where it does not read without."""
    c = _quoted(column)
    return F.coalesce(number(c), number(c, F.lit(True))) if text else number(c)
