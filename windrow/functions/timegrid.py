"""Ten-minute slots: an integer time axis that does not depend on the session time zone.

slot = number of ten-minute intervals since 1970-01-01; block = 32 days of slots.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SLOTS_PER_DAY = 144
SLOTS_PER_BLOCK = 32 * SLOTS_PER_DAY


def slot_of(ts: str) -> Column:
    return F.expr(f"unix_date(to_date({ts})) * {SLOTS_PER_DAY}L"
                  f" + hour({ts}) * 6 + minute({ts}) div 10")


def timestamp_of(slot: str = "slot") -> Column:
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval("
                  f"cast({slot} div {SLOTS_PER_DAY} as int), 0, "
                  f"cast({slot} % {SLOTS_PER_DAY} * 10 as int))")


def block_of(slot: str = "slot") -> Column:
    return F.expr(f"{slot} div {SLOTS_PER_BLOCK}L")


def date_of(slot: str = "slot") -> Column:
    return F.expr(f"date_from_unix_date(cast({slot} div {SLOTS_PER_DAY} as int))")


def month_of(slot: str = "slot") -> Column:
    return F.date_format(date_of(slot), "yyyy-MM")


def hour_of(slot: str = "slot") -> Column:
    return F.expr(f"cast({slot} % {SLOTS_PER_DAY} div 6 as int)")
