"""Which columns of an export hold what. Works on column names only; no data is read."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from windrow.sources import vocabulary as v

VALUE_KINDS = ("power", "ws", "dir", "wind_dir", "temp", "status")
WIDE_KINDS = ("power", "ws", "dir", "temp", "status")
BETWEEN = r"[ _\-.:/]*"  # a turbine and what is measured
UNIT = r"(?:kwh|mwh|kw|mw|kmh|km/h|m/s|deg|c)?"


def normalise(name: str) -> str:
    return "".join(re.sub(r"\([^)\]]*[)\]]|\[[^)\]]*[)\]]", " ", str(name)).lower().split())


def words(profile: str, overrides: dict | None = None) -> dict[str, list[str]]:
    """Words per kind, the most telling first: user overrides, then the vendor's, then the generic ones."""
    ranked = [overrides or {}, v.VENDOR.get(profile, {}), v.VENDOR["generic"]]
    return {kind: list(dict.fromkeys(normalise(w) for source in ranked for w in source.get(kind, ())))
            for kind in v.VENDOR["generic"]}


def any_vendor(kind: str) -> list[str]:
    return list(dict.fromkeys(normalise(w) for own in v.VENDOR.values() for w in own.get(kind, ())))


def _any_of(found: Iterable[str]) -> str:
    return "|".join(map(re.escape, sorted(found, key=len, reverse=True)))


def detect_profile(columns: list[str], overrides: dict | None = None) -> str:
    """The vendor whose own words are in the most columns, the first of several; generic if there is none."""
    header = "\n".join(map(normalise, columns))
    hits = {}
    for vendor, own in v.VENDOR.items():
        known = {normalise(w) for source in (own, overrides or {}) for kind in own if kind != "wind_dir"
                 for w in source.get(kind, ())}
        hits[vendor] = len(re.findall(rf"^.*(?:{_any_of(known)}).*$", header, re.M))
    del hits["generic"]
    best = max(hits, key=hits.get)
    return best if hits[best] else "generic"


@dataclass(frozen=True)
class ColumnPlan:
    """Resolved columns: one timestamp column or date and time, and one column per kind.

    `wide` maps turbine ids to their columns when every turbine has columns of its own.
    """
    profile: str
    timestamp: tuple[str, ...]
    turbine: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    wide: dict[str, dict[str, str]] = field(default_factory=dict)

    def value_columns(self) -> list[str]:
        if self.wide:
            return [c for kinds in self.wide.values() for c in kinds.values()]
        return list(self.fields.values())

    def has(self, kind: str) -> bool:
        return kind in self.fields or any(kind in kinds for kinds in self.wide.values())


class Header:
    """Bare names of the columns that have not been given away yet."""

    def __init__(self, columns: Iterable[str]):
        self.free = {c: normalise(c) for c in columns}

    def seek(self, wanted: Iterable[str], but: Iterable[str] = ()) -> str | None:
        """The column with the first of the words; the first such column."""
        hits = ((rank, place, c) for place, (c, bare) in enumerate(self.free.items()) if c not in but
                for rank, w in enumerate(wanted) if w and w in bare)
        return min(hits, default=(0, 0, None))[2]

    def take(self, *columns: str) -> None:
        for c in columns:
            self.free.pop(c, None)


def _timestamp_columns(header: Header, vocab: dict[str, list[str]]) -> tuple[str, ...]:
    whole = header.seek(("timestamp", "datetime"))
    date = header.seek(("date",))
    time = header.seek(("time",), {date})
    if whole:
        return (whole,)
    if date and time:
        return date, time
    one = header.seek(vocab["timestamp"]) or date
    return (one,) if one else ()


def wide_columns(header: Header, vocab: dict[str, list[str]]) -> dict[str, dict[str, str]]:
    """Turbine -> kind -> column for names such as "T01 Active Power (kW)", "T01_p" or "T02ws"."""
    kinds = {w: kind for kind in reversed(WIDE_KINDS) for w in vocab[kind] if len(w) >= 2}
    endings = dict(v.ENDINGS)
    inside = re.compile(rf"(?P<turbine>.*?[^ _\-.:/]){BETWEEN}(?P<word>{_any_of(kinds)})")
    at_end = re.compile(rf"(?P<turbine>.*?[^ _\-.:/]){BETWEEN}(?P<word>{_any_of(endings)}){UNIT}$")
    wide: dict[str, dict[str, str]] = {}
    for c, bare in header.free.items():
        if hit := inside.match(bare):
            wide.setdefault(hit["turbine"].lstrip(" _-.:/"), {})[kinds[hit["word"]]] = c
        elif hit := at_end.match(bare):
            wide.setdefault(hit["turbine"].lstrip(" _-.:/"), {})[endings[hit["word"]]] = c
    return wide


def plan_columns(columns: list[str], profile: str = "auto", overrides: dict | None = None) -> ColumnPlan:
    """Resolves the columns of an export; raises ValueError naming them if power or wind is missing."""
    if profile in (None, "auto"):
        profile = detect_profile(columns, overrides)
    vocab, header = words(profile, overrides), Header(columns)
    stamp = _timestamp_columns(header, vocab)
    header.take(*stamp)
    # the state column first, or "TurbineState" would be taken for the turbine
    status = header.seek([*any_vendor("status"), *vocab["status"]])
    turbine = header.seek([*any_vendor("turbine"), *vocab["turbine"]], {status})
    fields: dict[str, str] = {}
    wide = {} if turbine else wide_columns(header, vocab)
    if not wide:
        header.take(turbine)
        wanted = [*((k, vocab[k]) for k in VALUE_KINDS), ("curtailment", v.CURTAILMENT), *v.FALLBACK.items()]
        for kind, ws in wanted:
            if kind in fields:
                continue
            c = header.seek(ws)
            if c is None and kind == "power" and ws is v.FALLBACK["power"]:
                c = next((x for x, bare in header.free.items() if bare == "p"), None)
            if c:
                fields[kind] = c
                header.take(c)
    plan = ColumnPlan(profile, stamp, turbine, fields, wide)
    for kind, label in (("power", "power"), ("ws", "wind speed")):
        if not plan.has(kind):
            raise ValueError(f"no {label} column; columns found: {', '.join(map(str, columns[:30]))}")
    return plan


def plan_from_map(columns: list[str], column_map: dict[str, str]) -> ColumnPlan:
    """An explicit mapping of kinds to exact column names; only these columns are read."""
    known = {k: c for k, c in column_map.items() if c in columns}
    for kind in ("timestamp", "power", "ws"):
        if kind not in known:
            raise ValueError(f"column map lacks {kind}; columns found: {', '.join(map(str, columns[:30]))}")
    fields = {k: c for k, c in known.items() if k in (*VALUE_KINDS, "curtailment")}
    return ColumnPlan("generic", (known["timestamp"],), known.get("turbine"), fields)


def unit_factor(kind: str, column: str) -> float:
    """Factor that brings the unit named in the header to kW or m/s."""
    name = column.lower()
    if kind == "power" and "mw" in name:
        return 1000.0
    if kind == "ws" and ("km/h" in name or "kmh" in name):
        return 1.0 / 3.6
    return 1.0
