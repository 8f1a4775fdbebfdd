"""SQL for DuckDB, one statement per query. CTE lists the shared steps; `q` adds those a query needs.

Windows here run over whole turbines, without blocks or carried context.
"""

from __future__ import annotations

import re

ORACLE: dict[str, str] = {}
CTE: dict[str, str] = {}


def q(name: str, select: str, **local: str) -> None:
    """Registers `select` under `name` with all shared steps it refers to."""
    steps = {**CTE, **local}
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        words = set(re.findall(r"\w+", re.sub(r"'[^']*'", "", text)))
        for step in steps:
            if step in words and step not in seen:
                seen.add(step)
                visit(steps[step])
                needed.append(step)

    visit(select)
    head = ",\n".join(f"{s} AS ({steps[s]})" for s in needed)
    ORACLE[name] = f"WITH RECURSIVE {head}\n{select}" if head else select


def r(expr: str, name: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def rs(names: str, digits: int = 4) -> str:
    return ", ".join(r(n, n, digits) for n in names.split())


def big(names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names.split())


TS = "strftime(make_timestamp(slot * 600000000), '%Y-%m-%d %H:%M:%S') AS ts"
STAMP = "'%Y-%m-%d %H:%M:%S'"
DT = "(1.0/6.0)"


def clip(x, lo, hi):
    return f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END)"


# ---- records ---------------------------------------------------------------------------------

CTE["raw"] = """
SELECT concat('T', lpad(CAST(tno+1 AS VARCHAR),2,'0')) AS turbine, tno, slot_no,
       TIMESTAMP '1996-01-01 00:00:00' + to_minutes(CAST(slot_no*10 + l_linenumber AS BIGINT)) AS ts,
       ws, temp_c, dir_deg, (dir_deg + round(l_tax*100) - 3.7583::DOUBLE + 360) % 360 AS wind_dir_deg, status,
       (CASE WHEN status IN (200,300,400) THEN 0.0 WHEN status = 500 THEN least(750.0, p)
             ELSE p * (CASE WHEN tno=6 THEN 0.94 WHEN tno=11 THEN 0.97 ELSE 1.0 END) * (1-0.2*l_discount) END)
       * (CASE WHEN l_extendedprice > 104000 THEN 4.0 ELSE 1.0 END) AS power_kw
FROM (SELECT *, CASE WHEN ws<3.0 THEN 0.0 ELSE 2500.0*(1-exp(-pow((ws-3.0)/5.5,3))) END AS p,
             CASE (tno*13+b*7)%40 WHEN 0 THEN 200 WHEN 1 THEN 300 WHEN 2 THEN 400 WHEN 3 THEN 500
                                  WHEN 4 THEN 600 ELSE 100 END AS status
      FROM (SELECT *, 2.00131713::DOUBLE+0.00013711::DOUBLE*tno+0.5*CAST((b*7)%23 AS DOUBLE)+(l_quantity-25.0)*0.02 AS ws,
                   CAST((dd*11+CAST(l_quantity AS BIGINT))%45 AS DOUBLE)-2.0 AS temp_c,
                   CAST((b*41+CAST(l_quantity AS BIGINT))%359 AS DOUBLE)+0.37113::DOUBLE AS dir_deg
            FROM (SELECT *, slot_no // 36 AS b, slot_no // 144 AS dd
                  FROM (SELECT *, l_orderkey // 3 AS slot_no, (l_partkey+l_linenumber)%12 AS tno FROM lineitem))))"""

CTE["raw_frozen"] = """
SELECT turbine, ts, temp_c, dir_deg, wind_dir_deg, status, power_kw,
       CASE WHEN tno = 4 AND date_diff('day', DATE '1996-01-01', CAST(ts AS DATE)) % 3 = 1
            THEN 6.2 ELSE ws + 0.35*tno END AS ws FROM raw"""


def resampled(src: str, status: str = "arg_max(status, ts)") -> str:
    return f"""
SELECT turbine, epoch_us(ts) // 600000000 AS slot, avg(power_kw) AS power_kw, avg(ws) AS ws,
       avg(dir_deg) AS dir_deg, avg(wind_dir_deg) AS wind_dir_deg, avg(temp_c) AS temp_c, {status} AS status
FROM {src} GROUP BY ALL HAVING avg(power_kw) IS NOT NULL OR avg(ws) IS NOT NULL"""


CTE["res"] = resampled("raw").replace("GROUP BY ALL", "GROUP BY 1, 2")
CTE["res_nostatus"] = resampled("raw", "CAST(NULL AS INTEGER)").replace("GROUP BY ALL", "GROUP BY 1, 2")
CTE["res_frozen"] = resampled("raw_frozen").replace("GROUP BY ALL", "GROUP BY 1, 2")

CTE["node"] = """
SELECT CAST(i AS INTEGER) AS i, i*0.5 AS v,
       CASE WHEN i*0.5 < 3.0 OR i*0.5 >= 25.0 THEN 0.0
            ELSE least(2500.0*(1-exp(-pow((i*0.5-3.0)/5.5,3))), 2500.0) END AS p
FROM range(91) t(i)"""
CTE["cells"] = """
SELECT c.i AS cell, CASE WHEN c.i*0.1 >= 25.0 THEN 0.0
            ELSE least(a.p + (coalesce(b.p, a.p)-a.p)*(c.i % 5)/5.0, 2500.0) END AS p0
FROM (SELECT CAST(i AS INTEGER) AS i FROM range(451) t(i)) c
JOIN node a ON a.i = c.i // 5 LEFT JOIN node b ON b.i = c.i // 5 + 1"""
CTE["gridc"] = "SELECT cell, p0, coalesce(lead(p0) OVER (ORDER BY cell), p0) AS p1 FROM cells"


def cell(ws: str) -> str:
    return f"CAST(least(floor(greatest({ws}*10.0, 0)), 450) AS INTEGER)"


def pw(g: str, ws: str) -> str:
    return f"({g}.p0 + ({g}.p1-{g}.p0)*least(greatest({ws}*10.0 - {g}.cell, 0), 1))"


def flag_steps(tag: str, res: str, coded: bool, curtailed: str = "false") -> None:
    """The rules one after the other: f0 (single records), f1 low power, f2 curtailment, f3 climate."""
    status = ("WHEN status IN (1,100) THEN 0 WHEN status = 600 THEN 5 WHEN status = 500 THEN 3"
              " WHEN status IS NOT NULL THEN 2" if coded else "")
    why = "WHEN status IS NOT NULL THEN 'SCADA status code'" if coded else ""
    CTE[f"f0{tag}"] = f"""
SELECT *, CASE WHEN flag_a = 0 AND ws < 3.0 THEN 1 ELSE flag_a END AS flag0,
       CASE WHEN flag_a = 0 AND ws < 3.0 THEN 'Below cut-in' ELSE why_a END AS why0
FROM (SELECT t.*, {pw('g', 't.ws')} AS xraw, 99200.0/(287.05*(t.temp_c+273.15))/1.225 AS rho,
             CASE WHEN power_kw IS NULL OR ws IS NULL THEN 8
                  WHEN power_kw > 2875.0 OR power_kw < 0 OR ws < 0 OR ws > 45 THEN 6 {status} ELSE 0 END AS flag_a,
             CASE WHEN power_kw IS NULL OR ws IS NULL THEN 'Missing / NaN'
                  WHEN power_kw > 2875.0 OR power_kw < 0 OR ws < 0 OR ws > 45 THEN 'Bad data / spike' {why}
                  ELSE 'Operating' END AS why_a
      FROM {res} t LEFT JOIN gridc g ON g.cell = {cell('t.ws')})"""
    CTE[f"f1{tag}"] = f"""
SELECT *, CASE WHEN lowrun = 6 THEN 2 WHEN flag0 = 0 AND {curtailed} THEN 3 ELSE flag0 END AS flag1,
       CASE WHEN lowrun = 6 THEN 'Downtime (low power at usable wind)'
            WHEN flag0 = 0 AND {curtailed} THEN 'Curtailment (SCADA flag)' ELSE why0 END AS why1,
       power_kw / greatest(xraw, 1.0) AS ratio
FROM (SELECT *, sum(CASE WHEN flag0 = 0 AND ws > 4.0 AND power_kw < 12.5 THEN 1 ELSE 0 END)
                OVER (PARTITION BY turbine ORDER BY slot ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS lowrun
      FROM f0{tag})"""
    CTE[f"f2{tag}"] = f"""
SELECT *, CASE WHEN c3 = 3 THEN 3 WHEN c4 = 3 THEN 4 ELSE flag1 END AS flag2,
       CASE WHEN c3 = 3 THEN 'Curtailment (low output at usable wind)'
            WHEN c4 = 3 THEN 'Derated / partial load' ELSE why1 END AS why2
FROM (SELECT *, sum(CASE WHEN flag1 = 0 AND ws >= 3.0 AND ws < 24.0 AND xraw > 375.0 AND ratio < 0.30
                         THEN 1 ELSE 0 END) OVER w AS c3,
             sum(CASE WHEN flag1 = 0 AND ws >= 3.0 AND ws < 24.0 AND xraw > 375.0 AND ratio >= 0.30
                      AND ratio < 0.85 THEN 1 ELSE 0 END) OVER w AS c4
      FROM f1{tag}
      WINDOW w AS (PARTITION BY turbine ORDER BY slot ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
    CTE[f"f3{tag}"] = f"""
SELECT *, CASE WHEN flag2 = 0 AND temp_c > 39.0 AND ratio < 0.85 THEN 5
               WHEN flag2 = 0 AND temp_c < 1.0 AND ratio < 0.5 THEN 5 ELSE flag2 END AS flag3,
       CASE WHEN flag2 = 0 AND temp_c > 39.0 AND ratio < 0.85 THEN 'Environmental (high temperature)'
            WHEN flag2 = 0 AND temp_c < 1.0 AND ratio < 0.5 THEN 'Environmental (icing)' ELSE why2 END AS why3,
       xraw * {clip('rho', 0.5, 1.15)} AS xp
FROM f2{tag}"""
    CTE[f"f4{tag}"] = f"""
SELECT * REPLACE (CASE WHEN flag = 7 THEN coalesce(avg(CASE WHEN flag = 0 THEN xp END) OVER (PARTITION BY slot), 0.0)
                       ELSE xp END AS xp)
FROM (SELECT *, CASE WHEN frozen THEN 7 ELSE flag3 END AS flag,
             CASE WHEN frozen THEN 'Anemometer fault (frozen)' ELSE why3 END AS why
      FROM (SELECT *, coalesce(flag3 = 0 AND n12 = 12 AND sd12 < 0.02*ws AND ws > 4.0 AND spread > 0.5, false) AS frozen
            FROM (SELECT *, count(ws) OVER w AS n12, stddev_samp(ws) OVER w AS sd12,
                         stddev_samp(ws) OVER (PARTITION BY slot) AS spread
                  FROM f3{tag}
                  WINDOW w AS (PARTITION BY turbine ORDER BY slot ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))))"""


flag_steps("", "res", True)
flag_steps("_n", "res_nostatus", False)
flag_steps("_z", "res_frozen", True)
flag_steps("_c", "res_nostatus", False, "(slot // 144 - 9496) % 4 = 1 AND slot % 144 // 6 BETWEEN 8 AND 15")

# ---- gap filling -----------------------------------------------------------------------------

CTE["spine"] = """
SELECT e.turbine, s.slot, t.slot IS NOT NULL AS present
FROM (SELECT turbine, unnest(range(min(slot), max(slot)+1)) AS slot FROM res GROUP BY turbine) s
JOIN (SELECT turbine, count(*) AS n FROM res GROUP BY turbine) e ON e.turbine = s.turbine
LEFT JOIN res t ON t.turbine = s.turbine AND t.slot = s.slot"""
CTE["placed"] = """
SELECT s.turbine, s.slot, s.present, t.* EXCLUDE (turbine, slot)
FROM spine s LEFT JOIN f4 t ON t.turbine = s.turbine AND t.slot = s.slot"""


def edge(col: str) -> str:
    return (f"last_value({col} IGNORE NULLS) OVER b AS a_{col}, first_value({col} IGNORE NULLS) OVER f AS b_{col}")


CTE["bracketed"] = f"""
SELECT *, last_value(CASE WHEN present THEN slot END IGNORE NULLS) OVER b AS s0,
       first_value(CASE WHEN present THEN slot END IGNORE NULLS) OVER f AS s1,
       {edge('ws')}, {edge('temp_c')}, {edge('dir_deg')}, {edge('wind_dir_deg')}
FROM placed
WINDOW b AS (PARTITION BY turbine ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       f AS (PARTITION BY turbine ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""


def lin(col: str, f: str = "{}") -> str:
    a, b = f.format(f"a_{col}"), f.format(f"b_{col}")
    return f"({a} + ({b} - {a}) * (slot - s0) / (s1 - s0))"


def circ(col: str) -> str:
    x, y = lin(col, "cos(radians({}))"), lin(col, "sin(radians({}))")
    deg = f"degrees(atan2({y}, {x}))"
    return f"(({deg} % 360.0 + 360.0) % 360.0)"


CTE["filled"] = f"""
SELECT turbine, slot, CAST(NOT present AND slot - s0 <= 36 AS BIGINT) AS gap_filled,
       CAST(present AS BIGINT) AS recorded, power_kw, status, rho,
       CASE WHEN present THEN ws WHEN slot - s0 <= 36 THEN {lin('ws')} END AS ws,
       CASE WHEN present THEN temp_c WHEN slot - s0 <= 36 THEN {lin('temp_c')} END AS temp_c,
       CASE WHEN present THEN dir_deg WHEN slot - s0 <= 36 THEN {circ('dir_deg')} END AS dir_deg,
       CASE WHEN present THEN wind_dir_deg WHEN slot - s0 <= 36 THEN {circ('wind_dir_deg')} END AS wind_dir_deg,
       CASE WHEN present THEN flag ELSE 8 END AS flag,
       CASE WHEN present THEN xp ELSE 0.0 END AS xp,
       power_kw * {DT} AS e, (CASE WHEN present THEN xp ELSE 0.0 END) * {DT} AS x,
       strftime(make_timestamp(slot * 600000000), '%Y-%m') AS month
FROM bracketed"""

# ---- sources ---------------------------------------------------------------------------------

q("scan_scada", f"""
SELECT turbine, {big('status')}, count(*) AS n, {r('sum(power_kw)', 'power')}, {r('avg(ws)', 'ws')},
       {r('avg(temp_c)', 'temp')}, {r('avg(dir_deg)', 'dir')}, strftime(min(ts), {STAMP}) AS first_ts
FROM raw GROUP BY turbine, status""")
q("scan_column_map", f"""
SELECT turbine, count(*) AS n, {r('sum(power_kw)', 'power')}, {r('max(ws)', 'ws')}, CAST(0 AS BIGINT) AS n_dir,
       CAST(sum(status) AS BIGINT) AS status_sum FROM raw GROUP BY turbine""")
ORACLE["scan_export_files"] = ORACLE["scan_scada"]
q("split_months", f"""
SELECT strftime(ts, '%Y-%m') AS month, count(*) AS "rows", count(*) AS rows_by_number, {r('sum(power_kw)', 'power', 3)},
       {r('sum(ws)', 'ws', 3)}, CAST(sum(status) AS BIGINT) AS status_sum, strftime(min(ts), {STAMP}) AS first_ts,
       strftime(max(ts), {STAMP}) AS last_ts FROM raw GROUP BY 1""")
CTE["filed"] = """
SELECT *, CAST(date_diff('day', DATE '1996-01-01', CAST(ts AS DATE)) // 7 + hour(ts) % 2 AS INTEGER) AS ordinal
FROM raw"""
CTE["named"] = "SELECT *, concat('part_', lpad(CAST(ordinal AS VARCHAR), 4, '0'), '.csv') AS file FROM filed"
CTE["per_file"] = """
SELECT ordinal, turbine, epoch_us(ts) // 600000000 AS slot, avg(power_kw) AS power_kw, avg(ws) AS ws,
       arg_max(status, ts) AS status
FROM (SELECT ordinal, turbine, power_kw, ws, status, ts - to_hours(hour(ts) % 2) AS ts FROM filed) GROUP BY 1, 2, 3"""
q("multi_file_union", f"""
SELECT turbine, {TS}, {rs('power_kw ws', 6)}, {big('status')}
FROM per_file QUALIFY row_number() OVER (PARTITION BY turbine, slot ORDER BY ordinal DESC) = 1""")
CTE["prof"] = """
SELECT file, min(ts) AS t0, max(ts) AS t1, count(*) AS n, count(DISTINCT turbine) AS turbines FROM named GROUP BY file"""
q("file_profile", f"""
SELECT file, strftime(t0, {STAMP}) AS start, strftime(t1, {STAMP}) AS "end", n AS "rows", turbines FROM prof""")
q("file_overlap", f"""
SELECT a.file AS file_a, b.file AS file_b, strftime(greatest(a.t0, b.t0), {STAMP}) AS overlap_start,
       strftime(least(a.t1, b.t1), {STAMP}) AS overlap_end
FROM prof a JOIN prof b ON a.file < b.file AND a.t0 <= b.t1 AND b.t0 <= a.t1""")
q("file_overlap_groups", f"""
SELECT file, strftime(t0, {STAMP}) AS start, strftime(t1, {STAMP}) AS "end",
       strftime(min(t0) OVER (PARTITION BY grp), {STAMP}) AS group_start, strftime(max(t1) OVER (PARTITION BY grp), {STAMP}) AS group_end,
       count(*) OVER (PARTITION BY grp) AS n_files, CAST(count(*) OVER (PARTITION BY grp) > 1 AS BIGINT) AS overlaps
FROM (SELECT *, sum(CASE WHEN reached IS NULL OR t0 > reached THEN 1 ELSE 0 END) OVER (ORDER BY t0, file) AS grp
      FROM (SELECT *, max(t1) OVER (ORDER BY t0, file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM prof))""")
q("file_overlaps_of", f"""
SELECT b.file, strftime(greatest(a.t0, b.t0), {STAMP}) AS overlap_start, strftime(least(a.t1, b.t1), {STAMP}) AS overlap_end
FROM prof a JOIN prof b ON a.file = 'part_0001.csv' AND b.file <> a.file AND a.t0 <= b.t1 AND b.t0 <= a.t1""")
q("months_rewritten", f"""
SELECT month, count(*) AS "rows", {r('sum(power_kw / CASE WHEN month = m0 THEN 2 ELSE 1 END)', 'power')}, min(flag) AS least_flag,
       CASE WHEN month = any_value(m0) THEN 2 ELSE 1 END AS runs,
       CASE WHEN month = any_value(m0) THEN 2 ELSE 1 END * count(*) AS rows_written
FROM filled, (SELECT min(month) AS m0 FROM filled) GROUP BY month""")
q("input_extent", f"""
SELECT strftime(min(ts), {STAMP}) AS start, strftime(max(ts), {STAMP}) AS "end", count(*) AS "rows",
       count(DISTINCT turbine) AS turbines FROM raw""")
q("time_window_filter", f"""
SELECT strftime(ts, '%Y-%m-%d') AS d, count(*) AS n, {r('sum(value)', 'value')} FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1""")
q("warranted_curve", f"""
SELECT floor(ws*2)/2 AS bin_center, {r('max(power_kw)', 'mean_power', 6)} FROM res GROUP BY 1""")
q("generic_curve", f"""
SELECT b.v AS bin_center, b.n, {r('b.o', 'observed_kw', 6)}, {r('k.p', 'mean_power', 6)}
FROM (SELECT floor(ws*2)/2 AS v, count(*) AS n, avg(power_kw) AS o FROM res GROUP BY 1) b JOIN node k ON k.v = b.v""")
CTE["lay"] = """
SELECT turbine, CAST((CAST(substr(turbine, 2) AS INTEGER)-1) % 4 * 680 AS DOUBLE) AS x,
       CAST((CAST(substr(turbine, 2) AS INTEGER)-1) // 4 * 544 AS DOUBLE) AS y FROM (SELECT DISTINCT turbine FROM raw)"""
q("layout_scan", "SELECT turbine, x, y FROM lay")
q("reference_daily", f"""
SELECT d, {rs('ws dir', 6)}
FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, 2.0 + o_totalprice/50021.7::DOUBLE AS ws,
             CAST(o_custkey % 720 % 360 AS DOUBLE) AS dir FROM orders)
QUALIFY row_number() OVER (PARTITION BY d ORDER BY ws, dir) = 1""")

# ---- standardisation -------------------------------------------------------------------------

q("wide_to_long", f"""
SELECT lower(turbine) AS turbine, strftime(make_timestamp(slot*600000000), {STAMP}) AS timestamp, {rs('power_kw ws', 6)}
FROM res""")
q("coerce_decimal_comma", f"""
SELECT l_orderkey % 100 AS k, {r('sum(l_extendedprice)', 'price', 3)},
       {r('sum(CASE WHEN l_linenumber <> 7 THEN l_tax END)', 'tax', 3)},
       count(CASE WHEN l_linenumber <> 7 THEN l_tax END) AS n_tax FROM lineitem GROUP BY 1""")
q("parse_dayfirst", f"""
SELECT turbine, strftime(ts + INTERVAL 14 DAY, '%Y-%m-%d') AS d, count(*) AS n,
       strftime(max(ts) + INTERVAL 14 DAY, {STAMP}) AS last_ts, {r('sum(power_kw)', 'power')} FROM raw GROUP BY 1, 2""")
q("status_text_map", """
SELECT word, CASE WHEN word IN ('unheard of') THEN NULL ELSE status END AS code, count(*) AS n
FROM (SELECT CAST(status AS BIGINT) AS status,
             CASE status WHEN 100 THEN ' Running ' WHEN 200 THEN 'FAULT' WHEN 300 THEN '维护' WHEN 400 THEN 'Grid_Loss'
                         WHEN 500 THEN '限电' ELSE CASE WHEN temp_c > 20 THEN '600' ELSE 'unheard of' END END AS word
      FROM raw) GROUP BY 1, 2""")
q("unit_scale", f"SELECT turbine, {r('sum(power_kw)', 'power')}, {r('avg(ws)', 'ws')} FROM raw GROUP BY 1")
q("mw_autodetect", f"SELECT turbine, {r('sum(power_kw)', 'power')}, {r('max(power_kw)', 'top')} FROM raw GROUP BY 1")
q("clean_ranges", f"""
SELECT turbine, CAST(status > 500 AS BIGINT) AS curt_flag, count(*) AS n, {r('min(p)', 'p_min')}, {r('min(w)', 'ws_min')},
       {r('max(w)', 'ws_max')}, {r('sum(((dir_deg-400.0) % 360 + 360) % 360)', 'dir_sum')}, {r('sum(w)', 'ws_sum')}
FROM (SELECT *, greatest(power_kw-500.0, -100.0) AS p, least(greatest(ws*7.0-12.0, 0.0), 60.0) AS w FROM raw)
GROUP BY 1, 2""")

# ---- time series -----------------------------------------------------------------------------

q("resample_10min", f"SELECT turbine, {TS}, {rs('power_kw ws dir_deg wind_dir_deg temp_c', 6)}, {big('status')} FROM res")
q("sampling_interval", """
SELECT round(median(step) / 6.0, 6) + 0.0 AS interval_h
FROM (SELECT slot - lag(slot) OVER (PARTITION BY turbine ORDER BY slot) AS step FROM res)""")
q("dedup_last_wins", f"""
SELECT turbine, {TS}, ordinal, {rs('value')}
FROM (SELECT concat('T', CAST(user_id % 12 AS VARCHAR)) AS turbine, epoch_us(ts) // 600000000 AS slot,
             event_id AS ordinal, value FROM events)
QUALIFY row_number() OVER (PARTITION BY turbine, slot ORDER BY ordinal DESC) = 1""")
q("time_spine", f"SELECT turbine, {TS}, CAST(present AS BIGINT) AS present FROM spine")
q("gap_fill_linear", f"SELECT turbine, {TS}, {rs('ws temp_c power_kw', 6)}, gap_filled FROM filled")
q("gap_fill_circular", f"SELECT turbine, {TS}, {rs('dir_deg wind_dir_deg')} FROM filled WHERE gap_filled = 1")
q("gap_stats", f"""
SELECT CAST(sum(gap_filled) AS BIGINT) AS filled_rows, count(*) AS expected_rows,
       {r('100.0*sum(gap_filled)/count(*)', 'fill_pct')} FROM filled""")
CTE["holed"] = """
SELECT turbine, slot, ws, CASE WHEN slot % 31 <> 0 THEN power_kw END AS power_kw FROM res"""
CTE["hspine"] = """
SELECT s.turbine, s.slot, t.ws AS ws0, t.power_kw AS p0, CASE WHEN t.slot IS NOT NULL THEN s.slot END AS own
FROM (SELECT turbine, unnest(range(min(slot), max(slot)+1)) AS slot FROM holed GROUP BY turbine) s
LEFT JOIN holed t ON t.turbine = s.turbine AND t.slot = s.slot"""
CTE["hb"] = """
SELECT *, last_value(own IGNORE NULLS) OVER b AS s0, first_value(own IGNORE NULLS) OVER f AS s1,
       last_value(ws0 IGNORE NULLS) OVER b AS w0, first_value(ws0 IGNORE NULLS) OVER f AS w1
FROM hspine
WINDOW b AS (PARTITION BY turbine ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       f AS (PARTITION BY turbine ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"""
CTE["hfarm"] = "SELECT slot, avg(ws) AS farm FROM holed GROUP BY slot"
CTE["hlevel"] = """
SELECT turbine, median(ws/farm) AS level FROM holed JOIN hfarm USING (slot) WHERE farm <> 0 GROUP BY turbine"""
CTE["htier"] = """
SELECT h.turbine, h.slot, p0, CASE WHEN ws0 IS NOT NULL THEN ws0
            WHEN s1-s0-1 <= 6 THEN w0 + (w1-w0)*(h.slot-s0)/(s1-s0)
            WHEN s1-s0-1 <= 24 THEN farm*level END AS ws,
       CASE WHEN ws0 IS NOT NULL THEN '' WHEN s1-s0-1 <= 6 THEN 'linear_interp'
            WHEN s1-s0-1 <= 24 AND farm IS NOT NULL THEN 'neighbour_impute' ELSE '' END AS m0
FROM hb h LEFT JOIN hfarm f ON f.slot = h.slot LEFT JOIN hlevel l ON l.turbine = h.turbine"""
CTE["hdone"] = f"""
SELECT t.turbine, t.slot, t.ws, CASE WHEN t.p0 IS NULL AND t.ws IS NOT NULL THEN {pw('g', 't.ws')} ELSE t.p0 END AS power_kw,
       CAST(t.p0 IS NULL AND t.ws IS NOT NULL AS BIGINT) AS need, m0,
       CASE WHEN m0 = '' AND t.p0 IS NULL AND t.ws IS NOT NULL THEN 'curve_estimate' ELSE m0 END AS fill_method
FROM htier t LEFT JOIN gridc g ON g.cell = {cell('t.ws')}"""
q("gap_fill_tiered", f"""
SELECT turbine, {TS}, {rs('ws power_kw', 6)}, CAST(need = 1 OR m0 <> '' AS BIGINT) AS filled, fill_method FROM hdone""")
q("gap_fill_summary", """
SELECT turbine, count(*) FILTER (fill_method = 'linear_interp') AS ws_linear_filled,
       count(*) FILTER (fill_method = 'neighbour_impute') AS ws_neighbour_filled,
       CAST(sum(need) AS BIGINT) AS power_curve_filled,
       CAST(count(*) FILTER (fill_method IN ('linear_interp', 'neighbour_impute')) + sum(need) AS BIGINT) AS total_filled
FROM hdone GROUP BY turbine""")

CTE["refd"] = """
SELECT CAST(o_orderdate AS DATE) AS d, 2.0+avg(o_totalprice)/50021.7::DOUBLE AS ws,
       CAST((dayofyear(CAST(o_orderdate AS DATE))*37)%360 AS DOUBLE) AS dir,
       15.0+CAST(dayofyear(CAST(o_orderdate AS DATE))%20 AS DOUBLE)-10.0 AS temp_c
FROM orders GROUP BY CAST(o_orderdate AS DATE)"""
CTE["sited"] = """
SELECT CAST(l_shipdate AS DATE) AS d, 3.0+avg(l_quantity)/6.0137::DOUBLE AS ws, sum(l_quantity)/10.0::DOUBLE AS e_mwh
FROM lineitem GROUP BY CAST(l_shipdate AS DATE)"""
D = "strftime(d, '%Y-%m-%d') AS d"
q("reference_export", f"SELECT {D}, {r('ws', 'ws', 6)} FROM refd")
q("wind_shear", f"SELECT {D}, {r('ws*pow(2.0, 0.2)', 'ws_hub', 6)} FROM refd")
q("daily_mean", f"SELECT strftime(ts, '%Y-%m-%d') AS d, {r('avg(value)', 'value')} FROM events GROUP BY 1")
q("air_density", f"""
SELECT {r('temp_c', 'temp_c', 6)}, count(*) AS n, {r('99200.0/(287.05*(temp_c+273.15))/1.225', 'ratio', 8)}
FROM res GROUP BY temp_c""".replace("GROUP BY temp_c", "GROUP BY res.temp_c"))
SITE_RHO = "101325.0*pow(1.0-2.25577e-5*{h},5.25588)/(287.05*({t}+273.15))/1.225"
q("density_correct_ws", f"""
SELECT {D}, {r('ws*pow(least(greatest(' + SITE_RHO.format(h=500.0, t='temp_c') + ',0.5),1.5),1.0/3.0)', 'ws_n', 6)}
FROM refd""")

# ---- curve -----------------------------------------------------------------------------------

q("curve_grid", f"""
SELECT CAST(g.cell AS BIGINT) AS cell, {rs('p0 p1', 6)}, coalesce(b.n, 0) AS n
FROM gridc g LEFT JOIN (SELECT CAST(floor(ws*10) AS INTEGER) AS cell, count(*) AS n FROM res GROUP BY 1) b USING (cell)""")
q("expected_power", f"""
SELECT turbine, {TS}, {r('ws', 'ws')}, {r(pw('g', 't.ws'), 'p')}
FROM res t JOIN gridc g ON g.cell = {cell('t.ws')}""")
CTE["ctc"] = """
SELECT * FROM (VALUES (3.0,0.90),(4.0,0.90),(5.0,0.89),(6.0,0.87),(7.0,0.84),(8.0,0.80),(9.0,0.74),(10.0,0.67),
 (11.0,0.60),(12.0,0.53),(13.0,0.47),(14.0,0.42),(16.0,0.33),(18.0,0.27),(20.0,0.22),(22.0,0.19),(24.0,0.16),
 (25.0,0.15)) t(v, ct)"""
CTE["ctk"] = "SELECT v, ct, lead(v) OVER (ORDER BY v) AS v1, lead(ct) OVER (ORDER BY v) AS ct1 FROM ctc"


def ct(x: str) -> str:
    return (f"(CASE WHEN {x} <= 3.0 THEN 0.90 WHEN {x} >= 25.0 THEN 0.15 ELSE (SELECT CAST(k.ct AS DOUBLE)"
            f" + (CAST(k.ct1 AS DOUBLE) - CAST(k.ct AS DOUBLE))*({x} - CAST(k.v AS DOUBLE))"
            f"/(CAST(k.v1 AS DOUBLE) - CAST(k.v AS DOUBLE)) FROM ctk k WHERE k.v <= {x} AND {x} < k.v1) END)")


q("ct_lookup", f"""
SELECT {r('b.x', 'v', 6)}, n, {r(ct('b.x'), 'ct', 6)}
FROM (SELECT floor(ws*5)/5+0.05 AS x, count(*) AS n FROM res GROUP BY 1) b""")
q("energy_from_series", f"""
SELECT turbine, {r('sum(' + pw('g', 't.ws') + '*' + DT + ')/1000.0', 'energy_mwh')}
FROM res t JOIN gridc g ON g.cell = {cell('t.ws')} GROUP BY turbine""")
q("expected_energy", f"""
SELECT turbine, {r('avg(rho)', 'density')}, {r('sum(xp)', 'power_sum')}, {r('sum(x)/1000.0', 'expected_mwh')}
FROM filled WHERE recorded = 1 GROUP BY turbine""")

# ---- flags -----------------------------------------------------------------------------------

q("qc_flags", f"SELECT turbine, {TS}, CAST(flag AS BIGINT) AS flag, why AS flag_reason FROM f4")
q("qc_status_map", """
SELECT CAST(status AS BIGINT) AS status, CAST(flag AS BIGINT) AS flag, count(*) AS n FROM f4 GROUP BY 1, 2""")
q("qc_sustained_low", f"""
SELECT turbine, {TS}, CAST(flag AS BIGINT) AS flag FROM f4_n WHERE why = 'Downtime (low power at usable wind)'""")
q("qc_curtail_derate", f"""
SELECT turbine, {TS}, CAST(flag AS BIGINT) AS flag, why AS flag_reason FROM f4_n
WHERE why IN ('Curtailment (low output at usable wind)', 'Derated / partial load')""")
q("qc_curtail_flag", f"""
SELECT turbine, {TS}, CAST(flag AS BIGINT) AS flag, why AS flag_reason FROM f4_c
WHERE why IN ('Curtailment (SCADA flag)', 'Curtailment (low output at usable wind)', 'Derated / partial load')""")
q("qc_environment", f"""
SELECT turbine, {TS}, why AS flag_reason FROM f4_n
WHERE why IN ('Environmental (high temperature)', 'Environmental (icing)')""")
q("qc_frozen_anemometer", """
SELECT turbine, CAST(flag AS BIGINT) AS flag, count(*) AS n, min(slot) AS first_slot, CAST(sum(slot) AS BIGINT) AS slot_sum
FROM f4_z GROUP BY 1, 2""")
q("impute_anemometer", f"""
SELECT turbine, {TS}, {r('xp', 'expected_power_kw')}, {r('xp*' + DT, 'expected_energy_kwh')} FROM f4_z WHERE flag = 7""")
CTE["zcount"] = """
SELECT turbine, count(*) FILTER (flag = 7) AS bad, max(slot) - min(slot) + 1 AS span FROM f4_z GROUP BY turbine"""
q("bad_anemometers", f"""
SELECT turbine, {r('bad / CAST(span AS DOUBLE)', 'fault_share', 6)} FROM zcount WHERE bad / CAST(span AS DOUBLE) > 0.02""")
LABEL = """CASE flag WHEN 0 THEN 'Operating' WHEN 1 THEN 'Below cut-in' WHEN 2 THEN 'Downtime' WHEN 3 THEN 'Curtailment'
 WHEN 4 THEN 'Derated / partial load' WHEN 5 THEN 'Environmental' WHEN 6 THEN 'Bad data' WHEN 7 THEN 'Anemometer fault'
 ELSE 'Missing / NaN' END"""
q("flag_summary", f"""
SELECT CAST(flag AS BIGINT) AS flag, {LABEL} AS label, count(*) AS "count",
       {r('100.0*count(*)/sum(count(*)) OVER ()', 'pct_of_records')} FROM filled GROUP BY flag""")
CTE["cov"] = """
SELECT count(*) AS n, sum(recorded) AS n_raw, count(DISTINCT turbine) AS n_turbines, max(slot)-min(slot) AS span FROM filled"""
q("coverage", f"""
SELECT n_turbines, span AS expected_rows_per_turbine, {r('100.0*n_raw/(n_turbines*span)', 'coverage_raw_pct')},
       {r('100.0*n/(n_turbines*span)', 'coverage_filled_pct')} FROM cov""")
q("qc_warnings", f"""
SELECT 'downtime share above 50 %: check the status codes' AS warning, {r('100.0*down', 'share_pct')}
FROM (SELECT avg(CASE WHEN (slot // 144) % 5 = 0 THEN CAST(flag = 0 AS INTEGER) ELSE 0 END) AS op,
             avg(CASE WHEN (slot // 144) % 5 = 0 THEN CAST(flag = 2 AS INTEGER) ELSE 1 END) AS down FROM filled)
WHERE op >= 0.1 AND down > 0.5
UNION ALL
SELECT 'operating share below 10 %: check the status codes', {r('100.0*op', 'share_pct')}
FROM (SELECT avg(CASE WHEN (slot // 144) % 5 = 0 THEN CAST(flag = 0 AS INTEGER) ELSE 0 END) AS op FROM filled)
WHERE op < 0.1""")

# ---- energy ----------------------------------------------------------------------------------


def mwh(col: str, cond: str) -> str:
    return f"coalesce(sum({col}) FILTER ({cond}), 0.0)/1000.0"


CTE["acct"] = f"""
SELECT {mwh('e', 'flag IN (0,7)')} AS actual_mwh, sum(x)/1000.0 AS expected_mwh, {mwh('x', 'flag = 2')} AS downtime_mwh,
       {mwh('x', 'flag = 3')} AS curtailment_mwh, {mwh('x', 'flag = 4')} AS derating_mwh,
       {mwh('x', 'flag = 5')} AS environmental_mwh, {mwh('x', 'flag <= 5')} AS gross_mwh,
       {mwh('x', 'flag = 0')} - {mwh('e', 'flag = 0')} AS shortfall_mwh FROM filled"""
q("energy_accounting", "SELECT " + rs("actual_mwh expected_mwh downtime_mwh curtailment_mwh derating_mwh environmental_mwh"
                                      " gross_mwh shortfall_mwh") + " FROM acct")
CAUSE = """CASE WHEN status IN (200,201,202) THEN 'Faults' WHEN status = 300 THEN 'Maintenance'
 WHEN status = 400 THEN 'Grid outage' ELSE 'Other' END"""
q("downtime_split", f"""
SELECT c.cause, {r("coalesce(s.v, 0.0)", 'loss_mwh')}
FROM (VALUES ('Faults'), ('Maintenance'), ('Grid outage'), ('Other / unspecified')) c(cause)
LEFT JOIN (SELECT CASE {CAUSE} WHEN 'Other' THEN 'Other / unspecified' ELSE {CAUSE} END AS cause, sum(x)/1000.0 AS v
           FROM filled WHERE flag = 2 GROUP BY 1) s USING (cause)
WHERE c.cause <> 'Other / unspecified' OR coalesce(s.v, 0.0) > 0.01""")
CTE["perturb"] = f"""
SELECT turbine, count(*)*{DT} AS hours, count(*) FILTER (flag = 2)*{DT} AS downtime_h,
       count(*) FILTER (flag = 3)*{DT} AS curtailment_h, {mwh('e', 'flag IN (0,7)')} AS energy_mwh,
       {mwh('x', 'flag = 2')} AS downtime_loss_mwh, {mwh('x', 'flag = 3')} AS curtailment_loss_mwh,
       {mwh('x', 'flag = 4')} AS derating_loss_mwh, {mwh('x', 'flag = 5')} AS environmental_loss_mwh,
       100.0*(count(*)-count(*) FILTER (flag = 2))/count(*) AS time_avail_pct,
       CASE WHEN {mwh('e', 'flag IN (0,7)')} + {mwh('x', 'flag = 2')} > 0
            THEN 100.0*{mwh('e', 'flag IN (0,7)')}/({mwh('e', 'flag IN (0,7)')} + {mwh('x', 'flag = 2')}) ELSE 100.0 END AS prod_avail_pct
FROM filled GROUP BY turbine"""
LOSSES = "downtime_loss_mwh curtailment_loss_mwh derating_loss_mwh environmental_loss_mwh"
q("availability_turbine", f"""
SELECT turbine, {rs('hours downtime_h curtailment_h energy_mwh ' + LOSSES + ' time_avail_pct prod_avail_pct')} FROM perturb""")
ORACLE["tables_written"] = ORACLE["availability_turbine"]
CTE["farmav"] = "SELECT avg(time_avail_pct) AS time_avail_pct, avg(prod_avail_pct) AS prod_avail_pct, " + ", ".join(
    f"sum({c}) AS {c}" for c in ("energy_mwh " + LOSSES).split()) + " FROM perturb"
q("availability_farm", f"SELECT {rs('time_avail_pct prod_avail_pct energy_mwh ' + LOSSES)} FROM farmav")
q("availability_monthly", f"""
SELECT month, {r(f'count(*) FILTER (flag = 2)*{DT}', 'downtime_h')}, {r(f'count(*) FILTER (flag = 3)*{DT}', 'curtailment_h')},
       {r(f'count(*)*{DT}', 'total_h')}, {r('sum(e) FILTER (flag IN (0,7))/1000.0', 'energy_mwh')},
       {r('100.0*(1-count(*) FILTER (flag = 2)/CAST(count(*) AS DOUBLE))', 'time_avail_pct')} FROM filled GROUP BY month""")
CTE["dmon"] = f"SELECT month, {CAUSE} AS cause, sum(x)/1000.0 AS loss FROM filled WHERE flag = 2 GROUP BY 1, 2"
q("downtime_monthly", f"SELECT month, cause, {r('loss', 'loss_mwh')} FROM dmon")
q("downtime_pivot", "SELECT month, " + ", ".join(
    r(f"coalesce(sum(loss) FILTER (cause = '{c}'), 0.0)", c.lower().replace(" ", "_"))
    for c in ("Faults", "Maintenance", "Grid outage", "Other")) + " FROM dmon GROUP BY month")
q("performance_monthly", f"""
SELECT month, {r('sum(e)/greatest(sum(x), 1e-9)', 'performance_ratio', 6)} FROM filled WHERE flag = 0 GROUP BY month""")
q("yearly_production", f"""
SELECT CAST(substr(month, 1, 4) AS BIGINT) AS year, {r(mwh('e', 'flag IN (0,7)'), 'measured_mwh')},
       {r(f'count(*) FILTER (flag IN (0,7))*{DT}', 'hours')}, {r('sum(x)/1000.0', 'gross_mwh')}
FROM filled GROUP BY 1 HAVING count(*) FILTER (flag IN (0,7)) > 0""")
q("energy_balance", f"""
SELECT m.metric, {r('m.mwh', 'mwh')} FROM acct, LATERAL (VALUES ('Energy produced (SCADA)', actual_mwh),
 ('Downtime loss (faults/maintenance/grid)', downtime_mwh), ('Curtailment loss', curtailment_mwh),
 ('Derating / partial load', derating_mwh), ('Environmental losses', environmental_mwh)) m(metric, mwh)""")
q("daily_gross", f"""
SELECT strftime(make_timestamp(slot*600000000), '%Y-%m-%d') AS d, {r('sum(x)/1000.0', 'e_mwh')}
FROM filled WHERE flag <= 5 GROUP BY 1""")


def mgross(days: float, excluded: str = "''") -> str:
    return f"""
SELECT strftime(d, '%Y-%m') AS month, count(e_mwh) AS n_days, sum(e_mwh)*{days}/count(e_mwh) AS gross_mwh
FROM sited GROUP BY 1 HAVING count(e_mwh) >= 20 AND month NOT IN ({excluded})"""


q("monthly_gross", f"SELECT month, n_days, {rs('gross_mwh')} FROM mg",
  mg=mgross(30.0, "'1996-02', '1997-07'"))
q("worst_turbines", f"""
SELECT turbine, {rs('downtime_loss_mwh')}, row_number() OVER (ORDER BY p.downtime_loss_mwh DESC, turbine) AS rank
FROM perturb p ORDER BY p.downtime_loss_mwh DESC, turbine LIMIT 3""")

# ---- power curve -----------------------------------------------------------------------------


def binned(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""
SELECT {k}CAST(floor(ws/0.5) AS INTEGER) AS bin, count(*) AS n, avg(ws) AS mws, avg(pwr) AS mp, stddev_pop(pwr) AS sd,
       max(pwr) AS top
FROM (SELECT *, power_kw/{clip('rho', 0.3, 1.5)} AS pwr FROM filled WHERE flag = 0 AND ws IS NOT NULL) WHERE pwr IS NOT NULL AND ws < 45
GROUP BY {k}bin"""


CTE["fbin"] = binned("")
CTE["tbin"] = binned("turbine")
BINCOLS = (f"coalesce(n, 0) AS \"count\", {r('CASE WHEN n >= 3 THEN mws END', 'mean_ws')},"
           f" {r('CASE WHEN n >= 3 THEN mp END', 'mean_power')}, {r('CASE WHEN n > 1 THEN sd END', 'std_power')},"
           f" {r('top', 'max_power')}")
q("power_curve_farm", f"""
SELECT CAST((s.i+0.5)*0.5 AS DOUBLE) AS bin_center, {BINCOLS} FROM range(90) s(i) LEFT JOIN fbin b ON b.bin = s.i""")
q("power_curve_turbine", f"""
SELECT t.turbine, CAST((s.i+0.5)*0.5 AS DOUBLE) AS bin_center, {BINCOLS}
FROM (SELECT DISTINCT turbine FROM tbin) t CROSS JOIN range(90) s(i) LEFT JOIN tbin b ON b.turbine = t.turbine AND b.bin = s.i""")
# bin centres lie half way between two nodes of the 0.5 m/s curve
CTE["nodemid"] = "SELECT a.i AS bin, (a.p + b.p)/2.0 AS pw FROM node a JOIN node b ON b.i = a.i + 1"
CTE["tdev"] = """
SELECT turbine, 100.0*sum(n*(mp-pw))/sum(n*pw) AS dev FROM tbin JOIN nodemid USING (bin) WHERE n >= 3 GROUP BY turbine"""
q("curve_deviation", f"""
SELECT o.turbine, {r('o.pr', 'performance_ratio', 6)}, o.n AS n_operating_rows, {r('coalesce(t.dev, 0.0)', 'deviation_pct', 6)}
FROM (SELECT turbine, sum(e)/greatest(sum(x), 1e-6) AS pr, count(*) AS n FROM filled WHERE flag = 0 GROUP BY turbine) o
LEFT JOIN tdev t USING (turbine)""")
q("worst_deviation", f"""
SELECT turbine, {r('dev', 'deviation_pct')}, row_number() OVER (ORDER BY dev DESC, turbine) AS rank
FROM tdev ORDER BY dev DESC, turbine LIMIT 3""")
q("curve_delta", f"""
SELECT CAST((bin+0.5)*0.5 AS DOUBLE) AS bin_center, n AS records, {r('CASE WHEN n >= 3 THEN mp END', 'measured_kw')}, {r('pw', 'warranted_kw')},
       {r('CASE WHEN n >= 3 THEN mp END - pw', 'delta_kw')},
       {r('100.0*(CASE WHEN n >= 3 THEN mp END - pw)/greatest(pw, 1.0)', 'delta_pct')}
FROM fbin JOIN nodemid USING (bin) WHERE (bin+0.5)*0.5 BETWEEN 3.0 AND 25.5""")

# ---- resource --------------------------------------------------------------------------------

CTE["winds"] = "SELECT * FROM filled WHERE (flag IN (0,1) OR gap_filled = 1) AND ws IS NOT NULL"
CTE["rose"] = """
SELECT CAST(floor(dir_deg/5)*5 AS BIGINT) AS dir_deg, CAST(floor(ws) AS BIGINT) AS ws_bin, count(*) AS n
FROM winds WHERE dir_deg IS NOT NULL GROUP BY 1, 2""".replace("GROUP BY 1, 2", "GROUP BY floor(winds.dir_deg/5), floor(winds.ws)") \
    .replace("CAST(floor(dir_deg/5)*5", "CAST(floor(winds.dir_deg/5)*5").replace("CAST(floor(ws)", "CAST(floor(winds.ws)")
q("wind_rose", "SELECT dir_deg, ws_bin, n AS \"count\" FROM rose")
CTE["freqs"] = "SELECT dir_deg+2.5 AS dd, ws_bin+0.5 AS vv, n/CAST(sum(n) OVER () AS DOUBLE) AS freq FROM rose"
q("rose_freq", f"SELECT dd + 0.0 AS dir_deg, vv + 0.0 AS ws_bin, {rs('freq', 8)} FROM freqs".replace(
    "dd + 0.0", "CAST(dd AS DOUBLE)").replace("vv + 0.0", "CAST(vv AS DOUBLE)"))
CLASSES = (0, 3, 6, 9, 12, 15, 20, 40)
q("wind_rose_classes", "SELECT CAST(least(floor((dir_deg % 360)/30.0), 11) AS BIGINT) AS sector, " + ", ".join(
    r(f"100.0*count(*) FILTER (ws >= {lo} AND ws < {hi})/sum(count(*)) OVER ()", f"ws_{lo}_{hi}", 6)
    for lo, hi in zip(CLASSES, CLASSES[1:])) + ", " + r(
    "100.0*count(*) FILTER (ws >= 40)/sum(count(*)) OVER ()", "ws_40_up", 6) + " FROM winds WHERE dir_deg IS NOT NULL GROUP BY 1")
q("wind_summary", f"""
SELECT {r('avg(ws)', 'mean_ws', 6)}, {r('100.0*avg(CAST(ws < 0.5 AS INTEGER))', 'calm_pct', 6)}, count(*) AS n FROM winds""")
q("wind_monthly", f"SELECT month, {r('avg(ws)', 'ws_mps', 6)} FROM winds GROUP BY month")
q("wind_diurnal", f"SELECT slot % 144 // 6 AS hour, {r('avg(ws)', 'ws_mps', 6)} FROM winds GROUP BY 1")
CTE["hist"] = """
SELECT s.i, coalesce(b.n, 0) AS n FROM range(42) s(i)
LEFT JOIN (SELECT CAST(least(floor(ws), 41) AS BIGINT) AS i, count(*) AS n FROM winds WHERE ws >= 0 GROUP BY 1) b USING (i)"""
q("wind_histogram", "SELECT CAST(i+0.5 AS DOUBLE) AS bin_center, n AS \"count\" FROM hist")
q("daily_histogram", f"""
SELECT CAST(least(floor((ws-lo)/((hi-lo)/40)), 39) AS BIGINT) AS bin, count(*) AS "count",
       {r('count(*)/(any_value(tot)*any_value((hi-lo)/40))', 'density', 6)}
FROM sited, (SELECT min(ws) AS lo, max(ws) AS hi, count(ws) AS tot FROM sited) GROUP BY 1""")


def solve_weibull(moments: str) -> dict[str, str]:
    """Steps that bisect the moment equation for each key of `moments` (key, mu, sd, n)."""
    ok = "gamma(1+2/((lo+hi)/2))/pow(gamma(1+1/((lo+hi)/2)),2) > 1+pow(sd/mu,2)"
    return {
        "mom": moments,
        "bis": f"""
SELECT key, mu, sd, n, 0.35 AS lo, CAST(6.0 AS DOUBLE) AS hi, 0 AS i FROM mom
UNION ALL SELECT key, mu, sd, n, CASE WHEN {ok} THEN (lo+hi)/2 ELSE lo END, CASE WHEN {ok} THEN hi ELSE (lo+hi)/2 END, i+1
FROM bis WHERE i < 60""".replace("0.35 AS lo", "CAST(0.35 AS DOUBLE) AS lo"),
        "wb": "SELECT key, mu, sd, n, (lo+hi)/2 AS k, mu/gamma(1+1/((lo+hi)/2)) AS a FROM bis WHERE i = 60"}


def qw(name: str, select: str, moments: str, **local: str) -> None:
    q(name, select, **{**solve_weibull(moments), **local})


# a recursive step may not be found through its own text; list it before its users
MOM_T = "SELECT turbine AS key, avg(ws) AS mu, stddev_samp(ws) AS sd, count(*) AS n FROM filled WHERE ws > 0.5 GROUP BY 1"
MOM_1 = "SELECT 1 AS key, avg(ws) AS mu, stddev_samp(ws) AS sd, count(*) AS n FROM filled WHERE ws > 0.5"
q("pp_sample", f"""
SELECT turbine, {TS}, {rs('ws power_kw')}, {r('xp', 'expected_power_kw')} FROM winds
WHERE substr(md5(concat(turbine, '|', slot)), 1, 8) < '19999999'""")
q("pp_density", f"""
SELECT CAST(floor(xp/100.0) AS BIGINT) AS expected_bin, CAST(floor(power_kw/100.0) AS BIGINT) AS measured_bin, count(*) AS "count",
       {r('avg(ws)', 'mean_ws', 6)} FROM winds WHERE power_kw IS NOT NULL AND xp IS NOT NULL GROUP BY 1, 2""")
qw("weibull_fit", f"""
SELECT key AS turbine, {r('mu', 'mean_ws', 5)}, {r('sd', 'sd_ws', 5)}, n, {r('k', 'weibull_k', 5)}, {r('a', 'weibull_a', 5)}
FROM wb""", MOM_T)
qw("weibull_pdf", f"""
SELECT CAST(i+0.5 AS DOUBLE) AS bin_center, {r('h.n/CAST(w.n AS DOUBLE)', 'observed', 6)},
       {r('(wb.k/wb.a)*pow((i+0.5)/wb.a,wb.k-1)*exp(-pow((i+0.5)/wb.a,wb.k))', 'pdf', 6)}
FROM hist h, wb, (SELECT count(*) AS n FROM winds) w""", MOM_1)
CTE["vpts"] = f"""
SELECT t.v, {pw('g', 't.v')} AS p, CASE WHEN i IN (0, 1999) THEN 0.5 ELSE 1.0 END AS wt
FROM (SELECT i, 0.05 + i*(44.9/1999) AS v FROM range(2000) r(i)) t JOIN gridc g ON g.cell = {cell('t.v')}"""


def aep(a: str, k: str) -> str:
    return f"sum(({k}/{a})*pow(v/{a}, {k}-1)*exp(-pow(v/{a}, {k}))*p*wt)*(44.9/1999)*8.76"


qw("aep_weibull", f"SELECT key AS turbine, {r(aep('a', 'k'), 'aep_mwh', 3)} FROM wb, vpts GROUP BY key, a, k", MOM_T)

# ---- wake ------------------------------------------------------------------------------------

# no turbine of these records exceeds the share of anemometer faults, so all belong to the pool
CTE["op"] = """
SELECT turbine, slot, ws, dir_deg, rho, CAST(floor(median(dir_deg) OVER (PARTITION BY slot)/30)*30 AS INTEGER) AS sector
FROM filled WHERE flag = 0 AND ws IS NOT NULL"""
CTE["wmean"] = "SELECT sector, turbine, avg(ws) AS mean_ws FROM op WHERE sector IS NOT NULL GROUP BY 1, 2"
CTE["refset"] = "SELECT * FROM wmean QUALIFY mean_ws >= max(mean_ws) OVER (PARTITION BY sector) * 0.985"
CTE["freed"] = """
SELECT slot, any_value(sector) AS sector, CASE WHEN f >= 5.0 THEN f END AS ws_free
FROM (SELECT o.slot, max(o.sector) AS sector, coalesce(avg(o.ws) FILTER (s.turbine IS NOT NULL), max(o.ws)) AS f
      FROM op o LEFT JOIN refset s ON s.sector = o.sector AND s.turbine = o.turbine GROUP BY o.slot) GROUP BY slot, f"""
CTE["defi"] = f"""
SELECT *, CASE WHEN waked THEN 1.0 - ws/ws_free ELSE 0.0 END AS deficit,
       CASE WHEN waked THEN greatest(0.0, pf-pv)*{clip('rho', 0.5, 1.15)} ELSE 0.0 END AS lost
FROM (SELECT o.*, f.ws_free, coalesce(f.ws_free - o.ws > 0.1 AND f.ws_free > 6.0, false) AS waked,
             {pw('g', 'f.ws_free')} AS pf, {pw('h', 'o.ws')} AS pv
      FROM op o JOIN freed f USING (slot) LEFT JOIN gridc g ON g.cell = {cell('f.ws_free')}
      LEFT JOIN gridc h ON h.cell = {cell('o.ws')})"""
q("wake_sector", f"SELECT {TS}, CAST(max(sector) AS BIGINT) AS sector FROM op GROUP BY slot")
q("wake_reference_set", f"SELECT {big('sector')}, turbine, {rs('mean_ws', 6)} FROM refset")
q("wake_free_stream", f"SELECT {TS}, {big('sector')}, {rs('ws_free', 6)} FROM freed")
q("wake_deficit", f"SELECT turbine, {TS}, {rs('ws_free deficit')}, {r('lost', 'wake_power_loss_kw')} FROM defi")
q("wake_sector_table", f"""
SELECT CAST(floor(dir_deg/30)*30 AS BIGINT) AS sector_deg, {r('avg(deficit)', 'mean_deficit', 8)}, count(*) AS n_samples
FROM defi WHERE ws_free > 6.0 GROUP BY 1""")
CTE["waket"] = f"""
SELECT turbine, avg(deficit) AS mean_deficit, count(*) AS n_samples, sum(lost)*{DT}/1000.0 AS wake_energy_mwh
FROM defi GROUP BY turbine"""
q("wake_turbine_table", f"SELECT turbine, {rs('mean_deficit', 6)}, n_samples, {rs('wake_energy_mwh', 6)} FROM waket")
CTE["wake1"] = f"SELECT sum(lost)*{DT}/1000.0 AS wake_energy_mwh, count(*) FILTER (waked) AS n_intervals FROM defi"
q("wake_loss", f"""
SELECT {rs('wake_energy_mwh')}, n_intervals, {rs('gross_mwh')}, {r('100.0*wake_energy_mwh/gross_mwh', 'wake_loss_pct')}
FROM wake1, acct""")
q("loss_matrix", f"""
SELECT t.turbine, """ + ", ".join(
    r(f"coalesce(sum(x) FILTER (flag = {f}), 0.0)/1000.0", f"{n}_mwh") + ", "
    + r(f"100.0*coalesce(sum(x) FILTER (flag = {f}), 0.0)/sum(x)", f"{n}_pct")
    for f, n in ((2, "downtime"), (3, "curtailment"), (4, "derating"), (5, "environmental"))) + f""",
       {r('coalesce(sum(e) FILTER (flag IN (0,7)), 0.0)/1000.0', 'energy_mwh')}, {r('sum(x)/1000.0', 'gross_mwh')},
       {r('coalesce(any_value(w.wake_energy_mwh), 0.0)', 'wake_mwh')},
       {r('100.0*coalesce(any_value(w.wake_energy_mwh), 0.0)/(sum(x)/1000.0)', 'wake_pct')}
FROM filled t LEFT JOIN waket w USING (turbine) GROUP BY t.turbine""")
q("loss_calculation", f"""
SELECT m.loss, m.formula, {r('m.v', 'value_mwh')} FROM acct, wake1, LATERAL (VALUES
 ('Availability (downtime)', 'sum P(v) dt over downtime', downtime_mwh),
 ('Curtailment', 'sum P(v) dt over curtailment', curtailment_mwh),
 ('Derating', 'sum P(v) dt over derated records', derating_mwh),
 ('Environmental', 'sum P(v) dt over environmental records', environmental_mwh),
 ('Wake', 'sum (P(v_free) - P(v)) dt', wake_energy_mwh),
 ('Turbine performance', 'sum (P - P_act) dt - wake', shortfall_mwh - wake_energy_mwh)) m(loss, formula, v)""")
q("performance_energy", f"""
SELECT {rs('shortfall_mwh wake_energy_mwh')}, {r('shortfall_mwh - wake_energy_mwh', 'performance_mwh')} FROM acct, wake1""")

# layout model: all pairs spelled out; D = 136 m, turbulence 0.10, wind blows from dir_deg
CTE["lbin"] = f"""
SELECT dd, vv, freq, -sin(radians(dd)) AS ux, -cos(radians(dd)) AS uy, {ct('vv')} AS ctv
FROM freqs WHERE vv >= 3.0 AND vv < 25.0"""
CTE["lpair"] = """
SELECT b.dd, b.vv, b.freq, b.ctv, t.turbine, (t.x-u.x)*ux + (t.y-u.y)*uy AS dx, -(t.x-u.x)*uy + (t.y-u.y)*ux AS dy
FROM lbin b, lay t, lay u WHERE t.turbine <> u.turbine"""
CTE["lone"] = """
SELECT *, CASE WHEN 1.0-ctv/(8.0*pow(s/136.0,2)) <= 0 THEN 1.0 ELSE 1.0-sqrt(1.0-ctv/(8.0*pow(s/136.0,2))) END
          * exp(-dy*dy/(2*s*s)) * (2*s*s/pow(68.0,2))*(1-exp(-pow(68.0,2)/(2*s*s))) AS def
FROM (SELECT *, (0.3837*0.10+0.003678)*(dx-68.0) + 0.2*136.0*sqrt(1.2) AS s FROM lpair WHERE dx > 68.0)"""
CTE["ldef"] = """
SELECT b.dd, b.vv, b.freq, t.turbine, t.x, t.y, sqrt(coalesce(sum(o.def*o.def), 0.0)) AS deficit
FROM lbin b CROSS JOIN lay t LEFT JOIN lone o ON o.dd = b.dd AND o.vv = b.vv AND o.turbine = t.turbine
GROUP BY b.dd, b.vv, b.freq, t.turbine, t.x, t.y"""
CTE["len"] = f"""
SELECT l.*, {pw('g', 'l.vv')}*freq AS ef, {pw('h', 'l.ve')}*freq AS ew
FROM (SELECT *, greatest(0.5, vv*(1.0-least(greatest(deficit, 0.0), 0.95))) AS ve FROM ldef) l
JOIN gridc g ON g.cell = {cell('l.vv')} JOIN gridc h ON h.cell = {cell('l.ve')}"""
q("wake_layout_pairs", f"""
SELECT CAST(dd AS DOUBLE) AS dir_deg, CAST(vv AS DOUBLE) AS ws_bin, turbine, {rs('deficit', 8)} FROM ldef""")
q("wake_layout_turbine", f"""
SELECT turbine, x, y, {r('sum(ef)', 'energy_free_mwh', 6)}, {r('sum(ew)', 'energy_waked_mwh', 6)},
       {r('sum(ef)-sum(ew)', 'wake_loss_mwh', 6)}, {r('100.0*(sum(ef)-sum(ew))/sum(ef)', 'wake_loss_pct', 6)}
FROM len GROUP BY turbine, x, y""")
q("wake_layout_sector", f"""
SELECT CAST(dd AS DOUBLE) AS dir_deg, CAST(vv AS DOUBLE) AS ws_bin, {r('avg(deficit)', 'mean_deficit', 6)},
       {r('100.0*(sum(ef)-sum(ew))/greatest(sum(ef), 1e-9)', 'loss_pct', 6)} FROM len GROUP BY dd, vv""")
CTE["lfarm"] = "SELECT sum(ef) AS ef, sum(ew) AS ew, 100.0*(sum(ef)-sum(ew))/sum(ef) AS pct FROM len"
q("wake_layout_farm", f"""
SELECT {r('ef', 'energy_free_mwh', 6)}, {r('ew', 'energy_waked_mwh', 6)}, {r('pct', 'farm_loss_pct', 6)} FROM lfarm""")

# ---- long term -------------------------------------------------------------------------------

q("site_daily", f"""
SELECT strftime(make_timestamp(slot*600000000), '%Y-%m-%d') AS d, {r('avg(ws)', 'ws', 6)} FROM filled WHERE ws IS NOT NULL
GROUP BY 1""")
CTE["mpair"] = """
SELECT d, s.ws AS site_ws, f.ws AS ref_ws, CAST(floor(f.dir/30)*30 AS BIGINT) AS sector FROM sited s JOIN refd f USING (d)"""
q("mcp_pairs", f"SELECT {D}, {rs('site_ws ref_ws', 6)}, sector FROM mpair")
CTE["mfit"] = """
SELECT sector, regr_slope(site_ws, ref_ws) AS slope, regr_intercept(site_ws, ref_ws) AS intercept,
       regr_r2(site_ws, ref_ws) AS r2, count(*) AS n FROM mpair GROUP BY sector HAVING count(*) >= 30"""
q("mcp_fit", f"SELECT sector, {rs('slope intercept r2', 8)}, n FROM mfit")
CTE["mpred"] = """
SELECT d, intercept + slope*ws AS ws FROM refd f JOIN mfit m ON m.sector = floor(f.dir/30)*30 WHERE intercept + slope*ws > 0"""
q("mcp_predict", f"SELECT {D}, {rs('ws', 6)} FROM mpred")
CTE["mr2"] = "SELECT sum(r2*n)/sum(n) AS r2, CAST(sum(n) AS BIGINT) AS days FROM mfit"
q("mcp_r2", f"SELECT {r('r2', 'mcp_r2', 10)}, days AS mcp_days FROM mr2")
q("mcp_pooled_fit", f"""
SELECT {r('regr_slope(site_ws, ref_ws)', 'slope', 8)}, {r('regr_intercept(site_ws, ref_ws)', 'intercept', 8)},
       {r('regr_r2(site_ws, ref_ws)', 'r2', 8)}, count(*) AS n FROM mpair""")
CTE["lts"] = """
SELECT d, ws, 'predicted' AS origin FROM mpred WHERE (SELECT count(*) FROM mpred) >= 365
UNION ALL SELECT d, ws, 'measured' FROM sited WHERE (SELECT count(*) FROM mpred) < 365"""
q("lt_series", f"SELECT {D}, {rs('ws', 6)}, origin FROM lts")
q("lt_rolling", f"""
SELECT {D}, {r('ws', 'ws', 6)}, {r('CASE WHEN count(ws) OVER w = 30 THEN avg(ws) OVER w END', 'rolling', 6)} FROM lts
WINDOW w AS (ORDER BY lts.d ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)""")
CTE["mets"] = """
SELECT (SELECT count(*) FROM lts)/365.25 AS lt_n_years, (SELECT avg(ws) FROM lts) AS lt_mean_ws,
       (SELECT max(origin) FROM lts) = 'predicted' AS has_mcp,
       (SELECT date_diff('day', min(d), max(d)) FROM sited)/30.44 AS record_months, (SELECT avg(ws) FROM sited) AS site_mean_ws"""
q("record_metrics", f"""
SELECT {rs('lt_n_years lt_mean_ws', 6)}, CAST(has_mcp AS BIGINT) AS has_mcp, {rs('record_months site_mean_ws', 6)} FROM mets""")
WLT = "SELECT a, k, a*lt_mean_ws/greatest(site_mean_ws, 0.5) AS lt_a FROM wb, mets"
qw("weibull_lt", f"""
SELECT {r('a', 'weibull_a', 5)}, {r('k', 'weibull_k', 5)}, {r('lt_a', 'lt_a', 5)}, {r('k', 'lt_k', 5)} FROM wlt""", MOM_1, wlt=WLT)


def cubic(wind: str) -> str:
    return f"""
SELECT c, n, 1.0 - ss_res/ss_tot AS r2
FROM (SELECT c, count(*) AS n, sum(pow(e-c*pow(v,3),2)) AS ss_res, sum(pow(e-m,2)) AS ss_tot
      FROM (SELECT *, exp(avg(ln(e)-3.0*ln(v)) OVER ()) AS c, avg(e) OVER () AS m
            FROM (SELECT s.e_mwh AS e, w.ws AS v FROM sited s JOIN {wind} w USING (d) WHERE s.e_mwh > 0 AND w.ws > 0.5))
      GROUP BY c)"""


CTE["cub"] = cubic("sited")
CTE["cublt"] = cubic("lts")
q("fit_cubic", f"SELECT {rs('c', 8)}, n, {rs('r2', 8)} FROM cub")
q("fit_linear", f"""
SELECT {r('regr_slope(e_mwh, ws)', 'slope', 6)}, {r('regr_intercept(e_mwh, ws)', 'intercept', 6)},
       {r('regr_r2(e_mwh, ws)', 'r2', 6)}, count(*) AS n FROM sited""")
CTE["mdaily"] = """
SELECT b.c AS daily_c, b.n AS daily_n, b.r2 AS daily_r2,
       (SELECT c FROM cublt)*(SELECT sum(pow(greatest(ws, 0.5), 3)) FROM lts)/lt_n_years AS daily_mwh FROM cub b, mets"""
q("lt_daily_energy", f"SELECT {rs('daily_c', 5)}, daily_n, {rs('daily_r2 daily_mwh', 5)} FROM mdaily")
CTE["refm"] = """
SELECT strftime(d, '%Y-%m') AS month, avg(ws) AS ws, avg(temp_c) AS temp_c, any_value(day(last_day(d))) AS days
FROM refd GROUP BY 1"""
CTE["mge"] = mgross(30.44)
CTE["mfitm"] = """
SELECT regr_slope(g.gross_mwh, f.ws) AS b, regr_intercept(g.gross_mwh, f.ws) AS a, regr_r2(g.gross_mwh, f.ws) AS r2, count(*) AS n
FROM mge g JOIN refm f USING (month)"""
CTE["mmonthly"] = """
SELECT b AS monthly_slope, a AS monthly_intercept, r2 AS monthly_r2, n AS monthly_n,
       (SELECT sum(greatest(0.0, m.a+m.b*f.ws)) FROM refm f, mfitm m)/lt_n_years AS monthly_mwh FROM mfitm, mets"""
q("lt_monthly_energy", f"SELECT {rs('monthly_slope monthly_intercept monthly_r2', 5)}, monthly_n, {rs('monthly_mwh', 5)} FROM mmonthly")
CTE["nme"] = mgross(30.0)
CTE["nrho"] = f"SELECT *, {SITE_RHO.format(h=0.0, t='temp_c')} AS rho FROM refm"
CTE["ntrain"] = "SELECT g.gross_mwh, f.ws, f.rho FROM nme g JOIN nrho f USING (month)"
CTE["nall"] = """
SELECT month, days, ws*pow(least(greatest(rho/(SELECT avg(rho) FROM ntrain), 0.5), 1.5), 1.0/3.0) AS wsn FROM nrho"""
CTE["nfit"] = """
SELECT regr_slope(g.gross_mwh, f.wsn) AS b, regr_intercept(g.gross_mwh, f.wsn) AS a, regr_r2(g.gross_mwh, f.wsn) AS r2, count(*) AS n
FROM nme g JOIN nall f USING (month)"""
q("lt_normalised_month", f"""
SELECT {r('b', 'nm_slope', 5)}, {r('a', 'nm_intercept', 5)}, {r('r2', 'nm_r2', 5)}, n AS nm_n,
       {r('(SELECT sum(greatest(0.0, m.b*f.wsn+m.a)*f.days/30.0) FROM nall f, nfit m)/lt_n_years', 'nm_mwh', 5)} FROM nfit, mets""")

FARM = {**solve_weibull(MOM_1), "wlt": WLT,
        "gross": f"""
SELECT w.lt_a, w.k AS lt_k, n_turbines, n_turbines*aep1 AS method_a_mwh
FROM wlt w, (SELECT count(DISTINCT turbine) AS n_turbines FROM filled),
     (SELECT {aep('lt_a', 'k')} AS aep1 FROM wlt, vpts)"""}


def qf(name: str, select: str, **more: str) -> None:
    q(name, select, **{**FARM, **more})


# the daily and monthly relations have r2 far below 0.5, so none becomes primary
qf("lt_method_choice", f"""
SELECT {rs('method_a_mwh daily_mwh monthly_mwh record_months', 2)},
       CASE WHEN record_months >= 9 AND monthly_r2 >= 0.5 THEN 'monthly'
            WHEN record_months >= 9 AND daily_r2 >= 0.5 THEN 'daily' END AS primary_method,
       CASE WHEN record_months >= 9 AND monthly_r2 >= 0.5 THEN monthly_mwh
            WHEN record_months >= 9 AND daily_r2 >= 0.5 THEN daily_mwh END AS method_b_mwh
FROM gross, mdaily, mmonthly, mets""")
qf("gross_aep", f"""
SELECT {r('method_a_mwh', 'gross_lt_mwh', 3)}, 'Weibull and warranted curve' AS lt_method, {rs('lt_a lt_k', 3)}, n_turbines FROM gross""")
CTE["sigw"] = """
SELECT CASE WHEN has_mcp THEN least(greatest(3.0 + 5.0*(1.0-r2) + 1.5*least(3.0, 24.0/greatest(6.0, record_months))
            + greatest(0.0, 5.0-0.5*lt_n_years), 2.5), 12.0) ELSE 10.0 END AS s FROM mets, mr2"""
q("sigma_wind", f"SELECT {r('s', 'sigma_wind_pct', 6)} FROM sigw")

# ---- yaw -------------------------------------------------------------------------------------

CTE["yop"] = """
SELECT turbine, slot, ws, power_kw, CASE WHEN d > 180 THEN d-360 ELSE d END AS yaw_err, CAST(floor(ws*2) AS INTEGER) AS bin
FROM (SELECT *, ((wind_dir_deg-dir_deg) % 360 + 360) % 360 AS d FROM filled
      WHERE flag = 0 AND ws IS NOT NULL AND power_kw IS NOT NULL AND wind_dir_deg IS NOT NULL AND dir_deg IS NOT NULL)"""
CTE["yrow"] = """
SELECT *, least(greatest(power_kw/greatest(avg(power_kw) OVER (PARTITION BY turbine, bin), 1.0), 0.3), 1.7) AS pr
FROM (SELECT *, count(*) OVER (PARTITION BY turbine) AS n_used FROM yop o
      WHERE ws BETWEEN 3.0 AND 12.0 AND (SELECT count(*) FROM yop) >= 200
        AND turbine IN (SELECT turbine FROM yop GROUP BY 1 HAVING count(*) >= 100)) WHERE n_used >= 80"""
q("yaw_rows", f"SELECT turbine, {TS}, {rs('yaw_err pr', 6)} FROM yrow")
# parabola from centred sums: regress y on x and z = x^2
CTE["ysum"] = """
SELECT turbine, count(*) AS n, avg(yaw_err) AS mx, avg(yaw_err*yaw_err) AS mz, avg(pr) AS my,
       var_pop(yaw_err) AS sxx, var_pop(yaw_err*yaw_err) AS szz, covar_pop(yaw_err, yaw_err*yaw_err) AS sxz,
       covar_pop(yaw_err, pr) AS sxy, covar_pop(yaw_err*yaw_err, pr) AS szy, var_pop(pr) AS syy,
       sum((greatest(power_kw, 0.0)+1.0)*yaw_err)/sum(greatest(power_kw, 0.0)+1.0) AS wm, stddev_pop(yaw_err) AS spread
FROM yrow GROUP BY turbine"""
CTE["yfit"] = """
SELECT *, my - b*mx - a*mz AS c, (b*sxy + a*szy)/syy AS r2
FROM (SELECT *, (szy*sxx - sxy*sxz)/(szz*sxx - sxz*sxz) AS a, (sxy*szz - szy*sxz)/(szz*sxx - sxz*sxz) AS b FROM ysum)"""
q("yaw_fit", f"""
SELECT turbine, n, {r('wm', 'mean_yaw_error_deg', 7)}, {r('spread', 'yaw_spread_deg', 7)}, {r('my', 'mean_power_ratio', 7)},
       {rs('a b c', 7)}, {r('r2', 'r2_all', 7)} FROM yfit""")
CTE["yscr"] = """
SELECT *, CASE WHEN ok THEN r2 ELSE 0.0 END AS fit_r2, CASE WHEN ok AND r2 >= 0.02 THEN vertex END AS fitted
FROM (SELECT *, -b/(2.0*a) AS vertex, a < 0 AND spread > 2.0 AND abs(-b/(2.0*a)) <= 40 AS ok FROM yfit)"""
q("yaw_screening", f"""
SELECT turbine, {r('wm', 'mean_yaw_error_deg', 5)}, {r('coalesce(fitted, wm)', 'yaw_misalignment_deg', 5)}, {rs('fit_r2', 5)},
       {r('spread', 'yaw_spread_deg', 5)}, n,
       {r('coalesce(greatest(0.0, 100.0*(a*fitted*fitted + b*fitted)/greatest(c, 1e-9)), 0.0)', 'loss_pct', 5)},
       {r('my', 'mean_power_ratio', 5)}, CAST(abs(coalesce(fitted, wm)) > 5.0 AS BIGINT) AS flagged FROM yscr""")
q("yaw_bins", f"""
SELECT CAST(floor(yaw_err/2)*2+1 AS BIGINT) AS yaw_center, {r('avg(pr)', 'mean_power_ratio', 6)}, count(*) AS n
FROM yrow WHERE yaw_err >= -40 AND yaw_err < 40 GROUP BY 1""")

# ---- yield -----------------------------------------------------------------------------------

PCT = "100.0*{}/gross_mwh"
YIELD = {
    "site": """
SELECT *, pct/100.0*gross_mwh AS wake_used_mwh, shortfall_mwh - wake_energy_mwh AS performance_mwh,
       method_a_mwh AS gross_lt_mwh FROM acct, wake1, lfarm, gross""",
    "net": """
SELECT *, gross_lt_mwh*(1.0-total_loss_pct/100.0) AS net_mwh
FROM (SELECT *, 100.0*(downtime_mwh+curtailment_mwh+derating_mwh+environmental_mwh+wake_used_mwh+performance_mwh)/gross_mwh
                AS measured_loss_pct,
             100.0*(downtime_mwh+curtailment_mwh+derating_mwh+environmental_mwh+wake_used_mwh+performance_mwh)/gross_mwh + 2.5
                AS total_loss_pct FROM site)""",
    "tree": """
SELECT m.* FROM net, LATERAL (VALUES (0, 'Availability (downtime)', downtime_mwh, 100.0*downtime_mwh/gross_mwh),
 (1, 'Curtailment', curtailment_mwh, 100.0*curtailment_mwh/gross_mwh),
 (2, 'Derating / partial load', derating_mwh, 100.0*derating_mwh/gross_mwh),
 (3, 'Environmental', environmental_mwh, 100.0*environmental_mwh/gross_mwh),
 (4, 'Wake', wake_used_mwh, 100.0*wake_used_mwh/gross_mwh),
 (5, 'Turbine performance', performance_mwh, 100.0*performance_mwh/gross_mwh),
 (6, 'Electrical', NULL, 2.0), (7, 'Other', NULL, 0.5)) m(ord, loss, mwh, pct)""",
    "comp": """
SELECT m.* FROM net, sigw, LATERAL (VALUES (0, 'Wind resource (long-term)', s), (1, 'Power curve measurement', 2.0),
 (2, 'Availability losses', least(greatest(15.0*downtime_mwh/gross_mwh, 0.3), 1.5)), (3, 'Curtailment losses', 0.5),
 (4, 'Wake losses', least(greatest(25.0*wake_used_mwh/gross_mwh, 0.5), 3.0)), (5, 'Turbine performance', 1.0),
 (6, 'Electrical losses', 0.4), (7, 'Environmental losses', 0.4), (8, 'Other', 0.5)) m(ord, component, sg)""",
    "sig": """
SELECT *, net_mwh*exp(sigma*sigma/2) AS mean_mwh, net_mwh*exp(sigma*sigma/2)*sqrt(exp(sigma*sigma)-1) AS sd_mwh
FROM net, (SELECT sqrt(sum(sg*sg))/100.0 AS sigma FROM comp)""",
}


def qy(name: str, select: str, **more: str) -> None:
    q(name, select, **{**FARM, **YIELD, **more})


qy("loss_tree", f"SELECT {big('ord')}, loss, {r('mwh', 'energy_mwh')}, {r('pct', 'pct_of_gross')} FROM tree")
qy("loss_reconciliation", f"""
SELECT {r('gross_mwh', 'gross_period_mwh')}, {r('actual_mwh', 'measured_mwh')},
       {r('gross_mwh*(1-measured_loss_pct/100.0)', 'modelled_net_period_mwh')}, {rs('measured_loss_pct total_loss_pct')},
       {r('100.0*(gross_mwh*(1-measured_loss_pct/100.0)-actual_mwh)/gross_mwh', 'gap_pct')} FROM net""")
qy("loss_waterfall", f"""
SELECT {big('ord')}, loss, {r('-t.pct/100.0*gross_lt_mwh', 'step_mwh', 2)},
       {r('gross_lt_mwh*(1 - sum(t.pct) OVER (ORDER BY t.ord)/100.0)', 'balance_mwh', 2)} FROM tree t, net""")
qy("future_losses", f"""
SELECT {big('ord')}, loss, CAST(l AS DOUBLE) AS loss_pct, {r('gross_lt_mwh*kept', 'net_after_mwh', 2)},
       {r('CAST(100.0*(1-kept) AS DOUBLE)', 'total_pct', 2)}
FROM net, (VALUES (0, 'availability', 3.0, 0.97), (1, 'curtailment', 1.4, 0.97*0.986), (2, 'electrical', 2.0, 0.97*0.986*0.98),
 (3, 'blade degradation', 1.5, 0.97*0.986*0.98*0.985)) f(ord, loss, l, kept)""")
qy("uncertainty_components", f"""
SELECT {big('ord')}, component, {r('sg', 'sigma_pct', 6)}, {r('100.0*sg*sg/sum(sg*sg) OVER ()', 'contribution_pct', 6)} FROM comp""")
Z = {"P75": 0.6744897501960817, "P90": 1.2815515655446004, "P95": 1.6448536269514722, "P99": 2.3263478740408408}
qy("p_values", f"""
SELECT m.p_value, {r('m.v', 'net_aep_mwh', 2)}, {r('100.0*m.v/net_mwh', 'pct_of_deterministic', 2)}
FROM sig, LATERAL (VALUES ('P50', net_mwh), ('P75', net_mwh*exp(-{Z['P75']}*sigma)), ('P90', net_mwh*exp(-{Z['P90']}*sigma)),
 ('P99', net_mwh*exp(-{Z['P99']}*sigma)), ('P50 80% CI low', net_mwh*exp(-{Z['P90']}*sigma)),
 ('P50 80% CI high', net_mwh*exp({Z['P90']}*sigma)), ('P90 90% CI low', net_mwh*exp(-{Z['P95']}*sigma)),
 ('P90 90% CI high', net_mwh*exp({Z['P95']}*sigma)), ('mean', mean_mwh), ('sd', sd_mwh)) m(p_value, v)""")
qy("p_values_draws", f"""
SELECT turbine, {r('energy_mwh', 'p50', 3)}, {r(f"energy_mwh*exp(-{Z['P75']}*sigma)", 'p75', 3)},
       {r(f"energy_mwh*exp(-{Z['P90']}*sigma)", 'p90', 3)}, {r(f"energy_mwh*exp(-{Z['P99']}*sigma)", 'p99', 3)} FROM perturb, sig""")


def below(z: str) -> str:
    """Normal distribution function by its series; beyond six sigmas it is 0 or 1 to all places shown."""
    odd = "list_prepend(CAST(1 AS DOUBLE), list_transform(range(100), lambda k: CAST(201 - 2*k AS DOUBLE)))"
    return (f"(CASE WHEN {z} > 6 THEN 1.0 WHEN {z} < -6 THEN 0.0 ELSE 0.5 + exp(-{z}*{z}/2)/sqrt(2*pi())*{z}"
            f"*list_reduce({odd}, lambda acc, m: 1 + {z}*{z}/m*acc) END)")


qy("yield_histogram", f"""
SELECT i AS bin, {r('any_value(a)', 'from_mwh', 6)}, {r('any_value(w)', 'width_mwh', 6)},
       {r(f"sum(({below('z1')} - {below('z0')}) / (n*w))", 'density', 6)}
FROM (SELECT *, ln(a/e)/sigma AS z0, ln((a + w)/e)/sigma AS z1
      FROM (SELECT i, lo + i*(hi - lo)/80 AS a, (hi - lo)/80 AS w, e, sigma, n
            FROM (SELECT energy_mwh AS e, sigma FROM perturb, sig WHERE energy_mwh > 0),
                 (SELECT min(energy_mwh*exp(-4*sigma)) AS lo, max(energy_mwh*exp(4*sigma)) AS hi, count(*) AS n
                  FROM perturb, sig WHERE energy_mwh > 0), range(80) r(i))) GROUP BY i""")
qy("benchmark", f"""
SELECT CAST(60000.0 AS DOUBLE) AS preconstruction_p50_mwh, {r('net_mwh', 'assessment_p50_mwh', 3)},
       {r('net_mwh/60000.0', 'ratio', 3)}, {r('100.0*(net_mwh-60000.0)/60000.0', 'delta_pct', 3)} FROM sig""")
qy("sensitivity", f"""
SELECT parameter, change, {r('dv', 'delta_p50_mwh', 2)}, {r('100.0*dv/net_mwh', 'delta_p50_pct', 2)} FROM (
  SELECT concat('Loss: ', t.loss, ' +1 pp') AS parameter, '+1 pp' AS change, -net_mwh*0.01/(1.0-t.pct/100.0) AS dv, net_mwh
  FROM tree t, net
  UNION ALL
  SELECT concat('Long-term mean wind speed ', c), c, {aep('(lt_a+da)', 'lt_k')}*any_value(n_turbines)*(1-any_value(total_loss_pct)/100.0)
         - any_value(net_mwh), any_value(net_mwh)
  FROM net, (VALUES ('+0.1 m/s', 0.1), ('-0.1 m/s', -0.1)) s(c, da), vpts GROUP BY c, lt_a, da, lt_k)""")
CTE["fdev"] = "SELECT 100.0*sum(n*(mp-pw))/sum(n*pw) AS dev FROM fbin JOIN nodemid USING (bin) WHERE n >= 3"
qy("findings", f"""
SELECT m.finding, {r('m.v', 'value')} FROM net, farmav, cov, mr2, (SELECT min(dev) AS worst FROM tdev),
 LATERAL (VALUES ('availability', time_avail_pct, time_avail_pct < 97.0), ('power curve deviation', worst, worst < -2.0),
  ('curtailment', 100.0*curtailment_mwh/greatest(1.0, actual_mwh), 100.0*curtailment_mwh/greatest(1.0, actual_mwh) > 2.0),
  ('wake losses', 100.0*wake_energy_mwh/gross_mwh, 100.0*wake_energy_mwh/gross_mwh > 4.0),
  ('long-term correlation', r2, r2 < 0.8),
  ('data coverage', 100.0*n_raw/(cov.n_turbines*span), 100.0*n_raw/(cov.n_turbines*span) < 90.0)) m(finding, v, hit) WHERE m.hit""")
KPI = [
    ("Farm", None, "'Wind Farm'"), ("Turbines", "net.n_turbines", None), ("Rated power (kW)", "2500.0", None),
    ("SCADA period", None, "period"),
    ("Data coverage (%)", "round(100.0*n/(cov.n_turbines*span), 1)", None),
    ("Time-based availability (%)", "round(time_avail_pct, 2)", None),
    ("Production-based availability (%)", "round(prod_avail_pct, 2)", None),
    ("Energy-weighted power curve deviation (%)", "round(dev, 2)", None),
    ("Wake loss (% of gross)", "round(100.0*wake_energy_mwh/gross_mwh, 2)", None),
    ("Total losses (% of gross)", "round(total_loss_pct, 2)", None),
    ("Gross AEP (MWh/yr)", "round(gross_lt_mwh, 0)", None),
    ("Net AEP deterministic (MWh/yr)", "round(net_mwh, 0)", None), ("Net AEP P50 (MWh/yr)", "round(net_mwh, 0)", None),
    *[(f"Net AEP {k} (MWh/yr)", f"round(net_mwh*exp(-{Z[k]}*sigma), 0)", None) for k in ("P75", "P90", "P99")],
    ("Uncertainty 1 sigma (MWh/yr)", "round(sd_mwh, 0)", None),
    ("Capacity factor (%)", "round(100.0*net_mwh*1000.0/(2500.0*net.n_turbines*8760.0), 1)", None),
    ("Full-load hours (h/yr)", "round(net_mwh*1000.0/(2500.0*net.n_turbines), 0)", None),
    ("Long-term correction method", None, "CASE WHEN has_mcp THEN 'MCP on reference series' ELSE 'measured record only' END"),
    ("Long-term mean wind speed (m/s)", "round(lt_mean_ws, 2)", None),
    ("Long-term Weibull A (m/s)", "round(net.lt_a, 2)", None), ("Long-term Weibull k", "round(net.lt_k, 2)", None),
    ("Gross AEP - Method A (MWh/yr)", "round(method_a_mwh, 0)", None), ("Gross AEP - Method B (MWh/yr)", None, None),
    ("LT method used", None, "'Weibull and warranted curve'"), ("Pre-construction P50 (MWh/yr)", "60000.0", None),
    ("Assessment / pre-construction ratio", "round(net_mwh/60000.0, 3)", None)]
qy("kpi_summary", "SELECT CAST(ord AS BIGINT) AS ord, parameter, round(v, 3) AS value, txt AS text FROM sig AS net, farmav, cov, fdev, mets,\n"
   " (SELECT concat(strftime(make_timestamp(min(slot)*600000000), " + STAMP + "), ' - ', strftime(make_timestamp(max(slot)*600000000), "
   + STAMP + ")) AS period FROM filled),\n LATERAL (VALUES " + ",\n ".join(
       f"({i}, '{n}', CAST({v or 'NULL'} AS DOUBLE), CAST({t or 'NULL'} AS VARCHAR))" for i, (n, v, t) in enumerate(KPI))
   + ") m(ord, parameter, v, txt)")
