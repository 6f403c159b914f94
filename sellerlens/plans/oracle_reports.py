"""Oracle SQL (DuckDB) for the period/scope report queries.

Periods are restated in SQL from the as-of literal with DuckDB date
arithmetic (not taken from the Python calendar), so the oracle also checks
the period resolution. Ratios use the same IEEE operation order as the
Spark operators: each exact sum converted to DOUBLE once, then divided,
then scaled by 100.
"""

from __future__ import annotations

from sellerlens.plans.oracle import A, MART_SQL, asp_sql, cte, money, q10_cte, q14_cte, with_ctes
from sellerlens.plans.params import CUSTOM_END, CUSTOM_START, REFRESHED_AT

CS, CE = f"DATE '{CUSTOM_START.isoformat()}'", f"DATE '{CUSTOM_END.isoformat()}'"
CM = f"CAST(date_trunc('month', {A}) AS DATE)"

# ----------------------------------------------------------------------------- periods
cte("scope_list", "SELECT DISTINCT scope FROM scopes", ("scopes",))


def _series(start: str, end: str) -> str:
    return (f"SELECT CAST(unnest(generate_series(CAST({start} AS TIMESTAMP), CAST({end} AS TIMESTAMP), "
            f"INTERVAL 1 MONTH)) AS DATE) AS month")


def _roles(curr: str, d1: str | None, d2: str | None) -> str:
    parts = [f"SELECT 'curr' AS role, month FROM {curr}"]
    if d1:
        parts.append(f"SELECT 'd1', CAST(month - INTERVAL {d1} AS DATE) FROM {curr}")
    if d2:
        parts.append(f"SELECT 'd2', CAST(month - INTERVAL {d2} AS DATE) FROM {curr}")
    return "\nUNION ALL ".join(parts)


cte("pm_month_c", f"SELECT {CM} AS month")
cte("pm_month", _roles("pm_month_c", "1 MONTH", "12 MONTH"), ("pm_month_c",))
cte("pm_quarter_c", _series(f"date_trunc('quarter', {A})", CM))
cte("pm_quarter", _roles("pm_quarter_c", "3 MONTH", "12 MONTH"), ("pm_quarter_c",))
cte("pm_year_c", _series(f"date_trunc('year', {A})", CM))
cte("pm_year", _roles("pm_year_c", None, "12 MONTH"), ("pm_year_c",))
cte("pm_custom_c", _series(f"date_trunc('month', {CS})", f"date_trunc('month', {CE})"))
cte("pm_custom", _roles("pm_custom_c", "1 MONTH", "12 MONTH"), ("pm_custom_c",))
cte("pm_last_month_c", f"SELECT CAST({CM} - INTERVAL 1 MONTH AS DATE) AS month")
cte("pm_last_month", _roles("pm_last_month_c", "1 MONTH", "12 MONTH"), ("pm_last_month_c",))
# quick ranges are custom periods: the months their first and last days fall in
_WEEK_END = f"({A} - CAST(CASE WHEN isodow({A}) = 6 THEN 7 ELSE isodow({A}) % 7 + 1 END AS INTEGER))"
_QUICK = {
    "yesterday": (f"{A} - 1", f"{A} - 1"), "last_week": (f"{_WEEK_END} - 6", _WEEK_END), "this_month": (A, A),
    "this_quarter": (f"date_trunc('quarter', {A})", A), "this_year": (f"date_trunc('year', {A})", A),
}
for _q, (_s, _e) in _QUICK.items():
    cte(f"pm_{_q}_c", _series(f"date_trunc('month', {_s})", f"date_trunc('month', {_e})"))
    cte(f"pm_{_q}", _roles(f"pm_{_q}_c", "1 MONTH", "12 MONTH"), (f"pm_{_q}_c",))
cte("pd_day", f"SELECT 'curr' AS role, {A} - 1 AS s, {A} - 1 AS e UNION ALL SELECT 'd1', {A} - 2, {A} - 2")
cte("pd_week_end", f"SELECT {A} - CAST(CASE WHEN dayofweek({A}) = 6 THEN 7 ELSE dayofweek({A}) + 1 END AS INTEGER) AS wend")
cte("pd_week", """
SELECT 'curr' AS role, wend - 6 AS s, wend AS e FROM pd_week_end
UNION ALL SELECT 'd1', wend - 13, wend - 7 FROM pd_week_end""", ("pd_week_end",))

MONTH_CHART = (CM, f"{A} - 1")
DAY_CHART = (f"{A} - 30", f"{A} - 1")
WEEK_CHART = (f"{A} - 28", f"{A} - 1")

MONTHLY_ROLES = {"month": ("curr", "d1", "d2"), "quarter": ("curr", "d1", "d2"), "year": ("curr", "d2"),
                 **{x: ("curr", "d1", "d2") for x in ("custom", "last_month", *_QUICK)}}
DAILY_ROLES = {"day": ("curr", "d1"), "week": ("curr", "d1")}


def in_role(mode: str, role: str, col: str = "m.month", day_col: str = "m.day") -> str:
    if mode in DAILY_ROLES:
        pd = f"pd_{mode}"
        return (f"{day_col} BETWEEN (SELECT s FROM {pd} WHERE role = '{role}') "
                f"AND (SELECT e FROM {pd} WHERE role = '{role}')")
    return f"{col} IN (SELECT month FROM pm_{mode} WHERE role = '{role}')"


def period_cte(mode: str) -> str:
    return f"pd_{mode}" if mode in DAILY_ROLES else f"pm_{mode}"


def roles_of(mode: str) -> tuple[str, ...]:
    return DAILY_ROLES.get(mode) or MONTHLY_ROLES[mode]


# ----------------------------------------------------------------------------- expression helpers
def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def z(x: str) -> str:
    return f"COALESCE({x}, 0)"


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN {den} <> 0 THEN {d(num)} / {d(den)} END)"


def ratio0(num: str, den: str) -> str:
    return f"COALESCE({ratio(num, den)}, 0.0)"


def pct(num: str, den: str) -> str:
    return f"({ratio(num, den)} * 100.0)"


def pct0(num: str, den: str) -> str:
    return f"COALESCE({pct(num, den)}, 0.0)"


def chg(cur: str, prev: str) -> str:
    return f"(CASE WHEN {prev} <> 0 THEN {d(f'{cur} - {prev}')} / {d(prev)} END * 100.0)"


def out(expr: str, kind: str, alias: str) -> str:
    if kind == "money":
        return f"CAST({expr} AS DOUBLE) AS {alias}"
    if kind == "int":
        return f"CAST({expr} AS BIGINT) AS {alias}"
    return f"{expr} AS {alias}"


def asp0(num: str, den: str, digits: int = 0) -> str:
    return asp_sql(num, den, digits)


SALES_F = [("gmv", "money"), ("si", "int")]
LOGI_F = [("gmv_total", "money"), ("gmv_ff", "money"), ("gmv_xd", "money"), ("gmv_ss", "money")]
INV_COLS = ["g1_pre_agreed", "g1_dod", "g1_lightning", "g2_price_matching", "g2_smart", "g2_auto", "g3_coupons"]
G1 = "(COALESCE(g1_pre_agreed, 0) + COALESCE(g1_dod, 0) + COALESCE(g1_lightning, 0))"
G2 = "(COALESCE(g2_price_matching, 0) + COALESCE(g2_smart, 0) + COALESCE(g2_auto, 0))"
G3 = "COALESCE(g3_coupons, 0)"


def scoped(mart: str) -> str:
    return f"{mart} m JOIN scopes s ON m.seller_id = s.seller_id"


def sums_cte(name: str, mart: str, fields: list[str], mode: str) -> str:
    """(scope, f_role...) conditional sums of a mart over a period's roles."""
    cols = ",\n  ".join(
        f"SUM(CASE WHEN {in_role(mode, r)} THEN {z('m.' + f)} ELSE 0 END) AS {f}_{r}"
        for f in fields for r in roles_of(mode)
    )
    cte(name, f"SELECT s.scope,\n  {cols}\nFROM {scoped(mart)} GROUP BY s.scope",
        (mart, "scopes", period_cte(mode)) + (("pd_week_end",) if mode == "week" else ()))
    return name


def kpi_select(sums: str, fields: list[tuple[str, str]], mode: str) -> str:
    roles = roles_of(mode)
    cols = []
    for f, kind in fields:
        cols.append(out(z(f"a.{f}_curr"), kind, f))
        for r in ("d1", "d2"):
            if r in roles:
                cols.append(f"{chg(z(f'a.{f}_curr'), z(f'a.{f}_{r}'))} AS {f}_{r}")
            else:
                cols.append(f"CAST(NULL AS DOUBLE) AS {f}_{r}")
    return f"SELECT sl.scope, {', '.join(cols)}\nFROM scope_list sl LEFT JOIN {sums} a ON sl.scope = a.scope"


def kpi_sql(mart_m: str, mart_d: str, fields: list[tuple[str, str]], mode: str, tag: str) -> str:
    mart = mart_d if mode in DAILY_ROLES else mart_m
    name = sums_cte(f"sums_{tag}_{mode}", mart, [f for f, _ in fields], mode)
    return with_ctes([name, "scope_list"], kpi_select(name, fields, mode))


def period_sum_cte(name: str, mart: str, fields: list[str], mode: str, role: str = "curr") -> str:
    """(scope, Σ fields) over one role of a period, zero-filled over all scopes."""
    cols = ", ".join(f"SUM({z('m.' + f)}) AS {f}" for f in fields)
    inner = f"SELECT s.scope, {cols} FROM {scoped(mart)} WHERE {in_role(mode, role)} GROUP BY s.scope"
    fill = ", ".join(f"{z('x.' + f)} AS {f}" for f in fields)
    cte(name, f"SELECT sl.scope, {fill} FROM scope_list sl LEFT JOIN ({inner}) x ON sl.scope = x.scope",
        (mart, "scopes", "scope_list", period_cte(mode)) + (("pd_week_end",) if mode == "week" else ()))
    return name


def seller_rollup_cte(name: str, mart: str, fields: list[str], mode: str) -> str:
    cols = ", ".join(f"SUM({z('m.' + f)}) AS {f}" for f in fields)
    cte(name, f"SELECT s.scope, m.seller_id, {cols} FROM {scoped(mart)} WHERE {in_role(mode, 'curr')} "
              f"GROUP BY s.scope, m.seller_id",
        (mart, "scopes", period_cte(mode)) + (("pd_week_end",) if mode == "week" else ()))
    return name


def daily_series_cte(name: str, mart: str, fields: list[str], rng: tuple[str, str]) -> str:
    cols = ", ".join(f"SUM({z('m.' + f)}) AS {f}" for f in fields)
    cte(name, f"SELECT s.scope, m.day, {cols} FROM {scoped(mart)} WHERE m.day BETWEEN {rng[0]} AND {rng[1]} "
              f"GROUP BY s.scope, m.day", (mart, "scopes"))
    return name


def monthly_series_cte(name: str, mart: str, fields: list[str], months_cte: str) -> str:
    cols = ", ".join(f"SUM({z('m.' + f)}) AS {f}" for f in fields)
    roll = (f"SELECT s.scope, m.month, {cols} FROM {scoped(mart)} "
            f"WHERE m.month IN (SELECT month FROM {months_cte}) GROUP BY s.scope, m.month")
    fill = ", ".join(f"{z('r.' + f)} AS {f}" for f in fields)
    cte(name, f"SELECT g.scope, g.month, {fill} FROM (SELECT sl.scope, c.month FROM scope_list sl, {months_cte} c) g "
              f"LEFT JOIN ({roll}) r ON g.scope = r.scope AND g.month = r.month",
        (mart, "scopes", "scope_list", months_cte))
    return name


def lbl_day(col: str = "day") -> str:
    return f"CAST({col} AS VARCHAR) AS label"


def lbl_month(col: str = "month") -> str:
    return f"strftime({col}, '%Y-%m') AS label"


SQL: dict[str, str] = {}


def with_seller(sql: str) -> str:
    """The same rows with the seller's name, or its id as text."""
    return f"""
SELECT named.*, COALESCE(who.name, CAST(named.seller_id AS VARCHAR)) AS seller
FROM ({sql}) named
LEFT JOIN (SELECT s_suppkey AS seller_id, MIN(s_name) AS name FROM supplier GROUP BY 1) who USING (seller_id)"""


# ----------------------------------------------------------------------------- P01 / P02
SQL["seller_scopes"] = with_ctes(["scopes"], "SELECT scope, scope_kind, seller_id FROM scopes")
SQL["seller_labels"] = with_ctes(["q01", "portfolio"], """
SELECT q.seller_id, COALESCE(p.name, CAST(q.seller_id AS VARCHAR)) AS seller
FROM (SELECT DISTINCT seller_id FROM q01) q LEFT JOIN portfolio p ON q.seller_id = p.seller_id""")

# ----------------------------------------------------------------------------- P05-P13
cte("roll_q01", f"""
SELECT s.scope, m.month, SUM({z('m.gmv')}) AS gmv, SUM({z('m.si')}) AS si
FROM {scoped('q01')} GROUP BY s.scope, m.month""", ("q01", "scopes"))
SQL["months_rollup"] = with_ctes(["roll_q01"], f"""
SELECT scope, strftime(month, '%Y-%m') AS month, {money('gmv')}, CAST(si AS BIGINT) AS si FROM roll_q01""")
SQL["months_rollup_current_year"] = with_ctes(["roll_q01"], f"""
SELECT scope, strftime(month, '%Y-%m') AS month, {money('gmv')}, CAST(si AS BIGINT) AS si FROM roll_q01
WHERE year(month) = year({A})""")

SQL["sum_months_quarter"] = with_ctes([period_sum_cte("sm_q", "q01", ["gmv", "si"], "quarter")], f"""
SELECT scope, {money('gmv')}, CAST(si AS BIGINT) AS si FROM sm_q""")
SQL["sum_daily_range_week"] = with_ctes([period_sum_cte("sd_w", "q02", ["gmv", "si"], "week")], f"""
SELECT scope, {money('gmv')}, CAST(si AS BIGINT) AS si FROM sd_w""")
SQL["rollup_sellers_month"] = with_ctes([seller_rollup_cte("rs_m", "q01", ["gmv", "si"], "month")], f"""
SELECT scope, seller_id, {money('gmv')}, CAST(si AS BIGINT) AS si FROM rs_m""")
SQL["daily_series_month"] = with_ctes([daily_series_cte("ds_m", "q02", ["gmv"], MONTH_CHART)], f"""
SELECT scope, CAST(day AS VARCHAR) AS day, {money('gmv')} FROM ds_m""")
SQL["daily_series_multi_day"] = with_ctes([daily_series_cte("ds_d", "q02", ["gmv", "si"], DAY_CHART)], f"""
SELECT scope, CAST(day AS VARCHAR) AS day, {money('gmv')}, CAST(si AS BIGINT) AS si FROM ds_d""")
SQL["monthly_series_year"] = with_ctes([monthly_series_cte("msy", "q01", ["gmv", "si"], "pm_year_c")], f"""
SELECT scope, strftime(month, '%Y-%m') AS month, {money('gmv')}, CAST(si AS BIGINT) AS si FROM msy""")

SQL["chart_window_series_month"] = with_ctes(["roll_q01"], """
SELECT scope, strftime(month, '%Y-%m') AS label, CAST(gmv AS DOUBLE) AS value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY scope ORDER BY month DESC) AS k FROM roll_q01
) WHERE k <= 12""")
SQL["chart_window_series_year"] = with_ctes(["roll_q01"], f"""
SELECT scope, strftime(month, '%Y-%m') AS label, CAST(gmv AS DOUBLE) AS value FROM roll_q01
WHERE year(month) = year({A})""")
cte("ds_wk", f"""
SELECT s.scope, m.day, SUM({z('m.gmv')}) AS gmv FROM {scoped('q02')}
WHERE {in_role('week', 'curr')} GROUP BY s.scope, m.day""", ("q02", "scopes", "pd_week"))
SQL["chart_window_series_week"] = with_ctes(["ds_wk"], """
SELECT scope, CAST(day AS VARCHAR) AS label, CAST(gmv AS DOUBLE) AS value FROM ds_wk""")
SQL["chart_window_series_quarter"] = with_ctes([monthly_series_cte("cws_q", "q01", ["gmv"], "pm_quarter_c")], """
SELECT scope, strftime(month, '%Y-%m') AS label, CAST(gmv AS DOUBLE) AS value FROM cws_q""")

# ----------------------------------------------------------------------------- P14 / P15 / P16 / P17
for _mode in ("day", "week", "month", "quarter", "year", "custom", "last_month", *_QUICK):
    SQL[f"sales_kpi_{_mode}"] = kpi_sql("q01", "q02", SALES_F, _mode, "sales")


# P14 for the 30 as-of dates that end at A: each date's ranges are restated in SQL
cte("as_ofs", f"SELECT CAST(unnest(generate_series(CAST({A} - 29 AS TIMESTAMP), CAST({A} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS a")
_LAST_DAY = "least(CAST(date_trunc('month', {x}) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE), a - 1)"
cte("date_ranges_month", " UNION ALL ".join(
    f"SELECT a, '{r}' AS role, CAST(date_trunc('month', {x}) AS DATE) AS s, {_LAST_DAY.format(x=x)} AS e FROM as_ofs"
    for r, x in (("curr", "a"), ("d1", "a - INTERVAL 1 MONTH"), ("d2", "a - INTERVAL 12 MONTH"))), ("as_ofs",))
cte("date_ranges_week", """
SELECT a, role, sat - back - 6 AS s, sat - back AS e
FROM (SELECT a, a - CAST(1 + (isodow(a - 1) + 1) % 7 AS INTEGER) AS sat FROM as_ofs), (VALUES ('curr', 0), ('d1', 7)) r(role, back)""", ("as_ofs",))
cte("sales_days", """
SELECT closed_date AS day, seller_id, SUM(gmv) AS gmv, CAST(SUM(units) AS BIGINT) AS si FROM sales
WHERE gmv_flag AND seller_id IN (SELECT seller_id FROM portfolio) GROUP BY 1, 2""", ("sales", "portfolio"))
for _mode in ("month", "week"):
    _cols = [f"SUM({f}) FILTER (role = '{r}') AS {f}_{r}" for f in ("gmv", "si") for r in ("curr", "d1", "d2")]
    cte(f"date_sums_{_mode}", f"""
SELECT a, scope, {', '.join(_cols)}
FROM date_ranges_{_mode} JOIN sales_days ON day BETWEEN s AND e JOIN scopes USING (seller_id) GROUP BY a, scope""",
        (f"date_ranges_{_mode}", "sales_days", "scopes"))
    _out = [out(z(f"t.{f}_curr"), kind, f) for f, kind in (("gmv", "money"), ("si", "int"))]
    _out += [f"{chg(z(f't.{f}_curr'), z(f't.{f}_{r}'))} AS {f}_{r}" for f in ("gmv", "si") for r in ("d1", "d2")]
    SQL["sales_kpi_dates" + ("_week" if _mode == "week" else "")] = with_ctes([f"date_sums_{_mode}", "scope_list"], f"""
SELECT strftime(x.a, '%Y-%m-%d') AS as_of, sl.scope, {', '.join(_out)}
FROM scope_list sl CROSS JOIN as_ofs x LEFT JOIN date_sums_{_mode} t ON t.a = x.a AND t.scope = sl.scope""")


def asp_kpi_sql(mode: str) -> str:
    mart = "q02" if mode in DAILY_ROLES else "q01"
    name = sums_cte(f"sums_asp_{mode}", mart, ["gmv", "si"], mode)
    roles = roles_of(mode)
    cur = f"COALESCE({ratio('a.gmv_curr', 'a.si_curr')}, 0.0)"
    cols = []
    for r in ("d1", "d2"):
        if r in roles:
            p = ratio(f"a.gmv_{r}", f"a.si_{r}")
            ok = f"{p} IS NOT NULL AND {p} <> 0" + (f" AND {cur} <> 0" if mode in DAILY_ROLES else "")
            cols.append(f"CASE WHEN {ok} THEN ({cur} - {p}) / {p} * 100.0 END AS asp_{r}")
        else:
            cols.append(f"CAST(NULL AS DOUBLE) AS asp_{r}")
    return with_ctes([name, "scope_list"], f"""
SELECT sl.scope, {cur} AS asp, {', '.join(cols)}
FROM scope_list sl LEFT JOIN {name} a ON sl.scope = a.scope""")


SQL["asp_kpi_month"] = asp_kpi_sql("month")
SQL["asp_kpi_week"] = asp_kpi_sql("week")
SQL["asp_series_month"] = with_ctes([daily_series_cte("asp_sm", "q02", ["gmv", "si"], MONTH_CHART)], f"""
SELECT scope, {lbl_day()}, {asp0('gmv', 'si')} AS asp FROM asp_sm""")
SQL["asp_series_quarter"] = with_ctes([monthly_series_cte("asp_sq", "q01", ["gmv", "si"], "pm_quarter_c")], f"""
SELECT scope, {lbl_month()}, {asp0('gmv', 'si')} AS asp FROM asp_sq""")

SQL["growth_series"] = with_ctes(["roll_q01"], f"""
SELECT r.scope, strftime(r.month, '%Y-%m') AS month, CAST(r.gmv AS DOUBLE) AS value,
       {chg('r.gmv', 'r.prev')} AS mom_pct, {chg('r.gmv', 'y.gmv')} AS yoy_pct
FROM (SELECT *, LAG(gmv) OVER (PARTITION BY scope ORDER BY month) AS prev,
             ROW_NUMBER() OVER (PARTITION BY scope ORDER BY month DESC) AS k FROM roll_q01) r
LEFT JOIN roll_q01 y ON y.scope = r.scope AND y.month = CAST(r.month - INTERVAL 12 MONTH AS DATE)
WHERE r.k <= 12""")


# ----------------------------------------------------------------------------- P18 sales table
def seller_sales_sql(mode: str) -> str:
    mart = "q02" if mode in DAILY_ROLES else "q01"
    per = seller_rollup_cte(f"sst_{mode}", mart, ["gmv", "si"], mode)
    return with_ctes([per, "portfolio"], f"""
SELECT p.scope, p.seller_id, CAST(p.gmv AS DOUBLE) AS gmv, CAST(p.si AS BIGINT) AS si,
       {ratio0('p.gmv', 'p.si')} AS asp, {pct0('p.gmv', 't.tg')} AS share_pct,
       COALESCE(f.name, CAST(p.seller_id AS VARCHAR)) AS seller
FROM {per} p JOIN (SELECT scope, SUM(gmv) AS tg FROM {per} GROUP BY scope) t ON p.scope = t.scope
LEFT JOIN portfolio f ON p.seller_id = f.seller_id""")


SQL["seller_sales_table"] = seller_sales_sql("month")
SQL["seller_sales_table_week"] = seller_sales_sql("week")

# ----------------------------------------------------------------------------- P19-P21 logistics
_tot = "(CASE WHEN z_total <> 0 THEN z_total ELSE 1 END)"


def logistics_mix_sql(mode: str) -> str:
    """P19 for a period mode; daily modes sum the daily logistics mart (q03)."""
    lm = sums_cte(f"sums_logi_{mode}", "q03" if mode in DAILY_ROLES else "q06", [f for f, _ in LOGI_F], mode)
    prior = {r: z(f"a.gmv_ff_{r}") if r in roles_of(mode) else "NULL" for r in ("d1", "d2")}
    return with_ctes([lm, "scope_list"], f"""
SELECT scope, {pct('z_ff', _tot)} AS ff_pct, {pct('z_xd', _tot)} AS xd_pct, {pct('z_ss', _tot)} AS ss_pct,
       CAST(z_ff AS DOUBLE) AS gmv_ff, {chg('z_ff', 'z_ff1')} AS gmv_ff_d1, {chg('z_ff', 'z_ff2')} AS gmv_ff_d2
FROM (SELECT sl.scope, {z('a.gmv_total_curr')} AS z_total, {z('a.gmv_ff_curr')} AS z_ff,
             {z('a.gmv_xd_curr')} AS z_xd, {z('a.gmv_ss_curr')} AS z_ss,
             {prior['d1']} AS z_ff1, {prior['d2']} AS z_ff2
      FROM scope_list sl LEFT JOIN {lm} a ON sl.scope = a.scope)""")


SQL["logistics_mix"] = logistics_mix_sql("month")
SQL["logistics_mix_week"] = logistics_mix_sql("week")

_LOGI_SER = ["gmv_total", "gmv_ff", "gmv_xd", "gmv_ss", "si_ff", "si_xd", "si_ss"]


def _logi_series_select(src: str, label: str) -> str:
    return f"""
SELECT scope, {label}, {pct('gmv_ff', 'gmv_total')} AS ff_pct, {money('gmv_ff')}, {money('gmv_xd')},
       {money('gmv_ss')}, CAST(si_ff AS BIGINT) AS si_ff, CAST(si_xd AS BIGINT) AS si_xd,
       CAST(si_ss AS BIGINT) AS si_ss FROM {src}"""


SQL["logistics_series"] = with_ctes([daily_series_cte("ls_m", "q03", _LOGI_SER, MONTH_CHART)],
                                    _logi_series_select("ls_m", lbl_day()))
SQL["logistics_series_quarter"] = with_ctes([monthly_series_cte("ls_q", "q06", _LOGI_SER, "pm_quarter_c")],
                                            _logi_series_select("ls_q", lbl_month()))
def logistics_seller_sql(mode: str) -> str:
    per = seller_rollup_cte(f"lst_{mode}", "q03" if mode in DAILY_ROLES else "q06", [f for f, _ in LOGI_F], mode)
    return with_seller(with_ctes([per], f"""
SELECT scope, seller_id, {money('gmv_total')}, {money('gmv_ff')}, {pct0('gmv_ff', 'gmv_total')} AS ff_pct,
       {money('gmv_xd')}, {pct0('gmv_xd', 'gmv_total')} AS xd_pct,
       {money('gmv_ss')}, {pct0('gmv_ss', 'gmv_total')} AS ss_pct,
       {pct0('gmv_ff', 'gmv_total')} >= 50.0 AS ff_flag
FROM {per}"""))


SQL["logistics_seller_table"] = logistics_seller_sql("month")
SQL["logistics_seller_table_week"] = logistics_seller_sql("week")

# ----------------------------------------------------------------------------- P22-P26 ads
cte("ads_present", f"SELECT DISTINCT s.scope, m.month FROM {scoped('q07')}", ("q07", "scopes"))
cte("sales_roll", f"SELECT s.scope, m.month, SUM(m.gmv) AS gmv FROM {scoped('q01')} GROUP BY s.scope, m.month",
    ("q01", "scopes"))


def ads_ratio_cte(name: str, months_cte: str) -> str:
    """(scope, ads_invest, gmv_ads, gmv, roas, acos, ads_share, take_rate) over a month set."""
    last = f"(SELECT MAX(month) FROM {months_cte})"
    cte(name, f"""
SELECT sl.scope, {z('a.inv')} AS ads_invest, {z('a.gads')} AS gmv_ads, {z('g.gmv')} AS gmv,
       {ratio0(z('a.gads'), z('a.inv'))} AS roas,
       {pct0(z('a.inv'), z('a.gads'))} AS acos,
       {pct0(z('a.gads'), z('g.gmv'))} AS ads_share,
       CASE WHEN pg.gmv <> 0 THEN {d(z('a.inv'))} / {d('pg.gmv')} * 100.0 END AS take_rate
FROM scope_list sl
LEFT JOIN (SELECT s.scope, SUM({z('m.ads_invest')}) AS inv, SUM({z('m.gmv_ads')}) AS gads
           FROM {scoped('q07')} WHERE m.month IN (SELECT month FROM {months_cte}) GROUP BY s.scope) a
       ON sl.scope = a.scope
LEFT JOIN (SELECT s.scope, SUM({z('m.gmv')}) AS gmv
           FROM {scoped('q01')} WHERE m.month IN (SELECT month FROM {months_cte}) GROUP BY s.scope) g
       ON sl.scope = g.scope
LEFT JOIN (SELECT h.scope, (SELECT MAX(b.month) FROM ads_present b WHERE b.scope = h.scope AND b.month < h.month)
                  AS prev_month
           FROM ads_present h WHERE h.month = {last}) pm ON sl.scope = pm.scope
LEFT JOIN sales_roll pg ON pg.scope = sl.scope AND pg.month = pm.prev_month""",
        ("scope_list", "scopes", "q07", "q01", "ads_present", "sales_roll", months_cte))
    return name


for _role, _src in (("c", "curr"), ("d1", "d1"), ("d2", "d2")):
    for _mode in ("month", "quarter"):
        cte(f"pmr_{_mode}_{_role}", f"SELECT month FROM pm_{_mode} WHERE role = '{_src}'", (f"pm_{_mode}",))
        ads_ratio_cte(f"ar_{_mode}_{_role}", f"pmr_{_mode}_{_role}")

SQL["ads_ratios"] = with_ctes(["ar_month_c"], f"""
SELECT scope, {money('ads_invest')}, {money('gmv_ads')}, {money('gmv')}, roas, acos, ads_share, take_rate
FROM ar_month_c""")


def ads_kpi_sql(mode: str) -> str:
    sums = sums_cte(f"sums_ads_{mode}", "q07", ["ads_invest", "gmv_ads"], mode)
    base = kpi_select(sums, [("ads_invest", "money"), ("gmv_ads", "money")], mode)
    deltas = []
    for mname in ("roas", "acos", "ads_share", "take_rate"):
        for r in ("d1", "d2"):
            prior = f"{r}.{mname}"
            deltas.append(f"CASE WHEN {prior} IS NOT NULL THEN COALESCE(c.{mname}, 0.0) - {prior} END AS {mname}_{r}")
    return with_ctes([sums, "scope_list", f"ar_{mode}_c", f"ar_{mode}_d1", f"ar_{mode}_d2"], f"""
SELECT k.*, c.roas, c.acos, c.ads_share, c.take_rate, {', '.join(deltas)}, TRUE AS acos_better_down
FROM ({base}) k JOIN ar_{mode}_c c ON k.scope = c.scope
JOIN ar_{mode}_d1 d1 ON k.scope = d1.scope JOIN ar_{mode}_d2 d2 ON k.scope = d2.scope""")


SQL["ads_kpi"] = ads_kpi_sql("month")
SQL["ads_kpi_quarter"] = ads_kpi_sql("quarter")


def ads_kpi_daily_sql(mode: str) -> str:
    """P23 in a daily mode: sums of the daily ads mart (q04) with % deltas; ratios of the current
    range against the daily sales mart (q02); no take rate and no ratio deltas."""
    sums = sums_cte(f"sums_ads_{mode}", "q04", ["ads_invest", "gmv_ads"], mode)
    base = kpi_select(sums, [("ads_invest", "money"), ("gmv_ads", "money")], mode)
    ads = period_sum_cte(f"ads_cur_{mode}", "q04", ["ads_invest", "gmv_ads"], mode)
    gmv = period_sum_cte(f"gmv_cur_{mode}", "q02", ["gmv"], mode)
    nulls = ", ".join(f"CAST(NULL AS DOUBLE) AS {m}_{r}" for m in ("roas", "acos", "ads_share", "take_rate")
                      for r in ("d1", "d2"))
    return with_ctes([sums, "scope_list", ads, gmv], f"""
SELECT k.*, {ratio0('a.gmv_ads', 'a.ads_invest')} AS roas, {pct0('a.ads_invest', 'a.gmv_ads')} AS acos,
       {pct0('a.gmv_ads', 'g.gmv')} AS ads_share, CAST(NULL AS DOUBLE) AS take_rate, {nulls},
       TRUE AS acos_better_down
FROM ({base}) k JOIN {ads} a ON k.scope = a.scope JOIN {gmv} g ON k.scope = g.scope""")


SQL["ads_kpi_week"] = ads_kpi_daily_sql("week")

_ads_d = daily_series_cte("as_d", "q04", ["ads_invest", "gmv_ads"], MONTH_CHART)
_gmv_d = daily_series_cte("gs_d", "q02", ["gmv"], MONTH_CHART)
SQL["ads_series"] = with_ctes([_ads_d, _gmv_d], f"""
SELECT a.scope, {lbl_day('a.day')}, CAST(a.ads_invest AS DOUBLE) AS ads_invest, CAST(a.gmv_ads AS DOUBLE) AS gmv_ads,
       {ratio('a.gmv_ads', 'a.ads_invest')} AS roas, {pct('a.ads_invest', 'a.gmv_ads')} AS acos,
       {pct('a.gmv_ads', z('g.gmv'))} AS ads_share
FROM as_d a LEFT JOIN gs_d g ON a.scope = g.scope AND a.day = g.day""")

_ads_q = monthly_series_cte("as_q", "q07", ["ads_invest", "gmv_ads"], "pm_quarter_c")
_gmv_q = monthly_series_cte("gs_q", "q01", ["gmv"], "pm_quarter_c")
SQL["ads_series_quarter"] = with_ctes([_ads_q, _gmv_q], f"""
SELECT scope, {lbl_month()}, CAST(ads_invest AS DOUBLE) AS ads_invest, CAST(gmv_ads AS DOUBLE) AS gmv_ads,
       {ratio('gmv_ads', 'ads_invest')} AS roas, {pct('ads_invest', 'gmv_ads')} AS acos, {pct('gmv_ads', 'gmv')} AS ads_share
FROM as_q JOIN gs_q USING (scope, month)""")

cte("ads_roll", f"SELECT s.scope, m.month, SUM({z('m.ads_invest')}) AS inv FROM {scoped('q07')} GROUP BY s.scope, m.month",
    ("q07", "scopes"))
SQL["take_rate_series"] = with_ctes(["ads_roll", "sales_roll"], """
SELECT a.scope, strftime(a.month, '%Y-%m') AS month, CAST(a.inv AS DOUBLE) AS ads_invest,
       CASE WHEN g.gmv <> 0 THEN CAST(a.inv AS DOUBLE) / CAST(g.gmv AS DOUBLE) * 100.0 END AS take_rate
FROM (SELECT *, LAG(month) OVER (PARTITION BY scope ORDER BY month) AS prev_month FROM ads_roll) a
LEFT JOIN sales_roll g ON g.scope = a.scope AND g.month = a.prev_month""")

_ast = seller_rollup_cte("ast_m", "q07", ["ads_invest", "gmv_ads", "clicks"], "month")
_sgm = seller_rollup_cte("sgm_m", "q01", ["gmv"], "month")
SQL["ads_seller_table"] = with_seller(with_ctes([_ast, _sgm, "ads_present", "pm_month_c"], f"""
SELECT a.scope, a.seller_id, CAST(a.ads_invest AS DOUBLE) AS ads_invest, CAST(a.gmv_ads AS DOUBLE) AS gmv_ads,
       CAST(a.clicks AS BIGINT) AS clicks,
       {ratio0('a.gmv_ads', 'a.ads_invest')} AS roas, {pct0('a.ads_invest', 'a.gmv_ads')} AS acos,
       CASE WHEN pg.gmv <> 0 THEN CAST(a.ads_invest AS DOUBLE) / CAST(pg.gmv AS DOUBLE) * 100.0 END AS take_rate,
       {pct0('a.gmv_ads', z('g.gmv'))} AS ads_share
FROM ast_m a LEFT JOIN sgm_m g ON a.scope = g.scope AND a.seller_id = g.seller_id
LEFT JOIN (SELECT h.scope, (SELECT MAX(b.month) FROM ads_present b WHERE b.scope = h.scope AND b.month < h.month)
                  AS prev_month
           FROM ads_present h WHERE h.month = (SELECT MAX(month) FROM pm_month_c)) pm ON a.scope = pm.scope
LEFT JOIN q01 pg ON pg.seller_id = a.seller_id AND pg.month = pm.prev_month"""))
_astw = seller_rollup_cte("ast_w", "q04", ["ads_invest", "gmv_ads", "clicks"], "week")
_sgmw = seller_rollup_cte("sgm_w", "q02", ["gmv"], "week")
SQL["ads_seller_table_week"] = with_seller(with_ctes([_astw, _sgmw], f"""
SELECT a.scope, a.seller_id, CAST(a.ads_invest AS DOUBLE) AS ads_invest, CAST(a.gmv_ads AS DOUBLE) AS gmv_ads,
       CAST(a.clicks AS BIGINT) AS clicks,
       {ratio0('a.gmv_ads', 'a.ads_invest')} AS roas, {pct0('a.ads_invest', 'a.gmv_ads')} AS acos,
       CAST(NULL AS DOUBLE) AS take_rate, {pct0('a.gmv_ads', z('g.gmv'))} AS ads_share
FROM ast_w a LEFT JOIN sgm_w g USING (scope, seller_id)"""))

# ----------------------------------------------------------------------------- P27-P30 investments
_it = period_sum_cte("inv_tot", "q08", INV_COLS, "month")
cte("inv_fam", f"SELECT scope, {G1} AS g1, {G2} AS g2, {G3} AS g3 FROM inv_tot", (_it,))
SQL["investment_totals"] = with_ctes(["inv_fam"], f"""
SELECT scope, {money('g1')}, {money('g2')}, {money('g3')}, CAST(g1 + g2 + g3 AS DOUBLE) AS total FROM inv_fam""")
_itw = period_sum_cte("inv_tot_week", "q05", INV_COLS, "week")
SQL["investment_totals_week"] = with_ctes([_itw], f"""
SELECT scope, {money('g1')}, {money('g2')}, {money('g3')}, CAST(g1 + g2 + g3 AS DOUBLE) AS total
FROM (SELECT scope, {G1} AS g1, {G2} AS g2, {G3} AS g3 FROM {_itw})""")
SQL["investment_mix"] = with_ctes(["inv_fam"], """
SELECT scope, 'g3' AS family, CAST(g3 AS DOUBLE) AS amount FROM inv_fam
UNION ALL SELECT scope, 'g1', CAST(g1 AS DOUBLE) FROM inv_fam
UNION ALL SELECT scope, 'g2', CAST(g2 AS DOUBLE) FROM inv_fam""")
SQL["investment_series"] = with_ctes([daily_series_cte("is_m", "q05", INV_COLS, MONTH_CHART)], f"""
SELECT scope, {lbl_day()}, CAST({G1} AS DOUBLE) AS g1, CAST({G2} AS DOUBLE) AS g2, CAST({G3} AS DOUBLE) AS g3
FROM is_m""")
SQL["investment_series_quarter"] = with_ctes([monthly_series_cte("is_q", "q08", INV_COLS, "pm_quarter_c")], f"""
SELECT scope, {lbl_month()}, CAST({G1} AS DOUBLE) AS g1, CAST({G2} AS DOUBLE) AS g2, CAST({G3} AS DOUBLE) AS g3
FROM is_q""")
_ist = seller_rollup_cte("ist_m", "q08", ["gmv"] + INV_COLS, "month")


def investment_seller_sql(per: str, gmv: str) -> str:
    return f"""
SELECT scope, seller_id, CAST(gmv AS DOUBLE) AS gmv, CAST(g1 AS DOUBLE) AS g1, CAST(g2 AS DOUBLE) AS g2,
       CAST(g3 AS DOUBLE) AS g3, CAST(g1 + g2 + g3 AS DOUBLE) AS total, {pct0('g1 + g2 + g3', 'gmv')} AS invest_pct
FROM (SELECT scope, seller_id, {z(gmv)} AS gmv, {G1} AS g1, {G2} AS g2, {G3} AS g3 FROM {per})"""


SQL["investment_seller_table"] = with_seller(with_ctes([_ist], investment_seller_sql("ist_m", "gmv")))
_istw = seller_rollup_cte("ist_w", "q05", INV_COLS, "week")
_isgw = seller_rollup_cte("isg_w", "q02", ["gmv"], "week")
SQL["investment_seller_table_week"] = with_seller(with_ctes(
    [_istw, _isgw], investment_seller_sql("ist_w LEFT JOIN isg_w USING (scope, seller_id)", "gmv")))

# ----------------------------------------------------------------------------- P31 catalog
_q10 = q10_cte(20)
cte("cat_rows", f"SELECT s.scope, m.* FROM {scoped(_q10)}", (_q10, "scopes"))
SQL["catalog_table"] = with_seller(with_ctes(["cat_rows"], f"""
SELECT c.scope, c.seller_id, c.item_id, COALESCE(c.title, '') AS title, CAST(c.gmv AS DOUBLE) AS gmv, c.si,
       CASE WHEN c.si = 0 THEN NULL ELSE CAST(CAST(sign(CAST(c.gmv * 100 AS BIGINT)) * sign(c.si) AS BIGINT) *
            ((2 * abs(CAST(c.gmv * 100 AS BIGINT)) + abs(c.si)) // (2 * abs(c.si))) AS DOUBLE) / 100 END AS asp,
       {pct0('c.gmv', 't.tg')} AS share_pct, CAST(c.gmv_bb AS DOUBLE) AS gmv_bb,
       {pct0('c.gmv_bb', 'c.gmv')} AS bb_pct, {pct0('c.gmv_bb', 'c.gmv')} >= 50.0 AS bb_flag,
       'https://items.example/HOME-' || CAST(c.item_id AS VARCHAR) AS item_url
FROM cat_rows c JOIN (SELECT scope, SUM(gmv) AS tg FROM cat_rows GROUP BY scope) t ON c.scope = t.scope"""))

# ----------------------------------------------------------------------------- P32 / P33
_CLASS = """CASE WHEN {lv} IS NULL OR {lv} = '' THEN 'green' WHEN contains({lv}, 'platinum') THEN 'platinum'
     WHEN contains({lv}, 'gold') THEN 'gold' WHEN {lv} = 'green' THEN 'green' WHEN {lv} = 'yellow' THEN 'yellow'
     WHEN {lv} = 'orange' THEN 'orange' ELSE 'red' END"""
_LABEL = """COALESCE(CASE {lv} WHEN 'green_platinum' THEN 'Platinum' WHEN 'green_gold' THEN 'Gold'
     WHEN 'green' THEN 'Verde' WHEN 'yellow' THEN 'Amarelo' WHEN 'orange' THEN 'Laranja'
     WHEN 'red' THEN 'Vermelho' END, CASE WHEN {lv} <> '' THEN {lv} END, '-')"""
SQL["reputation_table"] = with_ctes(["q11"], f"""
SELECT seller_id, current_level, real_level, {money('claims_pct')}, {money('delay_pct')}, {money('cancel_pct')},
       orders_3m, {_CLASS.format(lv='current_level')} AS rep_class, {_LABEL.format(lv='current_level')} AS rep_label
FROM q11""")
SQL["scorecard"] = with_ctes(["q01", "q02", "q11", "portfolio"], f"""
SELECT p.seller_id, p.name, CAST({z('m.gmv')} AS DOUBLE) AS gmv, CAST({z('m.si')} AS BIGINT) AS si,
       {ratio0(z('m.gmv'), z('m.si'))} AS asp,
       {chg(z('w.w1'), z('w.w2'))} AS wow_pct, {chg(z('m.gmv'), z('m.pm'))} AS mom_pct,
       {chg(z('m.gmv'), z('m.ym'))} AS yoy_pct,
       r.current_level, {_CLASS.format(lv='r.current_level')} AS rep_class,
       {_LABEL.format(lv='r.current_level')} AS rep_label,
       CAST(r.claims_pct AS DOUBLE) AS claims_pct, CAST(r.delay_pct AS DOUBLE) AS delay_pct,
       CAST(r.cancel_pct AS DOUBLE) AS cancel_pct
FROM portfolio p
LEFT JOIN (SELECT seller_id,
             SUM(CASE WHEN month = {CM} THEN gmv ELSE 0 END) AS gmv,
             SUM(CASE WHEN month = {CM} THEN si ELSE 0 END) AS si,
             SUM(CASE WHEN month = CAST({CM} - INTERVAL 1 MONTH AS DATE) THEN gmv ELSE 0 END) AS pm,
             SUM(CASE WHEN month = CAST({CM} - INTERVAL 12 MONTH AS DATE) THEN gmv ELSE 0 END) AS ym
           FROM q01 GROUP BY seller_id) m ON p.seller_id = m.seller_id
LEFT JOIN (SELECT seller_id,
             SUM(CASE WHEN day BETWEEN {A} - 7 AND {A} - 1 THEN gmv ELSE 0 END) AS w1,
             SUM(CASE WHEN day BETWEEN {A} - 14 AND {A} - 8 THEN gmv ELSE 0 END) AS w2
           FROM q02 GROUP BY seller_id) w ON p.seller_id = w.seller_id
LEFT JOIN q11 r ON p.seller_id = r.seller_id""")

# ----------------------------------------------------------------------------- P34-P37 visits
def visit_kpi_sql(mode: str) -> str:
    """P34 for a period mode; daily modes sum the daily visit (q13) and sales (q02) marts."""
    daily = mode in DAILY_ROLES
    vs = sums_cte(f"sums_vis_{mode}", "q13" if daily else "q12", ["visits"], mode)
    vu = period_sum_cte(f"vu_{mode}", "q02" if daily else "q01", ["si"], mode)
    return with_ctes([vs, "scope_list", vu], f"""
SELECT k.scope, k.visits, k.visits_d1, k.visits_d2, CAST(u.si AS BIGINT) AS units,
       {pct0('u.si', 'k.visits')} AS units_per_visit_pct
FROM ({kpi_select(vs, [('visits', 'int')], mode)}) k JOIN {vu} u ON k.scope = u.scope""")


SQL["visit_kpi"] = visit_kpi_sql("month")
SQL["visit_kpi_week"] = visit_kpi_sql("week")
_cv = monthly_series_cte("cs_v", "q12", ["visits"], "pm_quarter_c")
_cu = monthly_series_cte("cs_u", "q01", ["si"], "pm_quarter_c")
SQL["conversion_series"] = with_ctes([_cv, _cu], f"""
SELECT v.scope, {lbl_month('v.month')}, CAST(v.visits AS BIGINT) AS visits,
       {pct(z('u.si'), 'v.visits')} AS units_per_visit_pct
FROM cs_v v LEFT JOIN cs_u u ON v.scope = u.scope AND v.month = u.month""")


def conversion_daily_sql(tag: str, rng: tuple[str, str]) -> str:
    v = daily_series_cte(f"cd_v_{tag}", "q13", ["visits"], rng)
    u = daily_series_cte(f"cd_u_{tag}", "q02", ["si"], rng)
    return with_ctes([v, u], f"""
SELECT scope, {lbl_day()}, CAST(visits AS BIGINT) AS visits, {pct(z('si'), 'visits')} AS units_per_visit_pct
FROM {v} LEFT JOIN {u} USING (scope, day)""")


SQL["conversion_series_week"] = conversion_daily_sql("week", WEEK_CHART)
_cmv = monthly_series_cte("cm_v", "q12", ["visits"], "pm_month_c")
_cmu = monthly_series_cte("cm_u", "q01", ["si"], "pm_month_c")
SQL["conversion_series_month"] = with_ctes([_cmv, _cmu], f"""
SELECT scope, {lbl_month()}, CAST(visits AS BIGINT) AS visits, {pct(z('si'), 'visits')} AS units_per_visit_pct
FROM cm_v JOIN cm_u USING (scope, month)""")


def visits_seller_sql(mode: str) -> str:
    daily = mode in DAILY_ROLES
    v = seller_rollup_cte(f"vst_{mode}", "q13" if daily else "q12", ["visits"] if daily else ["visits", "visits_vip"], mode)
    u = seller_rollup_cte(f"vsu_{mode}", "q02" if daily else "q01", ["si"], mode)
    return with_seller(with_ctes([v, u], f"""
SELECT v.scope, v.seller_id, CAST(v.visits AS BIGINT) AS visits, CAST({'0' if daily else 'v.visits_vip'} AS BIGINT) AS visits_vip,
       CAST({z('u.si')} AS BIGINT) AS units, {pct0(z('u.si'), 'v.visits')} AS units_per_visit_pct
FROM {v} v LEFT JOIN {u} u ON v.scope = u.scope AND v.seller_id = u.seller_id"""))


SQL["visits_seller_table"] = visits_seller_sql("month")
SQL["visits_seller_table_week"] = visits_seller_sql("week")
_q14 = q14_cte(50)
SQL["visited_items_table"] = with_seller(with_ctes([_q14, _q10, "scopes"], f"""
SELECT v.scope, v.seller_id, v.item_id, COALESCE(t.title, '') AS title, v.visits,
       CAST({z('t.si')} AS BIGINT) AS units, {pct0(z('t.si'), 'v.visits')} AS units_per_visit_pct, v.rank
FROM (SELECT s.scope, m.seller_id, m.item_id, m.visits,
             ROW_NUMBER() OVER (PARTITION BY s.scope ORDER BY m.visits DESC, m.seller_id, m.item_id) AS rank
      FROM {scoped(_q14)}) v
LEFT JOIN {_q10} t ON v.seller_id = t.seller_id AND v.item_id = t.item_id
WHERE v.rank <= 50"""))

# ----------------------------------------------------------------------------- P38 / P39 campaigns
_q16 = "q16_all"
SQL["campaign_seller_summary"] = with_seller(with_ctes([_q16, "scopes"], f"""
SELECT s.scope, c.seller_id, c.total, c.eligible, c.opt_in, {pct0('c.opt_in', 'c.eligible')} AS optin_pct
FROM (SELECT seller_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE COALESCE(eligible, FALSE)) AS eligible,
             COUNT(*) FILTER (WHERE COALESCE(opt_in, FALSE)) AS opt_in
      FROM {_q16} GROUP BY seller_id) c JOIN scopes s ON c.seller_id = s.seller_id"""))
_TYPE_LABEL = """COALESCE(CASE type WHEN 'TIER_1' THEN 'Tier 1' WHEN 'TIER_3' THEN 'Tier 3' WHEN 'SMART' THEN 'Smart'
     WHEN 'CUSTOM' THEN 'On Demand' WHEN 'PRENEGOTIATED' THEN 'Pré Neg.' WHEN 'LIGHTNING' THEN 'Relâmpago'
     WHEN 'BANK' THEN 'Banco' WHEN 'UNHEALTHY_STOCK' THEN 'Unhealthy' END, type)"""
SQL["campaign_item_table"] = with_seller(with_ctes([_q16, "scopes"], f"""
SELECT scope, seller_id, type, {_TYPE_LABEL} AS type_label, item_id, CAST(day AS VARCHAR) AS day, eligible, opt_in,
       CAST(price_initial AS DOUBLE) AS price_initial, CAST(price_final AS DOUBLE) AS price_final,
       CASE WHEN price_initial > 0 AND price_final IS NOT NULL AND price_final <> 0
            THEN (1.0 - {d('price_final')} / {d('price_initial')}) * 100.0 END AS discount_pct,
       CAST(gmv_l30d AS DOUBLE) AS gmv_l30d, rank
FROM (SELECT s.scope, m.*, ROW_NUMBER() OVER (PARTITION BY s.scope ORDER BY m.gmv_l30d DESC NULLS LAST,
          m.seller_id ASC, m.day DESC, m.opt_in DESC NULLS LAST, m.type ASC NULLS FIRST, m.item_id ASC,
          m.eligible ASC NULLS FIRST, m.price_initial ASC NULLS FIRST, m.price_final ASC NULLS FIRST,
          m.status ASC NULLS FIRST) AS rank
      FROM {scoped(_q16)})
WHERE rank <= 500"""))

# ----------------------------------------------------------------------------- P40-P44 price
_q15 = "q15_all"
SQL["price_kpi"] = with_ctes([_q15, "scopes", "scope_list"], f"""
SELECT sl.scope, CAST({z('x.vis')} AS DOUBLE) AS visits, CAST({z('x.exp')} AS DOUBLE) AS visits_exp,
       {pct0(z('x.exp'), z('x.vis'))} AS expensive_pct
FROM scope_list sl LEFT JOIN (SELECT s.scope, SUM(m.visits_match) AS vis, SUM(m.visits_exp3) AS exp
                              FROM {scoped(_q15)} GROUP BY s.scope) x ON sl.scope = x.scope""")
SQL["price_seller_table"] = with_seller(with_ctes([_q15, "scopes"], f"""
SELECT s.scope, p.seller_id, p.items, p.non_competitive, CAST(p.vis AS DOUBLE) AS visits,
       CAST(p.exp AS DOUBLE) AS visits_exp, {pct0('p.exp', 'p.vis')} AS expensive_pct,
       CASE WHEN ROUND({pct0('p.exp', 'p.vis')}, 1) > 30.0 THEN 'high'
            WHEN ROUND({pct0('p.exp', 'p.vis')}, 1) > 10.0 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT seller_id, COUNT(*) AS items, COUNT(*) FILTER (WHERE classification = 'Nao Competitivo') AS non_competitive,
             SUM(visits_match) AS vis, SUM(visits_exp3) AS exp FROM {_q15} GROUP BY seller_id) p
JOIN scopes s ON p.seller_id = s.seller_id"""))

_PORDER = ("CAST(m.seller_id AS VARCHAR) ASC, m.visits_exp3 DESC NULLS LAST, m.item_id ASC, m.visits_match ASC NULLS FIRST, "
           "m.our_price ASC NULLS FIRST, m.rival_price_min ASC NULLS FIRST, m.rival_name ASC NULLS FIRST, "
           "m.rival_url ASC NULLS FIRST, m.permalink ASC NULLS FIRST, m.title ASC NULLS FIRST, "
           "m.qualification ASC NULLS FIRST")


def price_items_sql(k: int) -> str:
    return with_seller(with_ctes([_q15, "scopes"], f"""
SELECT scope, seller_id, item_id, COALESCE(title, '') AS title, CAST(our_price AS DOUBLE) AS our_price,
       CAST(rival_price_min AS DOUBLE) AS rival_price_min,
       CASE WHEN our_price <> 0 AND rival_price_min <> 0
            THEN ({d('our_price')} / {d('rival_price_min')} - 1.0) * 100.0 END AS gap_pct,
       rival_name, CAST(visits_match AS DOUBLE) AS visits_match, CAST(visits_exp3 AS DOUBLE) AS visits_exp3,
       permalink, rival_url, rank
FROM (SELECT s.scope, m.*, ROW_NUMBER() OVER (PARTITION BY s.scope ORDER BY m.visits_exp3 DESC NULLS LAST,
                 {_PORDER}) AS rank
      FROM {scoped(_q15)} WHERE m.classification = 'Nao Competitivo')
WHERE rank <= {k}"""))


SQL["price_item_table"] = price_items_sql(200)
SQL["price_item_table_k5"] = price_items_sql(5)
SQL["qualification_item_table"] = price_items_sql(300)
SQL["qualification_table"] = with_seller(with_ctes([_q15, "scopes"], f"""
SELECT f.seller_id, f.qualification,
       COALESCE(CASE f.qualification WHEN 'C1' THEN 1 WHEN 'C2' THEN 2 WHEN 'C3' THEN 3 WHEN 'C4' THEN 4
                WHEN 'RC' THEN 5 END, 9) AS qual_rank,
       COALESCE(CASE f.qualification WHEN 'C1' THEN 'C1 - Saudável' WHEN 'C2' THEN 'C2 - Alerta Preç.'
                WHEN 'C3' THEN 'C3 - Crônico' WHEN 'C4' THEN 'C4 - Quarentena' WHEN 'RC' THEN 'RC - Recuperação' END,
                f.qualification) AS qual_label,
       COALESCE(CASE f.qualification WHEN 'C1' THEN TRUE WHEN 'C2' THEN TRUE WHEN 'C3' THEN FALSE
                WHEN 'C4' THEN TRUE WHEN 'RC' THEN TRUE END, TRUE) AS benefit_eligible,
       COALESCE(n.nc, 0) AS non_competitive, s.scope
FROM (SELECT seller_id, qualification FROM (
        SELECT m.seller_id, m.qualification, ROW_NUMBER() OVER (PARTITION BY m.seller_id ORDER BY {_PORDER}) AS rn
        FROM {_q15} m WHERE length(m.qualification) > 0) WHERE rn = 1) f
LEFT JOIN (SELECT seller_id, COUNT(*) FILTER (WHERE classification = 'Nao Competitivo') AS nc
           FROM {_q15} GROUP BY seller_id) n ON f.seller_id = n.seller_id
JOIN scopes s ON f.seller_id = s.seller_id"""))

REPORT_SQL = SQL


# ----------------------------------------------------------------------------- ranks of the seller tables
for _name, _by in {"seller_sales_table": "gmv", "logistics_seller_table": "gmv_total", "ads_seller_table": "ads_invest",
                   "investment_seller_table": "total", "visits_seller_table": "visits", "campaign_seller_summary": "eligible",
                   "price_seller_table": "visits_exp"}.items():
    for _query in (_name, f"{_name}_week"):
        if _query in SQL:
            SQL[_query] = (f"SELECT *, ROW_NUMBER() OVER (PARTITION BY scope ORDER BY {_by} DESC NULLS LAST, seller_id) AS rank "
                           f"FROM (\n{SQL[_query]}\n)")

# ----------------------------------------------------------------------------- bundle
for _query in ("bundle_parquet", "bundle_json"):
    SQL[_query] = f"SELECT *, '{REFRESHED_AT:%d/%m/%Y %H:%M}' AS updated_at FROM (\n{MART_SQL['sales_monthly']}\n)"
