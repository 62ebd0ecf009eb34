"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The SQL is written from the definitions, not from the Spark plans: stand-in
measures are joined straight from the base tables, hazards are pivoted
with ``FILTER`` clauses, and the index is an ``avg`` over long rows. Parts
are composed as CTEs by the helpers below.

Parity rules shared with :mod:`perilscope.queries`: integers are BIGINT,
doubles are rounded to 6 places with ``+ 0.0`` (no −0.0), and ranks over
computed doubles rank the value rounded to 9 places.
"""

from __future__ import annotations

from .config import FLOAT64_EPS
from .sources.driver_tables import GRAINS, PRIORITY_HAZARD

HZ = ["flood", "drought", "storms", "extreme_temp"]
TOTAL_SPELL = {"flood": "flood", "drought": "drought", "storms": "storm",
               "extreme_temp": "extreme_temp"}
TOTAL_ORDER = ["extreme_temp", "drought", "flood", "storms"]
DMG_COLS = ["drought", "flood", "storm", "extreme_temp"]
DMG_OF_HZ = {"drought": "drought", "flood": "flood", "storms": "storm",
             "extreme_temp": "extreme_temp"}
IMPACT_COLS = [f"{h}_impact" for h in HZ]


def with_(ctes: list[tuple[str, str]], body: str) -> str:
    """CTEs and body. The analysis table is used by several of its consumers,
    so it is computed once."""
    return "WITH " + ",\n".join(
        f"{n} AS {'MATERIALIZED ' if n == 'a_set' else ''}(\n{s}\n)"
        for n, s in ctes) + "\n" + body


def rd(expr: str, alias: str, places: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {places}) + 0.0 AS {alias}"


def bi(expr: str, alias: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {alias}"


def final(cols: list[tuple[str, str]], src: str, where: str = "") -> str:
    """SELECT with the parity casts; ``cols`` = [(name, kind)] with kind
    ``d`` double, ``i`` integer, ``s`` other."""
    parts = []
    for name, kind in cols:
        if kind == "d":
            parts.append(rd(name, name))
        elif kind == "i":
            parts.append(bi(name, name))
        else:
            parts.append(name)
    return f"SELECT {', '.join(parts)} FROM {src}" + (f" WHERE {where}" if where else "")


# -- stand-in measures --------------------------------------------------------

def _period(unit: str) -> str:
    y = "year(o.o_orderdate)"
    if unit == "year":
        return y
    if unit == "month":
        return f"({y} * 12 + month(o.o_orderdate) - 1)"
    return f"({y} * 4 + quarter(o.o_orderdate) - 1)"


def _hazard_case() -> str:
    whens = " ".join(f"WHEN '{p}' THEN '{h}'" for p, h in PRIORITY_HAZARD.items())
    return f"CASE o.o_orderpriority {whens} END"


def standins(grain: str) -> list[tuple[str, str]]:
    """CTEs ``aff, dth, dmg`` (wide damage), ``m_full``, ``m_inner``."""
    level, unit = GRAINS[grain]
    if level == "customer":
        ent_join = "JOIN customer c ON o.o_custkey = c.c_custkey"
        ent = "c.c_name"
    else:
        ent_join = ("JOIN customer c ON o.o_custkey = c.c_custkey "
                    "JOIN nation n ON c.c_nationkey = n.n_nationkey")
        ent = "n.n_name"
    per, hz = _period(unit), _hazard_case()
    aff = f"""SELECT {ent} AS country, {per} AS year, {hz} AS hazard,
  CAST(sum(l.l_quantity) AS DOUBLE) AS affected
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey {ent_join}
WHERE l.l_returnflag <> 'N'
GROUP BY 1, 2, 3"""
    dth = f"""SELECT {ent} AS country, {per} AS year, {hz} AS hazard,
  CAST(count(*) AS DOUBLE) AS death
FROM orders o {ent_join}
WHERE o.o_orderstatus <> 'P'
GROUP BY 1, 2, 3"""
    dmg_long = f"""SELECT {ent} AS country, {per} AS year, {hz} AS hazard,
  avg(l.l_discount) * 100 AS pct
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey {ent_join}
GROUP BY 1, 2, 3"""
    hz_of = {v: k for k, v in DMG_OF_HZ.items()}
    dmg = ("SELECT country, year, "
           + ", ".join(f"max(pct) FILTER (WHERE hazard = '{hz_of[c]}') AS {c}"
                       for c in DMG_COLS)
           + " FROM dmg_long GROUP BY country, year")
    full = """SELECT country, year, hazard, a.affected, d.death
FROM aff a FULL OUTER JOIN dth d USING (country, year, hazard)"""
    inner = """SELECT country, year, hazard, a.affected, d.death
FROM aff a JOIN dth d USING (country, year, hazard)"""
    return [("aff", aff), ("dth", dth), ("dmg_long", dmg_long), ("dmg", dmg),
            ("m_full", full), ("m_inner", inner)]


# -- builders -------------------------------------------------------------

def _period_expr(col: str, size: int | None) -> str:
    return col if size is None else f"CAST(floor({col} / {size}) * {size} AS INTEGER)"


def _scale(v: str, m: str, n: str) -> str:
    eps = repr(FLOAT64_EPS)
    return (f"CASE WHEN {v} <= {n} * {eps} * {v} + pow({n} * {m} * {eps}, 2) "
            f"THEN 1.0 ELSE sqrt({v}) END")


def impact(src: str, p: str = "i", size: int | None = None,
           min_events: int = 1, strict: bool = False) -> list[tuple[str, str]]:
    """CTE ``{p}_imp``: country, period, hazard, impact (long)."""
    having = f"count(year) > {min_events}" if strict else f"count(year) >= {min_events}"
    agg = f"""SELECT country, {_period_expr('year', size)} AS period, hazard,
  avg(affected) AS affected, avg(death) AS death
FROM {src}
WHERE (affected IS NOT NULL OR death IS NOT NULL)
  AND country IS NOT NULL AND year IS NOT NULL
GROUP BY 1, 2, 3 HAVING {having}"""
    logs = f"""SELECT country, period, hazard, ln(1 + affected) AS al, ln(1 + death) AS dl
FROM {p}_agg"""
    stats = f"""SELECT hazard, avg(al) AS ma, var_pop(al) AS va, count(al) AS na,
  avg(dl) AS md, var_pop(dl) AS vd, count(dl) AS nd
FROM {p}_log GROUP BY hazard"""
    imp = f"""SELECT l.country, l.period, l.hazard,
  (l.al - s.ma) / ({_scale('s.va', 's.ma', 's.na')})
  + (l.dl - s.md) / ({_scale('s.vd', 's.md', 's.nd')}) AS impact
FROM {p}_log l JOIN {p}_stats s ON l.hazard = s.hazard"""
    return [(f"{p}_agg", agg), (f"{p}_log", logs), (f"{p}_stats", stats),
            (f"{p}_imp", imp)]


def impact_index(p: str = "i") -> list[tuple[str, str]]:
    """CTE ``{p}_idx``: wide impacts + index, hazard_count, impact_rebased."""
    wide = ("SELECT country, period, "
            + ", ".join(f"max(impact) FILTER (WHERE hazard = '{h}') AS {h}_impact"
                        for h in HZ)
            + ", avg(impact) AS climate_impact_index, count(impact) AS hazard_count"
            + f" FROM {p}_imp GROUP BY country, period")
    idx = f"""SELECT w.*, w.climate_impact_index - (SELECT min(climate_impact_index)
  FROM {p}_wide) AS impact_rebased
FROM {p}_wide w"""
    return [(f"{p}_wide", wide), (f"{p}_idx", idx)]


def totals(src: str, p: str = "t", size: int | None = None,
           min_events: int = 1) -> list[tuple[str, str]]:
    """CTEs ``{p}_long`` (per hazard) and ``{p}_tab`` (wide, zero-filled,
    with ``total_deaths`` and ``total_affected``)."""
    long = f"""SELECT country, {_period_expr('year', size)} AS period, hazard,
  coalesce(sum(affected), 0) AS total_affected, coalesce(sum(death), 0) AS total_deaths
FROM {src}
WHERE (affected IS NOT NULL OR death IS NOT NULL)
  AND country IS NOT NULL AND year IS NOT NULL
GROUP BY 1, 2, 3 HAVING count(year) >= {min_events}"""
    cols = []
    for h in TOTAL_ORDER:
        s = TOTAL_SPELL[h]
        cols.append(f"coalesce(max(total_affected) FILTER (WHERE hazard = '{h}'), 0) "
                    f"AS {s}_total_affected")
        cols.append(f"coalesce(max(total_deaths) FILTER (WHERE hazard = '{h}'), 0) "
                    f"AS {s}_total_deaths")
    tab = (f"SELECT country, period, {', '.join(cols)}, "
           "sum(total_deaths) AS total_deaths, sum(total_affected) AS total_affected "
           f"FROM {p}_long GROUP BY country, period")
    return [(f"{p}_long", long), (f"{p}_tab", tab)]


def damage_yearly(src: str = "dmg", p: str = "e") -> list[tuple[str, str]]:
    """CTE ``{p}_dmg``: mean of all melted rows per (country, period)."""
    union = " UNION ALL ".join(
        f"SELECT country, year, {c} AS v FROM {src}" for c in DMG_COLS)
    return [(f"{p}_dmg", f"""SELECT country, year AS period, avg(v) AS economic_damage_pct_gdp
FROM ({union}) WHERE country IS NOT NULL AND year IS NOT NULL
GROUP BY country, year""")]


def damage_binned(src: str = "dmg", p: str = "e", size: int = 5) -> list[tuple[str, str]]:
    per = (f"SELECT country, {_period_expr('year', size)} AS period, "
           + ", ".join(f"avg({c}) AS {c}" for c in DMG_COLS)
           + f" FROM {src} WHERE country IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2")
    n = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in DMG_COLS)
    s = " + ".join(f"coalesce({c}, 0)" for c in DMG_COLS)
    return [(f"{p}_per", per), (f"{p}_dmg", f"""SELECT country, period,
  CASE WHEN {n} > 0 THEN ({s}) / ({n}) END AS economic_damage_pct_gdp
FROM {p}_per""")]


ANALYSIS_COLS = [
    ("country", "s"), ("period", "i"),
    ("flood_impact", "d"), ("drought_impact", "d"), ("storms_impact", "d"),
    ("extreme_temp_impact", "d"), ("climate_impact_index", "d"),
    ("impact_rebased", "d"), ("hazard_count", "i"), ("total_deaths", "d"),
    ("total_affected", "d"), ("resilience_rate", "d"),
    ("resilience_per_100k", "d"), ("economic_damage_pct_gdp", "d"),
]


def analysis(grain: str, binned: bool = False, p: str = "a") -> list[tuple[str, str]]:
    """All CTEs up to ``{p}_set`` (the 14-column analysis table)."""
    size = 5 if binned else None
    src = "m_inner" if binned else "m_full"
    ctes = standins(grain) + impact(src, "i", size) + impact_index("i") \
        + totals(src, "t", size) \
        + (damage_binned("dmg", "e", 5) if binned else damage_yearly("dmg", "e"))
    how = "LEFT" if binned else "FULL OUTER"
    joined = f"""SELECT country, period, i.flood_impact, i.drought_impact, i.storms_impact,
  i.extreme_temp_impact, i.climate_impact_index, i.impact_rebased, i.hazard_count,
  t.total_deaths, t.total_affected, e.economic_damage_pct_gdp AS dmg_raw
FROM i_idx i {how} JOIN t_tab t USING (country, period)
{how} JOIN e_dmg e USING (country, period)"""
    final_set = f"""SELECT country, period, flood_impact, drought_impact, storms_impact,
  extreme_temp_impact, climate_impact_index, impact_rebased, hazard_count,
  total_deaths, total_affected,
  CASE WHEN total_affected > 0 THEN total_deaths / total_affected ELSE 0.0 END AS resilience_rate,
  (CASE WHEN total_affected > 0 THEN total_deaths / total_affected ELSE 0.0 END) * 100000
    AS resilience_per_100k,
  coalesce(dmg_raw, 0.0) AS economic_damage_pct_gdp
FROM {p}_join"""
    return ctes + [(f"{p}_join", joined), (f"{p}_set", final_set)]


def analysis_query(grain: str, binned: bool = False) -> str:
    return with_(analysis(grain, binned), final(ANALYSIS_COLS, "a_set"))


# -- features, composite index, prediction rows -----------------------------

def in_list(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def row_mean_sql(cols) -> str:
    n = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cols)
    s = " + ".join(f"coalesce({c}, 0)" for c in cols)
    return f"(CASE WHEN {n} > 0 THEN ({s}) / ({n}) END)"


def slope_sql(lst: str) -> str:
    """Least-squares slope of a list against 0..n-1 (0 below two values)."""
    n = f"CAST(len({lst}) AS DOUBLE)"
    sy = f"list_sum({lst})"
    sxy = f"list_sum(list_transform({lst}, lambda y, i: y * (i - 1)))"
    sx = f"({n} * ({n} - 1) / 2)"
    sxx = f"(({n} - 1) * {n} * (2 * {n} - 1) / 6)"
    return (f"(CASE WHEN len({lst}) >= 2 THEN ({n} * {sxy} - {sx} * {sy}) / "
            f"({n} * {sxx} - {sx} * {sx}) ELSE 0.0 END)")


FEATURE_EXTRA = [
    "impact_rebased_next", "log_total_affected", "log_total_death",
    "total_affected_3yr_avg", "total_death_3yr_avg", "impact_3yr_avg",
    "impact_trend_5yr", "absolute_impact_trend", "impact_std_5yr",
    "country_mean_impact", "country_long_term_mean", "impact_lag1",
    "log_total_affected_3yr_avg", "log_total_death_3yr_avg",
    "country_recent_deviation",
]
FEATURE_COLS = ANALYSIS_COLS + [(c, "d") for c in FEATURE_EXTRA]
COMPONENT_COLS = [(c, "d") for c in ["human_burden", "persistence",
                                    "climate_intensity",
                                    "structural_vulnerability", "CLI"]]


def _w(frame: str = "") -> str:
    return f"OVER (PARTITION BY country ORDER BY period {frame})"


def features(grain: str, cutoff: int, excluded) -> list[tuple[str, str]]:
    """All CTEs up to ``ft`` (the feature table)."""
    ex = f"""SELECT * FROM a_set
WHERE country IS NULL OR country NOT IN ({in_list(excluded)})"""
    f1 = """SELECT *, ln(1 + coalesce(total_affected, 0)) AS log_total_affected,
  ln(1 + coalesce(total_deaths, 0)) AS log_total_death FROM f_ex"""
    r3 = "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"
    r5 = "ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"
    f2 = f"""SELECT *,
  lead(impact_rebased) {_w()} AS impact_rebased_next,
  lag(impact_rebased) {_w()} AS lag_raw,
  coalesce(avg(total_affected) {_w(r3)}, 0) AS total_affected_3yr_avg,
  coalesce(avg(total_deaths) {_w(r3)}, 0) AS total_death_3yr_avg,
  avg(climate_impact_index) {_w(r3)} AS impact_3yr_avg,
  list_filter(list(climate_impact_index) {_w(r5)}, lambda x: x IS NOT NULL) AS l_idx,
  list_filter(list(log_total_affected) {_w(r5)}, lambda x: x IS NOT NULL) AS l_log,
  coalesce(stddev_samp(climate_impact_index) {_w(r5)}, 0) AS impact_std_5yr
FROM f_1"""
    f3 = f"""SELECT * EXCLUDE (l_idx, l_log), {slope_sql('l_idx')} AS impact_trend_5yr,
  {slope_sql('l_log')} AS absolute_impact_trend FROM f_2"""
    tr = f"SELECT * FROM f_3 WHERE period <= {cutoff}"
    em = """SELECT country, avg(impact_rebased) AS cm, avg(climate_impact_index) AS cl
FROM f_tr GROUP BY country"""
    gm = "SELECT avg(impact_rebased) AS gm, avg(climate_impact_index) AS gl FROM f_tr"
    ft = """SELECT f.* EXCLUDE (lag_raw),
  coalesce(e.cm, g.gm) AS country_mean_impact,
  coalesce(e.cl, g.gl) AS country_long_term_mean,
  coalesce(f.lag_raw, coalesce(e.cm, g.gm)) AS impact_lag1,
  ln(1 + f.total_affected_3yr_avg) AS log_total_affected_3yr_avg,
  ln(1 + f.total_death_3yr_avg) AS log_total_death_3yr_avg,
  f.climate_impact_index - coalesce(e.cl, g.gl) AS country_recent_deviation
FROM f_3 f LEFT JOIN f_em e ON f.country = e.country CROSS JOIN f_gm g"""
    return analysis(grain) + [("f_ex", ex), ("f_1", f1), ("f_2", f2), ("f_3", f3),
                              ("f_tr", tr), ("f_em", em), ("f_gm", gm), ("ft", ft)]


HB = ["log_total_affected", "log_total_death", "log_total_affected_3yr_avg",
      "log_total_death_3yr_avg"]
PS = ["impact_3yr_avg", "impact_lag1"]
COMP_INPUT = {
    "human_burden": row_mean_sql(HB),
    "persistence": row_mean_sql(PS),
    "climate_intensity": "climate_impact_index",
    "structural_vulnerability": "country_mean_impact",
}


def comp_stats(cutoff: int, src: str = "ft") -> list[tuple[str, str]]:
    parts = []
    for n, e in COMP_INPUT.items():
        parts.append(f"avg({e}) AS {n}_m")
        parts.append(f"CASE WHEN stddev_samp({e}) = 0 THEN 1.0 ELSE stddev_samp({e}) END AS {n}_s")
    return [("c_st", f"SELECT {', '.join(parts)} FROM {src} WHERE period <= {cutoff}")]


def apply_comp(src: str, name: str) -> tuple[str, str]:
    comps = ", ".join(f"({e} - c_st.{n}_m) / c_st.{n}_s AS {n}" for n, e in COMP_INPUT.items())
    cli = " + ".join(f"{w} * (({e} - c_st.{n}_m) / c_st.{n}_s)"
                     for w, (n, e) in zip([0.50, 0.25, 0.15, 0.10], COMP_INPUT.items()))
    return (name, f"SELECT {src}.*, {comps}, {cli} AS CLI FROM {src} CROSS JOIN c_st")


def composite(grain: str, cutoff: int, excluded) -> list[tuple[str, str]]:
    """CTEs up to ``cli`` (feature table + components + CLI)."""
    return features(grain, cutoff, excluded) + comp_stats(cutoff) + [apply_comp("ft", "cli")]


MEDIAN_FILLED = ["country_mean_impact", "impact_lag1", "impact_3yr_avg",
                 "impact_trend_5yr", "impact_std_5yr", "country_recent_deviation",
                 "log_total_affected", "log_total_death",
                 "log_total_affected_3yr_avg", "log_total_death_3yr_avg",
                 "hazard_count", "economic_damage_pct_gdp"]


def prediction(grain: str, cutoff: int, lo: int, hi: int, excluded,
               min_periods: int = 5) -> list[tuple[str, str]]:
    """CTEs up to ``p_in`` (imputed prediction rows, with stale components)."""
    lat = f"""SELECT * FROM cli
WHERE period BETWEEN {lo} AND {hi}
  AND country IN (SELECT country FROM cli WHERE period <= {cutoff})
QUALIFY row_number() OVER (PARTITION BY country ORDER BY period DESC) = 1"""
    val = f"""SELECT country FROM cli WHERE period <= {cutoff} GROUP BY country
HAVING count(DISTINCT period) >= {min_periods}"""
    p0 = "SELECT * FROM p_lat WHERE country IN (SELECT country FROM p_val)"
    hz = ", ".join(f"coalesce({c}, 0) AS {c}" for c in IMPACT_COLS)
    p1 = f"SELECT * REPLACE ({hz}) FROM p_0"
    mean4 = "(" + " + ".join(IMPACT_COLS) + ") / 4.0"
    p2 = f"""SELECT * REPLACE (coalesce(climate_impact_index, {mean4}, 0) AS climate_impact_index,
  coalesce(absolute_impact_trend, 0) AS absolute_impact_trend) FROM p_1"""
    med = "SELECT " + ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in MEDIAN_FILLED) + " FROM p_2"
    fill = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}, 0) AS {c}" for c in MEDIAN_FILLED)
    p3 = f"SELECT p_2.* REPLACE ({fill}) FROM p_2 CROSS JOIN p_med"
    return composite(grain, cutoff, excluded) + [
        ("p_lat", lat), ("p_val", val), ("p_0", p0), ("p_1", p1), ("p_2", p2),
        ("p_med", med), ("p_in", p3)]


def scores(grain: str, cutoff: int, lo: int, hi: int, excluded) -> list[tuple[str, str]]:
    """CTEs up to ``s_ok`` (re-scored prediction rows with a CLI)."""
    drop = ", ".join(n for n in COMPONENT_COLS_NAMES)
    return prediction(grain, cutoff, lo, hi, excluded) + [
        ("p_base", f"SELECT * EXCLUDE ({drop}) FROM p_in"),
        apply_comp("p_base", "s_all"),
        ("s_ok", f"""SELECT * FROM s_all WHERE CLI IS NOT NULL
  AND (country IS NULL OR country NOT IN ({in_list(excluded)}))""")]


COMPONENT_COLS_NAMES = [c for c, _ in COMPONENT_COLS]
PRED_COLS = [(c, "d" if k == "i" and c == "hazard_count" else k)
             for c, k in FEATURE_COLS] + COMPONENT_COLS


ORACLE: dict[str, str] = {}
