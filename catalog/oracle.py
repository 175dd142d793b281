"""The catalog's queries as DuckDB SQL, written from the definitions and not from the Spark code.

Integer sums are cast to BIGINT and years to INTEGER so that types agree; doubles are rounded as in the queries.
"""

from __future__ import annotations

from eventrates.functions import fixed_values as fixed

YEARS = (2017, 2018, 2019)

RAW = """
SELECT event_id,
       CASE WHEN user_id % 37 = 0 THEN '' ELSE 'N' || (user_id % 50) END AS neighborhood,
       CASE WHEN event_id % 40 = 0 THEN 'Truancy (P)' WHEN event_id % 3 = 0 THEN 'Suspicious Person (P)'
            ELSE 'Traffic Law Enforcement (P)' END AS problem,
       CASE WHEN event_id % 7 < 3 THEN 'Female' WHEN event_id % 7 = 6 THEN 'Unknown' ELSE 'Male' END AS gender,
       race,
       CASE WHEN event_id % 3 = 0 THEN 'Unknown' ELSE race END AS preRace,
       CASE WHEN event_id % 17 = 0 THEN '' WHEN value >= 60 THEN 'YES' ELSE 'NO' END AS personSearch,
       CASE WHEN event_id % 19 = 0 THEN '' WHEN value BETWEEN 40 AND 90 THEN 'YES' ELSE 'NO' END AS vehicleSearch,
       CASE WHEN event_id % 6 = 0 THEN 'BKG-Booking' ELSE 'TAG-Tagged' END AS callDisposition,
       CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'Citizen / 9-1-1' ELSE 'Investigative' END AS reason,
       date_trunc('second', tm) AS tm,
       44.9e0 + (event_id * 7919 % 2003) / 10000e0 AS lat,
       -93.4e0 + (event_id * 104729 % 2503) / 10000e0 AS long
FROM (SELECT *,
             ts + to_months(CAST(event_id % 12 - 12 * CASE WHEN event_id % 101 = 0 THEN 3 ELSE 5 + event_id % 3 END AS INTEGER)) AS tm,
             CASE event_type WHEN 'click' THEN 'Black' WHEN 'view' THEN 'White' WHEN 'error' THEN 'East African'
                  WHEN 'purchase' THEN 'Latino'
                  ELSE CASE event_id % 4 WHEN 0 THEN 'Native American' WHEN 1 THEN '' WHEN 2 THEN 'Asian' ELSE 'Other' END
             END AS race
      FROM events)
"""


def _recoded(column: str) -> str:
    return (
        f"CASE {column} WHEN 'East African' THEN 'Black' WHEN 'Latino' THEN 'Latinx' "
        f"WHEN 'Native American' THEN 'Indigenous' WHEN '' THEN 'Unknown' ELSE {column} END"
    )


def _sun(day: str) -> str:
    """Sun times from the published series; ``e`` rows carry event_id, tm, lat, long."""
    r = "(pi() / 180)"
    return f"""
, s0 AS (SELECT *, -(long * {r}) AS lw, lat * {r} AS phi,
                (date_diff('day', DATE '1970-01-01', {day}) + 0.5e0 - 10957.5e0) AS d FROM e)
, s1 AS (SELECT *, floor(d - 0.0009e0 - lw / (2 * pi()) + 0.5e0) AS cyc FROM s0)
, s2 AS (SELECT *, 0.0009e0 + lw / (2 * pi()) + cyc AS ds FROM s1)
, s3 AS (SELECT *, 357.5291e0 * {r} + 0.98560028e0 * {r} * ds AS m FROM s2)
, s4 AS (SELECT *, m + 1.9148e0 * {r} * sin(m) + 0.02e0 * {r} * sin(2 * m) + 0.0003e0 * {r} * sin(3 * m)
                   + 102.9372e0 * {r} + pi() AS l FROM s3)
, s5 AS (SELECT *, asin(sin(23.4397e0 * {r}) * sin(l)) AS dec, 0.0053e0 * sin(m) - 0.0069e0 * sin(2 * l) AS wob FROM s4)
, s6 AS (SELECT *, (sin(-0.833e0 * {r}) - sin(phi) * sin(dec)) / (cos(phi) * cos(dec)) AS cs,
                   (sin(-6e0 * {r}) - sin(phi) * sin(dec)) / (cos(phi) * cos(dec)) AS cd FROM s5)
, s7 AS (SELECT *, 0.0009e0 + (acos(cs) + lw) / (2 * pi()) + cyc + wob AS jset,
                   0.0009e0 + (acos(cd) + lw) / (2 * pi()) + cyc + wob AS jdusk FROM s6)
, sun AS (SELECT event_id, tm, make_timestamp(CAST(floor((2 * (ds + wob) - jset + 10957.5e0) * 86400e6 + 0.5e0) AS BIGINT)) AS sunrise,
                 make_timestamp(CAST(floor((jset + 10957.5e0) * 86400e6 + 0.5e0) AS BIGINT)) AS sunset,
                 make_timestamp(CAST(floor((jdusk + 10957.5e0) * 86400e6 + 0.5e0) AS BIGINT)) AS dusk FROM s7)
"""


UTC_DAY = "CAST(tm AS DATE)"
LOCAL_DAY = "CAST(timezone('America/Chicago', timezone('UTC', tm)) AS DATE)"
SUN_ROWS = ", ".join(
    f"date_trunc('second', {n} + INTERVAL 500 MILLISECOND) AS {n}" for n in ("sunrise", "sunset", "dusk")
)
VEIL_ROWS = """
CASE WHEN tm >= sunrise AND tm <= sunset THEN 1 ELSE 0 END AS veilBeforeSunset,
CASE WHEN tm >= dusk OR tm <= sunrise THEN 1 ELSE 0 END AS veilAfterSunset
"""

CLEAN = f"""
WITH raw AS ({RAW})
, e AS (SELECT * FROM raw WHERE neighborhood <> '' AND problem NOT IN ('Truancy (P)', 'Curfew Violations (P)'))
{_sun(UTC_DAY)}
, clean AS (
  SELECT e.*, {_recoded('e.preRace')} AS preRaceRecode, {_recoded('e.race')} AS raceRecode,
         CASE WHEN personSearch = 'YES' OR vehicleSearch = 'YES' THEN 'YES' ELSE 'NO' END AS anySearch,
         hour(e.tm) + minute(e.tm) / 60e0 AS hm, v.veilBeforeSunset, v.veilAfterSunset
  FROM e JOIN (SELECT event_id, {VEIL_ROWS} FROM sun) v USING (event_id))
"""

PRIORITY = {"Urgent": "1-URGENT", "High": "2-HIGH", "Medium": "3-MEDIUM", "Unspec": "4-NOT SPECIFIED", "Low": "5-LOW"}

MONTHS = "strftime(o_orderdate, '%Y-%m')"
MONTHLY = (
    f"SELECT {MONTHS} AS dateMonthYear, "
    + ", ".join(f"count(*) FILTER (o_orderpriority = '{v}') AS NStops{k}" for k, v in PRIORITY.items())
    + ", "
    + ", ".join(
        f"round(count(*) FILTER (o_orderpriority = '{v}') / count(*)::DOUBLE * 100, 6) AS NStops{k}Pct"
        for k, v in PRIORITY.items()
    )
    + f" FROM orders GROUP BY 1 HAVING {MONTHS} <> '1995-01'"
)
MONTHLY_LONG = f"""
SELECT g.m AS dateMonthYear, o.p AS race, o.n AS NStops, round(o.n / g.t::DOUBLE * 100, 6) AS NStopsPct
FROM (SELECT {MONTHS} AS m, count(*) AS t FROM orders GROUP BY 1) g
JOIN (SELECT m, p, count(o_orderkey) AS n FROM (SELECT DISTINCT {MONTHS} AS m FROM orders) a
      CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) b
      LEFT JOIN orders ON {MONTHS} = m AND o_orderpriority = p GROUP BY 1, 2) o USING (m)
WHERE g.m <> '1995-01'
"""

# Polygons of the stand-in areas and boundary as edges (x1, y1, x2, y2).
OUTER = [(0, 0), (16, 0), (16, 16), (8, 8), (0, 16)]
HOLE = [(6, 2), (10, 2), (10, 6), (6, 6)]
BAND = [(1, 20), (14, 24), (14, 56), (1, 60)]


def _edge_rows(table: str, key: str, x: str, y: str, ring: list[tuple[int, int]], where: str = "true") -> str:
    parts = []
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        parts.append(
            f"SELECT {key} AS pid, -93.4e0 + ({x} + {ax}) / 320e0 AS x1, 44.9e0 + ({y} + {ay}) / 400e0 AS y1, "
            f"-93.4e0 + ({x} + {bx}) / 320e0 AS x2, 44.9e0 + ({y} + {by}) / 400e0 AS y2 FROM {table} WHERE {where}"
        )
    return " UNION ALL ".join(parts)


AREA_EDGES = (
    _edge_rows("nation", "n_nationkey", "n_nationkey % 5 * 16", "n_nationkey // 5 * 16", OUTER)
    + " UNION ALL "
    + _edge_rows("nation", "n_nationkey", "n_nationkey % 5 * 16", "n_nationkey // 5 * 16", HOLE, "n_nationkey % 3 = 0")
)
BAND_EDGES = _edge_rows("region", "r_regionkey", "r_regionkey * 16", "0", BAND)


def _inside(points: str, edges: str, px: str = "long", py: str = "lat") -> str:
    """(event_id, pid) pairs by ray casting over every edge, closed on edges and corners."""
    return f"""
SELECT p.event_id, g.pid FROM {points} p, {edges} g GROUP BY p.event_id, g.pid
HAVING sum(CASE WHEN (g.y1 > p.{py}) <> (g.y2 > p.{py})
                 AND p.{px} < (g.x2 - g.x1) * (p.{py} - g.y1) / (g.y2 - g.y1) + g.x1 THEN 1 ELSE 0 END) % 2 = 1
    OR bool_or(p.{px} BETWEEN least(g.x1, g.x2) AND greatest(g.x1, g.x2)
           AND p.{py} BETWEEN least(g.y1, g.y2) AND greatest(g.y1, g.y2)
           AND (g.x2 - g.x1) * (p.{py} - g.y1) - (g.y2 - g.y1) * (p.{px} - g.x1) = 0)
"""


AREA_POINTS = f"WITH p AS ({RAW}), g AS ({AREA_EDGES}), hit AS ({_inside('p', 'g')})"
NATION_ID = "'27053' || lpad(n_nationkey::VARCHAR, 6, '0')"

# Area-years whose polygon meets a boundary polygon.
TOUCHING = f"""
g AS ({AREA_EDGES}), b AS ({BAND_EDGES}),
cross_edges AS (
  SELECT DISTINCT g.pid FROM g, b
  WHERE least(g.x1, g.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(g.x1, g.x2)
    AND least(g.y1, g.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(g.y1, g.y2)
    AND sign((g.x2 - g.x1) * (b.y1 - g.y1) - (g.y2 - g.y1) * (b.x1 - g.x1))
      * sign((g.x2 - g.x1) * (b.y2 - g.y1) - (g.y2 - g.y1) * (b.x2 - g.x1)) <= 0
    AND sign((b.x2 - b.x1) * (g.y1 - b.y1) - (b.y2 - b.y1) * (g.x1 - b.x1))
      * sign((b.x2 - b.x1) * (g.y2 - b.y1) - (b.y2 - b.y1) * (g.x2 - b.x1)) <= 0),
g_corner AS (SELECT DISTINCT pid AS event_id, x1 AS long, y1 AS lat FROM g),
b_corner AS (SELECT DISTINCT pid AS event_id, x1 AS long, y1 AS lat FROM b),
g_in AS ({_inside('g_corner', 'b')}), b_in AS ({_inside('b_corner', 'g')}),
touching AS (SELECT pid FROM cross_edges UNION SELECT event_id FROM g_in UNION SELECT pid FROM b_in)
"""

SLICES = {
    "": "true",
    "BS": "bs = 1",
    "AS": "as_ = 1",
    "PS": "personSearch = 'YES'",
    "VS": "vehicleSearch = 'YES'",
    "PSBS": "personSearch = 'YES' AND bs = 1",
    "VSBS": "vehicleSearch = 'YES' AND bs = 1",
    "PSAS": "personSearch = 'YES' AND as_ = 1",
    "VSAS": "vehicleSearch = 'YES' AND as_ = 1",
}


def _cells(column: str, labels: dict[str, str]) -> list[str]:
    cells = []
    for suffix, condition in SLICES.items():
        for label, value in labels.items():
            cells.append(f"count(*) FILTER ({column} = '{value}' AND {condition}) AS NStops{label}{suffix}")
        cells.append(f"count(*) FILTER ({condition}) AS NStopsTotal{suffix}")
    return cells


def _rates(black: str, white: str, pop: str, wide_black: str, wide_white: str) -> list[str]:
    """The 33 rates as SQL over the counts."""
    own = {"Black": black, "White": white}
    city = {"Black": wide_black, "White": wide_white}
    rows = []

    def rate(label: str, piece: str, suffix: str, below: str) -> None:
        rows.append(f"round(NStops{label}{piece} / nullif({below}, 0)::DOUBLE * 100, 6) AS NStops{label}{piece}Rate{suffix}")

    for piece in ("", "AS", "BS"):
        rate("Total", piece, "PerCapita", pop)
        for label in own:
            rate(label, piece, "PerStratum", own[label])
            rate(label, piece, "PerCapita", pop)
            rate(label, piece, "PerCapitaCity", city[label])
    for piece in ("PS", "VS", "PSBS", "VSBS", "PSAS", "VSAS"):
        for label in own:
            rate(label, piece, "PerStratum", own[label])
    return rows


ORDER_RATES = f"""
WITH o AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS YEAR, n_name AS NAME, o_orderpriority AS category,
         CASE WHEN o_totalprice > 300000 THEN 'YES' ELSE 'NO' END AS personSearch,
         CASE WHEN o_totalprice < 200000 THEN 'YES' ELSE 'NO' END AS vehicleSearch,
         CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS bs, CASE WHEN o_totalprice < 100000 THEN 1 ELSE 0 END AS as_
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
, m AS (SELECT YEAR, NAME, {', '.join(_cells('category', {'Black': '1-URGENT', 'White': '5-LOW'}))} FROM o GROUP BY ALL)
, people AS (SELECT n_name AS NAME, count(*) AS tot_pop, count(*) FILTER (c_mktsegment = 'MACHINERY') AS tot_black,
                    count(*) FILTER (c_mktsegment IN ('BUILDING', 'FURNITURE')) AS tot_white
             FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
, j AS (SELECT *, sum(tot_black) OVER (PARTITION BY YEAR) AS city_black, sum(tot_white) OVER (PARTITION BY YEAR) AS city_white
        FROM m JOIN people USING (NAME))
, rates AS (SELECT YEAR, NAME, NStopsTotal, {', '.join(_rates('tot_black', 'tot_white', 'tot_pop', 'city_black', 'city_white'))} FROM j)
"""


def _classes(measure: str, breaks: dict = fixed.RATE_BREAKS) -> str:
    cuts = breaks[measure]
    last = len(cuts) - 2
    whens = "".join(
        f" WHEN {measure} >= {a} AND {measure} {'<=' if i == last else '<'} {b} THEN {i}"
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
    )
    texts = "".join(f" WHEN {i} THEN '{a:g} to {b:g}'" for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])))
    race = measure.removeprefix("NStops")[:5]
    return (
        f"SELECT YEAR, NAME, '{measure}' AS measure, {measure} AS rate, class, CASE class{texts} END AS legend, "
        f"'{race} rates across areas in ' || YEAR AS title "
        f"FROM (SELECT *, CASE{whens} END AS class FROM rates)"
    )


CLASSED = list(fixed.RATE_BREAKS)


def _demographic(variable: str) -> str:
    """Value of a source variable in the stand-in demographics, as a function of people and year."""
    i = list(fixed.VARIABLE_CODES).index(variable.removesuffix("E"))
    return f"(people * {1 + i % 7} + {i} + YEAR - 2017)::DOUBLE"


DEMOGRAPHIC_BASE = f"""
SELECT y.YEAR, n_nationkey, {NATION_ID} AS GEOID, n_name AS NAME, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS people
FROM nation, (SELECT unnest([2017, 2018, 2019])::INTEGER AS YEAR) y
"""


def _total(parts: list[str], derived: dict[str, str]) -> str:
    return "(" + " + ".join(derived.get(p) or _demographic(p) for p in parts) + ")"


def _demographic_ratios() -> str:
    derived = {name: _total(parts, {}) for name, parts in fixed.DERIVED_TOTALS.items()}
    derived["tot_other"] = f"({derived['tot_pop']} - ({derived['tot_white']} + {derived['tot_black']}))"
    for name, (over, under) in fixed.DERIVED_RATIOS.items():
        derived[name] = f"round({_total(over, derived)} / {_total(under, derived)}, 6)"
    white, black = (f"{derived[t]} / {_demographic('hisp_totE')}" for t in ("tot_white", "tot_black"))
    derived["pct_other"] = f"round(1 - ({white} + {black}), 6)"
    derived |= {v: _demographic(v) for v in ("pop_maleE", "pop_femaleE")}
    return f"SELECT GEOID, NAME, YEAR, {', '.join(f'{sql} AS {n}' for n, sql in derived.items())} FROM ({DEMOGRAPHIC_BASE})"


PIPELINE_LABELS = {"Black": "Black", "White": "White", "Latin": "Latinx"}
PIPELINE = f"""
{CLEAN}
, pts AS (SELECT event_id, long, lat, CAST(year(tm) AS INTEGER) AS YEAR, raceRecode, personSearch, vehicleSearch,
                 veilBeforeSunset AS bs, veilAfterSunset AS as_ FROM clean WHERE year(tm) IN (2017, 2018, 2019))
, {TOUCHING}
, city AS (SELECT * FROM ({DEMOGRAPHIC_BASE}) WHERE n_nationkey IN (SELECT pid FROM touching) AND n_nationkey NOT IN (7, 12))
, within AS (SELECT DISTINCT event_id FROM ({_inside('pts', 'b')}))
, placed AS ({_inside('pts', 'g')})
, m AS (SELECT pts.YEAR, placed.pid AS n_nationkey, {', '.join(_cells('raceRecode', PIPELINE_LABELS))}
        FROM pts JOIN placed USING (event_id) WHERE event_id IN (SELECT event_id FROM within) GROUP BY 1, 2)
, j AS (SELECT *, {_total(['hisp_no_blkE', 'hisp_yes_blkE'], {})} AS tot_black, {_total(['hisp_no_whtE', 'hisp_yes_whtE'], {})} AS tot_white,
               {_demographic('pop_totE')} AS tot_pop
        FROM city JOIN m USING (YEAR, n_nationkey))
, w AS (SELECT *, sum(tot_black) OVER (PARTITION BY YEAR) AS city_black, sum(tot_white) OVER (PARTITION BY YEAR) AS city_white FROM j)
SELECT YEAR, GEOID, NAME, round(tot_pop, 6) AS tot_pop, NStopsTotal, NStopsLatinVS,
       {', '.join(_rates('tot_black', 'tot_white', 'tot_pop', 'city_black', 'city_white'))} FROM w
"""


def _natural_breaks(table: str, column: str, k: int) -> str:
    """Exact least-deviation classes: every cut of the sorted distinct values, one class more per step."""
    sql = f"""
WITH v AS (SELECT {column} AS x, count(*) AS c FROM {table} WHERE {column} IS NOT NULL GROUP BY 1)
, mid AS (SELECT avg({column}) AS a FROM {table})
, s AS (SELECT row_number() OVER (ORDER BY x) AS i, x, sum(c) OVER w AS n, sum(c * (x - a)) OVER w AS t,
               sum(c * (x - a) * (x - a)) OVER w AS q FROM v, mid WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING))
, z AS (SELECT 0 AS i, NULL AS x, 0 AS n, 0e0 AS t, 0e0 AS q UNION ALL SELECT * FROM s)
, cost AS (SELECT a.i AS lo, b.i AS hi, greatest((b.q - a.q) - (b.t - a.t) * (b.t - a.t) / (b.n - a.n), 0) AS d
           FROM z a JOIN z b ON a.i < b.i)
, d1 AS (SELECT hi, d, [hi] AS cuts FROM cost WHERE lo = 0)
"""
    for step in range(2, k + 1):
        sql += (
            f", d{step} AS (SELECT cost.hi, min(p.d + cost.d) AS d, arg_min(list_append(p.cuts, cost.hi), p.d + cost.d) AS cuts "
            f"FROM d{step - 1} p JOIN cost ON cost.lo = p.hi GROUP BY cost.hi)\n"
        )
    return sql + f"""
, best AS (SELECT unnest(cuts) AS hi FROM d{k} WHERE hi = (SELECT max(i) FROM s))
, parts AS (SELECT hi, lag(hi, 1, 0) OVER (ORDER BY hi) AS lo, CAST(row_number() OVER (ORDER BY hi) - 1 AS INTEGER) AS class FROM best)
SELECT '{column}' AS measure, class, a.x AS lower, b.x AS upper, CAST(b.n - z.n AS BIGINT) AS n
FROM parts JOIN s a ON a.i = parts.lo + 1 JOIN s b ON b.i = parts.hi JOIN z ON z.i = parts.lo
"""


TRIAL = """
SELECT event_id, user_id AS cluster, CASE WHEN value >= 40 THEN 1e0 ELSE 0e0 END AS y, event_type AS kind,
       CAST(ts AS DATE) > DATE '2024-01-12' AS post, hour(ts) >= 12 AS late,
       CAST(json_extract(props, '$.k') AS DOUBLE) / 100e0 AS k, day(ts) / 10e0 AS day, 'w' || (event_id % 3) AS ward
FROM events
"""

KINDS = ["click", "error", "purchase", "signup", "view"]
SATURATED_TERMS = {"(intercept)": "true"}
SATURATED_TERMS |= {f"kind[{k}]": f"kind = '{k}'" for k in KINDS[1:]}
SATURATED_TERMS |= {"post": "post"}
SATURATED_TERMS |= {f"post:kind[{k}]": f"post AND kind = '{k}'" for k in KINDS[1:]}


def _inverse(name: str, source: str, p: int) -> str:
    """Gauss-Jordan elimination of a p x p matrix held as rows (i, j, v), one step per pivot."""
    sql = f", {name}_0 AS (SELECT i, j, v FROM {source} UNION ALL SELECT i, i + {p}, 1e0 FROM (SELECT DISTINCT i FROM {source}))\n"
    for k in range(p):
        # Zero entries are absent, so each step completes the rows of its pivot by outer joins.
        sql += f""", {name}_{k + 1} AS (
SELECT ij.i, ij.j, CASE WHEN ij.i = {k} THEN coalesce(t.v, 0) / d.v ELSE coalesce(m.v, 0) - coalesce(f.v, 0) * coalesce(t.v, 0) / d.v END AS v
FROM (SELECT a.i, b.j FROM (SELECT DISTINCT i FROM {name}_{k}) a, (SELECT DISTINCT j FROM {name}_{k}) b) ij
LEFT JOIN {name}_{k} m ON m.i = ij.i AND m.j = ij.j
LEFT JOIN {name}_{k} f ON f.i = ij.i AND f.j = {k}
LEFT JOIN {name}_{k} t ON t.i = {k} AND t.j = ij.j
JOIN {name}_{k} d ON d.i = {k} AND d.j = {k})
"""
    return sql + f", {name} AS (SELECT i, j - {p} AS j, v FROM {name}_{p} WHERE j >= {p})\n"


def _one_step(terms: dict[str, str], pattern: list[str], trial: str = f"WITH trial AS ({TRIAL})") -> str:
    """One-step estimating equations for a saturated model (one term per category combination).

    The starting fit is the mean of each combination; its coefficients solve X b = logit(mean), with X one row per
    combination. ``start``, ``step`` (i, b) and ``cov`` (i, j, v) are left for the final SELECT.
    """
    p, keys = len(terms), ", ".join(pattern)
    names = list(terms)
    xs = " UNION ALL ".join(
        f"SELECT {keys}, {i} AS i FROM cellmean WHERE {condition}" for i, condition in enumerate(terms.values())
    )
    on = " AND ".join(f"a.{c} = b.{c}" for c in pattern)

    def sums(name: str, eta: str) -> str:
        """Per cluster and term: a = sum sqrt(v) x, u = sum x (y - mu); W with the correlation of the start."""
        return f"""
, {name}_r AS (SELECT r.cluster, {', '.join('r.' + c for c in pattern)}, r.y, 1 / (1 + exp(-e.eta)) AS mu FROM trial r JOIN {eta} e USING ({keys}))
, {name}_c AS (SELECT cluster, {keys}, count(*) AS n, sum((y - mu) / sqrt(mu * (1 - mu))) AS se,
                      sum((y - mu) * (y - mu) / (mu * (1 - mu))) AS see, sum(sqrt(mu * (1 - mu))) AS a,
                      sum(y - mu) AS u, sum(mu * (1 - mu)) AS v FROM {name}_r GROUP BY ALL)
, {name}_n AS (SELECT cluster, sum(n)::DOUBLE AS n, sum(se) AS se, sum(see) AS see FROM {name}_c GROUP BY 1)
, {name}_t AS (SELECT a.cluster, x.i, sum(a.a) AS a, sum(a.u) AS u FROM {name}_c a JOIN x b ON {on} JOIN x ON x.i = b.i AND {on.replace('b.', 'x.')} GROUP BY 1, 2)
, {name}_g AS (SELECT x.i, x2.i AS j, sum(a.v) AS v FROM {name}_c a JOIN x ON {on.replace('b.', 'x.')} JOIN x x2 ON {on.replace('b.', 'x2.')} GROUP BY 1, 2)
"""

    def information(name: str) -> str:
        return f"""
, {name}_b AS (SELECT s.i, t.i AS j, sum(rho / (1 - rho + c.n * rho) * s.a * t.a) AS v
               FROM {name}_t s JOIN {name}_t t USING (cluster) JOIN {name}_n c USING (cluster), rho GROUP BY 1, 2)
, {name}_w AS (SELECT i, j, coalesce(g.v, 0) - coalesce(b.v, 0) AS v FROM {name}_b b FULL JOIN {name}_g g USING (i, j))
"""

    sql = f"""
{trial}
, cellmean AS (SELECT {keys}, ln(avg(y) / (1 - avg(y))) AS eta, row_number() OVER (ORDER BY {keys}) - 1 AS cell FROM trial GROUP BY {keys})
, x AS ({xs})
, xm AS (SELECT b.cell AS i, a.i AS j, 1e0 AS v FROM x a JOIN cellmean b ON {on}
         UNION ALL SELECT c.cell, t.j, 0e0 FROM cellmean c, (SELECT unnest(range({p})) AS j) t
         WHERE NOT EXISTS (SELECT 1 FROM x a JOIN cellmean b ON {on} WHERE b.cell = c.cell AND a.i = t.j))
, xord AS (SELECT m.i AS cell, r.rk AS i, m.j, m.v FROM xm m JOIN (
             SELECT cell, row_number() OVER (ORDER BY top, cell) - 1 AS rk FROM (SELECT i AS cell, max(j) FILTER (v = 1) AS top FROM xm GROUP BY 1)) r ON r.cell = m.i)
, xsq AS (SELECT i, j, v FROM xord)
{_inverse('xinv', 'xsq', p)}
, start AS (SELECT q.i, sum(q.v * c.eta) AS b FROM xinv q JOIN (SELECT DISTINCT cell, i FROM xord) o ON o.i = q.j JOIN cellmean c ON c.cell = o.cell GROUP BY 1)
{sums('f', 'cellmean')}
, rho AS (SELECT sum((se * se - see) / 2) / sum(n * (n - 1) / 2) AS rho FROM f_n)
{information('f')}
{_inverse('f_inv', 'f_w', p)}
, pull AS (SELECT t.i, sum(rho / (1 - rho + c.n * rho) * c.se * t.a) AS s FROM f_t t JOIN f_n c USING (cluster), rho GROUP BY 1)
, step AS (SELECT s.i, s.b - coalesce(m.d, 0) AS b FROM start s LEFT JOIN (SELECT q.i, sum(q.v * pull.s) AS d FROM f_inv q JOIN pull ON pull.i = q.j GROUP BY 1) m ON m.i = s.i)
, eta2 AS (SELECT {', '.join('a.' + c for c in pattern)}, sum(step.b) AS eta FROM x a JOIN step ON step.i = a.i GROUP BY ALL)
{sums('h', 'eta2')}
{information('h')}
{_inverse('h_inv', 'h_w', p)}
, fixed_u AS (SELECT t.cluster, t.i, t.u - rho / (1 - rho + c.n * rho) * t.a * c.se AS u FROM h_t t JOIN h_n c USING (cluster), rho)
, meat AS (SELECT s.i, t.i AS j, sum(s.u * t.u) AS v FROM fixed_u s JOIN fixed_u t USING (cluster) GROUP BY 1, 2)
, half AS (SELECT q.i, m.j, sum(q.v * m.v) AS v FROM h_inv q JOIN meat m ON m.i = q.j GROUP BY 1, 2)
, cov AS (SELECT h.i, q.j, sum(h.v * q.v) AS v FROM half h JOIN h_inv q ON q.i = h.j GROUP BY 1, 2)
, term AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(names))}) AS t(i, term))
"""
    return sql


FACTOR_LEVELS = {
    "gender": ["Female", "Male", "Unknown"],
    "preRaceRecode": ["Asian", "Black", "Indigenous", "Latinx", "Other", "Unknown", "White"],
    "problem": ["Suspicious Person (P)", "Traffic Law Enforcement (P)"],
    "reason": ["Citizen / 9-1-1", "Investigative", "Unknown"],
}


def _eliminated(name: str, source: str, p: int) -> str:
    """Gauss-Jordan elimination of a list of rows ``m`` of ``source``, whose first p columns become the identity.

    Rows that earlier ones make up become zero, so their terms have coefficient and variance 0.
    """
    return f"""
, {name}(k, m) AS (SELECT 0, m FROM {source} UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN abs(m[k + 1][k + 1]) < 1e-8 THEN CASE WHEN i = k + 1 THEN list_transform(r, lambda v: 0e0) ELSE r END
    WHEN i = k + 1 THEN list_transform(r, lambda v: v / r[k + 1]) ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM {name} WHERE k < {p})
"""


def _one_step_fitted(terms: dict[str, str], trial: str, rounds: int = 8) -> str:
    """One-step estimating equations of any design, the start by Newton's method. Leaves the same tables as _one_step.

    ``terms`` are numeric expressions over ``trial``, which also has cluster and y.
    """
    p = len(terms)
    design = ", ".join(f"({x})::DOUBLE" for x in terms.values())
    identity = f"list_transform(range(1, {p} + 1), lambda j: CASE WHEN j = i THEN 1e0 ELSE 0e0 END)"
    sql = trial.strip().replace("WITH ", "WITH RECURSIVE ", 1)
    sql += f"""
, design AS MATERIALIZED (SELECT cluster, y, [{design}] AS x FROM trial)
, ii AS (SELECT unnest(range(1, {p} + 1)) AS i)
, ij AS (SELECT i, j FROM ii, (SELECT unnest(range(1, {p} + 2)) AS j))
, newton_b0 AS (SELECT list_transform(range(1, {p} + 1), lambda i: 0e0) AS b)"""
    for r in range(1, rounds + 1):
        sql += f"""
, newton_m{r} AS MATERIALIZED (SELECT x, y, 1 / (1 + exp(-list_dot_product(x, b))) AS mu FROM design, newton_b{r - 1})
, newton_g{r} AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM (
    SELECT i, j, sum(x[i] * CASE WHEN j > {p} THEN y - mu ELSE x[j] * mu * (1 - mu) END) AS v FROM newton_m{r}, ij GROUP BY 1, 2) GROUP BY 1))
{_eliminated(f'newton_s{r}', f'newton_g{r}', p)}
, newton_b{r} AS MATERIALIZED (SELECT list_transform(b, lambda v, i: v + m[i][{p} + 1]) AS b FROM newton_b{r - 1}, newton_s{r} WHERE k = {p})"""

    def sums(name: str, b: str) -> str:
        return f"""
, {name}_r AS MATERIALIZED (SELECT cluster, x, y, 1 / (1 + exp(-list_dot_product(x, b))) AS mu FROM design, {b})
, {name}_n AS MATERIALIZED (SELECT cluster, count(*)::DOUBLE AS n, sum((y - mu) / sqrt(mu * (1 - mu))) AS se,
    sum((y - mu) * (y - mu) / (mu * (1 - mu))) AS see FROM {name}_r GROUP BY 1)
, {name}_t AS MATERIALIZED (SELECT cluster, list(a ORDER BY i) AS a, list(u ORDER BY i) AS u FROM (
    SELECT cluster, i, sum(x[i] * sqrt(mu * (1 - mu))) AS a, sum(x[i] * (y - mu)) AS u FROM {name}_r, ii GROUP BY 1, 2) GROUP BY 1)"""

    def inverse(name: str) -> str:
        return f"""
, {name}_g AS (SELECT i, j, sum(x[i] * x[j] * mu * (1 - mu)) AS v FROM {name}_r, ij WHERE j <= {p} GROUP BY 1, 2)
, {name}_o AS (SELECT i, j, sum(rho / (1 - rho + n * rho) * a[i] * a[j]) AS v FROM {name}_t JOIN {name}_n USING (cluster), rho, ij WHERE j <= {p} GROUP BY 1, 2)
, {name}_w AS MATERIALIZED (SELECT list(list_concat(r, {identity}) ORDER BY i) AS m FROM (
    SELECT i, list(g.v - o.v ORDER BY j) AS r FROM {name}_g g JOIN {name}_o o USING (i, j) GROUP BY 1))
{_eliminated(f'{name}_e', f'{name}_w', p)}
, {name}_inv AS MATERIALIZED (SELECT i, j, m[i][{p} + j] AS v FROM {name}_e, ij WHERE k = {p} AND j <= {p})"""

    return sql + f"""
{sums('f', f'newton_b{rounds}')}
, rho AS (SELECT sum((se * se - see) / 2) / sum(n * (n - 1) / 2) AS rho FROM f_n)
{inverse('f')}
, pull AS (SELECT i, sum(rho / (1 - rho + n * rho) * se * a[i]) AS s FROM f_t JOIN f_n USING (cluster), rho, ii GROUP BY 1)
, b_step AS MATERIALIZED (SELECT list(b[i] - d ORDER BY i) AS b FROM newton_b{rounds}, (SELECT q.i, sum(q.v * pull.s) AS d FROM f_inv q JOIN pull ON pull.i = q.j GROUP BY 1))
{sums('h', 'b_step')}
{inverse('h')}
, fixed_u AS MATERIALIZED (SELECT cluster, i, u[i] - rho / (1 - rho + n * rho) * a[i] * se AS u FROM h_t JOIN h_n USING (cluster), rho, ii)
, meat AS (SELECT s.i, t.i AS j, sum(s.u * t.u) AS v FROM fixed_u s JOIN fixed_u t USING (cluster) GROUP BY 1, 2)
, half AS (SELECT q.i, m.j, sum(q.v * m.v) AS v FROM h_inv q JOIN meat m ON m.i = q.j GROUP BY 1, 2)
, cov AS (SELECT h.i - 1 AS i, q.j - 1 AS j, sum(h.v * q.v) AS v FROM half h JOIN h_inv q ON q.i = h.j GROUP BY 1, 2)
, start AS (SELECT i - 1 AS i, b[i] AS b FROM newton_b{rounds}, ii)
, step AS (SELECT i - 1 AS i, b[i] AS b FROM b_step, ii)
, term AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{n}')" for i, n in enumerate(terms))}) AS t(i, term))
"""


def _estimates(digits: int) -> str:
    return f"""
SELECT term, round(start.b, {digits}) AS beta_start, round(step.b, {digits}) AS beta, round(sqrt(cov.v), {digits}) AS se
FROM term JOIN start USING (i) JOIN step USING (i) JOIN cov ON cov.i = term.i AND cov.j = term.i
"""


Z = "1.959963984540054e0"


def oracles() -> dict[str, str]:
    """SQL by query name."""
    saturated = _one_step(SATURATED_TERMS, ["kind", "post"])
    sql: dict[str, str] = {}

    sql["clean_events"] = f"""{CLEAN}
SELECT event_id, neighborhood, preRaceRecode, raceRecode, strftime(tm, '%Y/%m/%d %H:%M:%S') AS responseDate, tm AS dateFull,
       CAST(tm AS DATE) AS date, anySearch, round(long, 6) AS lon, veilBeforeSunset, veilAfterSunset, round(hm, 6) AS hm,
       CASE WHEN hm BETWEEN 17 AND 22 THEN 1 ELSE 0 END AS interTwilight, CAST(year(tm) AS INTEGER) AS year FROM clean"""
    sql["recode_fill"] = """
SELECT event_id, CASE kind WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' WHEN '' THEN 'Unknown' ELSE kind END AS kind,
       CASE WHEN event_id % 13 = 0 THEN 'Unknown' ELSE event_type END AS note, date_trunc('second', ts) AS at
FROM (SELECT *, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS kind FROM events) WHERE kind <> 'error'"""
    sql["any_flag_clock_window"] = f"""
WITH raw AS ({RAW}), t AS (SELECT *, hour(tm) + minute(tm) / 60e0 AS hm, timezone('America/Chicago', timezone('UTC', tm)) AS la FROM raw)
SELECT event_id, CASE WHEN personSearch = 'YES' OR vehicleSearch = 'YES' THEN 'YES' ELSE 'NO' END AS anySearch, round(hm, 6) AS hm,
       CASE WHEN hm BETWEEN 17 AND 22 THEN 1 ELSE 0 END AS utcWindow,
       CASE WHEN hour(la) + minute(la) / 60e0 BETWEEN 17 AND 22 THEN 1 ELSE 0 END AS localWindow, strftime(tm, '%Y-%m') AS month,
       CASE personSearch WHEN 'NO' THEN 0 WHEN 'YES' THEN 1 END AS code,
       CASE WHEN gender IN ('Male', 'Female') THEN gender END AS gender, CAST(tm AS DATE) > DATE '2018-05-25' AS after FROM t"""
    sql["exclude_listed"] = """
SELECT user_id, event_type, value FROM events
WHERE event_type = 'click' AND user_id NOT IN (3, 5, 8, 13) AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
    sql["safe_ratios"] = """
SELECT p_partkey, round(a / nullif(b, 0)::DOUBLE, 6) AS nulls, a = 0 AND b = 0 AS is_nan, a > 0 AND b = 0 AS is_inf,
       a < 0 AND b = 0 AS is_minus_inf,
       regexp_replace(printf('%.1f', round_even(p_partkey / 8e0, 1)), '\\.0$', '') || '%' AS label
FROM (SELECT p_partkey, p_size % 3 - 1 AS a, p_partkey % 4 - 1 AS b FROM part)"""
    sql["hit_rate"] = """
SELECT l_returnflag, count(*) AS trials, count(*) FILTER (l_discount >= 0.05e0) AS hits,
       round(count(*) FILTER (l_discount >= 0.05e0) / count(*)::DOUBLE, 6) AS rate
FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1"""
    sql["search_outcomes"] = f"""
WITH raw AS ({RAW})
SELECT race, count(*) AS total_searches_race, count(*) FILTER (callDisposition = 'BKG-Booking') AS total_arrests_race,
       round(count(*) FILTER (callDisposition = 'BKG-Booking') / count(*)::DOUBLE, 6) AS arrest_search_rate_race
FROM raw WHERE vehicleSearch = 'YES' GROUP BY 1"""
    sql["frequency"] = "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1"
    sql["percent_of_total"] = """
SELECT o_orderstatus AS status, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE * 100, 6) AS pct
FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1"""
    sql["crosstab"] = """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O,
       count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1"""
    sql["crosstab_long"] = f"WITH raw AS ({RAW}) SELECT problem, reason, count(*) AS n FROM raw WHERE reason IS NOT NULL GROUP BY 1, 2"
    known = f"WITH raw AS ({RAW}), k AS (SELECT * FROM raw WHERE race NOT IN ('', 'Unknown') AND preRace NOT IN ('Unknown', 'Other'))"
    sql["agreement_label"] = f"""{known}
SELECT round(count(*) FILTER (race = CASE WHEN event_id % 5 = 0 THEN 'Asian' ELSE preRace END) / count(*)::DOUBLE, 6) AS agreement FROM k"""
    sql["agreement_positional"] = f"""{known}
, a AS (SELECT preRace, row_number() OVER (ORDER BY preRace) AS i FROM (SELECT DISTINCT preRace FROM k))
, b AS (SELECT race, row_number() OVER (ORDER BY race) AS j FROM (SELECT DISTINCT race FROM k))
SELECT round(count(*) FILTER (i = j) / count(*)::DOUBLE, 6) AS agreement FROM k JOIN a USING (preRace) JOIN b USING (race)"""
    sql["category_percent"] = f"""{CLEAN}
SELECT raceRecode, count(*) AS n, round(count(*) / (SELECT count(*) FROM clean)::DOUBLE * 100, 6) AS pct FROM clean GROUP BY 1"""
    long = " UNION ALL ".join(
        f"SELECT personSearch, '{c}' AS variable, {c} AS value FROM raw" for c in ("race", "problem", "gender", "reason")
    )
    sql["melt_share"] = f"""
WITH raw AS ({RAW}), l AS ({long}), n AS (SELECT personSearch, variable, value, count(*) AS n FROM l GROUP BY ALL)
SELECT *, round(n / (sum(n) OVER (PARTITION BY personSearch, variable))::DOUBLE * 100, 6) AS freq FROM n"""
    sql["fill_share"] = f"""
WITH raw AS ({RAW}), l AS ({long}), n AS (SELECT personSearch, variable, value, count(*) AS n FROM l WHERE personSearch <> '' GROUP BY ALL)
SELECT *, round(n / (sum(n) OVER (PARTITION BY variable, value))::DOUBLE, 6) AS share FROM n"""
    sql["column_range"] = "SELECT " + ", ".join(
        f"{f}({c}) AS {f}_{c}" for c in ("l_extendedprice", "l_discount", "l_quantity") for f in ("min", "max")
    ) + " FROM lineitem"

    def interval(column: str, divisor: str) -> str:
        half = f"1.96e0 * stddev_samp({column}) / {divisor}"
        return (
            f"SELECT '{column}' AS measure, count({column}) AS n, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS sd, "
            f"round(avg({column}) - {half}, 6) AS lower, round(avg({column}) + {half}, 6) AS upper FROM lineitem"
        )

    sql["mean_ci"] = " UNION ALL ".join(interval(c, f"count({c})") for c in ("l_extendedprice", "l_discount", "l_tax"))
    sql["mean_ci_sqrt_n"] = " UNION ALL ".join(interval(c, f"sqrt(count({c}))") for c in ("l_quantity", "l_tax"))

    sql["monthly_counts"] = MONTHLY
    sql["monthly_long"] = MONTHLY_LONG
    sql["stack_layout"] = f"""
WITH l AS ({MONTHLY_LONG}), s AS (SELECT *, sum(NStops) OVER (PARTITION BY dateMonthYear ORDER BY race DESC ROWS UNBOUNDED PRECEDING) AS top FROM l)
, t AS (SELECT dateMonthYear, race, NStops, NStops / sum(NStops) OVER (PARTITION BY dateMonthYear)::DOUBLE * 100 AS p, top FROM s)
SELECT dateMonthYear, race, NStops, CAST(top AS BIGINT) AS top, round(top - NStops / 2e0, 6) AS middle,
       regexp_replace(printf('%.1f', round_even(p, 1)), '\\.0$', '') || '%' AS label FROM t"""
    months = f"m AS (SELECT DISTINCT {MONTHS} AS dateMonthYear FROM orders WHERE {MONTHS} <> '1995-01'), r AS (SELECT *, (row_number() OVER (ORDER BY dateMonthYear) - 1) % 3 = 0 AS first FROM m)"
    sql["every_nth_blank_first"] = f"WITH {months} SELECT dateMonthYear, CASE WHEN first THEN '' ELSE dateMonthYear END AS label FROM r"
    sql["every_nth_drop_first"] = f"WITH {months} SELECT dateMonthYear, dateMonthYear AS label FROM r WHERE NOT first"
    sql["every_nth_blank_rest"] = f"WITH {months} SELECT dateMonthYear, CASE WHEN first THEN dateMonthYear ELSE '' END AS label FROM r"
    sql["every_nth_keep_first"] = f"WITH {months} SELECT dateMonthYear, dateMonthYear AS label FROM r WHERE first"
    sql["add_position"] = "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders"
    sql["mark_events"] = f"""
WITH {months}, top AS (SELECT * FROM orders WHERE o_totalprice >= (SELECT min(o_totalprice) FROM (SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 40)))
, t AS (SELECT {MONTHS} AS dateMonthYear, string_agg('order ' || o_orderkey, chr(10) ORDER BY o_orderdate, 'order ' || o_orderkey) AS label FROM top GROUP BY 1)
SELECT m.dateMonthYear, label FROM m LEFT JOIN t USING (dateMonthYear)"""
    sql["days_since_first"] = "SELECT o_orderkey, CAST(date_diff('day', (SELECT min(o_orderdate) FROM orders), o_orderdate) AS INTEGER) AS day FROM orders"

    flags = {"added": "A", "none": "N", "returned": "R"}
    pivot = ", ".join(
        f"{agg}(l_quantity) FILTER (l_returnflag = '{v}') AS {k}{s}" for k, v in flags.items() for s, agg in (("E", "sum"), ("M", "max"))
    )
    wide = f"SELECT CAST(year(l_shipdate) AS INTEGER) AS YEAR, l_suppkey AS GEOID, {pivot} FROM lineitem GROUP BY 1, 2"
    sql["pivot_variables"] = wide
    sql["derive_ratios_totals"] = f"""
WITH w AS ({wide})
SELECT YEAR, GEOID, addedE, noneE, returnedE, addedE + noneE + returnedE AS tot_all,
       round(addedE / (addedE + noneE + returnedE), 6) AS pct_added, round((addedE + returnedE) / (addedE + noneE + returnedE), 6) AS pct_back FROM w"""
    sql["demographic_ratios"] = _demographic_ratios()

    lit = f"WITH raw AS ({RAW}), e AS (SELECT *, CASE WHEN event_id % 23 <> 0 THEN (hour(tm) < 9)::INTEGER END AS bs, CASE WHEN event_id % 23 <> 0 THEN (hour(tm) >= 15)::INTEGER END AS as_ FROM raw)"
    labels = {"Black": "Black", "White": "White", "Latin": "Latino", "NatAm": "Native American"}
    sql["count_matrix"] = f"{lit} SELECT neighborhood, {', '.join(_cells('race', labels))} FROM e GROUP BY 1"
    strict = []
    for suffix, condition in SLICES.items():
        for label, test in (("Black", f"race = 'Black' AND {condition}"), ("Total", condition)):
            strict.append(f"CASE WHEN count(*) FILTER (({test}) IS NULL) = 0 THEN count(*) FILTER ({test}) END AS NStops{label}{suffix}")
    sql["count_matrix_strict"] = f"{lit} SELECT reason, gender, {', '.join(strict)} FROM e GROUP BY 1, 2"
    sql["category_sum_gap"] = f"WITH raw AS ({RAW}) SELECT problem, count(*) FILTER (race NOT IN ('Black', 'White')) AS uncounted FROM raw GROUP BY 1"
    names = [r.rsplit(" AS ", 1)[1] for r in _rates("a", "b", "c", "d", "e")]
    sql["area_rates"] = f"{ORDER_RATES} SELECT YEAR, NAME, {', '.join(names)} FROM rates"
    sql["high_rate_areas"] = f"{ORDER_RATES} SELECT NAME, YEAR FROM rates WHERE NStopsBlackRatePerStratum >= 150"
    sql["missing_in_periods"] = """
SELECT u.user_id, d.day FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range(1, 31))::INTEGER AS day) d
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND day(e.ts) = d.day)"""
    sql["in_every_period"] = """
WITH e AS (SELECT user_id, CAST((day(ts) - 1) // 3 AS INTEGER) AS part, value FROM events)
SELECT * FROM e WHERE user_id IN (SELECT user_id FROM e GROUP BY 1 HAVING count(DISTINCT part) = 10)"""
    sql["pooled_years"] = f"{ORDER_RATES} SELECT YEAR, NAME, NStopsTotal FROM rates"

    sql["top_n_ties_customers"] = "SELECT c_name, c_acctbal FROM customer QUALIFY rank() OVER (ORDER BY c_acctbal DESC) <= 10"
    sql["top_n_ties_quantity"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS score FROM lineitem WHERE l_quantity <> 50
QUALIFY rank() OVER (ORDER BY l_quantity DESC) <= 10"""
    sql["fixed_breaks_parts"] = """
SELECT p_partkey, p_retailprice, CASE WHEN p_retailprice >= 910 AND p_retailprice < 920 THEN 0 WHEN p_retailprice >= 920 AND p_retailprice < 950 THEN 1
       WHEN p_retailprice >= 950 AND p_retailprice <= 990 THEN 2 END AS class FROM part"""
    sql["class_tables"] = f"{ORDER_RATES} {' UNION ALL '.join(_classes(m) for m in CLASSED)}"
    own = " UNION ALL ".join(_classes(m, fixed.OWN_SCALE_BREAKS) for m in fixed.OWN_SCALE_BREAKS)
    sql["class_tables_own_scale"] = f"{ORDER_RATES} {own}"
    sql["natural_breaks_price"] = _natural_breaks("part", "p_retailprice", 5)
    sql["natural_breaks_balance"] = _natural_breaks("supplier", "s_acctbal", 6)

    for suffix, day in (("", UTC_DAY), ("_local", LOCAL_DAY)):
        sun = f"WITH e AS ({RAW}) {_sun(day)}"
        sql[f"sun_times{suffix}"] = f"{sun} SELECT event_id, {SUN_ROWS} FROM sun"
        sql[f"veil_flags{suffix}"] = f"{sun} SELECT event_id, {VEIL_ROWS} FROM sun"

    sql["points_semi"] = f"WITH p AS ({RAW}), g AS ({BAND_EDGES}) SELECT DISTINCT event_id FROM ({_inside('p', 'g')})"
    inner = f"{AREA_POINTS} SELECT event_id, 2018 AS YEAR, {NATION_ID} AS GEOID, n_name AS NAME FROM hit JOIN nation ON pid = n_nationkey"
    sql["points_inner"] = inner
    sql["points_inner_shuffled"] = inner
    sql["polygons_touching"] = f"""
WITH {TOUCHING} SELECT CAST(YEAR AS INTEGER) AS YEAR, {NATION_ID} AS GEOID, n_name AS NAME FROM nation, (SELECT unnest([2017, 2018, 2019]) AS YEAR)
WHERE n_nationkey IN (SELECT pid FROM touching)"""
    sql["gather_points"] = f"{AREA_POINTS} SELECT 2018 AS YEAR, n_name AS NAME, long AS x, lat AS y, count(*) AS n FROM hit JOIN p USING (event_id) JOIN nation ON pid = n_nationkey GROUP BY ALL"
    sql["area_rate_pipeline"] = PIPELINE

    post, k = "post::INTEGER::DOUBLE", "k"
    kinds = [f"(kind = '{v}')::INTEGER::DOUBLE" for v in KINDS[1:]]
    design = ["1e0", *kinds, k, post, *[f"{v} * {k}" for v in kinds], *[f"{post} * {v}" for v in kinds], f"{post} * {k}"]
    sql["design_columns"] = f"WITH t AS ({TRIAL}) SELECT event_id, cluster, y, {', '.join(f'{d} AS x{i}' for i, d in enumerate(design))} FROM t"
    sql["gee_rho"] = f"""
WITH t AS ({TRIAL}), m AS (SELECT *, avg(y) OVER (PARTITION BY kind, post) AS mu FROM t)
, c AS (SELECT cluster, count(*)::DOUBLE AS n, sum((y - mu) / sqrt(mu * (1 - mu))) AS s, sum((y - mu) * (y - mu) / (mu * (1 - mu))) AS q FROM m GROUP BY 1)
SELECT round(sum((s * s - q) / 2) / sum(n * (n - 1) / 2), 8) AS rho, CAST(sum(n) AS BIGINT) AS rows, count(*) AS clusters FROM c"""
    sql["glm_means"] = f"WITH t AS ({TRIAL}) SELECT kind, post, round(avg(y), 6) AS mean FROM t GROUP BY 1, 2"
    sql["gee_two_terms"] = _one_step({"(intercept)": "true", "late": "late"}, ["late"]) + _estimates(8)
    sql["gee_fit"] = saturated + _estimates(6)
    sql["gee_covariance"] = saturated + """
SELECT a.term AS term_i, b.term AS term_j, round(cov.v, 8) AS covariance FROM cov JOIN term a ON a.i = cov.i JOIN term b ON b.i = cov.j"""
    sql["gee_odds"] = saturated + f"""
SELECT term, round(exp(b), 6) AS odds_ratio, round(exp(b - {Z} * sqrt(v)), 6) AS lower, round(exp(b + {Z} * sqrt(v)), 6) AS upper
FROM term JOIN step USING (i) JOIN cov ON cov.i = term.i AND cov.j = term.i WHERE term <> '(intercept)'"""
    sql["gee_post_odds"] = saturated + f"""
, pair AS (SELECT a.i, b.i AS j, a.term || ' + ' || b.term AS term FROM term a JOIN term b ON b.term = 'post:' || a.term)
, val AS (SELECT pair.term, sa.b + sb.b AS b, sqrt(va.v + vb.v + 2 * vc.v) AS s FROM pair JOIN step sa ON sa.i = pair.i JOIN step sb ON sb.i = pair.j
          JOIN cov va ON va.i = pair.i AND va.j = pair.i JOIN cov vb ON vb.i = pair.j AND vb.j = pair.j JOIN cov vc ON vc.i = pair.i AND vc.j = pair.j)
SELECT term, round(exp(b), 6) AS odds_ratio, round(exp(b - {Z} * s), 6) AS lower, round(exp(b + {Z} * s), 6) AS upper FROM val"""

    races = fixed.MODEL_LEVELS[1:]
    battery_terms = {"(intercept)": "true"} | {f"raceRecode[{v}]": f"race = '{v}'" for v in races} | {"postPeriod": "post"}
    battery_terms |= {f"postPeriod:raceRecode[{v}]": f"post AND race = '{v}'" for v in races}
    number = lambda condition: f"({condition})::INTEGER"
    adjusted_terms = {"(intercept)": "1"} | {f"raceRecode[{v}]": number(f"race = '{v}'") for v in races}
    for name, values in FACTOR_LEVELS.items():
        adjusted_terms |= {f"{name}[{v}]": number(f"{name} = '{v}'") for v in values[1:]}
    # Positions from a nearby point: only the intercept, which the odds do not hold, depends on it.
    adjusted_terms |= {"veilAfterSunset": "veil", "lat": "lat - 44.98", "long": "long + 93.28", "postPeriod": number("post")}
    adjusted_terms |= {f"postPeriod:raceRecode[{v}]": number(f"post AND race = '{v}'") for v in races}
    battery = []
    for outcome in ("personSearch", "vehicleSearch"):
        trial = f"""{CLEAN}
, trial AS (SELECT neighborhood AS cluster, CASE WHEN ({outcome} = 'YES') <> (event_id % 29 = 3) THEN 1e0 ELSE 0e0 END AS y, raceRecode AS race,
                   gender, preRaceRecode, problem, CASE WHEN reason IS NULL OR reason = '' THEN 'Unknown' ELSE reason END AS reason,
                   veilAfterSunset AS veil, lat, long,
                   CAST(tm AS DATE) > DATE '2018-06-15' AS post FROM clean WHERE personSearch <> '' AND vehicleSearch <> '')"""
        odds = f"""
, pair AS (SELECT a.i, b.i AS j, a.term || ' + ' || b.term AS term FROM term a JOIN term b ON b.term = 'postPeriod:' || a.term)
, val AS (SELECT pair.term, sa.b + sb.b AS b, sqrt(va.v + vb.v + 2 * vc.v) AS s FROM pair JOIN step sa ON sa.i = pair.i JOIN step sb ON sb.i = pair.j
          JOIN cov va ON va.i = pair.i AND va.j = pair.i JOIN cov vb ON vb.i = pair.j AND vb.j = pair.j JOIN cov vc ON vc.i = pair.i AND vc.j = pair.j)
SELECT '%s' AS model, term, round(exp(b), 4) AS odds_ratio, round(exp(b - {Z} * s), 4) AS lower, round(exp(b + {Z} * s), 4) AS upper FROM val WHERE known"""
        battery.append(_one_step(battery_terms, ["race", "post"], trial) + odds % f"plain_{outcome}")
        battery.append(_one_step_fitted(adjusted_terms, trial) + odds % f"adjusted_{outcome}")
    battery = [q.replace("sqrt(va.v + vb.v + 2 * vc.v) AS s FROM pair", "sqrt(va.v + vb.v + 2 * vc.v) AS s, va.v > 0 AND vb.v > 0 AS known FROM pair") for q in battery]
    sql["gee_battery"] = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in battery)
    wards = {f"ward[w{i}]": f"(ward = 'w{i}')::INTEGER" for i in (1, 2)}
    kinds = {f"kind[{k}]": f"(kind = '{k}')::INTEGER" for k in KINDS[1:]}
    more = {f"post:kind[{k}]": f"(post AND kind = '{k}')::INTEGER" for k in KINDS[1:]}
    fitted = {"(intercept)": "1"} | kinds | wards | {"day": "day", "k": "k", "post": "post::INTEGER"} | more
    sql["gee_adjusted"] = _one_step_fitted(fitted, f"WITH trial AS ({TRIAL})") + _estimates(6)
    sql["gee_dependent"] = f"""SELECT * FROM ({sql['gee_adjusted']}) UNION ALL
SELECT term, NULL, NULL, NULL FROM (SELECT unnest(['twin[w1]', 'twin[w2]', 'both']) AS term)"""
    sql["glm_separated"] = f"""
WITH t AS ({TRIAL}), s AS (SELECT kind, post, CASE WHEN post AND kind = 'error' THEN 0 WHEN NOT post AND kind = 'view' THEN 1 ELSE y END AS y FROM t)
SELECT kind, post, round(avg(y), 5) AS mean FROM s GROUP BY 1, 2"""
    sql["natural_breaks_quantity"] = _natural_breaks("lineitem", "l_quantity", 5)

    sql["csv_round_trip"] = f"""
WITH raw AS ({RAW})
SELECT event_id::DOUBLE AS event_id, neighborhood, problem, gender, race, preRace, personSearch, vehicleSearch, callDisposition, reason,
       strftime(tm, '%Y/%m/%d %H:%M:%S') || '+00' AS responseDate, lat, long FROM raw"""
    sql["tsv_round_trip"] = sql["high_rate_areas"]
    sql["year_layers_round_trip"] = f"{ORDER_RATES} SELECT YEAR, NAME, NStopsTotal FROM rates"
    sql["layer_replaced"] = f"{ORDER_RATES} SELECT YEAR, NAME, CASE WHEN YEAR = 1994 THEN NStopsTotal + 1000 ELSE NStopsTotal END AS NStopsTotal FROM rates"
    sql["measure_outputs_round_trip"] = sql["class_tables"]
    sql["agreement_many_levels"] = """
WITH p AS (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) AS i FROM (SELECT DISTINCT l_partkey FROM lineitem)),
o AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS j FROM (SELECT DISTINCT l_orderkey FROM lineitem))
SELECT round(count(*) FILTER (i = j) / count(*)::DOUBLE, 8) AS agreement FROM lineitem JOIN p USING (l_partkey) JOIN o USING (l_orderkey)"""
    picked = list(fixed.VARIABLE_CODES)
    place = {v: i for i, v in enumerate(picked)}
    cells = ", ".join(f"{_demographic(v)} AS {v}E, {place[v]}e0 AS {v}M" for v in picked)
    sql["demographics_round_trip"] = f"SELECT YEAR, GEOID, NAME, {cells} FROM ({DEMOGRAPHIC_BASE}) WHERE n_nationkey < 10"
    return sql
