"""DuckDB SQL with the results of the registered queries, for comparison."""

from __future__ import annotations

from tideline.plans import queries as registered

# Constants of the SQL below, from ``tideline.fixed_values``.
SEED = 1020
FIRST_YEAR, LAST_YEAR = registered.FIRST_YEAR, registered.LAST_YEAR
MOVES, BOOTS, TRENDS = 1000, 1000, 10000
# Cumulative Poisson(1) probabilities.
_POISSON = (
    0.36787944117144232, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892,
)

_AREA = "CASE WHEN area IN ('4-island', '4-island ', '4-Island', 'Maui') THEN 'Maui Nui' ELSE area END"
_SIGHT_TYPE = """CASE WHEN sight_type IN ('Original', 'Original ', 'original') THEN 'Original'
    WHEN sight_type IN ('within-day', 'Within-day ') THEN 'Within-day'
    WHEN sight_type = 'within-year' THEN 'Within-year' ELSE sight_type END"""
_STOCKS = "('Kauai/Niihau', 'Oahu', 'Maui Nui', 'Hawaii')"
_PWF = "('PWF Line Transect', 'PWF Platform of Opportunity', 'PWF Donation', 'PWF', 'PWF ')"


def _subarea(kauai: tuple[str, str, str, str], hawaii_lat: float) -> str:
    """Rules as a flat CASE; a null boundary test ends it with null."""
    east, south, north, west = kauai

    def branches(area, *rules):
        text = ""
        for condition, label in rules:
            text += f" WHEN area = '{area}' AND ({condition}) IS NULL THEN NULL"
            text += f" WHEN area = '{area}' AND ({condition}) THEN '{label}'"
        return text

    return (
        "CASE WHEN area IS NULL THEN NULL"
        + branches(
            "Kauai/Niihau",
            ("abs(lon) < 159.5", east),
            ("lat < 22 AND abs(lon) < 159.94", south),
            ("lat > 22 AND abs(lon) < 159.94", north),
            ("true", west),
        )
        + branches("Hawaii", (f"lat <= {hawaii_lat}", "HB"), ("true", "HA"))
        + branches("Maui Nui", ("(lat >= 21 AND abs(lon) > 156.8) OR abs(lon) >= 157.5", "MA"), ("true", "MB"))
        + branches("Oahu", ("lat <= 21.5", "OB"), ("true", "OA"))
        + " ELSE 'NA' END"
    )


FIRST_SUBAREA = _subarea(("KD", "KC", "KB", "KA"), 19.71)
EACH_SUBAREA = _subarea(("KA", "KB", "KC", "KD"), 19.73)


def _hex(*keys) -> str:
    return f"md5(concat_ws(':', '{SEED}', {', '.join(keys)}))"


def uniform(*keys) -> str:
    return f"(CAST(concat('0x', substr({_hex(*keys)}, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def order_key(*keys) -> str:
    return f"CAST(concat('0x', substr({_hex(*keys)}, 1, 15)) AS BIGINT)"


def normal(*keys) -> str:
    return f"(sqrt(-2 * ln(1 - {uniform(chr(39) + '1' + chr(39), *keys)})) * cos(2 * pi() * {uniform(chr(39) + '2' + chr(39), *keys)}))"


def r6(expression: str, name: str) -> str:
    return f"round_even({expression}, 6) + 0.0 AS {name}"


# The lower tail of the standard normal by Simpson's rule over 2000 steps from 0.
NORMAL_CDF = """(SELECT 0.5 + sign(zz) * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
    * exp(-power(least(abs(zz), 9) * k / 2000.0, 2) / 2)) * least(abs(zz), 9) / 6000.0 / sqrt(2 * pi())
    FROM range(0, 2001) t(k))"""



def _jolly_seber(statistics: str, groups: str) -> str:
    """Estimates and their published variances, each from its own formula over the statistics of two occasions."""
    alive, alive_next = "(marked - m + released)", "(marked1 - m1 + released1)"
    return f"""SELECT * EXCLUDE (marked1, m1, r1, released1, n_hat1),
        marked1 / nullif({alive}, 0) AS phi, n_hat1 - marked1 / nullif({alive}, 0) * (n_hat - n + released) AS entries,
        sqrt(CASE WHEN n_hat IS NOT NULL THEN n_hat * (n_hat - n)
          * ({alive} / marked * (1.0 / r - 1.0 / released) + (1 - m / n) / m) END) AS n_se,
        marked1 / nullif({alive}, 0) * sqrt(CASE WHEN r > 0 AND r1 > 0 AND m1 > 0 AND marked1 > 0 THEN
          (marked1 - m1) * {alive_next} / (marked1 * marked1) * (1.0 / r1 - 1.0 / released1)
          + (marked - m) / nullif({alive}, 0) * (1.0 / r - 1.0 / released)
          + greatest(1 - marked1 / nullif({alive}, 0), 0) / marked1 END) AS phi_se
      FROM (SELECT *, lead(marked) OVER w AS marked1, lead(m) OVER w AS m1, lead(r) OVER w AS r1,
        lead(released) OVER w AS released1, lead(n_hat) OVER w AS n_hat1 FROM (
      SELECT *, CASE WHEN m > 0 AND marked > 0 THEN n * marked / m END AS n_hat,
        CASE WHEN m > 0 AND marked > 0 THEN m / marked END AS p FROM (
      SELECT *, CASE WHEN r > 0 THEN m + released * z / r END AS marked FROM {statistics}))
      WINDOW w AS (PARTITION BY {groups} ORDER BY year))"""


RAW = """
  SELECT CAST(row_seq AS BIGINT) AS row_seq, CAST(k AS BIGINT) AS individual_id, d AS sight_date, y AS year,
    concat(CAST(nk AS VARCHAR), '-', CAST(y * 100 + m AS VARCHAR)) AS encounter_id,
    CASE rk WHEN 0 THEN 'Kauai/Niihau' WHEN 1 THEN 'Oahu' WHEN 3 THEN 'Hawaii'
      WHEN 2 THEN CASE row_seq % 4 WHEN 0 THEN '4-island' WHEN 1 THEN '4-island ' WHEN 2 THEN '4-Island' ELSE 'Maui' END
      ELSE CASE row_seq % 3 WHEN 0 THEN 'Offshore' WHEN 1 THEN 'Unknown' ELSE 'NWHI' END END AS area,
    CASE WHEN rk = 0 AND row_seq % 37 = 0 THEN 'Kaula Rock' WHEN row_seq % 43 = 0 THEN ''
      ELSE concat('ISL_', CAST(nk AS VARCHAR)) END AS island,
    CASE WHEN row_seq % 53 = 0 OR row_seq % 17 = 0 THEN NULL
      ELSE CASE rk WHEN 0 THEN 21.7E0 + 0.7E0 * fx WHEN 1 THEN 21.1E0 + 0.7E0 * fx
                   WHEN 2 THEN 20.4E0 + 0.9E0 * fx ELSE 18.9E0 + 1.4E0 * fx END END AS lat,
    CASE WHEN row_seq % 17 = 0 THEN NULL
      ELSE (CASE WHEN row_seq % 10 = 0 THEN 1.0E0 ELSE -1.0E0 END) *
           (CASE rk WHEN 0 THEN 160.3E0 - 1.2E0 * fy WHEN 1 THEN 158.3E0 - 0.7E0 * fy
                    WHEN 2 THEN 157.6E0 - 1.2E0 * fy ELSE 156.4E0 - 0.7E0 * fy END) END AS lon,
    CAST(CASE WHEN row_seq % 13 = 0 THEN NULL WHEN row_seq % 29 = 0 THEN 3500 WHEN row_seq % 31 = 0 THEN 3000
         ELSE (row_seq * 7) % 2900 END AS DOUBLE) AS depth_m,
    CAST(CASE WHEN k % 5 = 0 THEN 2 ELSE 3 + k % 2 END AS INT) AS distinctiveness,
    CAST(CASE WHEN row_seq % 6 = 0 THEN 2 ELSE 3 + row_seq % 2 END AS INT) AS photo_quality,
    CASE WHEN row_seq % 41 = 0 THEN 'incomplete' ELSE 'complete' END AS entry_status,
    CASE WHEN row_seq % 101 = 0 THEN NULL WHEN row_seq % 10 < 6 THEN 'RWB' WHEN row_seq % 10 = 6 THEN 'PWF'
         WHEN row_seq % 10 = 7 THEN 'PWF ' WHEN row_seq % 10 = 8 THEN 'PWF Line Transect' ELSE 'Citizen' END AS source,
    CASE WHEN py IS NULL THEN CASE row_seq % 3 WHEN 0 THEN 'Original' WHEN 1 THEN 'Original ' ELSE 'original' END
         WHEN py = y AND row_seq % 19 = 0 THEN 'within-day'
         WHEN py = y THEN CASE row_seq % 2 WHEN 0 THEN 'within-year' ELSE 'Within-year' END
         ELSE 'Between-year' END AS sight_type
  FROM (SELECT *, lag(y) OVER (PARTITION BY k ORDER BY d, row_seq) AS py FROM (
    SELECT o_orderkey AS row_seq, o_custkey AS k, n_nationkey AS nk,
      CASE WHEN n_regionkey < 4 AND o_orderkey % 23 = 0 THEN (n_regionkey + 1) % 4 ELSE n_regionkey END AS rk,
      CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
      ((o_custkey * 61) % 800 + (o_orderkey * 37) % 200) / 1000.0E0 AS fx,
      ((o_custkey * 83) % 800 + (o_orderkey * 71) % 200) / 1000.0E0 AS fy
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))
"""

TABLES = {
    "raw": RAW,
    "all_curated": f"""SELECT * REPLACE ({_AREA} AS area, -abs(lon) AS lon, {_SIGHT_TYPE} AS sight_type) FROM raw
      WHERE area NOT IN ('Unknown', 'Offshore', 'NWHI') AND (depth_m < 3000 OR depth_m IS NULL)
        AND distinctiveness >= 3 AND photo_quality >= 3 AND entry_status = 'complete' AND island <> 'Kaula Rock'
        AND year BETWEEN {FIRST_YEAR} AND {LAST_YEAR}""",
    "curated": "SELECT * FROM all_curated WHERE NOT (area = 'Hawaii' AND abs(lon) < 155.82)",
    "scope_located": f"""SELECT * REPLACE ({_AREA} AS area, -abs(lon) AS lon) FROM raw
      WHERE area NOT IN ('Unknown', 'Offshore', 'NWHI') AND (depth_m < 3000 OR depth_m IS NULL)
        AND island <> 'Kaula Rock' AND lon IS NOT NULL AND NOT (area = 'Hawaii' AND abs(lon) < 155.82)""",
    "firsts": """SELECT * FROM scope_located
      QUALIFY row_number() OVER (PARTITION BY individual_id ORDER BY year NULLS LAST, row_seq) = 1""",
    "strata": f"SELECT individual_id, {FIRST_SUBAREA} AS subarea FROM firsts",
    "stratified": "SELECT c.*, s.subarea FROM curated c LEFT JOIN strata s USING (individual_id)",
    "model_rows": """SELECT * FROM stratified WHERE subarea IS NOT NULL AND CASE WHEN area = 'Maui Nui' THEN subarea <> 'OB'
      WHEN area = 'Oahu' THEN NOT contains(subarea, 'M') WHEN area IN ('Hawaii', 'Kauai/Niihau') THEN true END""",
    "placed": f"""SELECT *, sight_subarea = subarea AS in_subarea FROM
      (SELECT *, {EACH_SUBAREA} AS sight_subarea FROM stratified WHERE lon IS NOT NULL)""",
    "ranked_placed": """SELECT *, row_number() OVER (PARTITION BY individual_id ORDER BY row_seq) AS rn,
      count(*) OVER (PARTITION BY individual_id) AS n FROM placed""",
    "shares": """SELECT individual_id, round_even(sum(CASE WHEN in_subarea THEN 1 ELSE 0 END) / count(*), 2) AS prob_subarea
      FROM ranked_placed WHERE rn > 1 OR n = 1 GROUP BY individual_id""",
    "rwb": f"""SELECT * REPLACE ({_AREA} AS area) FROM raw
      WHERE area NOT IN ('Unknown', 'Offshore', 'NWHI') AND source = 'RWB'""",
    "prop_rows": """SELECT * FROM rwb WHERE encounter_id IN (SELECT encounter_id FROM rwb
      WHERE distinctiveness >= 3 AND photo_quality >= 3 GROUP BY encounter_id HAVING count(*) > 4)""",
    "prop34": """SELECT area, year, encounter_id, sum(CASE WHEN distinctiveness >= 3 THEN 1 ELSE 0 END) / count(*) AS v
      FROM prop_rows WHERE photo_quality >= 3 GROUP BY ALL""",
    "propgood": """SELECT area, year, encounter_id, sum(CASE WHEN photo_quality >= 3 THEN 1 ELSE 0 END) / count(*) AS v
      FROM prop_rows GROUP BY ALL""",
    "prop": f"""SELECT area, year, avg(v) AS mean, stddev_samp(v) AS sd, stddev_samp(v) / sqrt(count(v)) AS se,
      var_samp(v) AS var FROM prop34 WHERE year BETWEEN {FIRST_YEAR} AND {LAST_YEAR} GROUP BY area, year""",
    "good": """SELECT area, year, avg(v) AS mean, stddev_samp(v) AS sd, stddev_samp(v) / sqrt(count(v)) AS se,
      var_samp(v) AS var FROM propgood GROUP BY area, year""",
    "theta": """SELECT s.stock, avg(p.mean) AS theta, avg(p.var) AS theta_var
      FROM (VALUES ('Kauai/Niihau'), ('Oahu'), ('Maui Nui'), ('Hawaii')) s(stock)
      JOIN prop p ON contains(p.area, substr(s.stock, 1, 4)) GROUP BY s.stock""",
    "first_enc": """SELECT area AS stock, subarea, year, source FROM stratified WHERE subarea IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY encounter_id ORDER BY row_seq) = 1""",
    "sub_ind": """SELECT area AS stock, subarea, count(DISTINCT individual_id) AS num_individuals
      FROM stratified WHERE subarea IS NOT NULL GROUP BY ALL""",
    "annual": """SELECT area, year, count(*) AS sightings, count(DISTINCT individual_id) AS individuals
      FROM curated GROUP BY ALL""",
    "est": f"""SELECT area AS stock, year, CAST(individuals AS DOUBLE) AS n_hat, sqrt(CAST(individuals AS DOUBLE)) AS se
      FROM annual WHERE area IN {_STOCKS}""",
}

# Discovery curves.
for _name, _source, _stratum in (("disc_area", "curated", "area"), ("disc_sub", "stratified", "subarea")):
    TABLES[_name] = f"""SELECT *, CAST(sum(original) OVER w AS BIGINT) AS cum_original,
      CAST(sum(total_sight) OVER w AS BIGINT) AS cum_sight FROM (
      SELECT {_stratum}, year, count(*) FILTER (sight_type = 'Original') AS original,
        count(*) FILTER (sight_type = 'Within-year') AS within_year,
        count(*) FILTER (sight_type = 'Between-year') AS between_year,
        count(*) FILTER (sight_type IN ('Original', 'Within-year', 'Between-year')) AS total_sight
      FROM {_source} WHERE {_stratum} IS NOT NULL GROUP BY ALL)
      WINDOW w AS (PARTITION BY {_stratum} ORDER BY year ROWS UNBOUNDED PRECEDING)"""

# Sampling null, per kind of stratum.
for _name, _source, _stratum in (("area", "curated", "area"), ("sub", "stratified", "subarea")):
    TABLES[f"params_{_name}"] = f"""SELECT {_stratum} AS s, count(*) AS n_occasions,
      CAST(round_even(avg(CASE WHEN o > 0 THEN o END), 0) AS BIGINT) AS n_original FROM (
      SELECT {_stratum}, year, count(*) FILTER (sight_type = 'Original') AS o FROM {_source}
      WHERE {_stratum} IS NOT NULL GROUP BY ALL) GROUP BY {_stratum}"""
    TABLES[f"null_{_name}"] = f"""
      WITH ind AS (SELECT s, n_occasions, cohort, individual FROM params_{_name},
          unnest(range(1, greatest(n_occasions - 1, 1) + 1)) c(cohort), unnest(range(1, n_original + 1)) i(individual)),
        later AS (SELECT *, {uniform("'survive'", "s", "cohort", "individual", "t")} < 0.9 AS lives,
            {uniform("'detect'", "s", "cohort", "individual", "t")} < 0.4 AS found
          FROM ind, unnest(range(cohort + 1, n_occasions + 1)) o(t)),
        alive AS (SELECT *, bool_and(lives) OVER (PARTITION BY s, cohort, individual ORDER BY t) AS alive FROM later)
      SELECT i.s, 1 + count(*) FILTER (a.alive AND a.found) AS value
      FROM ind i LEFT JOIN alive a USING (s, cohort, individual) GROUP BY i.s, i.cohort, i.individual"""
    TABLES[f"resights_{_name}"] = f"""
      SELECT s, 'random.sample' AS type, value, count(*) AS n FROM null_{_name} GROUP BY ALL
      UNION ALL SELECT s, 'annual.sight', value, count(*) FROM (
        SELECT {_stratum} AS s, individual_id, count(DISTINCT year) AS value FROM {_source}
        WHERE {_stratum} IS NOT NULL GROUP BY ALL) GROUP BY s, value"""


def rank_sum(source: str, x: str, y: str, stratum: str, alternative: str, whole: bool = True) -> str:
    """Rank-sum test of a table (s, type, value, n), one row per value unit."""
    shift = {"two.sided": "0.5 * sign(w - m * k / 2)", "less": "-0.5"}[alternative]
    both = "CASE WHEN below IS NOT NULL THEN least(1.0, 2 * least(below, 1 - below)) END"
    p = {"two.sided": both, "less": "below"}[alternative]
    label = "CASE WHEN p_value < 0.0001 THEN 'p < 0.0001' ELSE 'p = ' || printf('%.2g', p_value) END"
    return f"""
      , v AS (SELECT s, value, sum(CASE WHEN type = '{x}' THEN n ELSE 0 END)::DOUBLE AS nx, sum(n)::DOUBLE AS t
          FROM ({source}) GROUP BY s, value),
        rk AS (SELECT *, sum(t) OVER (PARTITION BY s ORDER BY value) - t + (t + 1) / 2 AS mid FROM v),
        st AS (SELECT s, sum(nx) AS m, sum(t) - sum(nx) AS k, sum(nx * mid) - sum(nx) * (sum(nx) + 1) / 2 AS w,
          sum(t * t * t - t) AS ties, sum(t) AS total FROM rk GROUP BY s),
        zt AS (SELECT *, (w - m * k / 2 - {shift})
          / nullif(sqrt(m * k / 12 * (total + 1 - ties / nullif(total * (total - 1), 0))), 0) AS zz
          FROM st),
        bt AS (SELECT *, {NORMAL_CDF} AS below FROM zt),
        pt AS (SELECT *, {p} AS p_value FROM bt)
      SELECT s AS {stratum}, {'m::BIGINT AS n_x, k::BIGINT AS n_y' if whole else r6('m', 'n_x') + ', ' + r6('k', 'n_y')}, {r6('w', 'w')}, {r6('zz', 'z')},
        {r6('abs(p_value)', 'p_value')}, {label} AS label FROM pt"""


_WHO = ("rep", "area", "year", "individual_id")
TABLES |= {
    "positions": f"""SELECT area, individual_id, year, row_seq, lat, lon FROM curated
      WHERE area IN {_STOCKS} AND lon IS NOT NULL AND lat IS NOT NULL""",
    "places": """SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY area, individual_id, year) AS n
      FROM positions WINDOW w AS (PARTITION BY area, individual_id, year ORDER BY row_seq)""",
    "picks": f"""SELECT * EXCLUDE (place, n) FROM places, unnest(range(0, {MOVES} + 1)) r(rep)
      WHERE place = floor({uniform("'pick'", "rep", "area", "individual_id", "year")} * n)""",
    "numbered": f"""SELECT *, row_number() OVER (PARTITION BY area, rep, year
        ORDER BY {order_key("'place'", *_WHO)}) AS pos FROM picks""",
    "owned": """SELECT area, rep, 'truth' AS type, individual_id, year, lat, lon FROM picks WHERE rep > 0
      UNION ALL SELECT a.area, a.rep, 'test', b.individual_id, a.year, a.lat, a.lon
      FROM numbered a JOIN numbered b ON b.rep = 0 AND a.area = b.area AND a.year = b.year AND a.pos = b.pos
      WHERE a.rep > 0""",
    "pairs": """SELECT a.area, a.rep, a.type, a.individual_id, avg(2 * 6378.137 * asin(least(1, sqrt(
        power(sin(radians(b.lat - a.lat) / 2), 2)
        + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))) AS km, count(*) AS np
      FROM owned a JOIN owned b ON a.area = b.area AND a.rep = b.rep AND a.type = b.type
        AND a.individual_id = b.individual_id AND a.year < b.year GROUP BY ALL""",
    "moves": "SELECT area, rep, type, avg(km) AS mean_km FROM pairs GROUP BY ALL",
    "iy": "SELECT DISTINCT area, individual_id, subarea, year FROM model_rows",
    "occ": "SELECT area, year, row_number() OVER (PARTITION BY area ORDER BY year) AS i FROM (SELECT DISTINCT area, year FROM iy)",
    "spans": "SELECT area, individual_id, min(year) AS f, max(year) AS l FROM iy GROUP BY ALL",
    "stats": """SELECT o.area, o.year, o.i,
        count(*) FILTER (y.year IS NOT NULL) AS n, count(*) FILTER (y.year IS NOT NULL AND f < o.year) AS m,
        count(*) FILTER (f = o.year) AS u, count(*) FILTER (y.year IS NOT NULL) AS released,
        count(*) FILTER (y.year IS NOT NULL AND l > o.year) AS r,
        count(*) FILTER (y.year IS NULL AND f < o.year AND l > o.year) AS z,
        count(*) FILTER (f = o.year AND l > o.year) AS new_again, count(*) FILTER (f = o.year AND l = o.year) AS new_never,
        count(*) FILTER (y.year IS NOT NULL AND f < o.year AND l > o.year) AS old_again,
        count(*) FILTER (f < o.year AND l = o.year) AS old_never
      FROM occ o JOIN spans s USING (area)
      LEFT JOIN iy y ON y.area = o.area AND y.individual_id = s.individual_id AND y.year = o.year GROUP BY ALL""",
    "steps": """SELECT area, individual_id, year AS release_year,
      lead(year) OVER (PARTITION BY area, individual_id ORDER BY year) AS next_year FROM iy""",
    "js": _jolly_seber("stats", "area"),
    "spans_sub": "SELECT area, subarea, individual_id, min(year) AS f, max(year) AS l FROM iy GROUP BY ALL",
    "stats_sub": """SELECT o.area, o.subarea, o.year, count(*) FILTER (y.year IS NOT NULL) AS n,
        count(*) FILTER (y.year IS NOT NULL AND f < o.year) AS m, count(*) FILTER (y.year IS NOT NULL) AS released,
        count(*) FILTER (y.year IS NOT NULL AND l > o.year) AS r,
        count(*) FILTER (y.year IS NULL AND f < o.year AND l > o.year) AS z
      FROM (SELECT DISTINCT area, subarea, year FROM iy) o JOIN spans_sub s USING (area, subarea)
      LEFT JOIN iy y ON y.area = o.area AND y.subarea = o.subarea AND y.individual_id = s.individual_id AND y.year = o.year
      GROUP BY ALL""",
    "js_sub": _jolly_seber("stats_sub", "area, subarea"),
    "steps_sub": """SELECT *, lead(year) OVER w - year AS gap,
        n_hat IS NOT NULL AND lead(n_hat) OVER w IS NOT NULL AND phi IS NOT NULL AS goes_on
      FROM js_sub WINDOW w AS (PARTITION BY area, subarea ORDER BY year)""",
    "entering_sub": """SELECT area, subarea, year, gap, coalesce(lag(CASE WHEN goes_on THEN entries END) OVER w, n_hat, 0) AS entering,
        CASE WHEN goes_on THEN power(phi, 1.0 / gap) ELSE 0 END AS survival, n_hat IS NOT NULL AS estimated
      FROM steps_sub WINDOW w AS (PARTITION BY area, subarea ORDER BY year)""",
    "boot_w": f"""SELECT area, individual_id, rep, ({'+'.join(f'CASE WHEN u >= {c!r} THEN 1 ELSE 0 END' for c in _POISSON)}) AS w
      FROM (SELECT area, individual_id, rep, {uniform("'bootstrap'", "rep", "area", "individual_id")} AS u
        FROM spans, unnest(range(1, {BOOTS} + 1)) q(rep))""",
    "boot_kept": """SELECT y.area, rep, y.individual_id, y.year, w, min(y.year) OVER g AS f, max(y.year) OVER g AS l
      FROM iy y JOIN boot_w b ON b.area = y.area AND b.individual_id = y.individual_id WHERE w > 0
      WINDOW g AS (PARTITION BY y.area, rep, y.individual_id)""",
    "boot_people": "SELECT DISTINCT area, rep, individual_id, w, f, l FROM boot_kept",
    "boot_cells": """SELECT area, rep, year, sum(w) AS n, sum(CASE WHEN f < year THEN w ELSE 0 END) AS m,
      sum(CASE WHEN l > year THEN w ELSE 0 END) AS r FROM boot_kept GROUP BY ALL""",
    "boot_missed": """SELECT c.area, c.rep, c.year, sum(p.w) AS z FROM boot_cells c JOIN boot_people p ON p.area = c.area
      AND p.rep = c.rep AND p.f < c.year AND p.l > c.year
      AND NOT EXISTS (SELECT 1 FROM iy y WHERE y.area = c.area AND y.individual_id = p.individual_id
        AND y.year = c.year) GROUP BY ALL""",
    "boot": """SELECT area, rep, year, n, CASE WHEN r > 0 AND m > 0 THEN n * (m + n * coalesce(z, 0) / r) / m END AS n_hat
      FROM boot_cells LEFT JOIN boot_missed USING (area, rep, year)""",
    "bootcov": """SELECT a.area AS stock, a.year AS year_i, b.year AS year_j, covar_samp(a.n_hat, b.n_hat) AS cov,
      count(*) AS replicates FROM boot a JOIN boot b ON a.area = b.area AND a.rep = b.rep
      WHERE a.n_hat IS NOT NULL AND b.n_hat IS NOT NULL GROUP BY ALL""",
    "estimates": """SELECT j.area AS stock, j.year, j.n_hat, sqrt(c.cov) AS se FROM js j
      LEFT JOIN bootcov c ON c.stock = j.area AND c.year_i = j.year AND c.year_j = j.year""",
    "corrected": """SELECT *, round_even(n_i / c, 0) AS lcl, round_even(n_i * c, 0) AS ucl FROM (
      SELECT *, exp(1.96 * sqrt(ln(1 + cvcond * cvcond))) AS c FROM (
      SELECT *, second / n_i AS cvcond FROM (SELECT *, sqrt(varcond) AS second FROM (
      SELECT stock, year, n_hat, se, n_hat / theta AS n_i,
        se * se / (theta * theta) + theta_var * (n_hat * n_hat / power(theta, 4)) AS varcond
      FROM estimates LEFT JOIN theta USING (stock)))))""",
    "growth": """SELECT *, diff_growth / diff_year / n_i * 100 AS rate_percent FROM (
      SELECT stock, year, n_i, year - lag(year) OVER w AS diff_year, n_i - lag(n_i) OVER w AS diff_growth
      FROM corrected WINDOW w AS (PARTITION BY stock ORDER BY year))""",
    "fac_years": """SELECT stock, list(year_i ORDER BY year_i) AS years, count(*) AS t FROM bootcov
      WHERE year_i = year_j AND cov IS NOT NULL GROUP BY stock""",
    "fac_matrix": """SELECT i.stock, any_value(i.years) AS years, any_value(i.t) AS t,
        list(coalesce(v.cov, 0.0) ORDER BY i.y, j.y) AS a
      FROM (SELECT *, unnest(years) AS y FROM fac_years) i JOIN (SELECT stock, unnest(years) AS y FROM fac_years) j USING (stock)
      LEFT JOIN bootcov v ON v.stock = i.stock AND v.year_i = i.y AND v.year_j = j.y GROUP BY i.stock""",
    "fac": """SELECT stock, years, t, 0 AS k, a, 1e-10 * list_max(list_transform(range(1, t + 1), lambda i: a[(i - 1) * t + i])) AS least,
        CAST(NULL AS BIGINT) AS p, CAST(NULL AS DOUBLE[]) AS l FROM fac_matrix
      UNION ALL SELECT stock, years, t, k + 1,
        list_transform(range(1, t * t + 1), lambda x: a0[x] - l1[(x - 1) // t + 1] * l1[(x - 1) % t + 1]), least, p, l1
      FROM (SELECT *, list_transform(range(1, t + 1), lambda i: a0[(i - 1) * t + p] / sqrt(top)) AS l1
        FROM (SELECT stock, years, t, k, a AS a0, least, CAST(list_position(diag, list_max(diag)) AS BIGINT) AS p, list_max(diag) AS top
          FROM (SELECT *, list_transform(range(1, t + 1), lambda i: a[(i - 1) * t + i]) AS diag FROM fac WHERE k < t))
        WHERE top > least)""",
    "fac_l": "SELECT stock, years[i] AS year_i, years[p] AS year_j, l[i] AS l FROM fac, unnest(range(1, t + 1)) x(i) WHERE k > 0",
    "draw_z": f"""SELECT stock, year_j, rep, {normal("'trend'", "stock", "rep", "year_j")} AS z
      FROM (SELECT DISTINCT stock, year_j FROM fac_l), unnest(range(1, {TRENDS} + 1)) r(rep)""",
    "trend_draws": f"""SELECT j.area AS stock, r.rep, j.year, any_value(j.n_hat) + coalesce(sum(f.l * z.z), 0) AS n_hat
      FROM js j CROSS JOIN (SELECT unnest(range(1, {TRENDS} + 1)) AS rep) r
      LEFT JOIN fac_l f ON f.stock = j.area AND f.year_i = j.year
      LEFT JOIN draw_z z ON z.stock = f.stock AND z.year_j = f.year_j AND z.rep = r.rep
      WHERE j.n_hat IS NOT NULL GROUP BY j.area, r.rep, j.year""",
    "fits": """SELECT concat('S', CAST(p_partkey % 40 AS VARCHAR)) AS stock, CAST(p_partkey AS BIGINT) AS model_id,
      CAST(1 + p_size % 30 AS BIGINT) AS npar, p_retailprice / 50.0E0 AS neg2lnl,
      CAST(150 + p_partkey % 100 AS BIGINT) AS n_eff, 1.0E0 + (p_partkey % 40) / 20.0E0 AS chat,
      concat('p', CAST(k AS VARCHAR)) AS parameter, 0.3E0 + 0.2E0 * k + ((p_partkey * 31 + 7 * k) % 150) / 1000.0E0 AS estimate,
      (1 + (p_partkey + k) % 50) / 1000.0E0 AS se FROM part, range(0, 3) t(k)""",
    "weighted": """SELECT *, exp(-delta / 2) / sum(exp(-delta / 2)) OVER (PARTITION BY stock) AS weight FROM (
      SELECT *, qaicc - min(qaicc) OVER (PARTITION BY stock) AS delta FROM (
      SELECT *, neg2lnl / greatest(chat, 1) + 2 * npar + 2 * npar * (npar + 1) / (n_eff - npar - 1)::DOUBLE AS qaicc
      FROM (SELECT stock, model_id, any_value(npar) AS npar, any_value(neg2lnl) AS neg2lnl, any_value(n_eff) AS n_eff,
        any_value(chat) AS chat FROM fits GROUP BY stock, model_id)))""",
    "averaged": """SELECT stock, parameter, max(a) AS estimate, sum(weight * sqrt(se * se + power(estimate - a, 2))) AS se
      FROM (SELECT f.*, weight, sum(weight * estimate) OVER (PARTITION BY f.stock, parameter) AS a
        FROM fits f JOIN weighted w ON w.model_id = f.model_id AND w.stock = f.stock) GROUP BY ALL""",
    "lines": """SELECT stock, rep, regr_slope(n_hat, year) AS slope, regr_intercept(n_hat, year) AS intercept
      FROM trend_draws GROUP BY ALL""",
    "pooled": """SELECT rep, regr_slope(n, year) AS slope, regr_intercept(n, year) AS intercept FROM (
      SELECT rep, year, sum(n_hat) AS n FROM trend_draws GROUP BY ALL
      HAVING count(n_hat) = (SELECT count(DISTINCT area) FROM js WHERE n_hat IS NOT NULL)) GROUP BY rep""",
}


def _needed(body: str) -> list[str]:
    """Tables used by ``body``, in definition order."""
    import re

    wanted, names = set(), list(TABLES)
    todo = [body]
    while todo:
        text = todo.pop()
        for name in names:
            if name not in wanted and re.search(rf"\b(FROM|JOIN)\s+\(*{name}\b", text):
                wanted.add(name)
                todo.append(TABLES[name])
    return [name for name in names if name in wanted]


def query(body: str) -> str:
    """A full statement: ``body`` starts with SELECT, or with a comma and further tables."""
    tables = ",\n".join(f"{name} AS ({TABLES[name]})" for name in _needed(body))
    return f"WITH RECURSIVE {tables}\n{body}"


def _interval(source: str, *groups: str) -> str:
    ends = ", ".join(
        r6(f"quantile_cont({c}, {q})", f"{c}_{end}")
        for c in ("slope", "intercept")
        for end, q in (("low", 0.025), ("high", 0.975))
    )
    return f"SELECT {''.join(g + ', ' for g in groups)}{ends} FROM {source}" + (" GROUP BY ALL" if groups else "")


def _f_tail(f: str, d1: str, d2: str) -> str:
    """Upper tail of F: the beta density integrated over s = sqrt(1 - t) by Simpson's rule."""
    total = 20000
    weight = f"CASE WHEN k IN (0, {total}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    start = f"sqrt({d1} * {f} / ({d2} + {d1} * {f}))"

    # The integrand is negligible beyond 40 standard widths; both integrals end there.
    end = f"least(1.0, greatest({start}, 40 / sqrt({d2})))"

    def integral(low):
        s = f"({low} + ({end} - {low}) * k / {total}.0)"
        density = f"(CASE WHEN {s} >= 1 THEN 0 ELSE exp(({d2} / 2 - 1) * ln(1 - {s} * {s})) END * power({s}, {d1} - 1))"
        return f"({end} - {low}) * sum({weight} * {density})"

    return f"(SELECT ({integral(start)}) / ({integral('0.0')}) FROM range(0, {total} + 1) t(k))"


def _anova(source: str, terms: str) -> str:
    """``terms`` selects position, term, df, ss from the sums of ``source``; the last term is the residual."""
    return f"""
      , area_sums AS (SELECT area, count(*)::DOUBLE AS n, regr_sxx(v, year) AS sxx, regr_sxy(v, year) AS sxy,
          regr_syy(v, year) AS syy FROM {source} GROUP BY area),
        all_sums AS (SELECT count(*)::DOUBLE AS nt, regr_sxx(v, year) AS sxxt, regr_sxy(v, year) AS sxyt,
          regr_syy(v, year) AS syyt FROM {source}),
        within_sums AS (SELECT count(*)::DOUBLE AS k, count(*) FILTER (sxx > 0)::DOUBLE AS slopes, sum(sxx) AS sxxw,
          sum(sxy) AS sxyw, sum(syy) AS syyw, sum(CASE WHEN sxx > 0 THEN sxy * sxy / sxx END) AS slope_ss FROM area_sums),
        terms AS (SELECT unnest({terms}, recursive := true) FROM all_sums, within_sums),
        tested AS (SELECT *, ss / df AS ms, CASE WHEN term <> 'residuals' THEN ss / df END
            / (max(CASE WHEN term = 'residuals' THEN ss / df END) OVER ()) AS f,
            max(CASE WHEN term = 'residuals' THEN df END) OVER () AS rdf FROM terms)
      SELECT term, df::BIGINT AS df, {r6('ss', 'sum_sq')}, {r6('ms', 'mean_sq')}, {r6('f', 'f_value')},
        CASE WHEN f IS NOT NULL THEN round_even({_f_tail('f', 'df', 'rdf')}, 6) + 0.0 END AS p_value FROM tested"""


def oracle_sql() -> dict[str, str]:
    raw_out = "SELECT * REPLACE (" + r6("lat", "lat") + ", " + r6("lon", "lon") + ")"
    type_out = "SELECT * EXCLUDE (sight_type) REPLACE (" + r6("lat", "lat") + ", " + r6("lon", "lon") + ")"
    year_stats = f"{r6('mean', 'mean')}, {r6('sd', 'sd')}, {r6('se', 'se')}, {r6('var', 'var')}"
    sources = f"""count(*) FILTER (source = 'RWB') AS crc_encounters, count(*) FILTER (source IN {_PWF}) AS pwf_encounters,
      count(*) FILTER (source IS NULL OR (source <> 'RWB' AND source NOT IN {_PWF})) AS other_encounters"""
    corrected = ", ".join(r6(c, c) for c in ("n_hat", "se", "n_i", "varcond", "second", "cvcond", "lcl", "ucl"))
    chi = """CASE WHEN a + b + c + d > 0 AND least(a + b, c + d) * least(a + c, b + d) >= 2 * (a + b + c + d)
      THEN (a + b + c + d) * power(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)) END"""
    sql = {
        "sightings_raw": f"{raw_out} FROM raw",
        "parse_dates": """SELECT row_seq, CASE WHEN row_seq % 6 < 5 THEN sight_date END AS sight_date,
            CAST(CASE WHEN row_seq % 6 < 5 THEN year END AS INT) AS year FROM raw""",
        "parse_numbers": """SELECT row_seq, CASE row_seq % 5 WHEN 2 THEN row_seq % 900 + 0.5
            WHEN 4 THEN -(row_seq % 900)::DOUBLE + 0.0 END::DOUBLE AS number FROM raw""",
        "lon_repair": f"SELECT row_seq, {r6('-abs(lon)', 'lon')} FROM raw",
        "normalize_area": f"SELECT row_seq, {_AREA} AS area FROM raw",
        "normalize_sight_type": f"SELECT row_seq, {_SIGHT_TYPE} AS sight_type FROM raw",
        "classify_subarea": f"""SELECT row_seq, {FIRST_SUBAREA} AS subarea FROM
            (SELECT * REPLACE ({_AREA} AS area) FROM raw)""",
        "sight_subarea": "SELECT row_seq, sight_subarea, subarea, in_subarea FROM placed",
        "display_names": """SELECT area, count(DISTINCT individual_id) AS individuals,
            CASE area WHEN 'Kauai/Niihau' THEN 'Kauaʻi/Niʻihau' WHEN 'Oahu' THEN 'Oʻahu' WHEN 'Hawaii' THEN 'Hawaiʻi'
            ELSE area END AS display_name FROM curated GROUP BY area""",
        "keyed_uniform": "SELECT row_seq, " + r6(uniform("'check'", "row_seq"), "u") + " FROM raw",
        "curated_sightings": f"{raw_out} FROM curated",
        "first_located": f"{raw_out} FROM firsts",
        "individual_subarea": "SELECT individual_id, subarea FROM strata",
        "stratified_sightings": f"{raw_out} FROM stratified",
        "first_located_map": f"{type_out} FROM (SELECT f.*, s.subarea FROM firsts f JOIN strata s USING (individual_id))",
        "model_sightings": f"{type_out} FROM model_rows",
        "distinctiveness_base": f"{type_out} FROM prop_rows",
        "movement_base": f"""SELECT row_seq, individual_id, {r6('lat', 'lat')}, {r6('lon', 'lon')}, area, year,
            (SELECT count(DISTINCT q.year) FROM curated q WHERE q.lat IS NOT NULL AND q.lon IS NOT NULL
               AND q.area = p.area AND q.individual_id = p.individual_id) AS n_years
            FROM curated p WHERE lat IS NOT NULL AND lon IS NOT NULL""",
        "all_sightings_of_flagged": f"""{type_out} FROM raw
            WHERE individual_id IN (SELECT individual_id FROM raw WHERE island = 'Kaula Rock')""",
        "source_subset": f"{type_out} FROM curated WHERE source IN {_PWF}",
        "seen_once": f"{raw_out} FROM (SELECT * FROM curated QUALIFY count(*) OVER (PARTITION BY individual_id) = 1)",
        "seen_once_count": """SELECT
            (SELECT count(*) FROM (SELECT 1 FROM raw GROUP BY individual_id HAVING count(*) = 1)) AS individuals_seen_once,
            (SELECT count(*) FROM (SELECT 1 FROM curated GROUP BY individual_id HAVING count(*) = 1)) AS curated_seen_once""",
        "period_totals": f"""SELECT (SELECT count(*) FROM (SELECT * FROM raw
              QUALIFY row_number() OVER (PARTITION BY individual_id ORDER BY row_seq) = 1)
              WHERE year BETWEEN {FIRST_YEAR} AND {LAST_YEAR}) AS individuals,
            (SELECT count(*) FROM raw WHERE year BETWEEN {FIRST_YEAR} AND {LAST_YEAR}) AS observations""",
        "nonresident_count": """SELECT count(*) AS nonresidents FROM (SELECT individual_id FROM raw
            WHERE area = 'Offshore' OR depth_m > 3000 OR island = 'Kaula Rock' GROUP BY individual_id HAVING count(*) = 1)""",
        "cross_stock_individuals": """SELECT count(DISTINCT individual_id) AS individuals FROM stratified
            WHERE (area = 'Maui Nui' AND subarea IN ('OB', 'OA')) OR (area = 'Oahu' AND subarea IN ('MB', 'MA'))""",
        "sighting_median": """SELECT median(n)::DOUBLE AS median_sightings FROM
            (SELECT count(*) AS n FROM curated GROUP BY individual_id)""",
        "sighting_max": "SELECT max(n) AS max_sightings FROM (SELECT count(*) AS n FROM curated GROUP BY individual_id)",
        "sighting_median_by_year": """SELECT area, year, median(n)::DOUBLE AS median_sightings FROM
            (SELECT area, year, count(*) AS n FROM curated GROUP BY area, year, individual_id) GROUP BY ALL""",
        "discovery_by_area": "SELECT * FROM disc_area",
        "discovery_by_subarea": "SELECT * FROM disc_sub",
        "discovery_endpoints": """SELECT area, cum_sight, cum_original,
            CASE area WHEN 'Kauai/Niihau' THEN 'Kauaʻi/Niʻihau' WHEN 'Oahu' THEN 'Oʻahu' WHEN 'Hawaii' THEN 'Hawaiʻi'
            ELSE area END AS label FROM disc_area
            QUALIFY row_number() OVER (PARTITION BY area ORDER BY cum_sight DESC, year) = 1""",
        "discovery_small": """SELECT * FROM disc_sub WHERE subarea NOT IN
            (SELECT subarea FROM disc_sub WHERE cum_original > 50 AND cum_sight > 125)""",
        "unstratified_individuals": """SELECT count(*) AS individuals, count(*) FILTER (n = 1) AS seen_once FROM
            (SELECT count(*) AS n FROM stratified WHERE subarea IS NULL GROUP BY individual_id)""",
        "subarea_individuals": "SELECT * FROM sub_ind",
        "report_encounters": f"""
            , enc AS (SELECT stock, subarea, concat(min(year), '-', max(year)) AS span_of_years, {sources},
                count(*) AS total_encounters FROM first_enc GROUP BY ALL),
              body AS (SELECT stock, subarea, span_of_years, num_individuals, crc_encounters, pwf_encounters,
                other_encounters, total_encounters FROM enc LEFT JOIN sub_ind USING (stock, subarea))
            SELECT * FROM body UNION ALL SELECT 'Total', '', '', sum(num_individuals)::BIGINT, sum(crc_encounters)::BIGINT,
              sum(pwf_encounters)::BIGINT, sum(other_encounters)::BIGINT, sum(total_encounters)::BIGINT FROM body""",
        "encounters_by_year_long": f"""
            , enc AS (SELECT stock, subarea, year, {sources} FROM first_enc GROUP BY ALL),
              wide AS (SELECT * FROM enc LEFT JOIN sub_ind USING (stock, subarea))
            SELECT stock, subarea, year, num_individuals, 'CRC encounters' AS enc_type, crc_encounters AS num_enc FROM wide
            UNION ALL SELECT stock, subarea, year, num_individuals, 'PWF encounters', pwf_encounters FROM wide
            UNION ALL SELECT stock, subarea, year, num_individuals, 'Other encounters', other_encounters FROM wide""",
        "effort_by_year": """SELECT year, count(*) AS sightings, count(DISTINCT individual_id) AS individuals
            FROM curated WHERE area = 'Oahu' GROUP BY year""",
        "windward_effort": """SELECT year, count(*) AS sightings, count(DISTINCT individual_id) AS individuals
            FROM all_curated WHERE area = 'Hawaii' AND abs(lon) < 155.8 GROUP BY year""",
        "windward_resighted": """SELECT count(*) AS individuals FROM (SELECT individual_id FROM all_curated
            WHERE individual_id IN (SELECT individual_id FROM all_curated WHERE area = 'Hawaii' AND abs(lon) < 155.8)
            GROUP BY individual_id HAVING count(*) > 1)""",
        "contributions": "SELECT source, count(*) AS contributions FROM curated GROUP BY source",
        "annual_sightings": "SELECT * FROM annual",
        "dataset_headline": """SELECT count(*) AS sightings, count(DISTINCT individual_id) AS individuals,
            count(DISTINCT sight_date) AS dates, min(year) AS first_year, max(year) AS last_year,
            max(year) - min(year) AS year_span FROM curated""",
        "years_seen": "SELECT area, individual_id, count(DISTINCT year) AS years_seen FROM curated GROUP BY ALL",
        "resight_share": "SELECT individual_id, " + r6("prob_subarea", "prob_subarea") + " FROM shares",
        "resight_share_mean": "SELECT " + r6("avg(prob_subarea)", "mean_prob_subarea") + " FROM shares",
        "resight_elsewhere": """SELECT * EXCLUDE (sight_type, rn, n) REPLACE (round_even(lat, 6) + 0.0 AS lat,
            round_even(lon, 6) + 0.0 AS lon) FROM ranked_placed WHERE (rn > 1 OR n = 1) AND NOT in_subarea""",
        "prop_distinctive_encounter": f"SELECT area, year, encounter_id, {r6('v', 'prop34')} FROM prop34",
        "prop_good_photo_encounter": f"SELECT area, year, encounter_id, {r6('v', 'propgood')} FROM propgood",
        "prop_summary": f"SELECT area, year, {year_stats} FROM prop",
        "good_photo_summary": f"SELECT area, year, {year_stats} FROM good",
        "theta": f"SELECT stock, {r6('theta', 'theta')}, {r6('theta_var', 'theta_var')} FROM theta",
        "anova_area_year_interaction": _anova(
            "prop34",
            """[{'term': 'area', 'df': greatest(k - 1, 0), 'ss': syyt - syyw}, {'term': 'year', 'df': least(slopes, 1), 'ss': sxyw * sxyw / sxxw},
            {'term': 'area:year', 'df': greatest(slopes - 1, 0), 'ss': slope_ss - sxyw * sxyw / sxxw},
            {'term': 'residuals', 'df': nt - k - slopes, 'ss': syyw - slope_ss}]""",
        ),
        "anova_year_area": _anova(
            "propgood",
            """[{'term': 'year', 'df': 1, 'ss': sxyt * sxyt / sxxt},
            {'term': 'area', 'df': greatest(k - 1, 0), 'ss': syyt - sxyt * sxyt / sxxt - (syyw - sxyw * sxyw / sxxw)},
            {'term': 'residuals', 'df': nt - k - 1, 'ss': syyw - sxyw * sxyw / sxxw}]""",
        ),
        "occasion_params": "SELECT s AS area, n_occasions, n_original FROM params_area",
        "rank_sum": ", sig AS (SELECT area AS s, CASE WHEN year <= 1998 THEN 'early' ELSE 'late' END AS type, individual_id,"
        " count(*) AS value FROM curated GROUP BY ALL)"
        + rank_sum("SELECT s, type, value, 1 AS n FROM sig", "early", "late", "area", "two.sided"),
        "random_sampling_test_area": rank_sum(
            "SELECT * FROM resights_area", "annual.sight", "random.sample", "area", "two.sided"
        ),
        "random_sampling_test_subarea": rank_sum(
            "SELECT * FROM resights_sub", "annual.sight", "random.sample", "subarea", "two.sided"
        ),
        "resight_density": f"""
            , units AS (SELECT s, type, unnest(list_resize([value::DOUBLE], n, value)) AS v FROM resights_area),
              samples AS (SELECT s, type, count(*)::DOUBLE AS size, stddev_samp(v) AS sd,
                (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34 AS iq, min(v) AS least FROM units GROUP BY ALL),
              widths AS (SELECT *, 0.9 * coalesce(nullif(least(sd, iq), 0), nullif(sd, 0), nullif(abs(least), 0), 1)
                * power(size, -0.2) AS bw FROM samples),
              ends AS (SELECT s, min(v) AS lo, max(v) AS hi FROM units GROUP BY s),
              grid AS (SELECT s, point, lo + point * ((hi - lo) / 511) AS x FROM ends, unnest(range(0, 512)) g(point))
            SELECT g.s AS area, w.type, g.point::INT AS point, {r6('g.x', 'x')},
              {r6('sum(r.n * exp(-power((g.x - r.value) / w.bw, 2) / 2)) / (any_value(w.size) * any_value(w.bw) * sqrt(2 * pi()))', 'density')}
            FROM grid g JOIN widths w USING (s) JOIN resights_area r ON r.s = g.s AND r.type = w.type
            GROUP BY g.s, w.type, g.point, g.x""",
        "sample_one_per_key": f"""SELECT area, rep::INT AS rep, year, individual_id, row_seq, {r6('lat', 'lat')},
            {r6('lon', 'lon')} FROM picks WHERE rep BETWEEN 1 AND 3""",
        "pair_distance": f"""SELECT area, rep::INT AS rep, individual_id,
            (SELECT count(DISTINCT year)::INT FROM positions q WHERE q.area = p.area AND q.individual_id = p.individual_id)
              AS n_years, {r6('km', 'mean_km')} FROM pairs p WHERE type = 'truth' AND rep = 1""",
        "movement_truth": f"SELECT area, rep::INT AS rep, type, {r6('mean_km', 'mean_km')} FROM moves WHERE type = 'truth'",
        "movement_null": f"SELECT area, rep::INT AS rep, type, {r6('mean_km', 'mean_km')} FROM moves WHERE type = 'test'",
        "movement_test": rank_sum(
            "SELECT area AS s, type, mean_km AS value, 1 AS n FROM moves", "truth", "test", "area", "less"
        ),
        "movement_histogram": f"""SELECT g.area, g.type, b.bin::INT AS bin, count(m.mean_km) AS n,
            {r6('any_value(b.bin * (30 / 149.0::DOUBLE))', 'centre')}
            FROM (SELECT DISTINCT area, type FROM moves) g CROSS JOIN range(0, 150) b(bin)
            LEFT JOIN moves m ON m.area = g.area AND m.type = g.type AND m.mean_km BETWEEN 0 AND 30
              AND greatest(ceil(m.mean_km / (30 / 149.0::DOUBLE) - 0.5), 0) = b.bin GROUP BY g.area, g.type, b.bin""",
        "occasion_gaps": """SELECT area, year, gap FROM (SELECT area, year,
            year - lag(year) OVER (PARTITION BY area ORDER BY year) AS gap FROM occ) WHERE gap IS NOT NULL""",
        "capture_history": """SELECT s.area, s.individual_id, s.subarea,
            string_agg(CASE WHEN y.year IS NULL THEN '0' ELSE '1' END, '' ORDER BY o.year) AS history
            FROM (SELECT DISTINCT area, individual_id, subarea FROM iy) s JOIN occ o USING (area)
            LEFT JOIN iy y ON y.area = s.area AND y.individual_id = s.individual_id AND y.year = o.year GROUP BY ALL""",
        "history_frequency": """SELECT area, subarea, history, count(*) AS individuals FROM (
            SELECT s.area, s.individual_id, s.subarea,
            string_agg(CASE WHEN y.year IS NULL THEN '0' ELSE '1' END, '' ORDER BY o.year) AS history
            FROM (SELECT DISTINCT area, individual_id, subarea FROM iy) s JOIN occ o USING (area)
            LEFT JOIN iy y ON y.area = s.area AND y.individual_id = s.individual_id AND y.year = o.year GROUP BY ALL)
            GROUP BY ALL""",
        "occasion_statistics": "SELECT area, year, n, m, u, released, r, z FROM stats",
        "m_array": """SELECT area, release_year, next_year, count(*) AS individuals FROM steps
            WHERE next_year IS NOT NULL GROUP BY ALL""",
        "overdispersion": f"""
            , size AS (SELECT area, max(i) AS t FROM occ GROUP BY area),
              fates AS (SELECT area, i, new_again AS a, new_never AS b, old_again AS c, old_never AS d
                FROM stats JOIN size USING (area) WHERE i BETWEEN 2 AND t - 1),
              moves2 AS (SELECT s.area, k.i AS k, j.i AS j FROM steps s JOIN occ k ON k.area = s.area
                AND k.year = s.release_year JOIN occ j ON j.area = s.area AND j.year = s.next_year),
              returns AS (SELECT o.area, o.i, count(*) FILTER (k = o.i AND j = o.i + 1) AS a,
                count(*) FILTER (k = o.i AND j > o.i + 1) AS b, count(*) FILTER (k < o.i AND j = o.i + 1) AS c,
                count(*) FILTER (k < o.i AND j > o.i + 1) AS d
                FROM occ o JOIN size z ON z.area = o.area JOIN moves2 m ON m.area = o.area AND m.k <= o.i AND m.j > o.i
                WHERE o.i BETWEEN 2 AND z.t - 2 GROUP BY ALL),
              chis AS (SELECT area, {chi} AS chi FROM (SELECT * FROM fates UNION ALL SELECT * FROM returns))
            SELECT area, round_even(coalesce(sum(chi), 0.0), 6) + 0.0 AS chi_square, count(chi) AS df,
              {r6('sum(chi) / nullif(count(chi), 0)', 'c_hat')} FROM chis GROUP BY area""",
        "jolly_seber": f"""SELECT area, year, n, m, r, z, {r6('marked', 'marked')}, {r6('n_hat', 'n_hat')}, {r6('p', 'p')},
            {r6('phi', 'phi')}, {r6('entries', 'entries')}, {r6('n_se', 'n_se')}, {r6('phi_se', 'phi_se')} FROM js""",
        "parameter_ranges": f"""SELECT area, {r6('min(phi)', 'phi_min')}, {r6('max(phi)', 'phi_max')}, {r6('avg(p)', 'p_mean')},
            {r6('min(p)', 'p_min')}, {r6('max(p)', 'p_max')},
            {r6('(SELECT avg(mean) * 100 FROM good)', 'good_photo_percent')} FROM js GROUP BY area""",
        "entry_parameters": f"""SELECT area, subarea, year, {r6('n_super', 'n_super')}, {r6('entering / n_super', 'entry_share')},
            {r6('survival::DOUBLE', 'survival')}, estimated
            FROM (SELECT *, sum(entering) OVER (PARTITION BY area, subarea) AS n_super FROM entering_sub) WHERE n_super <> 0""",
        "derived_abundance": f"""
            , p AS (SELECT *, sum(entering) OVER (PARTITION BY area, subarea) AS n_super FROM entering_sub),
              cells AS (SELECT t.area, t.subarea, t.year, j.entering * coalesce((SELECT product(power(s.survival, s.gap))
                  FROM p s WHERE s.area = t.area AND s.subarea = t.subarea AND s.year >= j.year AND s.year < t.year), 1) AS n
                FROM p t JOIN p j ON j.area = t.area AND j.subarea = t.subarea AND j.year <= t.year WHERE t.n_super <> 0)
            SELECT area, year, {r6('sum(n)', 'n_hat')} FROM cells GROUP BY area, year""",
        "abundance_bootstrap": f"SELECT area, rep::INT AS rep, year, n::BIGINT AS n, {r6('n_hat', 'n_hat')} FROM boot",
        "bootstrap_covariance": f"SELECT stock, year_i, year_j, {r6('cov', 'cov')}, replicates FROM bootcov",
        "model_weights": f"""SELECT stock, model_id, npar, {r6('qaicc', 'qaicc')}, {r6('delta', 'delta')},
            {r6('weight', 'weight')}, {r6('chat', 'chat')} FROM weighted WHERE weight > 0.0001""",
        "model_average": f"SELECT stock, parameter, {r6('estimate', 'estimate')}, {r6('se', 'se')} FROM averaged",
        "report_survival": f"""SELECT stock, {r6('estimate', 'estimate')}, {r6('se', 'se')} FROM averaged
            QUALIFY row_number() OVER (PARTITION BY stock ORDER BY parameter) = 1""",
        "corrected_abundance": f"SELECT stock, year, {corrected} FROM corrected",
        "report_abundance": f"""SELECT c.stock, c.year, {corrected.replace('(', '(c.')}, a.sightings, a.individuals
            FROM corrected c LEFT JOIN annual a ON a.area = c.stock AND a.year = c.year""",
        "annual_growth": f"""SELECT stock, year, {r6('n_i', 'n_i')}, diff_year, {r6('diff_growth', 'diff_growth')},
            {r6('rate_percent', 'rate_percent')} FROM growth""",
        "mean_growth": f"SELECT stock, {r6('avg(rate_percent)', 'mean_growth')} FROM growth GROUP BY stock",
        "minimum_abundance": f"SELECT stock, year, {r6('n_hat', 'n_hat')}, {r6('se', 'se')} FROM est",
        "trend_slope": f"""SELECT area AS stock, {r6('regr_slope(n_hat, year)', 'slope')},
            {r6('regr_intercept(n_hat, year)', 'intercept')} FROM js GROUP BY area""",
        "abundance_draws": "SELECT stock, rep, year, round_even(n_hat, 3) + 0.0 AS n_hat FROM trend_draws",
        "trend_interval_stock": _interval("lines", "stock"),
        "trend_interval_pooled": _interval("pooled"),
        "common_years": """SELECT count(*) AS years FROM (SELECT year FROM js GROUP BY year
            HAVING count(n_hat) = (SELECT count(DISTINCT area) FROM js WHERE n_hat IS NOT NULL))""",
    }
    sql["report_theta"] = sql["theta"]
    statements = {name: query(body) for name, body in sql.items()}
    statements["report_models"] = query(
        f"""SELECT stock, model_id, npar, {r6('qaicc', 'qaicc')}, {r6('delta', 'delta')},
        CAST(CAST(round_even(weight, 4) AS DECIMAL(5, 4)) AS VARCHAR) AS weight, {r6('chat', 'chat')} FROM weighted WHERE weight > 0.0001"""
    )
    return statements
