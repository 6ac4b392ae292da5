"""Pieces of DuckDB SQL that the checks of several queries share."""

from __future__ import annotations

FRAMES = """frames AS (
  SELECT o_orderpriority AS session, l_orderkey AS frame_id,
    sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*) / 100 AS background_median,
    sum(l_quantity::BIGINT)::DOUBLE / count(*) / 10 + 1 AS fwhm,
    1 - min(l_extendedprice) / max(l_extendedprice) AS eccentricity,
    sum(l_quantity::BIGINT)::INT AS star_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""

PIXELS = """pixels AS (
  SELECT vec_id, label, i, (i % 8)::INT AS x, (i // 8)::INT AS y, (e::DOUBLE + 1) / 2 AS v
  FROM (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(64))::INT AS i FROM embeddings))"""

HEADERS = """headers AS (
  SELECT event_id, user_id, ts, value, event_type AS filter, ' ' || regexp_extract(props, '(-?[0-9]+)', 1) || ' ' AS gain,
    CASE WHEN event_id % 7 <> 0 THEN floor(value)::BIGINT::VARCHAR END AS rotator FROM events), keywords AS (
  SELECT event_id, 'FILTER' AS name, filter AS value, 'filter name' AS comment FROM headers
  UNION ALL SELECT event_id, 'GAIN', gain, NULL FROM headers
  UNION ALL SELECT event_id, 'ROTATOR', rotator, 'degrees' FROM headers WHERE rotator IS NOT NULL)"""


def valley(source: str, by: str, value: str) -> str:
    """CTEs ending in ``valley`` (g, peak1, peak2, valley_bin, valley, depth)."""
    return f"""h0 AS (
  SELECT {by} AS g, {value}::DOUBLE AS v, min({value}) OVER w::DOUBLE AS lo, max({value}) OVER w::DOUBLE AS hi, count({value}) OVER w AS n
  FROM {source} WHERE {value} IS NOT NULL WINDOW w AS (PARTITION BY {by})), h1 AS (
  SELECT g, lo, (hi - lo) / 20 AS w, least(floor((v - lo) / ((hi - lo) / 20)), 19)::INT AS b FROM h0 WHERE hi - lo >= 1.1920929e-07 AND n >= 4), h2 AS (
  SELECT g, lo, w, b, count(*) AS c FROM h1 GROUP BY ALL), h3 AS (
  SELECT d.g, d.lo, d.w, r.b, coalesce(h2.c, 0) AS c FROM (SELECT DISTINCT g, lo, w FROM h2) d CROSS JOIN (SELECT unnest(range(20))::INT AS b) r
  LEFT JOIN h2 ON h2.g = d.g AND h2.b = r.b), h4 AS (
  SELECT *, lag(c) OVER o + c + lead(c) OVER o AS t FROM h3 WINDOW o AS (PARTITION BY g ORDER BY b)), h5 AS (
  SELECT *, coalesce(t // 3, c) AS s, coalesce(t / 3.0::DOUBLE, c::DOUBLE) AS e FROM h4), pk AS (
  SELECT g, arg_max(b, (s, b)) FILTER (WHERE b < 10) AS p1, arg_max(b, (s, b)) FILTER (WHERE b >= 10) AS p2 FROM h5 GROUP BY g), vb AS (
  SELECT h5.g, p1, p2, arg_min(h5.b, (s, h5.b)) AS vbin FROM h5 JOIN pk ON h5.g = pk.g WHERE h5.b BETWEEN p1 AND p2 GROUP BY ALL), valley AS (
  SELECT vb.g, p1 AS peak1, p2 AS peak2, vbin AS valley_bin, a.lo + (vbin + 0.5::DOUBLE) * a.w AS valley,
    CASE WHEN least(b.e, c.e) > 1.1920929e-07 THEN a.e / least(b.e, c.e) ELSE 1 END AS depth
  FROM vb JOIN h5 a ON a.g = vb.g AND a.b = vbin JOIN h5 b ON b.g = vb.g AND b.b = p1 JOIN h5 c ON c.g = vb.g AND c.b = p2)"""


def bimodality(source: str, by: str, value: str) -> str:
    """CTE ``bc`` (g, bc)."""
    return f"""b0 AS (
  SELECT {by} AS g, {value}::DOUBLE AS v, avg({value}::DOUBLE) OVER w AS m, stddev_pop({value}::DOUBLE) OVER w AS sd, count({value}) OVER w AS n
  FROM {source} WHERE {value} IS NOT NULL WINDOW w AS (PARTITION BY {by})), bc AS (
  SELECT g, CASE WHEN any_value(n) >= 4 AND any_value(sd) * any_value(sd) >= 1.1920929e-07 THEN
    (pow(avg(pow((v - m) / sd, 3)), 2) + 1) / (avg(pow((v - m) / sd, 4)) - 3 + 3 * pow(any_value(n) - 1.0::DOUBLE, 2) / nullif((any_value(n) - 2.0::DOUBLE) * (any_value(n) - 3), 0)) END AS bc
  FROM b0 GROUP BY g)"""


def anchored(source: str, by: str, value: str) -> str:
    """CTEs ending in ``anchored`` (g, mean, sigma, anchored)."""
    return f"""{bimodality(source, by, value)}, {valley(source, by, value)}, cl AS (
  SELECT {by} AS g, count({value}) AS n, avg({value}) AS m, stddev_pop({value}) AS sd FROM {source} s JOIN valley ON valley.g = s.{by} JOIN bc ON bc.g = valley.g
  WHERE bc > 0.555 AND depth <= 0.2 AND {value} > valley GROUP BY 1 HAVING count({value}) >= 2), anchored AS (
  SELECT {by} AS g, coalesce(any_value(cl.m), avg({value}), 0) AS mean, coalesce(any_value(cl.sd), stddev_pop({value}), 0) AS sigma, any_value(cl.n) IS NOT NULL AS anchored
  FROM {source} s LEFT JOIN cl ON cl.g = s.{by} GROUP BY 1)"""


STATS = f"""{FRAMES}, {anchored("frames", "session", "star_count")}, first_pass AS (
  SELECT f.session, avg(background_median) AS bm, stddev_pop(background_median) AS bs, avg(fwhm) AS fm, stddev_pop(fwhm) AS fs, avg(eccentricity) AS em, stddev_pop(eccentricity) AS es,
    any_value(a.mean) AS sm, any_value(a.sigma) AS ss FROM frames f JOIN anchored a ON a.g = f.session GROUP BY 1), marked AS (
  SELECT f.*, coalesce(bs > 1.1920929e-07 AND abs((background_median - bm) / bs) > 4, false) OR coalesce(fs > 1.1920929e-07 AND abs((fwhm - fm) / fs) > 4, false)
    OR coalesce(ss > 1.1920929e-07 AND abs((star_count - sm) / ss) > 4, false) AS outlier FROM frames f JOIN first_pass p ON f.session = p.session), stats AS (
  SELECT m.session, coalesce(avg(background_median) FILTER (NOT outlier), any_value(bm)) AS bm, coalesce(stddev_pop(background_median) FILTER (NOT outlier), any_value(bs)) AS bs,
    coalesce(avg(fwhm) FILTER (NOT outlier), any_value(fm)) AS fm, coalesce(stddev_pop(fwhm) FILTER (NOT outlier), any_value(fs)) AS fs,
    coalesce(avg(eccentricity) FILTER (NOT outlier), any_value(em)) AS em, coalesce(stddev_pop(eccentricity) FILTER (NOT outlier), any_value(es)) AS es,
    any_value(sm) AS sm, any_value(ss) AS ss, count(*) FILTER (outlier) AS outliers FROM marked m JOIN first_pass p ON m.session = p.session GROUP BY 1)"""

CLASSIFIED = f"""{STATS}, tagged AS (
  SELECT f.*, list_filter([
    CASE WHEN bs >= 1.1920929e-07 AND (background_median - bm) / bs >= 2.5 THEN 'BackgroundMedian' END,
    CASE WHEN fs >= 1.1920929e-07 AND (fwhm - fm) / fs >= 2.5 THEN 'FWHM' END,
    CASE WHEN ss >= 1.1920929e-07 AND (star_count - sm) / ss <= -1.5 THEN 'StarCount' END,
    CASE WHEN eccentricity >= 0.85 THEN 'Eccentricity' END], lambda x: x IS NOT NULL) AS t FROM frames f JOIN stats s ON f.session = s.session), classified AS (
  SELECT session, frame_id, background_median, fwhm, eccentricity, star_count, array_to_string(t, ',') AS triggered_by, CASE WHEN len(t) > 0 THEN 'REJECT' ELSE 'PASS' END AS flag,
    nullif((CASE WHEN list_contains(t, 'FWHM') OR list_contains(t, 'Eccentricity') THEN 'O' ELSE '' END) || (CASE WHEN list_contains(t, 'BackgroundMedian') THEN 'B' ELSE '' END)
      || (CASE WHEN list_contains(t, 'StarCount') THEN 'T' ELSE '' END), '') AS rejection_category,
    1 / greatest(fwhm, 0.1) + (1 - eccentricity) AS score FROM tagged)"""
