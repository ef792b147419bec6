"""What each registered query should return, as SQL for DuckDB over the same tables."""

from __future__ import annotations

import re

from .fixtures import VIEWS

M = ["effort_days", "juv_effort_days", "salmon_chinook_kept", "halibut_kept"]
STRATA = ["resident_status", "licence_type", "age_category", "purchase_period"]
DRAW = ["draw_type", "resident_status", "licence_type", "age_category"]
AM = ["area", "method"]
DC = ["area", "method", "lodge", "guided"]
MONTHS = [
    "April", "May", "June", "July", "August", "September",
    "October", "November", "December", "January", "February", "March",
]


def c(names, prefix=""):
    return ", ".join(f"{prefix}{n}" for n in names)


def each(names, template):
    return ", ".join(template.format(m=n) for n in names)


def same(a, b, names):
    return " AND ".join(f"{a}.{n} IS NOT DISTINCT FROM {b}.{n}" for n in names)


def either(a, b, names):
    return ", ".join(f"coalesce({a}.{n}, {b}.{n}) AS {n}" for n in names)


def r(expr, places=6):
    return f"round({expr}, {places}) + 0.0"


REG_COLUMNS = [
    "full_licence_id", "start_date", "purchase_date", "stamp_purchase_date", "lic_type_cat_code",
    "survey_access_key", "survey_definition_id", "lic_year", "fisher_id",
]


def _registry_blocks(source: str, tag: str, start: str, end: str, open_: str) -> dict[str, str]:
    """Registry CTEs of one licence year; ``tag`` ends their names."""
    code = "lic_type_cat_code"
    return {
        f"reg{tag}": f"""
SELECT full_licence_id, start_dt AS start_date, expiry_dt AS expiry_date, purchase_dtt AS purchase_date,
       stamp_purchase_dtt AS stamp_purchase_date, {code}, survey_access_key,
       CAST(NULL AS INT) AS survey_definition_id, lic_year, fisher_id FROM {source}""",
        f"fixed{tag}": f"""
SELECT * REPLACE (CASE WHEN year(start_date) < lic_year
           THEN expiry_date - coalesce(try_cast(substr({code}, 2, 1) AS INT), 0) + 1 ELSE start_date END AS start_date),
       year(start_date) < lic_year AS early
FROM reg{tag}""",
        f"dated{tag}": f"""
SELECT * REPLACE (
         CASE WHEN purchase_date BETWEEN DATE '{open_}' AND DATE '{end}' THEN purchase_date END AS purchase_date,
         CASE WHEN stamp_purchase_date NOT BETWEEN DATE '{open_}' AND DATE '{end}' THEN start_date
              ELSE stamp_purchase_date END AS stamp_purchase_date),
       stamp_purchase_date NOT BETWEEN DATE '{open_}' AND DATE '{end}' AS stamp_bad,
       CAST(CAST(split_part(full_licence_id, '-', 4) AS INT) AS VARCHAR) AS licence_id
FROM fixed{tag}""",
        f"clean{tag}": f"""
SELECT *, CASE licence_type WHEN 'Annual' THEN DATE '{end}' WHEN '5 Days' THEN start_date + 4
               WHEN '3 Days' THEN start_date + 2 WHEN '1 Day' THEN start_date END AS end_date
FROM (
  SELECT {c([n for n in REG_COLUMNS if n != 'start_date'])}, licence_id,
         greatest(start_date, coalesce(purchase_date, start_date)) AS start_date,
         CASE left({code}, 1) WHEN 'R' THEN 'Resident' WHEN 'N' THEN 'Non-Resident' END AS resident_status,
         CASE substr({code}, 3, 1) WHEN 'A' THEN 'Adult (16-64)' WHEN 'S' THEN 'Senior (65+)'
              WHEN '' THEN 'All Ages above 15 (Pacific)' END AS age_category,
         CASE substr({code}, 2, 1) WHEN 'A' THEN 'Annual' WHEN '5' THEN '5 Days' WHEN '3' THEN '3 Days'
              WHEN '1' THEN '1 Day' END AS licence_type,
         substr({code}, 2, 1) = 'A' AS annual_flag
  FROM dated{tag} WHERE fisher_id <> 1 AND {code} <> '' AND left({code}, 1) <> 'F'
) WHERE start_date BETWEEN DATE '{start}' AND DATE '{end}'""",
    }


def _modern(source: str, extra: str = "") -> str:
    return f"""
SELECT {extra} trim(surveykey) AS surveykey, didnotfish = 1 AS did_not_fish,
       nullif(trim(area), '') AS area, nullif(trim(method), '') AS method,
       coalesce(CASE fishedfromlodge WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' END, 'Unspecified') AS lodge,
       coalesce(CASE fishedwithguide WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' END, 'Unspecified') AS guided,
       CASE WHEN didnotfish = 1 THEN 0 ELSE 1 END AS effort_days,
       coalesce(totaljuveniles, 0) AS juv_effort_days,
       coalesce(salmon_chinook_kept, 0) AS salmon_chinook_kept, coalesce(halibut_kept, 0) AS halibut_kept
FROM {source} WHERE surveykey IS NOT NULL AND trim(completesurvey) = 'Complete'"""


def _vendor_sum(months) -> str:
    return " + ".join(f"coalesce({m}, 0)" for m in months) or "0"


DRAW_STATUS = """CASE WHEN annual_flag AND start_date >= DATE '{d1}' AND start_date < DATE '{d2}' THEN 'Post'
            WHEN annual_flag THEN 'Pre'
            WHEN start_date BETWEEN DATE '{d1}' AND DATE '{d2}' OR end_date BETWEEN DATE '{d1}' AND DATE '{d2}' THEN 'Post'
            END"""

MID = "start_date + CAST(floor((end_date - start_date) / 2) AS INT)"

BLOCKS: dict[str, str] = {
    **VIEWS,
    **_registry_blocks("licence_raw", "", "2020-04-01", "2021-03-31", "2020-03-01"),
    **_registry_blocks("licence_draw", "_draw", "2017-04-01", "2018-03-31", "2017-03-01"),
    "modern": _modern("response_raw"),
    "modern_year": _modern("response_year", "survey_id,"),
    "kept_modern": "SELECT * FROM modern WHERE surveykey NOT IN (SELECT survey_access_key FROM exclude_ids)",
    "adjust": "SELECT * REPLACE (CASE lower(did_not_fish) WHEN 'yes' THEN TRUE WHEN 'no' THEN FALSE END AS did_not_fish) FROM adjust_raw",
    "adjusted": f"""
SELECT surveykey, did_not_fish, area, method, lodge, guided, {c(M)}, CAST(NULL AS VARCHAR) AS datefished
FROM modern WHERE surveykey NOT IN (SELECT surveykey FROM adjust)
UNION ALL
SELECT surveykey, did_not_fish, area, method, NULL, NULL, CAST(effort_days AS INT), NULL,
       CAST(salmon_chinook_kept AS INT), CAST(halibut_kept AS INT), datefished FROM adjust""",
    "adjusted_kept": f"""
SELECT surveykey, did_not_fish, area, method, lodge, guided, {c(M)}, CAST(NULL AS VARCHAR) AS datefished
FROM kept_modern WHERE surveykey NOT IN (SELECT surveykey FROM adjust)
UNION ALL
SELECT surveykey, did_not_fish, area, method, NULL, NULL, CAST(effort_days AS INT), NULL,
       CAST(salmon_chinook_kept AS INT), CAST(halibut_kept AS INT), datefished FROM adjust""",
    "legacy": """
SELECT trim(Licence_ID) AS licence_id, trim(First_name) AS first_name, trim(Last_name) AS last_name,
       trim(AMAIL) AS email, CASE REPZONE WHEN 1 THEN 'Area 1' WHEN 2 THEN 'Area 2' WHEN 3 THEN 'Area 3' END AS area,
       CASE REPMETHOD WHEN 1 THEN 'Boat' WHEN 2 THEN 'Shore' END AS method, REPYEAR AS year, 'July' AS month,
       REPDAY - 1000 AS day, coalesce(CAST(QGUIDE AS VARCHAR), 'Unspecified') AS guided,
       coalesce(CAST(QLODGE AS VARCHAR), 'Unspecified') AS lodge, DNF_1 IS NOT NULL AS did_not_fish,
       CASE WHEN DNF_1 IS NOT NULL THEN 0 ELSE COMPLETE END AS effort_days,
       coalesce(AJUVEPRES, 0) AS juv_effort_days, coalesce(ASALMON_CHINOOK_KEPT, 0) AS salmon_chinook_kept,
       coalesce(AHALIBUT_KEPT, 0) AS halibut_kept
FROM legacy_raw WHERE Licence_ID IS NOT NULL AND (COMPLETE = 1 OR DNF_1 IS NOT NULL)""",
    "july": f"""
SELECT *, CASE WHEN annual_flag AND start_date >= DATE '2020-07-01' AND start_date < DATE '2020-07-31' THEN 'In Survey'
            WHEN annual_flag THEN 'Pre-Survey' ELSE 'Not Specified' END AS purchase_period,
       coalesce(CASE WHEN annual_flag THEN stamp_purchase_date < DATE '2020-07-31'
                     ELSE stamp_purchase_date <= DATE '2020-07-31' END, FALSE) AS stamp
FROM clean WHERE start_date <= DATE '2020-07-31'
  AND CASE WHEN annual_flag THEN start_date < DATE '2020-07-31'
           ELSE {MID} BETWEEN DATE '2020-07-01' AND DATE '2020-07-31' END""",
    "joined": f"""
SELECT m.surveykey AS survey_access_key, {c(STRATA, 'j.')}, m.* EXCLUDE (surveykey)
FROM modern m JOIN july j ON m.surveykey = j.survey_access_key""",
    "calendar": """
SELECT * FROM (VALUES
  ('2020-04', DATE '2020-04-01', DATE '2020-04-30', 'April'), ('2020-05', DATE '2020-05-01', DATE '2020-05-31', 'May'),
  ('2020-06', DATE '2020-06-01', DATE '2020-06-30', 'June'), ('2020-07', DATE '2020-07-01', DATE '2020-07-31', 'July'),
  ('2020-08', DATE '2020-08-01', DATE '2020-08-31', 'August'), ('2020-09', DATE '2020-09-01', DATE '2020-09-30', 'September'),
  ('2020-10', DATE '2020-10-01', DATE '2020-10-31', 'October'), ('2020-11', DATE '2020-11-01', DATE '2020-11-30', 'November'),
  ('2020-12', DATE '2020-12-01', DATE '2020-12-31', 'December'), ('2021-01', DATE '2021-01-01', DATE '2021-01-31', 'January'),
  ('2021-02', DATE '2021-02-01', DATE '2021-02-28', 'February'), ('2021-03', DATE '2021-03-01', DATE '2021-03-31', 'March')
) AS t(survey_id, survey_start, survey_end, month)""",
    "year_lic": f"""
SELECT s.survey_id, s.survey_start, s.survey_end, l.*,
       CASE WHEN annual_flag AND start_date >= survey_start AND start_date < survey_end THEN 'In Survey'
            WHEN annual_flag THEN 'Pre-Survey' ELSE 'Not Specified' END AS purchase_period,
       coalesce(CASE WHEN annual_flag THEN stamp_purchase_date < survey_end
                     ELSE stamp_purchase_date <= survey_end END, FALSE) AS stamp
FROM clean l JOIN calendar s ON start_date <= survey_end
  AND CASE WHEN annual_flag THEN start_date < survey_end ELSE {MID} BETWEEN survey_start AND survey_end END""",
    "vendor_sum": f"""
SELECT resident_status, licence_type, age_category,
       CAST({_vendor_sum(MONTHS[:3])} AS DOUBLE) AS before_month_total, CAST(July AS DOUBLE) AS month_total
FROM vendor_wide""",
    "draw_lic": f"""
SELECT *, {DRAW_STATUS.format(d1='2017-07-01', d2='2017-07-31')} AS draw_type
FROM clean_draw WHERE start_date <= DATE '2017-07-31'
  AND (NOT annual_flag OR start_date < DATE '2017-07-31')""",
    "draw_lic_merged": """
SELECT * REPLACE (CASE WHEN resident_status = 'Non-Resident' AND licence_type = 'Annual' AND (
         SELECT max(month_total) FROM vendor_sum WHERE resident_status = 'Non-Resident' AND licence_type = 'Annual'
            AND age_category = 'All Ages above 15 (Pacific)') > 0
       THEN 'All Ages above 15 (Pacific)' ELSE age_category END AS age_category)
FROM draw_lic""",
    "vendor_pop": """
SELECT resident_status, licence_type, age_category, draw_type, coalesce(sum(sold), 0) AS vlic_total FROM (
  SELECT resident_status, licence_type, age_category, 'Post' AS draw_type, month_total AS sold
  FROM vendor_sum WHERE month_total > 0
  UNION ALL
  SELECT resident_status, licence_type, age_category, 'Pre', before_month_total FROM vendor_sum
  WHERE licence_type = 'Annual')
GROUP BY ALL""",
    "lines": """
SELECT 'K' || CAST(l_orderkey AS VARCHAR) AS surveykey,
       CASE WHEN l_quantity > 10 THEN l_quantity END AS salmon_chinook_kept,
       CASE WHEN l_partkey % 4 > 0 THEN l_partkey END AS halibut_kept, l_returnflag = 'N' AS did_not_fish
FROM lineitem""",
}


def _population_blocks(source: str, tag: str, prefix: list[str]) -> dict[str, str]:
    keys = [*prefix, *STRATA]
    return {f"pop{tag}": f"""
SELECT {c(keys)}, count(*) AS lic_total FROM (SELECT DISTINCT {c(keys)}, licence_id FROM {source}) GROUP BY {c(keys)}"""}


def _estimate_blocks(
    rows: str, unit: str, pop: str, strata: list[str], cells: list[str], var_cells: list[str], tag: str,
    counted: str = "did_not_fish IS NOT NULL", need_area: bool = False, prefix: list[str] = (),
) -> dict[str, str]:
    """The literal two-step estimator over joined rows; ``pop`` has ``lic_total`` per stratum."""
    keys = [*prefix, *strata]
    area = "HAVING area IS NOT NULL" if need_area else ""
    variance = (
        "(sum((x.{m} - x.mean_{m}) ** 2) + (max(x.n_{m}) - count(*)) * max(x.mean_{m}) ** 2)"
        " / (CASE WHEN max(x.n_{m}) > 1 THEN max(x.n_{m}) - 1 END) AS {m}"
    )
    return {
        f"sums{tag}": f"""
SELECT {c(keys)}, {c(cells)}, {each(M, 'CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}')}
FROM {rows} WHERE {counted} GROUP BY {c(keys)}, {c(cells)} {area}""",
        f"sizes{tag}": f"""
SELECT {c(keys)}, {each(M, 'count(*) FILTER (WHERE {m}) AS n_{m}')} FROM (
  SELECT {c(keys)}, {unit}, {each(M, 'bool_and({m} IS NOT NULL) AS {m}')} FROM {rows}
  WHERE effort_days > 0 OR did_not_fish GROUP BY {c(keys)}, {unit}) GROUP BY {c(keys)}""",
        f"resp{tag}": f"""
SELECT {c(keys)}, {unit}, {c(var_cells)}, {each(M, 'CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}')}
FROM {rows} GROUP BY {c(keys)}, {unit}, {c(var_cells)}""",
        f"spec{tag}": f"""
SELECT {c(keys)}, {c(var_cells)}, {each(M, variance)} FROM (
  SELECT p.*, {each(M, 'z.n_{m} AS n_{m}')},
         {each(M, 'sum(p.{m}) OVER (PARTITION BY ' + c([*keys, *var_cells], 'p.') + ') / CAST(z.n_{m} AS DOUBLE) AS mean_{m}')}
  FROM resp{tag} p LEFT JOIN sizes{tag} z ON {same('p', 'z', keys)}) x
GROUP BY {c(keys)}, {c(var_cells)}""",
        f"full{tag}": f"""
SELECT {either('b', 'z', keys)}, lic_total, {c(cells)}, {c(M, 'b.')}, {each(M, 'z.n_{m}')} FROM (
  SELECT {either('p', 's', keys)}, lic_total, {c(cells)}, {c(M)}
  FROM {pop} p FULL JOIN sums{tag} s ON {same('p', 's', keys)}) b
FULL JOIN sizes{tag} z ON {same('b', 'z', keys)}""",
        f"detail{tag}": f"""
SELECT {c(keys)}, lic_total, {c(cells)},
       {each(M, '{m} * (CAST(coalesce(lic_total, 0) AS DOUBLE) / nullif(n_{m}, 0)) AS {m}')} FROM full{tag}""",
        f"total{tag}": f"""
SELECT {c([*prefix, *var_cells])},
       {each(M, '(coalesce(sum(w * w * {m} / n_{m}), 0) - coalesce(sum(w * {m} / big_n), 0)) * max(big_n) ** 2 AS {m}')}
FROM (
  SELECT {either('b', 'v', keys)}, {c(var_cells, 'v.')}, {c(M, 'v.')}, w, big_n, {each(M, 'n_{m}')} FROM (
    SELECT {either('z', 'p', keys)}, {each(M, 'n_{m}')}, lic_total / big_n AS w, big_n FROM sizes{tag} z FULL JOIN (
      SELECT *, CAST(sum(lic_total) OVER ({'PARTITION BY ' + c(prefix) if prefix else ''}) AS DOUBLE) AS big_n FROM {pop}) p
    ON {same('z', 'p', keys)}) b
  FULL JOIN spec{tag} v ON {same('b', 'v', keys)})
GROUP BY {c([*prefix, *var_cells])}""",
    }


BLOCKS |= _population_blocks("july", "", [])
BLOCKS |= _population_blocks("year_lic", "_year", ["survey_id"])
BLOCKS |= _estimate_blocks("joined", "survey_access_key", "pop", STRATA, AM, AM, "_")
BLOCKS["joined_kept"] = BLOCKS["joined"].replace("FROM modern m", "FROM kept_modern m")
BLOCKS |= _estimate_blocks("joined_kept", "survey_access_key", "pop", STRATA, DC, DC, "_kept")
BLOCKS["joined_adj"] = BLOCKS["joined"].replace("FROM modern m", "FROM adjusted m")
BLOCKS |= _estimate_blocks("joined_adj", "survey_access_key", "pop", STRATA, AM, AM, "_adj")
BLOCKS["joined_year"] = f"""
SELECT m.survey_id, m.surveykey AS survey_access_key, {c(STRATA, 'j.')}, m.* EXCLUDE (survey_id, surveykey)
FROM modern_year m JOIN year_lic j ON m.surveykey = j.survey_access_key AND m.survey_id = j.survey_id"""
BLOCKS |= _estimate_blocks(
    "joined_year", "survey_access_key", "pop_year", STRATA, AM, AM, "_year", prefix=["survey_id"]
)
BLOCKS["elic_pop"] = f"""
SELECT {c(DRAW)}, CAST(count(*) AS DOUBLE) AS elic_total FROM draw_lic WHERE draw_type IS NOT NULL GROUP BY {c(DRAW)}"""
BLOCKS["all_pop"] = f"""
SELECT {either('v', 'e', DRAW)}, coalesce(vlic_total, 0) AS vlic_total, coalesce(elic_total, 0) AS elic_total,
       coalesce(vlic_total, 0) + coalesce(elic_total, 0) AS lic_total
FROM vendor_pop v FULL JOIN elic_pop e ON {same('v', 'e', DRAW)}"""
BLOCKS["elic_pop_merged"] = BLOCKS["elic_pop"].replace("draw_lic", "draw_lic_merged")
BLOCKS["draw_pop"] = (
    BLOCKS["all_pop"].replace("elic_pop e", "elic_pop_merged e")
    + "\nWHERE coalesce(v.age_category, e.age_category) <> 'Juvenile (under 16 years)'"
)
_OUTSIDE = "end_date < DATE '2017-07-01' OR start_date > DATE '2017-07-31'"
for _tag, _source in (("", "draw_lic"), ("_merged", "draw_lic_merged")):
    BLOCKS[f"joined_draw{_tag}"] = f"""
SELECT l.full_licence_id, l.start_date, l.end_date, {c(DRAW, 'l.')},
       r.licence_id, r.area, r.method, r.lodge, r.guided, r.did_not_fish, {c(M, 'r.')}
FROM legacy r JOIN {_source} l ON r.licence_id = l.licence_id
WHERE l.full_licence_id NOT IN (SELECT full_licence_id FROM {_source} WHERE {_OUTSIDE})"""
    BLOCKS |= _estimate_blocks(
        f"joined_draw{_tag}", "licence_id", "draw_pop", DRAW, DC, AM, f"_draw{_tag}",
        counted="(effort_days > 0 OR did_not_fish)", need_area=True,
    )


# Runs from files to files: a month with exclusions and adjustments, and surveys of different strata.
BLOCKS["july_one"] = "SELECT '2020-07' AS survey_id, * FROM july"
BLOCKS |= _population_blocks("july_one", "_one", ["survey_id"])
for _tag, _rows, _cells in (("_job", "adjusted_kept", DC), ("_one", "modern", AM)):
    BLOCKS[f"joined{_tag}"] = f"SELECT '2020-07' AS survey_id, * FROM ({BLOCKS['joined'].replace('FROM modern m', f'FROM {_rows} m')})"
    BLOCKS |= _estimate_blocks(
        f"joined{_tag}", "survey_access_key", "pop_one", STRATA, _cells, _cells, _tag, prefix=["survey_id"]
    )
SETS = [*STRATA, "stamp", "strata_set"]
BLOCKS["calendar_mixed"] = """
SELECT survey_id, survey_start, survey_end, month, survey_id IN ('2020-06', '2020-08') AS stamp_stratify, TRUE AS period_stratify,
       CASE WHEN survey_id IN ('2020-08', '2020-09') THEN DATE '2020-06-15' END AS period_stratify_date
FROM calendar WHERE survey_id BETWEEN '2020-06' AND '2020-09'"""
BLOCKS["mixed_lic"] = """
SELECT l.* REPLACE (CASE WHEN stamp_stratify THEN stamp END AS stamp,
         CASE WHEN purchase_period <> 'Pre-Survey' OR period_stratify_date IS NULL THEN purchase_period
              WHEN start_date < period_stratify_date THEN 'Early Season' ELSE 'Late Season' END AS purchase_period),
       CAST(stamp_stratify AS INT) AS strata_set
FROM year_lic l JOIN (SELECT survey_id, stamp_stratify, period_stratify_date FROM calendar_mixed) s ON l.survey_id = s.survey_id"""
BLOCKS["pop_mixed"] = f"""
SELECT survey_id, {c(SETS)}, count(*) AS lic_total FROM (SELECT DISTINCT survey_id, {c(SETS)}, licence_id FROM mixed_lic)
GROUP BY survey_id, {c(SETS)}"""
BLOCKS["joined_mixed"] = f"""
SELECT m.survey_id, m.surveykey AS survey_access_key, {c(SETS, 'j.')}, m.* EXCLUDE (survey_id, surveykey)
FROM modern_year m JOIN mixed_lic j ON m.surveykey = j.survey_access_key AND m.survey_id = j.survey_id"""
BLOCKS |= _estimate_blocks(
    "joined_mixed", "survey_access_key", "pop_mixed", SETS, DC, DC, "_mixed", prefix=["survey_id"]
)
# Many measures of which a row reports one: zeros are never written down here either.
BLOCKS["sparse_rows"] = """
SELECT trim(surveykey) AS surveykey, didnotfish = 1 AS did_not_fish, nullif(trim(area), '') AS area, nullif(trim(method), '') AS method,
       CASE WHEN didnotfish = 1 THEN 0 ELSE 1 END AS effort_days, coalesce(salmon_chinook_kept, 0) AS caught,
       coalesce(halibut_kept, 0) AS other FROM response_raw WHERE surveykey IS NOT NULL"""
BLOCKS["sparse_joined"] = f"""
SELECT {c(STRATA)}, m.* FROM sparse_rows m JOIN july ON m.surveykey = survey_access_key"""
_GAP = "caught = 13 AND other * 75 < 300"
BLOCKS["sparse_values"] = f"""
SELECT {c(STRATA)}, surveykey, {c(AM)}, 'effort_days' AS measure, effort_days AS value FROM sparse_joined
UNION ALL
SELECT {c(STRATA)}, surveykey, {c(AM)}, 'finfish_kind' || lpad(CAST((caught * 7 + other) % 300 AS VARCHAR), 3, '0'), caught FROM sparse_joined
WHERE NOT ({_GAP} AND other * 75 = (caught * 7 + other) % 300)"""
BLOCKS["sparse_gaps"] = f"""
SELECT {c(STRATA)}, 'finfish_kind' || lpad(CAST(other * 75 AS VARCHAR), 3, '0') AS measure, count(DISTINCT surveykey) AS gaps
FROM sparse_joined WHERE {_GAP} GROUP BY ALL"""
BLOCKS["sparse_gap_cells"] = f"""
SELECT DISTINCT {c(STRATA)}, {c(AM)}, 'finfish_kind' || lpad(CAST(other * 75 AS VARCHAR), 3, '0') AS measure
FROM sparse_joined WHERE {_GAP}"""
BLOCKS["sparse_people"] = f"SELECT {c(STRATA)}, count(DISTINCT surveykey) AS people FROM sparse_joined GROUP BY {c(STRATA)}"
BLOCKS["sparse_spec"] = f"""
SELECT x.*, n, CASE WHEN n > 1 THEN (squares - total * total / n) / (n - 1) END AS variance
FROM (SELECT {c(STRATA)}, {c(AM)}, measure, sum(total) AS total, sum(total * total) AS squares FROM (
        SELECT {c(STRATA)}, {c(AM)}, measure, surveykey, CAST(sum(value) AS DOUBLE) AS total FROM sparse_values
        WHERE value <> 0 GROUP BY ALL
        UNION ALL SELECT *, '' AS surveykey, 0 FROM (SELECT {c(STRATA)}, {c(AM)}, measure FROM sparse_gap_cells)) GROUP BY ALL) x
JOIN (SELECT k.*, people - coalesce(gaps, 0) AS n FROM (SELECT DISTINCT {c(STRATA)}, measure FROM (
        SELECT {c(STRATA)}, measure FROM sparse_values UNION ALL SELECT {c(STRATA)}, measure FROM sparse_gap_cells)) k
      JOIN sparse_people p ON {same('k', 'p', STRATA)}
      LEFT JOIN sparse_gaps g ON {same('k', 'g', STRATA)} AND k.measure = g.measure) s
  ON {same('x', 's', STRATA)} AND x.measure = s.measure"""
BLOCKS["sparse_all"] = f"""
SELECT x.*, lic_total FROM sparse_spec x LEFT JOIN pop p ON {same('x', 'p', STRATA)}"""


def rounded(columns, rounded_columns, source, places=6):
    plain = f"{c(columns)}, " if columns else ""
    return f"SELECT {plain}{each(rounded_columns, 'round({m}, ' + str(places) + ') + 0.0 AS {m}')} FROM {source}"


def summary(source, prefix=()):
    keys = c([*prefix, *AM])
    return f"SELECT {keys}, {each(M, r('coalesce(sum({m}), 0)') + ' AS {m}')} FROM {source} GROUP BY {keys}"


def tagged(columns, source):
    return f"""
SELECT CAST(year(s.survey_start) AS INT) AS year, CAST(month(s.survey_start) AS INT) AS month_id, s.month, {columns}
FROM {source} t JOIN calendar s ON t.survey_id = s.survey_id"""


def violation(check, severity, key, detail, source):
    return (
        f"SELECT '{check}' AS \"check\", '{severity}' AS severity, CAST({key} AS VARCHAR) AS key, "
        f"{detail} AS detail FROM {source}"
    )


COUNT_RULES = [
    ("start_date_unfixable", "ERROR", "early AND term IS NULL"),
    ("start_date_fixed", "WARNING", "early AND term IS NOT NULL"),
    ("purchase_date_invalid", "WARNING", "purchase_date IS NULL"),
    ("stamp_date_invalid", "WARNING", "coalesce(stamp_bad, FALSE)"),
    ("unsold", "INFO", "fisher_id = 1"),
    ("blank", "INFO", "fisher_id <> 1 AND code = ''"),
    ("out_of_year", "WARNING", "fisher_id <> 1 AND NOT in_year"),
    ("family", "INFO", "fisher_id <> 1 AND in_year AND code <> '' AND left(code, 1) = 'F'"),
    ("kept", "INFO", "fisher_id <> 1 AND in_year AND code <> '' AND left(code, 1) <> 'F'"),
]
COUNTS_SOURCE = """(SELECT *, lic_type_cat_code AS code, try_cast(substr(lic_type_cat_code, 2, 1) AS INT) AS term,
  greatest(start_date, coalesce(purchase_date, start_date)) BETWEEN DATE '2020-04-01' AND DATE '2021-03-31' AS in_year
  FROM dated)"""
REGISTRY_COUNTS = "SELECT * FROM (" + " UNION ALL ".join(
    violation("registry_counts", level, f"'{name}'", f"CAST(count(*) FILTER (WHERE {test}) AS VARCHAR)", COUNTS_SOURCE)
    for name, level, test in COUNT_RULES
) + ") WHERE severity = 'INFO' OR detail <> '0'"
CATEGORY_CODES = " UNION ALL ".join(
    f"SELECT DISTINCT 'category_codes' AS \"check\", 'ERROR' AS severity, letter AS key, 'unknown code for {part}' AS detail "
    f"FROM (SELECT substr(lic_type_cat_code, {at}, 1) AS letter FROM reg) WHERE letter NOT IN ({known})"
    for part, at, known in (("residency", 1, "'R', 'N'"), ("age", 3, "'A', 'S', ''"), ("licence type", 2, "'A', '5', '3', '1'"))
)
MIXED_NULL = " UNION ALL ".join(
    violation("mixed_null", "ERROR", "surveykey", f"'{m}'",
              f"(SELECT surveykey FROM lines GROUP BY surveykey HAVING count({m}) > 0 AND count({m}) < count(*))")
    for m in M[2:]
)


def diagnostics(source):
    return f"""
SELECT CAST(NULL AS VARCHAR) AS survey_id, severity, code, detail, max(n) AS n,
       string_agg(key, ', ' ORDER BY key) FILTER (WHERE rank <= 10)
       || CASE WHEN max(n) > 10 THEN ', ...+' || CAST(max(n) - 10 AS VARCHAR) || ' more...' ELSE '' END AS sample
FROM (SELECT severity, "check" AS code, detail, key,
        row_number() OVER (PARTITION BY severity, "check", detail ORDER BY key) AS rank,
        count(*) OVER (PARTITION BY severity, "check", detail) AS n
      FROM (SELECT DISTINCT severity, "check", detail, coalesce(key, '(none)') AS key FROM ({source})))
GROUP BY severity, code, detail"""


def messages(source):
    """Like ``diagnostics`` for violations that carry a survey_id."""
    group = 'survey_id, severity, "check", detail'
    return f"""
SELECT survey_id, severity, code, detail, max(n) AS n,
       string_agg(key, ', ' ORDER BY key) FILTER (WHERE rank <= 10)
       || CASE WHEN max(n) > 10 THEN ', ...+' || CAST(max(n) - 10 AS VARCHAR) || ' more...' ELSE '' END AS sample
FROM (SELECT survey_id, severity, "check" AS code, detail, key,
        row_number() OVER (PARTITION BY {group} ORDER BY key) AS rank, count(*) OVER (PARTITION BY {group}) AS n
      FROM (SELECT DISTINCT {group}, coalesce(key, '(none)') AS key FROM ({source})))
GROUP BY survey_id, severity, code, detail"""


GROUPED_AGES = """
SELECT '2017-07' AS survey_id, 'ages_grouped' AS "check", 'WARNING' AS severity, 'All Ages above 15 (Pacific)' AS key,
       'adult and senior non-resident licences are grouped' AS detail
FROM vendor_sum WHERE resident_status = 'Non-Resident' AND licence_type = 'Annual'
  AND age_category = 'All Ages above 15 (Pacific)' AND month_total > 0"""


def settings(source):
    return " UNION ALL ".join(
        f"SELECT survey_id, 'strata_settings' AS \"check\", 'INFO' AS severity, '{key}' AS key, "
        f"'set to ' || coalesce(CAST({key} AS VARCHAR), 'nothing') AS detail FROM {source}"
        for key in ("stamp_stratify", "period_stratify", "period_stratify_date")
    )


def results(name, keys, values, source):
    """One result table as (table, key, name, value)."""
    key = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '-')" for k in sorted(keys))
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", concat_ws('|', {key}) AS key, '{v}' AS name, "
        f"round(CAST({v} AS DOUBLE) * 1.000000001, 4) + 0.0 AS value FROM {source}"
        for v in values
    )


def all_results(tag, pop, keys, cells, log, strata=STRATA):
    """The eight result tables of one run from its estimate blocks; ``keys`` names the survey in each of them."""
    n = [f"n_{m}" for m in M]

    def named(block):
        return keys[1].format(block)

    summed = f"(SELECT survey_id, {c(AM)}, {each(M, 'coalesce(sum({m}), 0) AS {m}')} FROM detail{tag} GROUP BY survey_id, {c(AM)})"
    return " UNION ALL ".join([
        results("licence_summary", [*keys[0], *strata], ["lic_total"], named(pop)),
        results("survey_summary", [*keys[0], *strata, *cells], ["lic_total", *M], named(f"full{tag}")),
        results("survey_sample_sizes", [*keys[0], *strata, *cells], ["lic_total", *n], named(f"full{tag}")),
        results("survey_specific_variance", [*keys[0], *strata, *cells], M, named(f"spec{tag}")),
        results("detail_estimated_catch", [*keys[0], *strata, *cells], ["lic_total", *M], named(f"detail{tag}")),
        results("summary_estimated_catch", [*keys[0], *AM], M, named(summed)),
        results("total_variance", [*keys[0], *cells], M, named(f"total{tag}")),
        results("log", ["survey_id", "severity", "code", "detail", "sample"], ["n"], f"({log})"),
    ])


CLEAN_COLUMNS = [
    *REG_COLUMNS, "licence_id", "resident_status", "age_category", "licence_type", "annual_flag", "end_date",
]
MODERN_COLUMNS = ["surveykey", "did_not_fish", "area", "method", "lodge", "guided", *M]

# Each oracle names the blocks it reads from; their own needs are added below.
SQL: dict[str, str] = {
    "src_registry": f"""
SELECT {c([n for n in REG_COLUMNS if n != 'lic_type_cat_code'])}, expiry_date,
       CASE WHEN lic_type_cat_code NOT IN ('', 'NA') THEN lic_type_cat_code END AS lic_type_cat_code FROM reg""",
    "src_registry_jdbc": """
SELECT CAST(o_orderkey AS VARCHAR) AS full_licence_id, CAST(o_orderdate + to_hours(o_orderkey % 24) + INTERVAL 5 HOUR AS DATE) AS purchase_date,
       CAST(o_orderdate + INTERVAL 5 HOUR AS DATE) AS start_date, CAST(year(o_orderdate) AS INT) AS lic_year FROM orders""",
    "src_responses_modern": f"SELECT {c(MODERN_COLUMNS)} FROM modern",
    "src_responses_legacy": "SELECT * FROM legacy",
    "src_responses_dispatch": f"""
SELECT licence_id, NULL AS surveykey, did_not_fish, area, method, lodge, guided, {c(M)}, NULL AS datefished FROM legacy
UNION ALL SELECT NULL, surveykey, did_not_fish, area, method, lodge, guided, {c(M)}, datefished FROM adjusted_kept""",
    "src_exclude": """
SELECT 'K' || licence_id AS licence_id, licence_type FROM clean
WHERE 'K' || licence_id NOT IN (SELECT survey_access_key FROM exclude_ids)""",
    "src_adjustments": "SELECT * FROM adjust",
    "src_vendor_sales": "SELECT * FROM vendor_sum",
    "prj_measure_columns": f"SELECT surveykey, {c(M)} FROM modern",
    "prj_sample_size_columns": f"SELECT {c(STRATA)}, {each(M, 'n_{m}')} FROM full_",
    "prj_drop_pii": f"SELECT licence_id, area, method, guided, lodge, did_not_fish, {c(M)} FROM legacy",
    "prj_licence_id_part": "SELECT full_licence_id, licence_id FROM dated",
    "prj_term_length": "SELECT full_licence_id, try_cast(substr(lic_type_cat_code, 2, 1) AS INT) AS term_length FROM reg",
    "prj_fix_start_date": "SELECT full_licence_id, start_date FROM fixed",
    "prj_null_bad_purchase": "SELECT full_licence_id, purchase_date FROM dated",
    "prj_fix_stamp_date": "SELECT full_licence_id, stamp_purchase_date FROM dated",
    "prj_effective_start": "SELECT full_licence_id, greatest(start_date, coalesce(purchase_date, start_date)) AS start_date FROM dated",
    "flt_unsold": "SELECT full_licence_id, fisher_id FROM reg WHERE fisher_id <> 1",
    "flt_licence_year": "SELECT full_licence_id, start_date FROM reg WHERE start_date BETWEEN DATE '2020-04-01' AND DATE '2021-03-31'",
    "flt_blank_and_family": "SELECT full_licence_id, lic_type_cat_code FROM reg WHERE lic_type_cat_code <> '' AND lic_type_cat_code NOT LIKE 'F%'",
    "prj_decode_category": """
SELECT full_licence_id, CASE left(lic_type_cat_code, 1) WHEN 'R' THEN 'Resident' ELSE 'Non-Resident' END AS resident_status,
       CASE right(lic_type_cat_code, 1) WHEN 'S' THEN 'Senior (65+)' WHEN 'A' THEN
            CASE WHEN length(lic_type_cat_code) = 3 THEN 'Adult (16-64)' ELSE 'All Ages above 15 (Pacific)' END
            ELSE 'All Ages above 15 (Pacific)' END AS age_category,
       CASE WHEN lic_type_cat_code LIKE '_A%' THEN 'Annual' WHEN lic_type_cat_code LIKE '_5%' THEN '5 Days'
            WHEN lic_type_cat_code LIKE '_3%' THEN '3 Days' ELSE '1 Day' END AS licence_type,
       lic_type_cat_code LIKE '_A%' AS annual_flag
FROM reg WHERE lic_type_cat_code <> '' AND lic_type_cat_code NOT LIKE 'F%'""",
    "prj_end_date": """
SELECT full_licence_id, start_date, CASE WHEN lic_type_cat_code LIKE '_A%' THEN DATE '2021-03-31'
       ELSE start_date + CAST(substr(lic_type_cat_code, 2, 1) AS INT) - 1 END AS end_date
FROM reg WHERE lic_type_cat_code <> '' AND lic_type_cat_code NOT LIKE 'F%'""",
    "prj_registry_clean": f"SELECT {c(CLEAN_COLUMNS)} FROM clean",
    "prj_stamp_flag": """
SELECT full_licence_id, stamp_purchase_date IS NOT NULL AND CASE WHEN licence_type = 'Annual'
       THEN stamp_purchase_date < DATE '2020-07-31' ELSE stamp_purchase_date <= DATE '2020-07-31' END AS stamp FROM clean""",
    "prj_draw_type": f"SELECT full_licence_id, {DRAW_STATUS.format(d1='2020-07-01', d2='2020-07-31')} AS draw_type FROM clean",
    "prj_purchase_period": """
SELECT full_licence_id, 'Not Specified' AS off,
       CASE WHEN NOT annual_flag THEN 'Not Specified' WHEN inside THEN 'In Survey' ELSE 'Pre-Survey' END AS no_split,
       CASE WHEN NOT annual_flag THEN 'Not Specified' WHEN inside THEN 'In Survey'
            WHEN start_date < DATE '2020-06-01' THEN 'Early Season' ELSE 'Late Season' END AS purchase_period
FROM (SELECT *, start_date >= DATE '2020-07-01' AND start_date < DATE '2020-07-31' AS inside FROM clean)""",
    "flt_eligible": "SELECT full_licence_id, start_date, end_date FROM july",
    "prj_collapse_age": """
SELECT full_licence_id, licence_type, CASE WHEN resident_status = 'Non-Resident' AND licence_type = 'Annual' AND (
         SELECT max(month_total) FROM vendor_sum WHERE resident_status = 'Non-Resident' AND licence_type = 'Annual'
            AND age_category = 'All Ages above 15 (Pacific)') > 0
       THEN 'All Ages above 15 (Pacific)' ELSE age_category END AS age_category FROM clean""",
    "prj_key_cleanup": """
SELECT trim(surveykey) AS surveykey, NULL AS licence_id FROM response_raw WHERE surveykey IS NOT NULL
UNION ALL SELECT NULL, trim(surveykey) || ' 1' FROM response_raw WHERE surveykey IS NOT NULL""",
    "prj_blank_to_null": "SELECT surveykey, nullif(trim(area), '') AS area, nullif(trim(method), '') AS method FROM response_raw",
    "prj_fishing_flags": "SELECT surveykey, didnotfish = 1 AS did_not_fish, didnotfish - 1 AS effort_days FROM response_raw",
    "flt_complete_modern": "SELECT surveykey, area, method FROM response_raw WHERE trim(completesurvey) = 'Complete'",
    "flt_complete_legacy": """
SELECT Licence_ID, DNF_1 IS NOT NULL AS did_not_fish, CASE WHEN DNF_1 IS NULL THEN COMPLETE ELSE 0 END AS effort_days
FROM legacy_raw WHERE COMPLETE = 1 OR DNF_1 IS NOT NULL""",
    "prj_zero_fill": """
SELECT surveykey, coalesce(salmon_chinook_kept, 0) AS salmon_chinook_kept, coalesce(halibut_kept, 0) AS halibut_kept,
       totaljuveniles FROM response_raw""",
    "prj_label_decode": """
SELECT surveykey, coalesce(l.label, 'Unspecified') AS lodge, coalesce(g.label, 'Unspecified') AS guided,
       coalesce(replace(k.label, 'rrawn', 'prawn'), 'Unspecified') AS checkcrabsprawns
FROM response_raw LEFT JOIN label_codes l ON l.col_name = 'lodge' AND l.code = fishedfromlodge
LEFT JOIN label_codes g ON g.col_name = 'guided' AND g.code = fishedwithguide
LEFT JOIN label_codes k ON k.col_name = 'checkcrabsprawns' AND k.code = fishedwithguide""",
    "prj_cast_to_schema": """
SELECT surveykey, did_not_fish, CAST(effort_days AS INT) AS effort_days, area, method,
       CAST(salmon_chinook_kept AS DOUBLE) AS salmon_chinook_kept, CAST(halibut_kept AS BIGINT) AS halibut_kept,
       DATE '2020-07-13' AS datefished FROM adjust""",
    "prj_parse_date_multi": """
SELECT o_orderkey, written, CAST(CASE WHEN o_orderkey % 5 = 2 THEN
         coalesce(try_strptime(written, '%m/%d/%Y'), try_strptime(written, '%d/%m/%Y'))
       ELSE o_orderdate END AS DATE) AS day
FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
        WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y')
        WHEN 3 THEN strftime(o_orderdate, '%d-%b-%Y') ELSE strftime(o_orderdate, '%Y%m%d') END AS written FROM orders)""",
    "prj_bool_to_yesno": "SELECT surveykey, lower(did_not_fish) AS did_not_fish FROM adjust_raw",
    "prj_ascii_fold": "SELECT doc_id, replace(strip_accents(text), 'ß', 'ss') AS text FROM documents",
    "join_inner_responses": f"""
SELECT r.licence_id, full_licence_id, licence_type, age_category, start_date, area, method, {c(M)}
FROM legacy r JOIN clean l ON r.licence_id = l.licence_id""",
    "join_right_responses": f"""
SELECT m.surveykey AS survey_access_key, {c(STRATA)}, {c([n for n in MODERN_COLUMNS if n != 'surveykey'])}
FROM modern m LEFT JOIN (SELECT * FROM july WHERE survey_access_key IS NOT NULL) j ON m.surveykey = j.survey_access_key""",
    "join_full_strata": f"SELECT {c(STRATA)}, lic_total, {c(AM)}, {c(M)}, {each(M, 'n_{m}')} FROM full_",
    "join_full_cells": f"""
SELECT {either('a', 'b', AM)}, at_lodge, with_guide FROM
  (SELECT {c(AM)}, count(*) AS at_lodge FROM joined WHERE lodge = 'Yes' GROUP BY {c(AM)}) a FULL JOIN
  (SELECT {c(AM)}, count(*) AS with_guide FROM joined WHERE guided = 'Yes' GROUP BY {c(AM)}) b ON {same('a', 'b', AM)}""",
    "join_full_totals": "SELECT * FROM all_pop",
    "join_full_raw": """
SELECT full_licence_id, coalesce(l.survey_access_key, m.surveykey) AS survey_access_key, lic_type_cat_code,
       area, method, salmon_chinook_kept
FROM licence_raw l FULL JOIN (SELECT * REPLACE (trim(surveykey) AS surveykey) FROM response_raw) m
  ON l.survey_access_key = m.surveykey""",
    "join_anti_period": f"SELECT full_licence_id, licence_id, draw_type, area, method, {c(M)} FROM joined_draw",
    "join_anti_exclude": f"SELECT {c(MODERN_COLUMNS)} FROM kept_modern",
    "join_anti_invalid_key": f"""
SELECT survey_access_key, {c(STRATA)}, {c([n for n in MODERN_COLUMNS if n != 'surveykey'])} FROM joined""",
    "join_replace_by_key": f"SELECT {c(MODERN_COLUMNS)}, datefished FROM adjusted",
    "join_semi_ids": f"SELECT {c(MODERN_COLUMNS)} FROM modern WHERE surveykey IN (SELECT survey_access_key FROM exclude_ids)",
    "join_calendar_range": "SELECT survey_id, full_licence_id, stamp, purchase_period FROM year_lic",
    "set_union_by_name": """
SELECT licence_id, end_date, licence_type, CAST(NULL AS DATE) AS start_date FROM clean WHERE annual_flag
UNION ALL SELECT licence_id, NULL, licence_type, start_date FROM clean WHERE NOT annual_flag""",
    "set_distinct": "SELECT DISTINCT surveykey, did_not_fish FROM modern",
    "set_diff_unknown_ids": "SELECT surveykey FROM modern EXCEPT SELECT survey_access_key FROM july",
    "set_union_periods": tagged(f"{c(STRATA)}, lic_total", "pop_year"),
    "agg_population": f"SELECT {c(STRATA)}, lic_total FROM pop",
    "agg_population_elic": "SELECT * FROM elic_pop",
    "agg_vendor_months": " UNION ALL ".join(
        f"SELECT '{2020 if i < 9 else 2021}-{(i + 3) % 12 + 1:02d}' AS survey_id, resident_status, licence_type, age_category, "
        f"CAST({_vendor_sum(MONTHS[:i])} AS DOUBLE) AS before_month_total, CAST({m} AS DOUBLE) AS month_total FROM vendor_wide"
        for i, m in enumerate(MONTHS)
    ),
    "agg_vendor_population": "SELECT * FROM vendor_pop",
    "agg_licence_population": "SELECT * FROM all_pop WHERE age_category <> 'Juvenile (under 16 years)'",
    "agg_respondent_sums": f"SELECT {c(STRATA)}, survey_access_key, {c(AM)}, {c(M)} FROM resp_",
    "agg_cell_sums": f"""
SELECT {c(STRATA)}, {c(DC)}, {each(M, 'CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}')}
FROM joined WHERE did_not_fish IS NOT NULL GROUP BY {c(STRATA)}, {c(DC)}""",
    "agg_cell_sums_draw": f"SELECT {c(DRAW)}, {c(DC)}, {c(M)} FROM sums_draw",
    "agg_sample_sizes": f"SELECT {c(STRATA)}, {each(M, 'n_{m}')} FROM sizes_adj",
    "agg_zero_padded_variance": f"""
SELECT l_suppkey, l_linestatus, l_returnflag, count(*) AS k, max(n) AS n,
       {r('(sum((l_quantity - total / n) ** 2) + (max(n) - count(*)) * (max(total) / max(n)) ** 2) / (CASE WHEN max(n) > 1 THEN max(n) - 1 END)', 4)} AS variance
FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS n,
        sum(l_quantity) OVER (PARTITION BY l_suppkey, l_linestatus, l_returnflag) AS total FROM lineitem)
GROUP BY l_suppkey, l_linestatus, l_returnflag""",
    "agg_specific_variance": rounded([*STRATA, *AM], M, "spec_"),
    "agg_specific_variance_long": f"""
SELECT {c([*STRATA, *AM])}, measure, round(variance, 6) + 0.0 AS variance FROM sparse_spec""",
    "agg_total_variance_long": f"""
SELECT '2020-07' AS survey_id, {either('e', 'v', [*AM, 'measure'])}, round(estimate, 4) + 0.0 AS estimate, round(variance, 4) + 0.0 AS variance
FROM (SELECT {c(AM)}, measure, coalesce(sum(total * (CAST(lic_total AS DOUBLE) / nullif(n, 0))), 0) AS estimate
      FROM sparse_all WHERE total <> 0 AND lic_total IS NOT NULL GROUP BY {c(AM)}, measure) e FULL JOIN
     (SELECT {c(AM)}, measure, coalesce(sum(CAST(lic_total AS DOUBLE) * (lic_total - n) / nullif(n, 0) * variance), 0) AS variance
      FROM sparse_all GROUP BY {c(AM)}, measure) v ON {same('e', 'v', [*AM, 'measure'])}""",
    "agg_total_variance": rounded(AM, M, "total_", 4),
    "agg_max_sample_size": f"SELECT {c(STRATA)}, {each(M, 'max(n_{m}) AS n_{m}')} FROM full_ WHERE n_effort_days IS NOT NULL GROUP BY {c(STRATA)}",
    "agg_expansion_rate": f"""
SELECT {c([*STRATA, *AM])}, lic_total, {each(M, r('CAST(coalesce(lic_total, 0) AS DOUBLE) / nullif(n_{m}, 0)') + ' AS n_{m}')} FROM full_""",
    "agg_estimate_detail": rounded([*STRATA, "lic_total", *AM], M, "detail_"),
    "agg_estimate_summary": summary("detail_"),
    "agg_survey_summary": f"SELECT {c(STRATA)}, lic_total, {c(AM)}, {c(M)} FROM full_",
    "agg_survey_sample_sizes": f"SELECT {c(STRATA)}, lic_total, {c(AM)}, {each(M, 'n_{m}')} FROM full_",
    "agg_unpivot_status": " UNION ALL ".join(
        f"SELECT surveykey, '{m}' AS col_name, count({m}) IN (0, count(*)) AS status FROM lines GROUP BY surveykey" for m in M[2:]
    ),
    "agg_first_n_text": """
SELECT licence_type, max(n) AS n_values, string_agg(full_licence_id, ', ' ORDER BY full_licence_id) FILTER (WHERE rank <= 10)
       || CASE WHEN max(n) > 10 THEN ', ...+' || CAST(max(n) - 10 AS VARCHAR) || ' more...' ELSE '' END AS sample
FROM (SELECT licence_type, full_licence_id, count(*) OVER (PARTITION BY licence_type) AS n,
        row_number() OVER (PARTITION BY licence_type ORDER BY full_licence_id) AS rank
      FROM (SELECT DISTINCT licence_type, full_licence_id FROM clean)) GROUP BY licence_type""",
    "dq_domain": violation(
        "domain", "ERROR", "area", "'area is not a known value'",
        "(SELECT DISTINCT nullif(trim(area), '') AS area FROM response_raw) WHERE area IS NULL OR area NOT IN ('Area 0', 'Area 1', 'Area 2')",
    ),
    "dq_category_codes": CATEGORY_CODES,
    "dq_mixed_dnf": violation(
        "mixed_dnf", "ERROR", "surveykey", "'fished and did not fish'",
        "(SELECT surveykey FROM lines GROUP BY surveykey HAVING count(DISTINCT did_not_fish) > 1)",
    ),
    "dq_mixed_null": MIXED_NULL,
    "dq_missing_key_ratio": " UNION ALL ".join(
        f"SELECT 'missing_key_ratio' AS \"check\", CASE WHEN gone > n * 0.01 THEN 'ERROR' ELSE 'WARNING' END AS severity, "
        f"'{key}' AS key, gone || ' of ' || n AS detail FROM (SELECT count(*) - count({key}) AS gone, count(*) AS n FROM {t}) WHERE gone > 0"
        for key, t in (("surveykey", "response_raw"), ("survey_access_key", "reg"))
    ),
    "dq_empty_input": " UNION ALL ".join(
        violation("empty_input", "ERROR", f"'{name}'", "'no rows'", f"(SELECT count(*) AS n FROM response_raw WHERE {test}) WHERE n = 0")
        for name, test in (("responses", "TRUE"), ("responses of Area 9", "area = 'Area 9'"))
    ),
    "dq_catch_without_area": violation(
        "catch_without_area", "ERROR", f"concat_ws(', ', {c(STRATA)}, method)", "CAST(caught AS VARCHAR)",
        f"(SELECT {c(STRATA)}, method, CAST(sum(effort_days + juv_effort_days + salmon_chinook_kept + halibut_kept) AS BIGINT) AS caught "
        f"FROM joined WHERE (method = 'Boat') IS NOT TRUE GROUP BY {c(STRATA)}, method) WHERE caught > 0",
    ),
    "dq_nonpositive_sample": " UNION ALL ".join(
        violation("nonpositive_sample", "ERROR", f"concat_ws(', ', {c(STRATA)})", f"'{m}'",
                  f"(SELECT DISTINCT {c(STRATA)} FROM joined EXCEPT SELECT {c(STRATA)} FROM joined WHERE lodge = 'Yes' AND guided = 'Yes' "
                  "AND age_category <> 'Senior (65+)')")
        for m in M
    ),
    "dq_unknown_ids": violation(
        "unknown_ids", "WARNING", "surveykey", "'not in the registry'",
        "(SELECT surveykey FROM modern EXCEPT SELECT survey_access_key FROM july)",
    ),
    "dq_registry_counts": REGISTRY_COUNTS,
    "dq_duplicate_licences": """
SELECT 'duplicate_licences' AS "check", 'INFO' AS severity, 'l_orderkey' AS key,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem)) AS VARCHAR) AS detail
FROM lineitem""",
    "dq_registry_regression": violation(
        "registry_regression", "ERROR", "full_licence_id", "'missing from the new snapshot'",
        "(SELECT full_licence_id FROM reg EXCEPT SELECT full_licence_id FROM clean)",
    ),
    "dq_period_same_month": """
SELECT survey_id, 'period_same_month' AS "check", 'WARNING' AS severity, survey_id AS key, 'start and end in different months' AS detail
FROM order_calendar WHERE year(survey_start) <> year(survey_end) OR month(survey_start) <> month(survey_end)""",
    "dq_split_date_in_year": """
SELECT survey_id, 'split_date_in_year' AS "check", 'ERROR' AS severity, survey_id AS key,
       CASE WHEN NOT period_stratify THEN 'split date without period strata'
            WHEN period_stratify_date < lic_start THEN 'split date before the licence year' ELSE 'split date after the licence year' END AS detail
FROM order_calendar WHERE period_stratify_date IS NOT NULL AND (NOT period_stratify OR period_stratify_date NOT BETWEEN lic_start AND lic_end)""",
    "dq_vendor_months": """
SELECT 'vendor_months' AS "check", 'ERROR' AS severity, key, detail FROM (
  VALUES ('Total', 'not a month'), ('March', 'month missing')) AS t(key, detail)
UNION ALL SELECT 'vendor_months', 'ERROR', 'July', 'no sales in the survey month'
FROM (SELECT sum(July * 0) AS sold FROM vendor_wide) WHERE coalesce(sold, 0) = 0""",
    "dq_missing_strata_cols": """
SELECT DISTINCT survey_id, 'missing_strata_cols' AS "check", 'WARNING' AS severity, key, 'column missing' AS detail
FROM modern_year, (VALUES ('checkcrabs'), ('checkprawns'), ('checkcrabsprawns'), ('guided'), ('lodge')) AS t(key)
WHERE key LIKE 'check%' OR (key = 'guided' AND survey_id < '2020-08') OR (key = 'lodge' AND survey_id = '2020-11')""",
    "fn_licence_year": """
SELECT o_orderkey, make_date(y, 4, 1) AS lic_start, make_date(y + 1, 3, 31) AS lic_end,
       CAST(y AS VARCHAR) || '-' || CAST((y + 1) % 100 AS VARCHAR) AS lic_label
FROM (SELECT o_orderkey, year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS y FROM orders)""",
    "fn_month_end": "SELECT o_orderkey, CAST(last_day(o_orderdate) AS DATE) AS month_end FROM orders",
    "job_month_inst": "SELECT '2020-07' AS survey_id, * FROM (" + summary("detail_kept") + ")",
    "job_month_inst_detail": "SELECT '2020-07' AS survey_id, * FROM (" + rounded([*STRATA, "lic_total", *DC], M, "detail_kept") + ")",
    "job_month_inst_specific_variance": "SELECT '2020-07' AS survey_id, * FROM (" + rounded([*STRATA, *DC], M, "spec_kept") + ")",
    "job_month_inst_variance": "SELECT '2020-07' AS survey_id, * FROM (" + rounded(DC, M, "total_kept", 4) + ")",
    "job_month_prepost": "SELECT '2017-07' AS survey_id, * FROM (" + summary("detail_draw_merged") + ")",
    "job_month_prepost_population": "SELECT '2017-07' AS survey_id, * FROM draw_pop",
    "job_month_prepost_variance": "SELECT '2017-07' AS survey_id, * FROM (" + rounded(AM, M, "total_draw_merged", 4) + ")",
    "job_annual": tagged(f"{c(AM)}, {c(M)}", "(" + summary("detail_year", ["survey_id"]) + ")"),
    "job_annual_variance": tagged(f"{c(AM)}, {c(M)}", "(" + rounded(["survey_id", *AM], M, "total_year", 4) + ")"),
    "job_export_responses": f"""
SELECT m.surveykey AS survey_access_key, full_licence_id, licence_type, stamp, did_not_fish, area, method, {c(M)}
FROM adjusted_kept m LEFT JOIN july j ON m.surveykey = j.survey_access_key""",
    "job_adjustment_template": f"""
SELECT surveykey, CASE WHEN did_not_fish THEN 'yes' ELSE 'no' END AS did_not_fish, area, method, lodge, guided, {c(M)}
FROM modern WHERE surveykey IN (SELECT survey_access_key FROM exclude_ids)""",
    "job_raw_export": """
SELECT full_licence_id, coalesce(l.survey_access_key, m.surveykey) AS survey_access_key, start_dt, lic_year,
       didnotfish, halibut_kept FROM licence_raw l FULL JOIN response_raw m ON l.survey_access_key = m.surveykey""",
    "job_refresh_registry": """
SELECT full_licence_id, start_dt, fisher_id, 'second' AS snapshot, TRUE AS refused FROM licence_raw WHERE fisher_id <> 1""",
    "job_adjustment_unknown_ids": violation(
        "unknown_template_ids", "WARNING", "key", "'not among the responses'",
        "(SELECT survey_access_key AS key FROM exclude_ids EXCEPT SELECT surveykey FROM modern)",
    ),
    "job_parse_id_list": """
SELECT CAST(l_orderkey AS VARCHAR) AS id FROM lineitem UNION SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem
UNION SELECT CAST(l_partkey AS VARCHAR) FROM lineitem""",
    "sink_csv": f"""
SELECT {c([n for n in REG_COLUMNS if n != 'lic_type_cat_code'])}, expiry_date,
       nullif(lic_type_cat_code, '') AS lic_type_cat_code FROM reg""",
    "sink_diagnostics": messages(" UNION ALL ".join([
        f"SELECT NULL AS survey_id, * FROM ({x})" for x in (REGISTRY_COUNTS, CATEGORY_CODES, MIXED_NULL)
    ] + [GROUPED_AGES, settings("(SELECT *, month(survey_start) > 6 AS stamp_stratify FROM order_calendar)")])),
    "job_month_log": f"""
SELECT '2020-07' AS survey_id, severity, code, detail, n, sample FROM ({diagnostics(
    violation("unknown_ids", "WARNING", "surveykey", "'not in the registry'",
              "(SELECT surveykey FROM adjusted_kept EXCEPT SELECT survey_access_key FROM july)"))})""",
}


UNKNOWN = "SELECT survey_id, 'unknown_ids' AS \"check\", 'WARNING' AS severity, surveykey AS key, 'not in the registry' AS detail FROM "
NO_COLUMNS = """SELECT survey_id, 'missing_strata_cols', 'WARNING', key, 'column missing'
FROM {source}, (VALUES ('checkcrabs'), ('checkprawns'), ('checkcrabsprawns')) AS t(key)"""
ONE = (["survey_id"], "{}")
EACH = (["year", "month_id", "month"], "(SELECT t.*, year(survey_start) AS year, month(survey_start) AS month_id, month "
        "FROM {} t JOIN (SELECT survey_id, survey_start, month FROM calendar) s ON t.survey_id = s.survey_id)")


def _intake(source, name, excluded):
    """Counts of the delivered responses of one survey or of several."""
    kept = f"surveykey IS NOT NULL AND NOT ({excluded})"
    return f"""
SELECT {name} AS survey_id, 'missing_key_ratio' AS "check", CASE WHEN gone > n * 0.01 THEN 'ERROR' ELSE 'WARNING' END AS severity,
       'surveykey' AS key, gone || ' of ' || n AS detail
FROM (SELECT {name}, count(*) - count(surveykey) AS gone, count(*) AS n FROM {source} GROUP BY {name}) WHERE gone > 0
UNION ALL SELECT {name}, 'excluded_responses', 'INFO', {name}, count(*) || ' rows of excluded keys' FROM {source}
WHERE surveykey IS NOT NULL AND ({excluded}) GROUP BY {name}
UNION ALL SELECT {name}, 'incomplete_responses', 'INFO', {name}, count(*) || ' rows of surveys not completed' FROM {source}
WHERE {kept} AND trim(completesurvey) <> 'Complete' GROUP BY {name}"""


JULY_DELIVERED = "(SELECT '2020-07' AS survey_id, * FROM response_raw)"
SQL["job_month"] = all_results("_job", "pop_one", ONE, DC, messages(" UNION ALL ".join([
    f"SELECT NULL AS survey_id, * FROM ({REGISTRY_COUNTS})",
    _intake(JULY_DELIVERED, "survey_id", "trim(surveykey) IN (SELECT survey_access_key FROM exclude_ids)"),
    NO_COLUMNS.format(source="(SELECT '2020-07' AS survey_id)"),
    settings("(SELECT '2020-07' AS survey_id, FALSE AS stamp_stratify, TRUE AS period_stratify, CAST(NULL AS DATE) AS period_stratify_date)"),
    UNKNOWN + "(SELECT '2020-07' AS survey_id, * FROM (SELECT surveykey FROM adjusted_kept EXCEPT SELECT survey_access_key FROM july))",
])))
SUMMER = "(SELECT * FROM response_year WHERE survey_id BETWEEN '2020-06' AND '2020-09')"
SQL["job_annual_run"] = all_results("_mixed", "pop_mixed", EACH, DC, messages(" UNION ALL ".join([
    f"SELECT NULL AS survey_id, * FROM ({REGISTRY_COUNTS})",
    "SELECT NULL, 'no_exclusions', 'WARNING', '(none)', 'nobody is excluded'",
    _intake(SUMMER, "survey_id", "FALSE"), NO_COLUMNS.format(source="calendar_mixed"), settings("calendar_mixed"),
    UNKNOWN + "(SELECT survey_id, surveykey FROM modern_year WHERE survey_id BETWEEN '2020-06' AND '2020-09' "
    "EXCEPT SELECT survey_id, survey_access_key FROM year_lic)",
])), SETS)
SQL["sink_bundle"] = all_results("_one", "pop_one", ONE, AM, messages(
    UNKNOWN + "(SELECT '2020-07' AS survey_id, * FROM (SELECT surveykey FROM modern EXCEPT SELECT survey_access_key FROM july))"
))
SQL["sink_annual"] = all_results("_year", "pop_year", EACH, AM, messages(
    UNKNOWN + "(SELECT survey_id, surveykey FROM modern_year EXCEPT SELECT survey_id, survey_access_key FROM year_lic)"
))


def needs(sql: str) -> list[str]:
    """Blocks that a statement reads, those they read themselves first."""
    order: list[str] = []
    for name in re.findall(r"(?:FROM|JOIN)\s+\(?(\w+)", sql):
        if name in BLOCKS and name not in order:
            order += [n for n in [*needs(BLOCKS[name]), name] if n not in order]
    return order


def statement(name: str) -> str:
    """The oracle of one query as a single statement."""
    body = SQL[name]
    blocks = ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in needs(body))
    return f"WITH {blocks}\nSELECT * FROM ({body})" if blocks else body
