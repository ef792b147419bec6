"""Registry, responses and side inputs derived from the given tables.

The SQL runs unchanged on Spark and DuckDB, so the same inputs feed the queries and their oracles. All of it
covers whole tables: which respondents are incomplete, excluded or adjusted follows from the data.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from creelstat.config import LicenceYear, SurveyPeriod, months_of
from creelstat.operators import registry as reg
from creelstat.operators import responses as resp
from creelstat.operators import strata
from creelstat.operators.vendor import vendor_summary
from creelstat.sources import normalise_registry

BASE_TABLES = ["orders", "customer", "lineitem", "supplier", "part", "documents", "events"]

YEAR = LicenceYear.ending(dt.date(2021, 3, 31))
JULY = SurveyPeriod.month_from(dt.date(2020, 7, 1), period_stratify=True)
MONTHLY = months_of(YEAR, period_stratify=True)
# The year before instant selection: the same dates in 2017, for the pre/post analysis.
DRAW_YEAR = LicenceYear.ending(dt.date(2018, 3, 31))
DRAW_JULY = SurveyPeriod.month_from(dt.date(2017, 7, 1))

LABELS = {
    "area": {1: "Area 1", 2: "Area 2", 3: "Area 3"},
    "method": {1: "Boat", 2: "Shore"},
    "month": {7: "July"},
    "lodge": {1: "Yes", 2: "No"},
    "guided": {1: "Yes", 2: "No"},
    "checkcrabsprawns": {1: "Checked rrawn trap", 2: "No"},
}


def _licence_raw(year: int) -> str:
    return f"""
SELECT 'BC-20-S-' || lpad(CAST(o.o_orderkey AS STRING), 8, '0') AS full_licence_id,
       CASE WHEN o.o_orderkey % 50 = 1 THEN DATE '{year - 2}-01-01'
            ELSE DATE '{year}-03-20' + CAST(o.o_orderkey % 380 AS INT) END AS start_dt,
       CASE WHEN o.o_orderkey % 4 = 0 THEN DATE '{year + 1}-03-31'
            ELSE DATE '{year}-03-20' + CAST(o.o_orderkey % 380 AS INT)
                 + CASE o.o_orderkey % 4 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END END AS expiry_dt,
       CASE WHEN o.o_orderkey % 41 = 0 THEN DATE '2010-01-01'
            ELSE DATE '{year}-03-20' + CAST(o.o_orderkey % 380 AS INT) - 3
                 + CAST(o.o_orderkey % 6 AS INT) END AS purchase_dtt,
       CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
            WHEN o.o_orderkey % 43 = 0 THEN DATE '2010-01-01'
            ELSE DATE '{year}-03-25' + CAST(o.o_orderkey % 370 AS INT) END AS stamp_purchase_dtt,
       CASE WHEN o.o_orderkey % 101 = 0 THEN ''
            ELSE (CASE WHEN o.o_orderkey % 89 = 0 THEN 'F' WHEN c.c_nationkey < 12 THEN 'R' ELSE 'N' END)
              || (CASE o.o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN '5' WHEN 2 THEN '3' ELSE '1' END)
              || (CASE o.o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'S' ELSE '' END) END AS lic_type_cat_code,
       CASE WHEN o.o_orderkey % 10 = 9 THEN NULL ELSE 'K' || CAST(o.o_orderkey AS STRING) END AS survey_access_key,
       {year} AS lic_year,
       CASE WHEN o.o_orderkey % 97 = 0 THEN 1 ELSE o.o_custkey + 2 END AS fisher_id
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""


def _response_columns() -> str:
    return """
       CASE WHEN l_orderkey % 499 = 0 THEN NULL ELSE ' K' || CAST(l_orderkey AS STRING) || ' ' END AS surveykey,
       CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 2 END AS didnotfish,
       CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 3 = 1 THEN 'Incomplete' ELSE 'Complete ' END AS completesurvey,
       CASE WHEN l_orderkey % 7 = 0 THEN ' ' ELSE 'Area ' || CAST(l_suppkey % 5 AS STRING) END AS area,
       CASE WHEN l_orderkey % 7 = 0 THEN '' WHEN l_linestatus = 'F' THEN 'Boat' ELSE 'Shore' END AS method,
       CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE NULL END AS fishedfromlodge,
       CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 2 END AS fishedwithguide,
       CASE WHEN l_linenumber = 1 THEN 1 ELSE NULL END AS totaljuveniles,
       CASE WHEN l_orderkey % 7 = 0 OR l_quantity < 10 THEN NULL ELSE CAST(l_quantity AS INT) END AS salmon_chinook_kept,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 4 AS INT) END AS halibut_kept"""


def _vendor_months() -> str:
    names = {
        4: "April", 5: "May", 6: "June", 7: "July", 8: "August", 9: "September",
        10: "October", 11: "November", 12: "December", 1: "January", 2: "February", 3: "March",
    }
    return ",\n       ".join(
        f"nullif(CAST(sum(CASE WHEN month(l_shipdate) = {i} THEN 1 ELSE 0 END) AS BIGINT), 0) AS {name}"
        for i, name in names.items()
    )


VIEWS = {
    "licence_raw": _licence_raw(2020),
    "licence_draw": _licence_raw(2017),
    "response_raw": f"SELECT {_response_columns()}\nFROM lineitem",
    "response_year": f"""
SELECT CASE WHEN month(l_shipdate) >= 4 THEN '2020-' ELSE '2021-' END
       || lpad(CAST(month(l_shipdate) AS STRING), 2, '0') AS survey_id, {_response_columns()}
FROM lineitem""",
    "legacy_raw": """
SELECT CASE WHEN l_orderkey % 499 = 0 THEN NULL ELSE ' ' || CAST(l_orderkey AS STRING) || ' ' END AS Licence_ID,
       ' F' AS First_name, 'L ' AS Last_name, ' a@example.org ' AS AMAIL,
       CASE WHEN l_orderkey % 7 = 0 AND l_orderkey % 3 <> 1 THEN 1 ELSE NULL END AS DNF_1,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey % 3 + 1 AS INT) END AS REPZONE,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS REPMETHOD,
       2014 AS REPYEAR, 7 AS REPMONTH, CAST(1001 + l_partkey % 28 AS INT) AS REPDAY,
       CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 3 = 1 THEN 0 ELSE 1 END AS COMPLETE,
       CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE NULL END AS QLODGE,
       CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 2 END AS QGUIDE,
       CASE WHEN l_linenumber = 1 THEN 1 ELSE NULL END AS AJUVEPRES,
       CASE WHEN l_orderkey % 7 = 0 OR l_quantity < 10 THEN NULL ELSE CAST(l_quantity AS INT) END AS ASALMON_CHINOOK_KEPT,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 4 AS INT) END AS AHALIBUT_KEPT
FROM lineitem""",
    "exclude_ids": """
SELECT 'K' || CAST(o_orderkey AS STRING) AS survey_access_key FROM orders WHERE o_totalprice > 480000""",
    "adjust_raw": """
SELECT 'K' || CAST(o_orderkey AS STRING) AS surveykey,
       CASE WHEN o_orderstatus = 'F' THEN 'YES' ELSE 'No' END AS did_not_fish,
       CASE WHEN o_orderstatus = 'F' THEN '0' ELSE '1' END AS effort_days,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Area 1' END AS area,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Boat' END AS method,
       CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE '2' END AS salmon_chinook_kept,
       '1' AS halibut_kept,
       '13/07/2020' AS datefished
FROM orders WHERE o_totalprice < 60000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
    "vendor_wide": f"""
SELECT CASE WHEN s_nationkey < 12 THEN 'Resident' ELSE 'Non-Resident' END AS resident_status,
       CASE l_partkey % 4 WHEN 0 THEN 'Annual' WHEN 1 THEN '5 Days' WHEN 2 THEN '3 Days' ELSE '1 Day' END AS licence_type,
       CASE WHEN l_quantity < 20 THEN 'Adult (16-64)' WHEN l_quantity < 35 THEN 'Senior (65+)'
            WHEN l_quantity < 45 THEN 'All Ages above 15 (Pacific)' ELSE 'Juvenile (under 16 years)' END AS age_category,
       {_vendor_months()}
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
GROUP BY 1, 2, 3""",
    "label_codes": """
SELECT * FROM (VALUES
  ('area', 1, 'Area 1'), ('area', 2, 'Area 2'), ('area', 3, 'Area 3'),
  ('method', 1, 'Boat'), ('method', 2, 'Shore'), ('month', 7, 'July'),
  ('lodge', 1, 'Yes'), ('lodge', 2, 'No'), ('guided', 1, 'Yes'), ('guided', 2, 'No'),
  ('checkcrabsprawns', 1, 'Checked rrawn trap'), ('checkcrabsprawns', 2, 'No')
) AS t(col_name, code, label)""",
    "order_calendar": """
SELECT CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS survey_id,
       CAST(min(o_orderdate) AS DATE) AS survey_start,
       CAST(CASE WHEN max(o_totalprice) > 490000 THEN max(l_shipdate) ELSE max(o_orderdate) END AS DATE) AS survey_end,
       make_date(min(year(o_orderdate)) - CASE WHEN min(month(o_orderdate)) < 4 THEN 1 ELSE 0 END, 4, 1) AS lic_start,
       make_date(min(year(o_orderdate)) + CASE WHEN min(month(o_orderdate)) < 4 THEN 0 ELSE 1 END, 3, 31) AS lic_end,
       count(*) % 3 <> 0 AS period_stratify,
       CASE count(*) % 5 WHEN 0 THEN NULL WHEN 1 THEN DATE '1997-07-01'
            ELSE CAST(max(l_shipdate) AS DATE) END AS period_stratify_date
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY year(o_orderdate), month(o_orderdate)""",
}


def with_views(*names: str) -> str:
    """The named inputs as the head of a WITH clause."""
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)


class Fixture:
    """Inputs of the queries at one scale, as lazy frames. ``prepared`` holds some of them as written tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, prepared: dict[str, str] | None = None) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self.prepared = prepared or {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name in self.prepared:
            return self.spark.read.parquet(self.prepared[name])
        for table in BASE_TABLES:
            if re.search(rf"\b{table}\b", VIEWS[name]):
                self.base(table).createOrReplaceTempView(table)
        return self.spark.sql(VIEWS[name])

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)

    @cached_property
    def registry(self) -> DataFrame:
        return normalise_registry(self.licence_raw)

    @cached_property
    def clean(self) -> DataFrame:
        return reg.clean_registry(self.registry, YEAR)

    @cached_property
    def july(self) -> DataFrame:
        """Licences eligible for July with stamp and purchase period."""
        return strata.period_strata(strata.eligible(self.clean, [JULY]))

    @cached_property
    def modern(self) -> DataFrame:
        return resp.normalise_modern(self.response_raw, LABELS)

    @cached_property
    def legacy(self) -> DataFrame:
        return resp.normalise_legacy(self.legacy_raw, LABELS)

    @cached_property
    def adjustments(self) -> DataFrame:
        return resp.normalise_adjustments(self.adjust_raw)

    @cached_property
    def draw_clean(self) -> DataFrame:
        return reg.clean_registry(normalise_registry(self.licence_draw), DRAW_YEAR)

    @cached_property
    def draw_licences(self) -> DataFrame:
        """Licences eligible for July of the draw year with their draw."""
        eligible = strata.eligible(self.draw_clean, [DRAW_JULY])
        return strata.draw_type(eligible, DRAW_JULY.start, DRAW_JULY.end)

    @cached_property
    def draw_sales(self) -> DataFrame:
        return vendor_summary(self.vendor_wide, [DRAW_JULY], DRAW_YEAR)
