"""Licence-shaped views derived from the driver's star-schema tables.

The reference reads a licence register (one row per business) and a table of
stored address-lookup responses.  Our test data is a TPC-H-like star schema, so
the register is derived from it: one licence per order, regions from the
nation/region dimension, names drawn from a fixed set of templates that carry
every quirk of the name-cleaning rules.  The SQL text is shared verbatim with
the DuckDB oracle (both engines parse it; only the table references are
bound differently), so the two sides of every parity check start from the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import read_source

# The 26 business-name templates and the derivation rule of the
# licence view (see FIXTURES.md section 3).
LIC_SQL = """
SELECT o_orderkey AS unique_id, r_name AS sido, n_name AS sigungu,
  concat(n_name, '-', CAST(o_custkey % 20 AS varchar(20))) AS dong, c_mktsegment AS service,
  concat(c_mktsegment, '/', o_orderpriority) AS subtype, CAST(o_orderdate AS date) AS license_date,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS date) + CAST(o_orderkey % 3000 AS int) END AS closure_date,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS closed,
  CASE o_orderkey % 26
    WHEN 0 THEN '(주)씨유 강남점' WHEN 1 THEN 'GS25역삼점' WHEN 2 THEN '지에스25' WHEN 3 THEN '이디야'
    WHEN 4 THEN '이디야 홍대센터' WHEN 5 THEN '맘스터치 (moms touch)' WHEN 6 THEN '(CAFE ONE)'
    WHEN 7 THEN '주식회사  한빛' WHEN 8 THEN '주' WHEN 9 THEN '*' WHEN 10 THEN '김밥천국-한시적'
    WHEN 11 THEN '김밥천국신촌점' WHEN 12 THEN '(주' WHEN 13 THEN '1234' WHEN 14 THEN '12345'
    WHEN 15 THEN 'a,b/c & d' WHEN 16 THEN 'cu 편의점' WHEN 17 THEN '현대마트분점' WHEN 18 THEN '현대'
    WHEN 19 THEN NULL WHEN 20 THEN '   ' WHEN 21 THEN '한글 abc 나 d' WHEN 22 THEN '이디야커피 (본점)'
    WHEN 23 THEN '가' WHEN 24 THEN 'cu-한강공원점' ELSE '(null)' END AS bizname,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(190000 + o_custkey % 20000 AS double) END AS x_5174,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(440000 + o_orderkey % 20000 AS double) END AS y_5174,
  CASE WHEN o_orderkey % 7 <> 0 THEN concat(r_name, '  ', n_name, ' (dong', CAST(o_custkey % 20 AS varchar(20)),
    ', bldg ', CAST(o_orderkey % 9 AS varchar(20)), ')') END AS road_address
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
  JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# Stored address-lookup payloads, one per licence; every 11th is a miss.
RESPONSES_SQL = """
SELECT unique_id AS uid,
  CASE WHEN unique_id % 11 = 0 THEN '({{"results":{{"common":{{"totalCount":"0"}},"juso":[]}}}})'
  ELSE concat('({{"results":{{"common":{{"totalCount":"1","currentPage":"1","countPerPage":"1","errorCode":"0","errorMessage":"ok"}},"juso":[{{"siNm":"',
    sido, '","sggNm":"', sigungu, '","emdNm":"', dong, '"}}]}}}})') END AS payload
FROM {lic}
"""


def licences(spark: SparkSession, sf_dir: str, by_key: bool = False) -> DataFrame:
    """The licence register derived from orders/customer/nation/region.

    Plan shape: orders and customer are the only large inputs and meet in one
    join on the customer key; nation (25 rows) and region (5 rows) are left to
    the planner, which broadcasts them from their file statistics.  The inputs
    are bound as query parameters, so no temp view of the caller's session is
    created or replaced.

    ``by_key`` hash-partitions the register by licence id, for pipelines that
    join on it several times; row-local work keeps the partitions of the scan.
    """
    t = {n: read_source(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    out = spark.sql(LIC_SQL, **t)
    # no explicit count: AQE sizes the partitions from the data
    return out.repartition("unique_id") if by_key else out


def address_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored lookup payloads ``(uid, payload)`` keyed by licence id."""
    return spark.sql(RESPONSES_SQL, lic=licences(spark, sf_dir))


def oracle_prelude() -> str:
    """The CTE header that re-derives ``lic`` and ``responses`` in DuckDB."""
    lic = LIC_SQL.format(orders="orders", customer="customer", nation="nation", region="region")
    return f"WITH lic AS ({lic}), responses AS ({RESPONSES_SQL.format(lic='lic')})\n"
