"""Shipments derived from the order tables, as a DataFrame and as the same SQL for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargosift.scratch import spread

CODES = ("US", "CA", "GB", "DE", "SG", "HK", "AE", "PA", "TR", "RU", "IR", "KP", "SY", "CU", "MM", "VE", "PK", "CN", "BY", "XX", "YY", "ZZ", "AA", "BB", "CC")
CELLS = ("severe", " Very High ", "moderate", "minimal", "high", "odd", "1", "yes", "2", "55", "-3", "full", "partial", "blacklist", "enhanced monitoring", "ok", "x")

# One text for both engines; {code:...} is replaced by each engine's list access.
_SHIPMENTS = """
SELECT id, description,
  CASE WHEN k % 23 = 0 THEN NULL WHEN k % 31 = 0 THEN lower({o}) ELSE {o} END AS origin_country,
  CASE WHEN k % 29 = 0 THEN NULL WHEN k % 97 = 0 THEN {o} ELSE {d} END AS destination_country,
  CASE WHEN k % 37 = 0 THEN NULL WHEN k % 43 = 0 THEN 'BLOCKED INDUSTRIES, LTD.' WHEN k % 47 = 0 THEN 'Blockd Industries Ltd' WHEN k % 101 = 0 THEN 'Prohibitd Tradng Company ' || CAST(k % 10 AS {text}) WHEN k % 103 = 0 THEN 'Corp. of Holding' ELSE c_name END AS consignee,
  CASE WHEN k % 37 = 0 OR k % 53 = 0 THEN NULL WHEN k % 59 = 0 THEN 'Sanctioned Holdings' WHEN k % 107 = 0 THEN 'Sanctiond Hldings ' || CAST(k % 1000 AS {text}) WHEN k % 109 = 0 THEN 'Industries, ' || s_name ELSE s_name END AS shipper,
  CASE WHEN k % 61 = 0 THEN NULL WHEN k % 67 = 0 THEN CAST(0 AS DOUBLE) WHEN k % 71 = 0 THEN CAST(50000 AS DOUBLE) WHEN k % 5 = 0 THEN price * 20 ELSE price END AS declared_value,
  CASE WHEN k % 7 = 0 THEN NULL ELSE 'USD' END AS declared_currency,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 73 = 0 THEN 'abc' WHEN k % 79 = 0 THEN '84' ELSE lpad(CAST(part % 100 AS {text}), 2, '0') || lpad(CAST(supp % 100 AS {text}), 2, '0') || '.10' END AS hs_code,
  CASE WHEN k % 83 = 0 THEN CAST(0 AS DOUBLE) ELSE qty END AS weight_kg,
  CASE k % 4 WHEN 0 THEN {list0} WHEN 1 THEN {list1} WHEN 2 THEN {list2} ELSE {list3} END AS transit_countries,
  CASE k % 6 WHEN 0 THEN {m} WHEN 1 THEN {o} END AS country_of_manufacture,
  CASE k % 9 WHEN 0 THEN {f} WHEN 1 THEN {d} END AS final_destination,
  qty / 10 AS l0, disc * 90 AS l1, tax * 20 AS l2, k
FROM (
  SELECT CAST(l_orderkey AS {text}) || '-' || CAST(l_linenumber AS {text}) || '-' || CAST(l_partkey AS {text}) || '-' || CAST(l_suppkey AS {text}) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS {text}) AS id,
    l_orderkey * 7 + l_linenumber * 3 + l_partkey + l_suppkey AS k, l_partkey AS part, l_suppkey AS supp,
    l_extendedprice AS price, l_quantity AS qty, l_discount AS disc, l_tax AS tax, s_nationkey AS sn, c_nationkey AS cn, c_name, s_name,
    CASE WHEN (l_orderkey * 7 + l_linenumber * 3 + l_partkey + l_suppkey) % 41 = 0 THEN 'abc'
         WHEN (l_orderkey * 7 + l_linenumber * 3 + l_partkey + l_suppkey) % 13 = 0 THEN p_name || ' Drone encryption unit'
         WHEN (l_orderkey * 7 + l_linenumber * 3 + l_partkey + l_suppkey) % 17 = 0 THEN p_name || ' Ivory carving'
         WHEN (l_orderkey * 7 + l_linenumber * 3 + l_partkey + l_suppkey) % 19 = 0 THEN p_name || ' AK47 part, night vision drones'
         ELSE p_name || ' ' || lower(p_type) END AS description
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey) AS wide
"""


def _text(pick, listed, text: str) -> str:
    stop = lambda n: listed([pick(f"(k + {i}) % 25") for i in range(1, n + 1)])
    return _SHIPMENTS.format(text=text, o=pick("sn % 25"), d=pick("cn % 25"), m=pick("(sn + 1) % 25"), f=pick("(cn + 2) % 25"), list0=listed([]), **{f"list{n}": stop(n) for n in (1, 2, 3)})


SPARK_SQL = _text(lambda at: "element_at(array(" + ", ".join(f"'{c}'" for c in CODES) + f"), CAST({at} AS INT) + 1)", lambda xs: f"CAST(array({', '.join(xs)}) AS ARRAY<STRING>)", "STRING")
DUCK_SQL = _text(lambda at: "([" + ", ".join(f"'{c}'" for c in CODES) + f"])[CAST({at} AS INTEGER) + 1]", lambda xs: f"CAST([{', '.join(xs)}] AS VARCHAR[])", "VARCHAR")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipments of a table folder, with logits (three numbers) and the slice key k."""
    names = ("lineitem", "orders", "customer", "supplier", "part")
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    wanted = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    frames["lineitem"] = spread(frames["lineitem"].select(*wanted))
    # Orders meet their customers first, so that the far more and wider lineitems are not shuffled once more by customer.
    frames["orders"] = frames["orders"].select("o_orderkey", "o_custkey").join(frames.pop("customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    frames["part"] = frames["part"].select("p_partkey", "p_name", F.lower("p_type").alias("p_type"))  # once a part
    rows = spark.sql(SPARK_SQL.replace("lower(p_type)", "p_type").replace("FROM lineitem", "FROM {lineitem}").replace("JOIN orders", "JOIN {orders}").replace("JOIN customer ON o_custkey = c_custkey", "").replace("JOIN supplier", "JOIN {supplier}").replace("JOIN part ON", "JOIN {part} ON"), **frames)
    return rows.selectExpr("*", "array(l0, l1, l2) AS logits").drop("l0", "l1", "l2")
