"""Views over the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "events", "documents", "pages")

GRID_VARS = ("chl", "kd490", "pp", "zsd", "sst", "sss", "current_speed")

VIEWS = {
    "grid": """
SELECT time, CAST(18+i AS DOUBLE) AS lat, CAST(-98+j AS DOUBLE) AS lon,
  CASE WHEN (i*7+j*3+EXTRACT(MONTH FROM time)) % 11 = 0 THEN NULL ELSE CAST(q AS DOUBLE)/CAST(n*10 AS DOUBLE) END AS chl,
  CASE WHEN (i*5+j*2+EXTRACT(MONTH FROM time)) % 13 = 0 THEN NULL ELSE CAST(d+2 AS DOUBLE)/CAST(n*20 AS DOUBLE) END AS kd490,
  CAST(p AS DOUBLE)/CAST(n*10000 AS DOUBLE) AS pp,
  CAST(x+10 AS DOUBLE)/CAST(n AS DOUBLE) AS zsd,
  CAST(q+n*20 AS DOUBLE)/CAST(n*2 AS DOUBLE) AS sst,
  CAST(n*300+x AS DOUBLE)/CAST(n*10 AS DOUBLE) AS sss,
  CAST(d AS DOUBLE)/CAST(n*10 AS DOUBLE) AS current_speed
FROM (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time,
    CAST(l_suppkey % 12 AS INT) AS i, CAST(l_partkey % 10 AS INT) AS j, COUNT(*) AS n,
    SUM(CAST(l_quantity AS BIGINT)) AS q,
    SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)) AS p,
    SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS d,
    SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS x
  FROM lineitem GROUP BY 1, 2, 3) o""",
    "grid_b": """
SELECT time, CAST(18+i AS DOUBLE) AS lat, CAST(-97+j AS DOUBLE) AS lon,
  CAST(x AS DOUBLE)/CAST(n*100 AS DOUBLE) AS cdm, CAST(d AS DOUBLE)/CAST(n*1000 AS DOUBLE) AS bbp
FROM (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time,
    CAST(l_suppkey % 12 AS INT) AS i, CAST(l_partkey % 10 AS INT) AS j, COUNT(*) AS n,
    SUM(CAST(ROUND(l_discount*100) AS BIGINT)) AS d, SUM(CAST(ROUND(l_tax*100) AS BIGINT)) AS x
  FROM lineitem GROUP BY 1, 2, 3) o""",
    "series": """
SELECT event_type AS cell, CAST(ts AS DATE) AS time,
  CASE WHEN EXTRACT(DAY FROM CAST(ts AS DATE)) % 7 = 0 THEN NULL
       ELSE CAST(SUM(CAST(ROUND(value*100) AS BIGINT)) AS DOUBLE)/CAST(COUNT(*)*100 AS DOUBLE) END AS v
FROM events GROUP BY event_type, CAST(ts AS DATE)""",
    "samples": """
SELECT o_orderkey AS id,
  CAST(o_orderkey % 600 AS DOUBLE)/CAST(10 AS DOUBLE) AS chl,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(ROUND(o_totalprice*100) AS BIGINT) % 120000 AS DOUBLE)/CAST(100 AS DOUBLE) END AS pp,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE)/CAST(100 AS DOUBLE) END AS kd490,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey % 50 AS DOUBLE)/CAST(100 AS DOUBLE) END AS diato,
  o_orderdate AS ts
FROM orders""",
    "kv": """
SELECT doc_id AS id,
  concat('chl=', CAST(doc_id % 20 AS VARCHAR(20)), '.5 PP=', CAST(doc_id * 3 AS VARCHAR(20)),
         CASE WHEN doc_id % 4 = 0 THEN ' KD490=bad' ELSE ' KD490=0.2' END) AS line
FROM documents""",
    "lists": """
SELECT doc_id AS id,
  concat(CAST(doc_id % 20 AS VARCHAR(20)), '.5, ', CAST(doc_id % 7 AS VARCHAR(20)),
         CASE WHEN doc_id % 5 = 0 THEN ',x' ELSE ',0.25' END) AS line
FROM documents""",
    "urls": """
SELECT page_id AS id,
  CASE page_id % 3
    WHEN 0 THEN concat('https://host.example/file/d/A', CAST(page_id AS VARCHAR(20)), '_x/view?usp=sharing')
    WHEN 1 THEN concat('https://host.example/open?id=B', CAST(page_id AS VARCHAR(20)), '&name=f', CAST(page_id AS VARCHAR(20)), '.nc')
    ELSE url END AS url
FROM pages""",
    # variable lists per file, from the kinds of events and the ids that occur in them
    "expected": """
SELECT DISTINCT event_type AS file, concat('v', CAST(event_id % 12 AS VARCHAR(20)), '_mean') AS var FROM events""",
    "actual": """
SELECT DISTINCT event_type AS file, concat('V', CAST(user_id % 7 + length(event_type) % 3 AS VARCHAR(20))) AS var FROM events""",
    "listing": """
SELECT event_type AS file, event_id AS pos,
  CASE WHEN user_id % 10 = 3 THEN concat('my_chl_', CAST(user_id AS VARCHAR(20)))
       ELSE concat('sst_', CAST(user_id AS VARCHAR(20))) END AS var
FROM events""",
    "points": """
SELECT DISTINCT l_orderkey % 90 AS time_idx, l_suppkey % 14 AS lat_idx, l_partkey % 12 AS lon_idx FROM lineitem""",
}

# Helper views of the DuckDB side only.
ORACLE_VIEWS = {
    "dense": "SELECT t.time, la.lat, lo.lon, " + ", ".join(f"g.{v}" for v in GRID_VARS) + """
FROM (SELECT DISTINCT time FROM grid) t CROSS JOIN (SELECT DISTINCT lat FROM grid) la
CROSS JOIN (SELECT DISTINCT lon FROM grid) lo
LEFT JOIN grid g ON g.time = t.time AND g.lat = la.lat AND g.lon = lo.lon""",
    "scored": """
SELECT *, CASE WHEN chl < 1 THEN 'LOW' WHEN chl < 3 THEN 'MEDIUM' WHEN chl IS NOT NULL THEN 'HIGH' END AS level,
  CAST(CASE WHEN chl < 1 THEN 0.85 WHEN chl < 3 THEN 0.75 WHEN chl IS NOT NULL THEN 0.80 END AS DOUBLE) AS confidence
FROM samples""",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the views as a DataFrame."""
    text = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    for t in used:
        text = re.sub(rf"(FROM )({t})\b", r"\1{\2}", text)
    return spark.sql(text, **{t: table(spark, folder, t) for t in used})


def oracle(body: str) -> str:
    """A query text with the views it uses put in front."""
    every = {**VIEWS, **ORACLE_VIEWS}
    order: list[str] = []

    def visit(text: str) -> None:
        for name, sql in every.items():
            if name not in order and re.search(rf"(?i)\b(from|join)\s+{name}\b", text):
                visit(sql)
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    heads = ",\n".join(f"{n} AS ({every[n]})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"
