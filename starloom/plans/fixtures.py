"""Views over the driver tables that stand for catalogs, papers, regions and alerts (see FIXTURES.md).

The text runs unchanged in Spark and in the oracle, so both start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.functions.tables import table

STARS = """
SELECT CAST(100000000000000000 + o_orderkey AS STRING) AS source_id,
 CASE WHEN o_orderkey % 997 = 0 THEN NULL ELSE CAST(((o_custkey * 104729) % 360000 + (o_orderkey * 13) % 100) % 360000 AS DOUBLE) / 1000.0E0 END AS ra,
 CAST((o_custkey * 7919) % 60001 + (o_orderkey * 29) % 100 AS DOUBLE) / 1000.0E0 - 30.0E0 AS dec,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST((o_custkey * 31 + o_orderkey) % 4000 - 40 AS DOUBLE) / 100.0E0 END AS parallax,
 CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST((o_orderkey * 13) % 300 AS DOUBLE) / 100.0E0 END AS parallax_error,
 CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST((o_orderkey * 17) % 24000 - 12000 AS DOUBLE) / 100.0E0 END AS pmra,
 CAST(NULL AS DOUBLE) AS pmra_error,
 CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST((o_orderkey * 19) % 20000 - 10000 AS DOUBLE) / 100.0E0 END AS pmdec,
 CAST(NULL AS DOUBLE) AS pmdec_error,
 CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST((o_orderkey * 43) % 1800 AS DOUBLE) / 100.0E0 + 3.0E0 END AS phot_g_mean_mag,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST((o_orderkey * 43) % 1800 + (o_orderkey * 7) % 380 AS DOUBLE) / 100.0E0 + 3.0E0 END AS phot_bp_mean_mag,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST((o_orderkey * 43) % 1800 + 50 AS DOUBLE) / 100.0E0 + 3.0E0 END AS phot_rp_mean_mag,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST((o_orderkey * 11) % 260 AS DOUBLE) / 100.0E0 + 0.5E0 END AS ruwe,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'WISE' WHEN '2-HIGH' THEN '2MASS' WHEN '3-MEDIUM' THEN 'gaia ' WHEN '4-NOT SPECIFIED' THEN 'GAIA' ELSE NULL END AS catalog_source,
 CASE o_orderstatus WHEN 'F' THEN 'yso/young_star' WHEN 'O' THEN ' rr_lyrae ' ELSE NULL END AS object_class,
 0 AS is_transient, CAST(NULL AS STRING) AS alert_name
FROM {orders}
"""

PAPERS = """
SELECT CAST(2301 + doc_id % 12 AS STRING) || '.' || lpad(CAST(doc_id AS STRING), CAST(greatest(5, length(CAST(doc_id AS STRING))) AS INT), '0') AS arxiv_id,
 substring(text, 1, 60) AS title,
 text || CASE doc_id % 5
   WHEN 0 THEN ' Gaia DR3 ' || CAST(100000000000000000 + (doc_id * 7) % 1500 AS STRING) || ' is a binary.'
   WHEN 1 THEN ' Targets in the Pleiades (M45) and Hyades were analysed.'
   WHEN 2 THEN ' We compare Sirius, HD 48915 and HIP 32349.'
   WHEN 3 THEN ' A runaway, hypervelocity young star.'
   ELSE '' END AS abstract,
 source AS categories, '2024-01-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') AS published_date
FROM {documents}
"""

REGIONS = """
SELECT * FROM (VALUES ('Hyades',66.75E0,15.87E0,5.5E0),('Pleiades',56.75E0,24.12E0,2.0E0),
 ('Orion OB1',83.82E0,-5.39E0,4.0E0),('Coma Berenices',185.0E0,25.83E0,4.0E0),
 ('Praesepe',130.05E0,19.52E0,2.5E0)) AS t(name,ra,dec,radius_deg)
"""

ALERTS = """
SELECT 'AT' || CAST(e.event_id AS STRING) AS name, CAST(e.ts AS TIMESTAMP) AS ts, e.event_type AS type, e.value AS mag,
 s.ra + 0.0002E0 AS ra, s.dec AS dec
FROM {events} e JOIN {stars} s ON s.source_id = CAST(100000000000000000 + (e.event_id * 3) % 1500 AS STRING)
"""

#: Common table expressions of the same views for the oracle.
WITH = {
    "stars": f"stars AS ({STARS.replace('{orders}', 'orders')})",
    "papers": f"papers AS ({PAPERS.replace('{documents}', 'documents')})",
    "regions": f"regions AS ({REGIONS})",
    "alerts": f"alerts AS ({ALERTS.replace('{events}', 'events').replace('{stars}', 'stars')})",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(WITH[n] for n in names)


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STARS, orders=table(spark, sf_dir, "orders"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAPERS, documents=table(spark, sf_dir, "documents"))


def regions(spark: SparkSession) -> DataFrame:
    return spark.sql(REGIONS)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ALERTS, events=table(spark, sf_dir, "events"), stars=stars(spark, sf_dir))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages of the conversations table, in turn order."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text AS content")
