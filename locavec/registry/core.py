"""Registration of named queries with their DuckDB counterparts, and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[key] = lambda spark, sf: fn(ship(spark), sf)
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def R(col: Column | str, places: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), places) + F.lit(0.0)


def r(expr: str, places: int = 6) -> str:
    return f"(round(({expr})::DOUBLE,{places})+0.0::DOUBLE)"


_LAT = "(({i}*7919)%14401)/100.0::DOUBLE-60"
_LON = "(({i}*104729)%36000)/100.0::DOUBLE-180"


def lat_sql(i: str) -> str:
    return _LAT.format(i=i)


def lon_sql(i: str) -> str:
    return _LON.format(i=i)


PTS = (f"pts AS (SELECT c_custkey AS id, {lat_sql('c_custkey')} AS lat, {lon_sql('c_custkey')} AS lon, c_acctbal AS y, "
       "c_mktsegment AS cls, (2017+c_custkey%9)::INT AS year FROM customer)")
XYZ = ("xyz AS (SELECT *, cos(radians(lat))*cos(radians(lon)) AS x, cos(radians(lat))*sin(radians(lon)) AS yy, "
       "sin(radians(lat)) AS z, (id%5)::INT AS fold FROM pts)")
VECS = (f"vecs AS (SELECT vec_id AS id, {lat_sql('vec_id')} AS lat, {lon_sql('vec_id')} AS lon, embedding::DOUBLE[] AS v, "
        f"label::INT AS cls, 3*embedding[1]::DOUBLE-2*embedding[2]::DOUBLE+embedding[33]::DOUBLE+({lat_sql('vec_id')})/90 AS y FROM embeddings)")
ANN = ("ann AS (SELECT vec_id AS point_id, yr AS year, list_transform(embedding::DOUBLE[], lambda x: greatest(-127, least(127, "
       "sign(x)*floor(sqrt(abs(x))*127.5)+(yr-2018)))::INT) AS aef FROM embeddings, (VALUES (2017),(2018),(2019)) t(yr))")
UNIT = ("unit AS (SELECT id, year, list_transform(d, lambda x: x/greatest(sqrt(list_inner_product(d,d)),1e-12)) AS u FROM "
        "(SELECT point_id AS id, year, list_transform(aef, lambda q: sign(q)*pow(abs(q)/127.5::DOUBLE,2)) AS d FROM ann))")
CELLROWS = ("cells AS (SELECT (o_orderkey*7919)%144 AS row, (o_orderkey*104729)%360 AS col, count(*) AS n, bool_or(o_orderstatus='O') AS valid, "
            "84-((o_orderkey*7919)%144)-0.5::DOUBLE AS lat, ((o_orderkey*104729)%360)-180+0.5::DOUBLE AS lon FROM orders GROUP BY ALL)")
SHARDS = ("shards AS (SELECT l_linenumber%4 AS level, l_partkey%48 AS band, l_suppkey%25 AS shard, "
          "sum(CASE WHEN l_suppkey%5=0 THEN 0 ELSE l_quantity::BIGINT END)::BIGINT AS bytes FROM lineitem GROUP BY ALL)")
RESULTS = """g AS (SELECT c_nationkey AS nk, count(*) AS cnt, sum(o_orderkey)::BIGINT AS ks FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1),
results AS (SELECT n_name AS benchmark, lower(r_name) AS family, 't'||t AS task, 'regression' AS task_type, seed, m AS encoder, cell AS cell_deg,
 (cnt%100 + (CASE WHEN nk=3 AND ci=4 THEN 3 ELSE ci END)*10)/10.0::DOUBLE AS median_nn_train_km,
 (((cnt*7+ks%1009+seed*37+ci*53+mi*71+t*29)*37)%250-150)/100.0::DOUBLE AS score, nk
 FROM g JOIN nation ON nk=n_nationkey JOIN region ON n_regionkey=r_regionkey,
 (VALUES (0),(1),(2),(3),(4)) s(seed), (VALUES (0,0.0::DOUBLE),(1,2.0),(2,10.0),(3,20.0),(4,40.0)) c(ci,cell),
 (VALUES (0,'alpha'),(1,'beta'),(2,'gamma')) e(mi,m), (VALUES (0),(1)) k(t) WHERE NOT (nk=7 AND mi=2))"""


def W(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
