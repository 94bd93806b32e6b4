"""Queries for the cleaning, geospatial and vector column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import color, encoders, geo
from ..functions import vectors as V
from ..operators import clean, stats
from ..operators.summary import category, floor_score
from .core import ANN, CELLROWS, PTS, R, VECS, W, query, r

# --------------------------------------------------------------------------- cleaning


@query("prj1_canonicalize", W(PTS) + f"""SELECT {r('lon')} AS lon, {r('lat')} AS lat,
 epoch_ms(make_date(year,1,1)::TIMESTAMP) AS timestamp, CASE WHEN id%2=0 THEN 'train' ELSE 'test' END AS split, id::VARCHAR AS id, y FROM pts""")
def prj1(spark, sf):
    p = X.points(spark, sf).withColumn("part", F.when(F.col("id") % 2 == 0, "train").otherwise("test"))
    c = clean.canonicalize(p, lon="lon", lat="lat", timestamp="year", unit="year", split="part", id="id", drop=("cls",))
    return c.select(R("lon").alias("lon"), R("lat").alias("lat"), "timestamp", "split", "id", "y")


@query("prj2_unix_ms", """SELECT event_id, epoch_ms(date_trunc('millisecond', ts)) AS ms,
 epoch_ms(make_date(year(ts)::INT,1,1)::TIMESTAMP) AS year_ms FROM events""")
def prj2(spark, sf):
    e = X.table(spark, sf, "events").withColumn("y", F.year("ts"))
    return e.select("event_id", clean.to_unix_ms(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ms"), clean.to_unix_ms("y", "year").alias("year_ms"))


@query("prj3_validate", W(PTS) + """SELECT count(*)::BIGINT AS n, count(*) FILTER (id%7=0)::BIGINT AS null_coords,
 count(*) FILTER (id%7<>0 AND NOT (lon+id%3 BETWEEN -180 AND 180))::BIGINT AS bad_lon,
 count(*) FILTER (NOT (lat*2 BETWEEN -90 AND 90))::BIGINT AS bad_lat FROM pts""")
def prj3(spark, sf):
    p = X.points(spark, sf)
    return clean.validation_counts(p.select(
        F.when(F.col("id") % 7 != 0, F.col("lon") + F.col("id") % 3).alias("lon"), (F.col("lat") * 2).alias("lat")))


@query("prj4_resolve_columns", W(PTS) + f"SELECT id, {r('lon')} AS lon, {r('lat')} AS lat FROM pts")
def prj4(spark, sf):
    p = X.points(spark, sf).select("id", F.col("lat").alias("Latitude_deg"), F.col("lon").alias("Longitude_deg"))
    lon, lat = clean.coordinate_names(p, by_prefix=True)
    c = clean.canonicalize(p, lon=lon, lat=lat, id="id")
    return c.select(F.col("id").cast("long").alias("id"), R("lon").alias("lon"), R("lat").alias("lat"))


@query("prj5_parse_point", W(PTS) + f"SELECT id, {r('lon')} AS lon, {r('lat')} AS lat FROM pts")
def prj5(spark, sf):
    lon, lat = clean.parse_point("Geolocation")
    raw = X.raw_source(spark, sf)
    return raw.select(F.col(" ID").alias("id"), R(lon).alias("lon"), R(lat).alias("lat"))


@query("prj6_melt_tasks", W(PTS) + """SELECT id, task, y FROM (SELECT id, 'a' AS task, y FROM pts UNION ALL
 SELECT id, 'b', CASE WHEN id%3=0 THEN NULL ELSE lat END FROM pts) WHERE y IS NOT NULL""")
def prj6(spark, sf):
    p = X.points(spark, sf).select("id", F.col("y").alias("a"), F.when(F.col("id") % 3 != 0, F.col("lat")).alias("bb"))
    return clean.melt_tasks(p, ["id"], ["a", "bb"], rename={"bb": "b"})


@query("prj7_sentinels", W(PTS) + """SELECT id, CASE WHEN y>0 THEN y END AS pos FROM pts
 WHERE id%17<>0 AND (id%4)<>0""")
def prj7(spark, sf):
    raw = X.points(spark, sf).withColumn("value", F.when(F.col("id") % 17 == 0, clean.VALUE_NODATA).otherwise(F.col("y"))).withColumn(
        "country", F.col("id") % 4)
    d = clean.drop_value(clean.drop_value(raw, "value", clean.VALUE_NODATA), "country", 0)
    return d.select("id", clean.nonpositive_to_null("y").alias("pos"))


@query("prj8_log_labels", W(PTS) + f"SELECT id, {r('ln(1+abs(y))')} AS population, y AS elevation FROM pts")
def prj8(spark, sf):
    p = X.points(spark, sf)
    return p.select("id", R(clean.log_label(F.abs("y"), "population")).alias("population"), clean.log_label("y", "elevation").alias("elevation"))


@query("prj9_choose_target", W(PTS) + "SELECT id, y AS value FROM pts")
def prj9(spark, sf):
    p = X.points(spark, sf).select("id", "lat", "lon", F.lit(1).alias("Unnamed_0"), F.col("cls").alias("note"), F.col("y").alias("mean_Income_usd"))
    t = clean.target_name(p, "income")
    return p.select("id", F.col(t).alias("value"))


@query("prj10_task_type", "SELECT 'classification' AS task_type, count(DISTINCT label)::BIGINT AS n_classes_seen FROM embeddings "
       "UNION ALL SELECT 'regression', least(101, count(DISTINCT value))::BIGINT FROM events")
def prj10(spark, sf):
    a = clean.infer_task_type(X.vectors(spark, sf), "cls")
    return a.unionByName(clean.infer_task_type(X.table(spark, sf, "events"), "value"))


@query("prj11_year_of_ms", "SELECT event_id, year(ts)::INT AS year FROM events")
def prj11(spark, sf):
    return X.table(spark, sf, "events").select("event_id", clean.year_of_ms(F.unix_millis(F.col("ts").cast("timestamp"))).alias("year"))


@query("prj12_split_flag", W(PTS) + "SELECT count(*) FILTER (id%4=0)::BIGINT AS named, count(*) FILTER (id%5=0)::BIGINT AS plain FROM pts")
def prj12(spark, sf):
    p = X.points(spark, sf).withColumn("extrapolation_split", F.when(F.col("id") % 4 == 0, "test").otherwise("train")).withColumn(
        "split", F.when(F.col("id") % 5 == 0, "test"))
    return p.agg(F.count_if(clean.is_test(p, "extrapolation")).alias("named"), F.count_if(clean.is_test(p)).alias("plain"))


_NAMES = ["mosaiks-roads", "soilgrids-soc", "dm-glance", "unlisted", "places-asthma", "dm-aster_ged", "satclip-biome"]


@query("prj13_category_floor", W(PTS) + """SELECT category, count(*)::BIGINT AS n, min(greatest(y/1000-5,-1.0)) AS lo FROM (SELECT y,
 CASE id%7 WHEN 0 THEN 'socio' WHEN 1 THEN 'env' WHEN 2 THEN 'land' WHEN 3 THEN 'other' WHEN 4 THEN 'socio' WHEN 5 THEN 'env' ELSE 'land' END AS category
 FROM pts) GROUP BY 1""")
def prj13(spark, sf):
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("id") % 7).cast("int"))
    return X.points(spark, sf).select(category(name).alias("category"), floor_score(F.col("y") / 1000 - 5).alias("s")).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"))


@query("prj14_class_codes", W(PTS) + "SELECT id, cls, (dense_rank() OVER (ORDER BY cls)-1)::INT AS code FROM pts")
def prj14(spark, sf):
    return clean.sorted_codes(X.points(spark, sf), "cls", "id").select("id", "cls", "code")


@query("prj15_validity", "SELECT vec_id AS id, vec_id%11<>0 AND vec_id%13<>0 AS valid FROM embeddings")
def prj15(spark, sf):
    d = X.vectors(spark, sf).withColumn(
        "v", F.when(F.col("id") % 11 == 0, F.concat(F.slice("v", 1, 63), F.array(F.lit(float("nan"))))).otherwise(F.col("v")))
    d = d.withColumn("y", F.when(F.col("id") % 13 == 0, F.lit(float("inf"))).otherwise(F.col("y")))
    return d.select("id", clean.valid_rows("y", "v").alias("valid"))


@query("prj16_task_groups", W(PTS).rstrip() + """, t AS (SELECT id, 'a' AS task, id%3<>0 AS ok FROM pts UNION ALL SELECT id, 'b', id%3<>0 FROM pts
 UNION ALL SELECT id, 'c', id%5<>0 FROM pts), s AS (SELECT task, count(*) FILTER (ok)::BIGINT AS n_valid,
 string_agg(CASE WHEN ok THEN id::VARCHAR END, ',' ORDER BY id) AS sig FROM t GROUP BY 1)
 SELECT n_valid, string_agg(task, ';' ORDER BY task) AS tasks FROM s GROUP BY sig, n_valid""")
def prj16(spark, sf):
    p = X.points(spark, sf)
    long = p.select("id", F.explode(F.array(*[F.struct(F.lit(t).alias("task"), (F.col("id") % m != 0).alias("valid"))
                                              for t, m in (("a", 3), ("b", 3), ("c", 5))])).alias("s")).select("id", "s.*")
    sig = clean.task_signatures(long)
    return sig.groupBy("group_key", "n_valid").agg(F.array_join(F.sort_array(F.collect_list("task")), ";").alias("tasks")).select("n_valid", "tasks")


@query("prj17_bounds", W(CELLROWS) + f"SELECT row, col, {r('lat')} AS lat, {r('lon')} AS lon FROM cells WHERE lat BETWEEN 28 AND 50 AND lon BETWEEN -125 AND -95 AND lat>=-60")
def prj17(spark, sf):
    c = X.cell_rows(spark, sf)
    return c.where(F.col("lat").between(28, 50) & F.col("lon").between(-125, -95) & (F.col("lat") >= -60.0)).select(
        "row", "col", R("lat").alias("lat"), R("lon").alias("lon"))


_LABSQL = W(VECS).rstrip() + """, s AS (SELECT id, v[1] AS p1, v[2] AS p2, v[3] AS p3 FROM vecs),
 q AS (SELECT quantile_cont(p1,0.02) AS lo, quantile_cont(p1,0.98) AS hi, quantile_cont(abs(p2),0.98) AS m2, quantile_cont(abs(p3),0.98) AS m3 FROM s),
 lab AS (SELECT id, 32+greatest(0,least(1,(p1-lo)/(hi-lo+1e-9)))*60 AS l, greatest(-1,least(1,p2/(m2+1e-9)))*58 AS a, greatest(-1,least(1,p3/(m3+1e-9)))*58 AS b FROM s, q),
 f AS (SELECT id, (l+16)/116 AS fy, (l+16)/116+a/500 AS fx, (l+16)/116-b/200 AS fz FROM lab),
 xyz AS (SELECT id, 0.95047*(CASE WHEN fx*fx*fx>0.008856 THEN fx*fx*fx ELSE (fx-16/116.0::DOUBLE)/7.787 END) AS x,
  CASE WHEN fy*fy*fy>0.008856 THEN fy*fy*fy ELSE (fy-16/116.0::DOUBLE)/7.787 END AS y,
  1.08883*(CASE WHEN fz*fz*fz>0.008856 THEN fz*fz*fz ELSE (fz-16/116.0::DOUBLE)/7.787 END) AS z FROM f),
 lin AS (SELECT id, greatest(0,least(1,3.2406*x-1.5372*y-0.4986*z)) AS r, greatest(0,least(1,-0.9689*x+1.8758*y+0.0415*z)) AS g,
  greatest(0,least(1,0.0557*x-0.2040*y+1.0570*z)) AS b FROM xyz) SELECT id, """ + ", ".join(
    r(f"CASE WHEN {c}<=0.0031308 THEN 12.92*{c} ELSE 1.055*pow({c},1/2.4::DOUBLE)-0.055 END", 5) + f" AS {c}" for c in "rgb") + " FROM lin"


@query("prj18_lab_color", _LABSQL)
def prj18(spark, sf):
    s = X.vectors(spark, sf).select("id", *[F.col("v")[i].alias(f"p{i + 1}") for i in range(3)])
    stretch, _ = color.stretch_of(s, "p1", "p2", "p3", "id")
    return s.select("id", color.stretched_rgb("p1", "p2", "p3", stretch).alias("c")).select(
        "id", R("c.r", 5).alias("r"), R("c.g", 5).alias("g"), R("c.b", 5).alias("b"))


_RAMP = ", ".join(f"({k},{a},{b},{c})" for k, (a, b, c) in enumerate(color.MAGMA))
_SHADE = lambda c: f"floor(a.{c}+(b.{c}-a.{c})*(x-j)+0.5)::INT AS {c}"


@query("prj18_ramp_color", W(CELLROWS, f"ramp(k,r,g,b) AS (VALUES {_RAMP})", "top AS (SELECT max(n) FILTER (o=floor(0.98*(c-1))) AS top FROM (SELECT n, row_number() OVER (ORDER BY n, row*360+col)-1 AS o, count(*) OVER () AS c FROM cells)), "
       f"i AS (SELECT row, col, floor(least(1.0,sqrt(n/top::DOUBLE))*255)/255.0::DOUBLE*{len(color.MAGMA) - 1} AS x FROM cells, top), j AS (SELECT *, least(floor(x),{len(color.MAGMA) - 2})::INT AS j FROM i)") +
       f"SELECT row, col, {_SHADE('r')}, {_SHADE('g')}, {_SHADE('b')} FROM j JOIN ramp a ON a.k=j JOIN ramp b ON b.k=j+1")
def prj18_ramp(spark, sf):
    """Density colouring: root of the count over its 98th percentile, on the dark ramp."""
    c = X.cell_rows(spark, sf).withColumn("key", F.col("row") * 360 + F.col("col"))
    top = stats.floor_percentiles(c, "n", "key", [0.98])[0] or 1
    t = F.least(F.lit(1.0), F.sqrt(F.col("n") / F.lit(float(top))))
    rgb = color.ramp_color(t, color.MAGMA, round_index=False)
    return c.select("row", "col", rgb[0].alias("r"), rgb[1].alias("g"), rgb[2].alias("b"))


# --------------------------------------------------------------------------- geospatial functions

@query("geo1_raw_features", W(PTS) + "SELECT id, " + ", ".join(r(e) + f" AS f{i}" for i, e in enumerate(
    ["sin(radians(lat))", "cos(radians(lat))", "sin(radians(lon))", "cos(radians(lon))"])) + " FROM pts")
def geo1(spark, sf):
    return X.points(spark, sf).select("id", geo.raw_features("lat", "lon").alias("f")).select("id", *[R(F.col("f")[i]).alias(f"f{i}") for i in range(4)])


@query("geo2_unit_xyz", W(PTS) + "SELECT id, " + ", ".join(r(e) + f" AS f{i}" for i, e in enumerate(
    ["cos(radians(lat))*cos(radians(lon))", "cos(radians(lat))*sin(radians(lon))", "sin(radians(lat))"])) + " FROM pts")
def geo2(spark, sf):
    return X.points(spark, sf).select("id", geo.unit_xyz("lat", "lon").alias("f")).select("id", *[R(F.col("f")[i]).alias(f"f{i}") for i in range(3)])


@query("geo3_equal_earth", W(PTS, "t AS (SELECT id, lon, asin(sqrt(3.0::DOUBLE)/2*sin(radians(lat))) AS th FROM pts)") + "SELECT id, " + r(
    "2*sqrt(3.0::DOUBLE)*radians(lon)*cos(th)/(3*(9*0.003796*pow(th,8)+7*0.000893*pow(th,6)+3*(-0.081106)*pow(th,2)+1.340264))*66.50336/180") +
    " AS x, " + r("(0.003796*pow(th,9)+0.000893*pow(th,7)-0.081106*pow(th,3)+1.340264*th)*66.50336/180") + " AS y FROM t")
def geo3(spark, sf):
    return X.points(spark, sf).select("id", geo.equal_earth("lat", "lon").alias("p")).select("id", R(F.col("p")[0]).alias("x"), R(F.col("p")[1]).alias("y"))


@query("geo4_great_circle", W(PTS) + "SELECT a.id, " + r(
    "2*6371.0*asin(sqrt(least(1.0,pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2))))", 5) +
    " AS km, " + r("2*6371.0*asin(least(1.0,sqrt(pow(cos(radians(a.lat))*cos(radians(a.lon))-cos(radians(b.lat))*cos(radians(b.lon)),2)+"
                   "pow(cos(radians(a.lat))*sin(radians(a.lon))-cos(radians(b.lat))*sin(radians(b.lon)),2)+pow(sin(radians(a.lat))-sin(radians(b.lat)),2))/2))", 5) +
    " AS chord_km FROM pts a JOIN pts b ON b.id=a.id+1")
def geo4(spark, sf):
    a = X.points(spark, sf)
    b = a.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    j = a.join(b, "id")
    return j.select("id", R(geo.haversine_km("lat", "lon", "lat2", "lon2"), 5).alias("km"), R(geo.chord_to_km(
        V.distance(geo.unit_xyz("lat", "lon"), geo.unit_xyz("lat2", "lon2"))), 5).alias("chord_km"))


@query("geo5_pixel_affine", W(PTS) + f"""SELECT id, {r('(83.68570533713473-lat)/0.00008983111749910169-0.5', 3)} AS row,
 {r('(lon+180)/0.00008983111749910169-0.5', 3)} AS col, {r('-180.0+(id*100+0.5)*0.00008983111749910169')} AS plon,
 {r('83.68570533713473-(id*50+0.5)*0.00008983111749910169')} AS plat FROM pts""")
def geo5(spark, sf):
    row, col = geo.lonlat_to_pixel("lat", "lon")
    plon, plat = geo.pixel_to_lonlat(F.col("id") * 50, F.col("id") * 100)
    return X.points(spark, sf).select("id", R(row, 3).alias("row"), R(col, 3).alias("col"), R(plon).alias("plon"), R(plat).alias("plat"))


@query("geo6_grid_cell", W(PTS) + "SELECT id, floor(lat/10)::BIGINT AS cell_lat, floor(lon/10)::BIGINT AS cell_lon FROM pts")
def geo6(spark, sf):
    a, b = geo.grid_cell("lat", "lon", 10.0)
    return X.points(spark, sf).select("id", a.alias("cell_lat"), b.alias("cell_lon"))


_CURVE = ("h AS (SELECT id, floor((lon+180.0)/360.0*65535)::BIGINT AS x, floor((lat+90.0)/180.0*65535)::BIGINT AS y, 0::BIGINT AS d, 32768::BIGINT AS s FROM pts UNION ALL "
          "SELECT id, CASE WHEN top THEN mx ELSE my END, CASE WHEN top THEN my ELSE mx END, d+s*s*q, s//2 FROM (SELECT id, d, s, top, q, CASE WHEN q=3 THEN s-1-lx ELSE lx END AS mx, CASE WHEN q=3 THEN s-1-ly ELSE ly END AS my FROM "
          "(SELECT id, d, s, (y&s)>0 AS top, x&(s-1) AS lx, y&(s-1) AS ly, CASE WHEN (x&s)>0 AND (y&s)=0 THEN 3 WHEN (x&s)>0 THEN 2 WHEN (y&s)>0 THEN 1 ELSE 0 END AS q FROM h WHERE s>0)))")


@query("geo7_hilbert_key", "WITH RECURSIVE " + PTS + ", " + _CURVE + " SELECT id, d AS hilbert FROM h WHERE s=0")
def geo7(spark, sf):
    return X.points(spark, sf).select("id", geo.hilbert_key("lat", "lon").alias("hilbert"))


@query("geo8_wkb_bbox", W(PTS) + f"SELECT id, 21::INT AS bytes, '0101000000' AS head, {r('lon')} AS xmin, {r('lat')} AS ymin, {r('lon')} AS xmax, {r('lat')} AS ymax FROM pts")
def geo8(spark, sf):
    g = X.points(spark, sf).select("id", geo.wkb_point("lat", "lon").alias("w"), geo.bbox_struct("lat", "lon").alias("b"))
    return g.select("id", F.octet_length("w").alias("bytes"), F.substring(F.hex("w"), 1, 10).alias("head"), *[
        R(f"b.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


_BRG = "((id*37)%360)*pi()/180"


@query("geo9_geodesic_offset", W(PTS, f"o AS (SELECT id, radians(lat) AS p1, radians(lon) AS l1, {_BRG} AS b, (10+id%900)/6371.0::DOUBLE AS d FROM pts)",
                                "s AS (SELECT *, sin(p1)*cos(d)+cos(p1)*sin(d)*cos(b) AS s2 FROM o)") + "SELECT id, " + r("degrees(asin(s2))") + " AS lat2, " + r(
    "degrees(l1+atan2(sin(b)*sin(d)*cos(p1),cos(d)-sin(p1)*s2))+180-360*floor((degrees(l1+atan2(sin(b)*sin(d)*cos(p1),cos(d)-sin(p1)*s2))+180)/360)-180") + " AS lon2 FROM s")
def geo9(spark, sf):
    brg = (F.col("id") * 37) % 360 * F.pi() / 180
    la, lo = geo.geodesic_offset("lat", "lon", (10 + F.col("id") % 900).cast("double"), brg)
    return X.points(spark, sf).select("id", R(la).alias("lat2"), R(lo).alias("lon2"))


@query("geo10_ring", W(PTS, "m AS (SELECT * FROM pts, range(5) t(member))") + "SELECT id, member::INT AS member, " + r(
    "CASE WHEN member=0 THEN lat ELSE lat+0.1*sin((member-1)*2*pi()/4) END") + " AS lat, " + r(
    "CASE WHEN member=0 THEN lon ELSE lon+0.1*cos((member-1)*2*pi()/4) END") + " AS lon FROM m")
def geo10(spark, sf):
    return geo.ring_points(X.points(spark, sf), 4, 0.1).select("id", "member", R("lat").alias("lat"), R("lon").alias("lon"))


@query("geo11_jitter")
def geo11(spark, sf):
    return geo.jitter_points(X.points(spark, sf), 3, 0.05, "id", seed=1).select("id", "member", R("lat").alias("lat"), R("lon").alias("lon"))


@query("geo12_city_bbox", f"WITH c AS (SELECT s_suppkey AS id, ((s_suppkey*7919)%14401)/100.0::DOUBLE-60 AS lat, ((s_suppkey*104729)%36000)/100.0::DOUBLE-180 AS lon, "
       "15000+floor(abs(s_acctbal)*100) AS pop FROM supplier), d AS (SELECT *, greatest(2.0,least(25.0,2*sqrt(pop/1e5))) AS rk FROM c) SELECT id, " +
       r("lon-rk/(111.0*greatest(0.2,least(1.0,cos(radians(lat)))))") + " AS west, " + r("lat-rk/111.0") + " AS south, " +
       r("lon+rk/(111.0*greatest(0.2,least(1.0,cos(radians(lat)))))") + " AS east, " + r("lat+rk/111.0") + " AS north FROM d")
def geo12(spark, sf):
    return cities(spark, sf).select(F.col("city").alias("id"), geo.city_bbox("lat", "lon", "population").alias("b")).select(
        "id", *[R(f"b.{c}").alias(c) for c in ("west", "south", "east", "north")])


def cities(spark, sf):
    i = F.col("s_suppkey")
    return X.table(spark, sf, "supplier").select(i.alias("city"), X.lat_of(i).alias("lat"), X.lon_of(i).alias("lon"),
                                                 (15000 + F.floor(F.abs("s_acctbal") * 100)).cast("double").alias("population"))


@query("geo13_spherical_harmonics")
def geo13(spark, sf):
    return X.points(spark, sf).select("id", geo.spherical_harmonics(6)("lat", "lon").alias("h")).select(
        "id", *[R(F.col("h")[i]).alias(f"h{i}") for i in (0, 1, 2, 3, 8, 20, 35)])


@query("geo14_year_features", W(PTS) + "SELECT id, " + ", ".join(
    r(f"{fn}((year-2021)/4.0::DOUBLE*{2**i})") + f" AS {fn}{i}" for fn in ("sin", "cos") for i in (0, 3, 7)) + " FROM pts")
def geo14(spark, sf):
    f = X.points(spark, sf).select("id", geo.year_features("year").alias("f"))
    return f.select("id", *[R(F.col("f")[i]).alias(f"sin{i}") for i in (0, 3, 7)], *[R(F.col("f")[8 + i]).alias(f"cos{i}") for i in (0, 3, 7)])


@query("geo15_grid_rowcol", W(PTS) + """SELECT id, least(561,greatest(0,floor((84-lat)/144*562)))::BIGINT AS row,
 least(1124,greatest(0,floor((lon+180)/360*1125)))::BIGINT AS col FROM pts""")
def geo15(spark, sf):
    row, col = geo.grid_rowcol("lat", "lon", lat_min=-60, lat_max=84, lon_min=-180, lon_max=180, height=562, width=1125)
    return X.points(spark, sf).select("id", row.cast("long").alias("row"), col.cast("long").alias("col"))


# --------------------------------------------------------------------------- vectors

_SQ = "list_transform(aef, lambda q: sign(q)*pow(abs(q)/127.5::DOUBLE,2))"


@query("vec1_dequantize", W(ANN) + f"SELECT point_id, year, {r('list_sum(' + _SQ + ')')} AS square, {r('list_sum(list_transform(aef, lambda q: q/127.0::DOUBLE))')} AS linear, "
       "list_sum(aef)::DOUBLE AS raw FROM ann")
def vec1(spark, sf):
    tot = lambda m: F.aggregate(V.dequantize("aef", m), F.lit(0.0), lambda s, x: s + x)
    return X.annual(spark, sf).select("point_id", F.col("year").cast("int").alias("year"), R(tot("signed_square")).alias("square"),
                                      R(tot("linear")).alias("linear"), tot("none").alias("raw"))


@query("vec2_l2_normalize", W(ANN, f"d AS (SELECT point_id, year, {_SQ} AS d FROM ann)") +
       f"SELECT point_id, year, {r('list_sum(list_transform(d, lambda x: x/greatest(sqrt(list_inner_product(d,d)),1e-12)))')} AS total FROM d")
def vec2(spark, sf):
    u = V.l2_normalize(V.dequantize("aef"))
    return X.annual(spark, sf).select("point_id", F.col("year").cast("int").alias("year"), R(F.aggregate(u, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("vec3_nodata", W(ANN) + "SELECT point_id, year, point_id%10=0 AS nodata, (CASE WHEN point_id%10=0 THEN NULL ELSE aef[1] END)::DOUBLE AS first FROM ann")
def vec3(spark, sf):
    a = X.annual(spark, sf).withColumn("aef", F.when(F.col("point_id") % 10 == 0, F.concat(
        F.slice("aef", 1, 63), F.array(F.lit(-128).cast("tinyint")))).otherwise(F.col("aef")))
    f = V.nodata_to_nan("aef", 64)[0]
    return a.select("point_id", F.col("year").cast("int").alias("year"), V.has_nodata("aef").alias("nodata"), F.when(~F.isnan(f), f).alias("first"))


@query("vec4_prefix_chunk", W(VECS) + f"SELECT id, {r('list_sum(v[1:16])')} AS pre, {r('list_sum(v[17:32])')} AS mid FROM vecs")
def vec4(spark, sf):
    s = lambda a: R(F.aggregate(a, F.lit(0.0), lambda t, x: t + x))
    return X.vectors(spark, sf).select("id", s(V.prefix("v", 16, 64)).alias("pre"), s(V.chunk("v", 16, 32, 64)).alias("mid"))


@query("vec5_concat_standardized", W(VECS, "l AS (SELECT id, unnest(v) AS x, generate_subscripts(v,1) AS j FROM vecs)",
                                     "m AS (SELECT j, avg(x) AS mu, stddev_pop(x) AS sd FROM l GROUP BY 1)") +
       f"SELECT l.id, {r('sum(CASE WHEN sd>1e-4 THEN (x-mu)/sd ELSE 0 END) FILTER (j<=32)')} AS a, "
       f"{r('sum(CASE WHEN sd>1e-4 THEN (x-mu)/sd ELSE 0 END) FILTER (j>48)')} AS c FROM l JOIN m USING (j) GROUP BY 1")
def vec5(spark, sf):
    t = encoders.concat_standardized(X.teachers(spark, sf), ["ta", "tb", "tc"])
    s = lambda a: R(F.aggregate(a, F.lit(0.0), lambda x, y: x + y))
    return t.select(F.col("point_id").alias("id"), s(F.slice("vec", 1, 32)).alias("a"), s(F.slice("vec", 49, 16)).alias("c"))


@query("vec6_affine_decode", W(ANN) + "SELECT point_id, year, " + r(
    "list_sum(list_transform(range(64), lambda i: aef[i+1]*(0.01+i*0.001)+(i*0.5-3)))") + " AS total FROM ann")
def vec6(spark, sf):
    d = V.affine_decode("aef", [0.01 + i * 0.001 for i in range(64)], [i * 0.5 - 3 for i in range(64)])
    return X.annual(spark, sf).select("point_id", F.col("year").cast("int").alias("year"), R(F.aggregate(d, F.lit(0.0), lambda s, x: s + x)).alias("total"))


_PAIR = "p AS (SELECT a.id, a.v AS va, b.v AS vb FROM vecs a JOIN vecs b ON b.id=a.id+1)"


def _pairs(spark, sf):
    a = X.vectors(spark, sf).select("id", F.col("v").alias("va"))
    return a.join(a.select((F.col("id") - 1).alias("id"), F.col("va").alias("vb")), "id")


@query("vec7_pair_distance", W(VECS, _PAIR) + "SELECT id, " + ", ".join(
    f"{r(f'list_distance(va[1:{w}],vb[1:{w}])')} AS d{w}, {r(f'list_distance(va[1:{w}],vb[1:{w}])/greatest(sqrt(list_inner_product(va[1:{w}],va[1:{w}])),1e-9)')} AS rel{w}"
    for w in (8, 64)) + " FROM p")
def vec7(spark, sf):
    return _pairs(spark, sf).select("id", *[c for w in (8, 64) for c in (
        R(V.distance(V.prefix("va", w), V.prefix("vb", w))).alias(f"d{w}"), R(V.relative_change(V.prefix("va", w), V.prefix("vb", w))).alias(f"rel{w}"))])


@query("vec8_cosine", W(VECS, _PAIR) + "SELECT id, " + ", ".join(r(f"list_cosine_similarity(va[1:{w}],vb[1:{w}])") + f" AS c{w}" for w in (8, 16, 32, 64)) + " FROM p")
def vec8(spark, sf):
    return _pairs(spark, sf).select("id", *[R(V.cosine(V.prefix("va", w), V.prefix("vb", w))).alias(f"c{w}") for w in X.WIDTHS])


@query("vec9_permute", W(VECS) + f"SELECT id, {r('v[(0*37+11)%64+1]')} AS first, {r('v[(63*37+11)%64+1]')} AS last, {r('list_sum(v)')} AS total FROM vecs")
def vec9(spark, sf):
    p = V.permute("v", [(i * 37 + 11) % 64 for i in range(64)])
    d = X.vectors(spark, sf).select("id", p.alias("p"))
    return d.select("id", R(F.col("p")[0]).alias("first"), R(F.col("p")[63]).alias("last"), R(F.aggregate("p", F.lit(0.0), lambda s, x: s + x)).alias("total"))
