"""Queries S1 to S13: files, feeds, stores.

File queries first write the given tables to a new shared folder and read that.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.blocks import DAY, floor_div
from sensorloom.operators import screen, splits
from sensorloom.queries import views as V
from sensorloom.queries.registry import query
from sensorloom.queries.screen import _POOLED, FLAGS, GROUP, segment_scores
from sensorloom.session import cut
from sensorloom.sources import feed, files, store

FROM_MS, TO_MS = 1_704_420_123_456, 1_705_876_543_210
WINDOW = f"ts >= epoch_ms({FROM_MS}) AND ts <= epoch_ms({TO_MS}) AND value >= 0 AND value < 100000"
HOUR_WINDOW = f"ts >= epoch_ms({FROM_MS // 3600000 * 3600000}) AND ts <= epoch_ms({TO_MS // 3600000 * 3600000}) AND value >= 0 AND value < 100000"


def station_files(spark, sf):
    """``<folder>/station=<s>/name=<s>_NO2.csv``: every 50th timestamp is junk,
    some values are not numbers."""
    folder = store.scratch_folder(spark, "stations")
    rows = V.obs(spark, sf)
    text = rows.select(
        F.when(F.col("event_id") % 50 == 0, F.lit("not a time")).otherwise(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        ).alias("fecha"),
        F.when(F.col("event_id") % 31 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("NO2"),
        F.col("series").alias("station"), F.concat("series", F.lit("_NO2.csv")).alias("name"),
    )
    text.write.partitionBy("station", "name").option("header", True).csv(folder)
    return folder


@query(
    "S1_csv_scan",
    """SELECT event_type AS parent, event_type || '_NO2' AS stem, CASE WHEN event_id % 50 <> 0 THEN ts END AS ts,
      CASE WHEN event_id % 31 <> 0 THEN round(value, 6) END AS value FROM events""",
)
def s1(spark, sf):
    rows = files.read_csv(spark, files.dataset_glob(station_files(spark, sf), "NO2", "csv"))
    parent, stem = files.path_parts(F.col("path"), "csv")
    return rows.select(parent.alias("parent"), stem.alias("stem"), "ts", "value")


@query(
    "S2_station_readings",
    "SELECT event_type AS station, ts, CASE WHEN event_id % 31 <> 0 THEN round(value, 6) END AS value FROM events WHERE event_id % 50 <> 0",
)
def s2(spark, sf):
    return files.read_stations(spark, station_files(spark, sf), "NO2")


@query(
    "S3_json_payload",
    V.HOURLY + " SELECT series, ts, round(value, 6) AS value FROM hourly",
)
def s3(spark, sf):
    folder = store.scratch_folder(spark, "payloads")
    # One document per series and day.
    daily = V.hourly(spark, sf).groupBy("series", F.to_date("ts").alias("day")).agg(
        F.collect_list(F.array(F.unix_millis("ts").cast("double"), F.col("value"))).alias("rows")
    )
    documents = daily.select(
        "rows", F.array(F.lit("time"), F.lit("NO2")).alias("cols"),
        F.lit("all").alias("city"), F.concat("series", F.lit("_hourly.json")).alias("name"),
    )
    documents.write.partitionBy("city", "name").option("ignoreNullFields", False).json(folder)
    rows = files.read_payload_series(spark, files.dataset_glob(folder, "hourly", "json"), multi_line=False)
    return rows.select("series", "ts", "value")


@query(
    "S4_tolerant_read",
    """SELECT 'good' AS kind, event_type AS stem, count(*) AS n FROM events WHERE event_id % 50 <> 0 GROUP BY 2
    UNION ALL SELECT 'good', 'payload', count(*) FROM region
    UNION ALL SELECT 'left out: no row with a timestamp', unnest(['broken', 'bytes', 'header', 'text']), 1
    UNION ALL SELECT 'left out: unsupported kind: txt', 'notes', 1""",
)
def s4(spark, sf):
    folder = station_files(spark, sf)
    # A good JSON file beside the readings, and five files that hold none: junk
    # times, no byte, a header alone, broken JSON, another kind.
    one = V.table(spark, sf, "region").coalesce(1)
    # One document of all regions.
    points = one.agg(F.collect_list(F.array(F.col("r_regionkey") * 3_600_000.0, F.col("r_regionkey").cast("double"))).alias("rows"))
    points.withColumn("cols", F.array(F.lit("time"), F.lit("NO2"))).write.json(f"{folder}/station=x/name=payload_NO2.json")
    junk = one.select(F.lit("junk").alias("fecha"), F.col("r_name").alias("NO2"))
    junk.write.option("header", True).csv(f"{folder}/station=x/name=broken_NO2.csv")
    junk.where("false").write.csv(f"{folder}/station=x/name=bytes_NO2.csv")
    junk.where("false").write.option("header", True).csv(f"{folder}/station=x/name=header_NO2.csv")
    one.select(F.concat(F.lit('{"rows": [['), "r_name").alias("value")).write.text(f"{folder}/station=x/name=notes_NO2.txt")
    # The JSON writer would mend what is broken; a CSV of broken lines is left as text.
    one.select(F.lit("no time at all").alias("value")).write.option("header", True).csv(f"{folder}/station=x/name=text_NO2.csv")
    good, left_out = files.read_tolerant(spark, [f"{folder}/*"])
    stem = files.short_name(files.path_parts(F.col("path"), "[a-z]+")[1])
    counts = good.groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("good"))
    missing = left_out.groupBy(stem.alias("stem"), F.concat(F.lit("left out: "), "reason").alias("kind")).agg(
        F.countDistinct(stem).alias("n")
    )
    return counts.unionByName(missing)


_CLEAN = r"replace(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[^\pL\pM\pN_\-\. ]+', '_', 'g'), ' ', '_')"


@query(
    "S5_series_names",
    f"""WITH n AS (SELECT page_id, url, {_CLEAN.format("regexp_replace(url, '/[^/]*$', '')")} AS parent,
      {_CLEAN.format("regexp_extract(url, '([^/]*)$', 1)")} AS stem FROM pages),
    l AS (SELECT page_id, CASE WHEN contains(lower(stem), 'no2') THEN parent || '__' || stem ELSE parent || '__' || stem || '__NO2' END AS name,
      regexp_extract(url, '^([^_]*)', 1) AS short FROM n),
    k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) - 1 AS k FROM l)
    SELECT page_id, short, CASE WHEN k = 0 THEN name ELSE name || '_' || k END AS name FROM k""",
)
def s5(spark, sf):
    pages = V.table(spark, sf, "pages")
    parent, stem = F.regexp_replace("url", "/[^/]*$", ""), F.regexp_extract("url", "([^/]*)$", 1)
    named = pages.select(
        "page_id", files.short_name(F.col("url")).alias("short"), files.long_name(parent, stem, F.lit("NO2")).alias("name")
    )
    return files.unique_names(named, order="page_id", block=floor_div(F.col("page_id"), 100_000))


@query(
    "S6_column_by_position",
    V.DAILY + """, odd AS (SELECT series, ts, CASE WHEN day(ts) % 9 <> 0 THEN value END AS value FROM daily),
    raw AS (SELECT o_orderpriority AS series, o_orderdate AS ts, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT g.series, g.ts, CASE WHEN day(g.ts) % 9 <> 0 THEN round(g.value, 6) END AS value FROM daily_grid g""",
)
def s6(spark, sf):
    folder = store.scratch_folder(spark, "columns")
    rows = V.daily(spark, sf)
    text = rows.select(
        "series", F.date_format("ts", "yyyy-MM-dd").alias("fecha"), F.lit("x").alias("note"),
        F.when(F.dayofmonth("ts") % 9 == 0, F.lit("?")).otherwise(F.col("value").cast("string")).alias("value"),
    )
    text.write.partitionBy("series").option("header", True).csv(folder)
    raw = spark.read.option("header", True).schema("fecha string, note string, value string, series string").csv(folder)
    return files.load_series(raw, 1, DAY).select("series", "ts", "value")


@query(
    "S7_series_gate",
    V.DAILY + """, ok AS (SELECT series FROM daily_grid GROUP BY 1 HAVING count(*) >= 300 AND avg((value IS NOT NULL)::INT) >= 0.716)
    SELECT series, ts, round(value, 6) AS value FROM daily_grid WHERE series IN (SELECT series FROM ok)""",
)
def s7(spark, sf):
    rows = V.daily_grid(spark, sf).select("series", "ts", "value")
    return splits.enough_points(rows, min_points=300, min_ratio=0.716)


@query(
    "S8_csv_report",
    "SELECT o_orderpriority AS model, round(avg(o_totalprice), 6) AS mae, count(*) AS n FROM orders GROUP BY 1",
)
def s8(spark, sf):
    folder = store.scratch_folder(spark, "report")
    report = V.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.avg("o_totalprice").alias("mae"), F.count(F.lit(1)).alias("n")
    )
    store.write_report(report, folder, ["model"])
    return store.read_report(spark, folder, "model string, mae double, n bigint")


@query(
    "S9_score_store",
    FLAGS + _POOLED + f""", macro AS (SELECT detector, avg(rate) <= 0.07 AS kept FROM pooled GROUP BY 1),
    names AS (SELECT list_sort(list(detector) FILTER (kept)) AS kept, list_sort(list(detector) FILTER (NOT kept)) AS discarded FROM macro)
    SELECT s.detector, s.series, s.segment, s.ts, round(s.score, 6) AS score, (day(s.ts) = 13)::INT AS label,
      list_contains(n.kept, s.detector) AS kept, list_contains(n.discarded, s.detector) AS discarded, 0.07 AS budget
    FROM scores s, names n""",
)
def s9(spark, sf):
    folder = store.scratch_folder(spark, "store")
    scores = segment_scores(spark, sf)
    rates = screen.pooled_rates(screen.flag(scores, GROUP, ready=True))
    results = cut(rates.join(screen.split_by_rate(rates), "detector"))
    labels = scores.select("series", "ts").distinct().withColumn("label", (F.dayofmonth("ts") == 13).cast("int"))
    # A version that the second one replaces, and another run beside them.
    store.save_run(folder, "first", "unlabelled", scores=scores.where("detector = 'IQR'"), results=results, config={"budget": 0.5})
    for run in ("other", "first"):
        store.save_run(folder, run, "synthetic", scores=scores, results=results, labels=labels, config={"budget": 0.07})
    kept = store.load_run(spark, folder, "first")
    rows = kept.scores.join(kept.labels, ["series", "ts"])
    return rows.select(
        "detector", "series", "segment", "ts", "score", "label", F.col("detector").isin(kept.kept).alias("kept"),
        F.col("detector").isin(kept.discarded).alias("discarded"), F.lit(kept.config["budget"]).alias("budget"),
    )


@query(
    "S10_keyed_replace",
    """WITH c AS (SELECT o_orderpriority AS model_name, year(o_orderdate) AS epoch, avg(o_totalprice) AS train_loss FROM orders GROUP BY 1, 2)
    SELECT model_name, epoch, round(train_loss, 6) AS train_loss FROM c WHERE model_name NOT IN ('2-HIGH', '5-LOW')
    UNION ALL SELECT model_name, epoch + 1, round(train_loss / 2, 6) FROM c WHERE model_name IN ('2-HIGH', '5-LOW')""",
)
def s10(spark, sf):
    old = V.table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("model_name"), F.year("o_orderdate").cast("bigint").alias("epoch")
    ).agg(F.avg("o_totalprice").alias("train_loss"))
    new = old.where(F.col("model_name").isin("2-HIGH", "5-LOW")).select(
        "model_name", (F.col("epoch") + 1).alias("epoch"), (F.col("train_loss") / 2).alias("train_loss")
    )
    return store.replace_rows(old, new)


@query(
    "S11_observation_query",
    f"""SELECT '5min' AS form, event_type AS series, ts, round(value, 6) AS value FROM events WHERE {WINDOW}
    UNION ALL SELECT 'hourly', event_type, date_trunc('hour', ts), round(avg(value), 6) FROM events WHERE {HOUR_WINDOW} GROUP BY 2, 3""",
)
def s11(spark, sf):
    raw = V.obs(spark, sf)
    plain = feed.observations(raw, FROM_MS, TO_MS).withColumn("form", F.lit("5min"))
    return plain.unionByName(feed.observations(raw, FROM_MS, TO_MS, hourly=True).withColumn("form", F.lit("hourly")))


@query(
    "S12_feed_grid",
    f"WITH {V.OBS}, {V.SLOTS}, {V.GRID5} SELECT series, ts, round(value, 6) AS value FROM grid5",
)
def s12(spark, sf):
    raw = V.obs(spark, sf).select("series", F.unix_millis("ts").alias("ms"), "value", "event_id")
    return feed.grid_feed(raw).select("series", "ts", "value")


@query(
    "S13_pollutant_names",
    """WITH l AS (SELECT concat_ws(',', o_orderstatus, ' pm2.5 ', o_orderpriority, 'no2 ', 'PM2_5', ' o3') AS names FROM orders),
    i AS (SELECT upper(trim(unnest(string_split(names, ',')))) AS item FROM l),
    a AS (SELECT CASE WHEN item IN ('PM2.5', 'PM2_5') THEN 'PM25' ELSE item END AS pollutant FROM i)
    SELECT pollutant, regexp_matches(pollutant, '^[A-Z][A-Z0-9_]*$') AS valid, count(*) AS n FROM a GROUP BY 1, 2""",
)
def s13(spark, sf):
    lists = V.table(spark, sf, "orders").select(
        F.concat_ws(",", "o_orderstatus", F.lit(" pm2.5 "), "o_orderpriority", F.lit("no2 "), F.lit("PM2_5"), F.lit(" o3")).alias("names")
    )
    valid, rejected = feed.pollutant_names(lists, "names")
    both = valid.withColumn("valid", F.lit(True)).unionByName(rejected.withColumn("valid", F.lit(False)))
    return both.groupBy("pollutant", "valid").agg(F.count(F.lit(1)).alias("n"))
