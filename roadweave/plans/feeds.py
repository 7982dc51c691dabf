"""Feeds, text keys, rules and ride times."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadweave.functions import rules
from roadweave.plans.registry import query
from roadweave.session import table
from roadweave.sources import feeds
from roadweave.streaming import feeds as streams


@query("SELECT event_type, CAST(CAST(props ->> '$.k' AS BIGINT) % 10 AS BIGINT) AS k, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1, 2")
def json_extract(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").where("props is not null").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"))


@query(
    """WITH items AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1)) AS item FROM pages),
    plain AS (SELECT page_id, trim(regexp_replace(regexp_replace(item, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS item FROM items)
    SELECT page_id, count(*) AS items, CAST(sum(length(item)) AS BIGINT) AS chars FROM plain WHERE item <> '' GROUP BY 1"""
)
def html_items(spark, sf_dir):
    items = feeds.html_items(table(spark, sf_dir, "pages"), "p", keep=["page_id"])
    return items.groupBy("page_id").agg(F.count("*").alias("items"), F.sum(F.char_length("item")).cast("long").alias("chars"))


@query(
    """WITH tags AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<a\\s[^>]*>.*?</a>)', 1)) AS a FROM pages)
    SELECT page_id, count(*) AS links, min(regexp_extract(a, '(?i)href\\s*=\\s*["'']?([^"''>\\s]+)', 1)) AS first FROM tags WHERE regexp_extract(a, '(?i)href\\s*=\\s*["'']?([^"''>\\s]+)', 1) <> '' GROUP BY 1"""
)
def html_links(spark, sf_dir):
    return feeds.html_links(table(spark, sf_dir, "pages"), keep=["page_id"]).groupBy("page_id").agg(F.count("*").alias("links"), F.min("href").alias("first"))


@query("SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS hits, count(*) > 2 AS over FROM events GROUP BY 1, 2")
def ratelimit_window(spark, sf_dir):
    hits = streams.window_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], "1 day")
    return hits.select("user_id", F.floor(F.unix_timestamp("start") / 86400).alias("day"), F.col("n").alias("hits"), (F.col("n") > 2).alias("over"))


@query(
    """WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 DAY THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM m)
    SELECT user_id, count(*) AS n, count(DISTINCT session) AS sessions FROM s GROUP BY 1"""
)
def presence_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.presence(e, "ts", ["user_id"], "2 days").groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("sessions"))


@query("SELECT CAST(ts AS DATE) AS day, event_type AS tool, count(*) AS n FROM events GROUP BY 1, 2")
def tally_upsert(spark, sf_dir):
    from roadweave.sources.sinks import upsert_counts

    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("tool"), "event_id")
    early = e.where("event_id % 2 = 0").groupBy("day", "tool").agg(F.count("*").alias("n"))
    return upsert_counts(early, e.where("event_id % 2 = 1"), ["day", "tool"])


LOCAL = "ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York'"


@query(
    f"""WITH l AS (SELECT {LOCAL} AS t, CAST(floor(value * 100) AS BIGINT) AS v FROM events), m AS (SELECT t, v, hour(t) * 60 + minute(t) AS minute, isodow(t) - 1 AS day, CAST(t AS DATE) AS d FROM l),
    years AS (SELECT unnest(generate_series(1990, 2040)) AS y),
    fixed AS (SELECT make_date(y, m, d) AS day FROM years, (VALUES (1, 1), (6, 19), (7, 4), (11, 11), (12, 25)) AS f(m, d)),
    nth AS (SELECT make_date(y, m, 1) + CAST((w - (isodow(make_date(y, m, 1)) - 1) + 7) % 7 + 7 * (n - 1) AS INTEGER) AS day FROM years, (VALUES (1, 0, 3), (2, 0, 3), (9, 0, 1), (10, 0, 2), (11, 3, 4)) AS f(m, w, n)),
    memorial AS (SELECT make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) AS day FROM years),
    holidays AS (SELECT CASE isodow(day) WHEN 6 THEN day - 1 WHEN 7 THEN day + 1 ELSE day END AS day FROM fixed UNION SELECT day FROM nth UNION SELECT day FROM memorial)
    SELECT CASE WHEN minute >= 1260 OR minute < 420 THEN 'night' WHEN day = 6 AND minute >= 1080 THEN 'weekday_offpeak' WHEN day >= 5 THEN 'weekend'
        WHEN d IN (SELECT day FROM holidays) THEN 'weekday_offpeak' WHEN (minute >= 420 AND minute < 600) OR (minute >= 960 AND minute < 1140) THEN 'weekday_rush' ELSE 'weekday_offpeak' END AS ride_time,
        count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM m GROUP BY 1"""
)
def mean_by_ride_time(spark, sf_dir):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    e = table(spark, sf_dir, "events").select(rules.ride_time(local).alias("ride_time"), F.floor(F.col("value") * 100).alias("v"))
    return e.groupBy("ride_time").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


NAMES = "c_mktsegment || '  Trail ' || CASE c_custkey % 4 WHEN 0 THEN 'Extension' WHEN 1 THEN '(north) x' WHEN 2 THEN 'Northwest' ELSE '' END"


def names(spark, sf_dir):
    tail = F.element_at(F.array(F.lit("Extension"), F.lit("(north) x"), F.lit("Northwest"), F.lit("")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit("  Trail "), tail).alias("name"))


@query(
    f"""SELECT nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower({NAMES}), '\\s*[(\\[].*$', ''), '\\s+(extension|extn|connector|connection)$', ''), '\\s+', ' ', 'g')), '') AS trail,
        nullif(regexp_replace(trim(regexp_replace(lower({NAMES}), '\\s+', ' ', 'g')), ' (northwest|northeast|southwest|southeast|nw|ne|sw|se)$', ''), '') AS street, count(*) AS n FROM customer GROUP BY 1, 2"""
)
def name_key(spark, sf_dir):
    return names(spark, sf_dir).groupBy(rules.trail_key(F.col("name")).alias("trail"), rules.street_key(F.col("name")).alias("street")).agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'cycleway' WHEN 1 THEN 'footway' ELSE 'residential' END AS highway, CASE p_size % 3 WHEN 0 THEN 'track' WHEN 1 THEN 'lane' END AS cycleway, CASE WHEN p_size % 7 = 0 THEN 'no' END AS bicycle FROM part)
    SELECT CASE WHEN bicycle = 'no' THEN NULL WHEN highway = 'cycleway' OR (highway = 'footway' AND bicycle IS NULL) THEN 'path' WHEN cycleway = 'track' THEN 'protected' WHEN cycleway = 'lane' THEN 'lane' ELSE 'none' END AS facility, count(*) AS n FROM t GROUP BY 1"""
)
def facility_rules(spark, sf_dir):
    size = F.col("p_size")
    pairs = F.array(
        F.struct(F.lit("highway").alias("k"), F.when(size % 5 == 0, "cycleway").when(size % 5 == 1, "footway").otherwise("residential").alias("v")),
        F.struct(F.lit("cycleway").alias("k"), F.when(size % 3 == 0, "track").when(size % 3 == 1, "lane").alias("v")),
        F.struct(F.lit("bicycle").alias("k"), F.when(size % 7 == 0, "no").alias("v")),
    )
    tags = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    t = table(spark, sf_dir, "part").select(tags.alias("tags"))
    tag = lambda k: F.col("tags").getItem(k)
    found = rules.first_match(
        [
            (tag("bicycle") == "no", F.lit(None).cast("string")),
            ((tag("highway") == "cycleway") | ((tag("highway") == "footway") & tag("bicycle").isNull()), "path"),
            (tag("cycleway") == "track", "protected"),
            (tag("cycleway") == "lane", "lane"),
        ],
        "none",
    )
    return t.groupBy(found.alias("facility")).agg(F.count("*").alias("n"))


@query(
    """WITH v AS (SELECT CASE p_size % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || ' mph' WHEN 2 THEN p_size || ' km/h' ELSE 'walk' END AS s, p_size || ';' || p_size % 7 || ';x' AS l FROM part)
    SELECT s, l, CASE WHEN s LIKE '%km/h' THEN CAST(split_part(s, ' ', 1) AS DOUBLE) * 0.621371 WHEN s <> 'walk' THEN CAST(split_part(s, ' ', 1) AS DOUBLE) END AS mph,
        CAST(greatest(CAST(split_part(l, ';', 1) AS INTEGER), CAST(split_part(l, ';', 2) AS INTEGER)) AS INTEGER) AS lanes, count(*) AS n FROM v GROUP BY 1, 2, 3, 4"""
)
def parsed_tags(spark, sf_dir):
    size = F.col("p_size")
    s = F.when(size % 4 == 0, size.cast("string")).when(size % 4 == 1, F.concat(size, F.lit(" mph"))).when(size % 4 == 2, F.concat(size, F.lit(" km/h"))).otherwise("walk")
    v = table(spark, sf_dir, "part").select(s.alias("s"), F.concat_ws(";", size, size % 7, F.lit("x")).alias("l"))
    return v.groupBy("s", "l", rules.speed_mph(F.col("s")).alias("mph"), rules.lanes(F.col("l")).alias("lanes")).agg(F.count("*").alias("n"))


@query(
    """WITH f AS (SELECT p_partkey, 60.0 * 0.37 * 0.7 * (p_size * 0.25) * 1.9 AS riders FROM part) SELECT (riders >= 60)::INT + (riders >= 120)::INT + (riders >= 200)::INT AS band, count(*) AS n, CAST(sum(floor(riders)) AS BIGINT) AS riders FROM f GROUP BY 1"""
)
def flow_bands(spark, sf_dir):
    riders = rules.level_riders(F.col("p_size") * 0.25)
    return table(spark, sf_dir, "part").groupBy(rules.band(riders).alias("band")).agg(F.count("*").alias("n"), F.sum(F.floor(riders)).alias("riders"))


@query(
    """SELECT CASE WHEN s > 80000 THEN 'HC' WHEN s > 64000 THEN '1' WHEN s > 32000 THEN '2' WHEN s > 16000 THEN '3' WHEN s > 8000 THEN '4' WHEN s > 4000 THEN '5' END AS category, count(*) AS n FROM (SELECT floor(o_totalprice / 4) AS s FROM orders) GROUP BY 1"""
)
def climb_category(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(rules.climb_category(F.floor(F.col("o_totalprice") / 4)).alias("category")).agg(F.count("*").alias("n"))


@query(
    """WITH k AS (SELECT p_partkey, p_size % 2 = 0 AS rail, p_size % 3 = 0 AS tram, p_size % 5 = 0 AS listed FROM part)
    SELECT nullif(concat_ws(',', CASE WHEN rail THEN 'rail' WHEN listed THEN 'rail/list' END, CASE WHEN tram THEN 'tram' END), '') AS hazard, count(*) AS n FROM k GROUP BY 1"""
)
def hazard_codec(spark, sf_dir):
    size = F.col("p_size")
    kinds = F.array_compact(F.array(F.when(size % 2 == 0, "rail"), F.when(size % 3 == 0, "tram")))
    marked = F.array_compact(F.array(F.when(size % 5 == 0, "rail")))
    return table(spark, sf_dir, "part").groupBy(rules.listed(kinds, marked, ["rail", "tram"]).alias("hazard")).agg(F.count("*").alias("n"))


@query(
    """WITH last AS (SELECT user_id, max(ts) AS read_at FROM events GROUP BY 1), now AS (SELECT max(ts) AS now FROM events)
    SELECT user_id, CASE WHEN epoch(now) - epoch(read_at) > 864000 THEN 'failed' WHEN epoch(now) - epoch(read_at) > 172800 THEN 'old' ELSE 'ok' END AS status, floor(epoch(now)) - floor(epoch(read_at)) > 259200 AS frozen FROM last, now"""
)
def feed_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts").alias("now"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("read_at")).crossJoin(F.broadcast(now))  # now is one row
    return last.select("user_id", streams.status(F.col("read_at"), F.col("now"), 172_800, 864_000).alias("status"), streams.frozen(F.col("read_at"), F.col("now")).alias("frozen"))


@query(
    """WITH a AS (SELECT item_id, text FROM benchmark), seen AS (SELECT text FROM benchmark WHERE item_id % 3 = 0) SELECT item_id FROM a WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.text = a.text)"""
)
def unseen_items(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return items.join(items.where("item_id % 3 = 0").select("text"), "text", "left_anti").select("item_id")


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn, role) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def thread_summary(spark, sf_dir):
    """Ordered collection of a feed's parts: turns of a conversation."""
    c = table(spark, sf_dir, "conversations")
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(roles, ">").alias("roles"), F.sum(F.char_length("text")).cast("long").alias("chars"))
