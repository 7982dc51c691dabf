"""Parsers of live feeds and files: JSON, GeoJSON, XML and HTML documents to typed rows.

Each takes a DataFrame with a column of whole documents and gives rows; parts that
don't have the expected form are left out, as a feed's bad rows must not fail the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATIONS = "data struct<stations: array<struct<station_id: string, name: string, lat: double, lon: double, capacity: int>>>, last_updated long"
STATUS = "data struct<stations: array<struct<station_id: string, num_bikes_available: int, num_docks_available: int, is_renting: string, last_reported: long>>>, last_updated long"
BIKES = "data struct<bikes: array<struct<bike_id: string, lat: double, lon: double, is_reserved: string, is_disabled: string, current_range_meters: double>>>"
PLANS = "data struct<plans: array<struct<plan_id: string, name: string, currency: string, price: double, per_min_pricing: array<struct<start: int, rate: double, interval: int>>>>>"
ZONES = "data struct<geofencing_zones: struct<features: array<struct<geometry: struct<type: string, coordinates: array<array<array<array<double>>>>>, properties: struct<name: string, rules: array<struct<ride_allowed: string, maximum_speed_kph: double>>>>>>>"
FEATURES = "features array<struct<id: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
ALERTS = "features array<struct<id: string, properties: struct<event: string, severity: string, headline: string, onset: string, ends: string, expires: string>>>"
TRAINS = "Trains array<struct<LocationCode: string, Line: string, DestinationName: string, Min: string, Car: string>>"
PREDICTIONS = "Predictions array<struct<RouteID: string, DirectionText: string, Minutes: int, VehicleID: string, TripID: string>>"
RAIN = "properties struct<quantitativePrecipitation: struct<values: array<struct<validTime: string, value: double>>>>"


def _rows(docs: DataFrame, column: str, schema: str, path: str, keep: list[str]) -> DataFrame:
    parsed = docs.withColumn("__doc", F.from_json(column, schema))
    return parsed.select(*keep, F.explode(F.col(f"__doc.{path}")).alias("__row")).select(*keep, "__row.*")


def on_earth(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def stations(docs: DataFrame, column: str = "doc", keep=()) -> DataFrame:
    return _rows(docs, column, STATIONS, "data.stations", list(keep)).where(F.col("station_id").isNotNull() & on_earth(F.col("lat"), F.col("lon")))


def station_status(docs: DataFrame, column: str = "doc", keep=()) -> DataFrame:
    rows = _rows(docs, column, STATUS, "data.stations", list(keep)).where("station_id is not null and num_bikes_available >= 0 and num_docks_available >= 0")
    return rows.withColumn("is_renting", F.lower("is_renting").isin("1", "true"))


def free_bikes(docs: DataFrame, column: str = "doc", keep=()) -> DataFrame:
    rows = _rows(docs, column, BIKES, "data.bikes", list(keep)).where(F.col("bike_id").isNotNull() & on_earth(F.col("lat"), F.col("lon")))
    flag = lambda c: F.coalesce(F.lower(c).isin("1", "true"), F.lit(False))
    return rows.where(~flag("is_reserved") & ~flag("is_disabled")).drop("is_reserved", "is_disabled")


def pricing(docs: DataFrame, column: str = "doc", keep=()) -> DataFrame:
    """A row for each step of each plan; a plan without steps has one, with nulls."""
    rows = _rows(docs, column, PLANS, "data.plans", list(keep)).where("plan_id is not null and price >= 0")
    return rows.withColumn("step", F.explode_outer("per_min_pricing")).select(*keep, "plan_id", "name", "currency", "price", "step.start", "step.rate", "step.interval")


def zones(docs: DataFrame, column: str = "doc", keep=()) -> DataFrame:
    """A row for each outer ring: name, ring as array of [lon, lat], whether rides may pass, and the speed limit."""
    rows = _rows(docs, column, ZONES, "data.geofencing_zones.features", list(keep))
    rule = F.get(F.col("properties.rules"), F.lit(0))
    each = rows.select(*keep, F.col("properties.name").alias("name"), rule["ride_allowed"].alias("ride_allowed"), rule["maximum_speed_kph"].alias("speed_kph"), F.explode("geometry.coordinates").alias("polygon"))
    return each.withColumn("ring", F.get("polygon", F.lit(0))).drop("polygon").where(F.size("ring") >= 4)


def features(docs: DataFrame, column: str = "doc", keep=()) -> DataFrame:
    """GeoJSON features with properties as a map and coordinates as JSON text."""
    return _rows(docs, column, FEATURES, "features", list(keep))


def permits(docs: DataFrame, now: Column, column: str = "doc", start: str = "start", end: str = "end", keep=()) -> DataFrame:
    """Features whose time span, in epoch milliseconds, holds now."""
    rows = features(docs, column, keep)
    at = lambda k: F.timestamp_millis(F.col("properties").getItem(k).try_cast("long"))
    rows = rows.withColumns({"starts": at(start), "ends": at(end)})
    return rows.where((F.col("starts") <= now) & (F.col("ends") >= now))


def weather_alerts(docs: DataFrame, now: Column, events: list[str], column: str = "doc", keep=()) -> DataFrame:
    rows = _rows(docs, column, ALERTS, "features", list(keep)).select(*keep, "id", "properties.*")
    rows = rows.withColumns({"onset": F.try_to_timestamp("onset"), "until": F.coalesce(F.try_to_timestamp("ends"), F.try_to_timestamp("expires"))})
    return rows.where(F.col("event").isin(events) & (F.col("onset") <= now) & (F.col("until") > now)).drop("ends", "expires")


def rain(docs: DataFrame, column: str = "doc", keep=()) -> DataFrame:
    """Steps of precipitation: when each begins, for how many hours, millimetres."""
    rows = _rows(docs, column, RAIN, "properties.quantitativePrecipitation.values", list(keep))
    hours = F.coalesce(F.regexp_extract("validTime", r"/P(?:(\d+)D)?T?(?:(\d+)H)?", 1).try_cast("int"), F.lit(0)) * 24 + F.coalesce(F.regexp_extract("validTime", r"/P(?:(\d+)D)?T?(?:(\d+)H)?", 2).try_cast("int"), F.lit(0))
    return rows.select(*keep, F.try_to_timestamp(F.regexp_extract("validTime", "^([^/]+)", 1)).alias("begins"), hours.alias("hours"), F.col("value").alias("mm")).where("hours > 0 and mm is not null")


def trains(docs: DataFrame, column: str = "doc", keep=()) -> DataFrame:
    """Arrivals; minutes is 0 for boarding and arriving trains, null where it isn't known."""
    rows = _rows(docs, column, TRAINS, "Trains", list(keep)).where("LocationCode is not null")
    return rows.withColumn("minutes", F.when(F.col("Min").isin("ARR", "BRD"), 0).otherwise(F.col("Min").try_cast("int"))).drop("Min")


def predictions(docs: DataFrame, column: str = "doc", keep=()) -> DataFrame:
    return _rows(docs, column, PREDICTIONS, "Predictions", list(keep)).where("RouteID is not null and Minutes >= 0")


def track_points(docs: DataFrame, column: str = "doc", keep=()) -> DataFrame:
    """Points of GPX documents in order: n, lon, lat, ele (null where missing)."""
    points = F.regexp_extract_all(F.col(column), F.lit(r"(?s)(<trkpt\b.*?(?:/>|</trkpt>))"), F.lit(1))
    rows = docs.select(*keep, F.posexplode(points).alias("n", "p"))
    number = lambda pattern: F.regexp_extract("p", pattern, 1).try_cast("double")
    return rows.select(*keep, "n", number(r"""\blon\s*=\s*["']([^"']+)""").alias("lon"), number(r"""\blat\s*=\s*["']([^"']+)""").alias("lat"), number(r"<ele>\s*([^<]+?)\s*</ele>").alias("ele")).where("lon is not null and lat is not null")


def html_items(docs: DataFrame, tag: str, column: str = "html", keep=()) -> DataFrame:
    """Texts of one kind of element, markup taken out and white space turned to single spaces."""
    inner = F.regexp_extract_all(F.col(column), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    plain = F.trim(F.regexp_replace(F.regexp_replace("item", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return docs.select(*keep, F.posexplode(inner).alias("n", "item")).withColumn("item", plain).where("item != ''")


def html_links(docs: DataFrame, column: str = "html", keep=()) -> DataFrame:
    """Links in order: n, href, text."""
    tags = F.regexp_extract_all(F.col(column), F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), F.lit(1))
    rows = docs.select(*keep, F.posexplode(tags).alias("n", "a"))
    href = F.regexp_extract("a", r"""(?i)href\s*=\s*["']?([^"'>\s]+)""", 1)
    return rows.select(*keep, "n", href.alias("href"), F.trim(F.regexp_replace("a", r"(?s)<[^>]*>", "")).alias("text")).where("href != ''")


def override_rows(docs: DataFrame, column: str = "doc", keep=()) -> DataFrame:
    """A file's `rows`, and one row for each way of each of its `groups`."""
    schema = "rows array<struct<kind: string, way: long, value: string, reason: string>>, groups array<struct<kind: string, ways: array<long>, value: string, reason: string>>"
    parsed = docs.withColumn("d", F.from_json(column, schema))
    single = parsed.select(*keep, F.explode("d.rows").alias("r")).select(*keep, "r.kind", "r.way", "r.value", "r.reason")
    grouped = parsed.select(*keep, F.explode("d.groups").alias("g")).select(*keep, "g.kind", F.explode("g.ways").alias("way"), "g.value", "g.reason")
    return single.unionByName(grouped)


def checked(rows: DataFrame, keys: DataFrame, on: list[str], what: str) -> DataFrame:
    """rows, after refusing any whose key isn't among keys."""
    stray = rows.join(keys, on, "left_anti").select(*on).first()
    if stray:
        raise ValueError(f"{what}: {stray.asDict()} isn't known")
    return rows
