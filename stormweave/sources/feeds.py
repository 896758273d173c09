"""Feed documents to canonical report rows.

A mapping takes rows with one landed document each (`spark.read.text(path, wholetext=True)`, a log topic, or
any column of JSON or XML text) and returns one row per report with the canonical columns and `errors`;
`contracts.accepted` and `contracts.rejected` split them. Bad items never fail the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormweave import rules
from stormweave.functions import identity, text
from stormweave.functions.binding import staged
from stormweave.functions.spatial import GRID, HexGrid
from stormweave.operators.contracts import broken_rules, coordinate_errors
from stormweave.operators.dedup import keep_first
from stormweave.schemas import REPORT_DDL, SCHEMA_VERSION, columns

SourceMapping = Callable[..., DataFrame]
_REGISTRY: dict[str, SourceMapping] = {}


def source_mapping(name: str) -> Callable[[SourceMapping], SourceMapping]:
    """Register a feed mapping under a name, so that jobs can pick it by configuration."""

    def register(mapping: SourceMapping) -> SourceMapping:
        _REGISTRY[name] = mapping
        return mapping

    return register


def mapping(name: str) -> SourceMapping:
    return _REGISTRY[name]


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _canonical(
    rows: DataFrame, fields: dict[str, Column], errors: dict[str, Column], extra: tuple[str, ...] = (), grid: HexGrid = GRID
) -> DataFrame:
    """Fill the canonical columns, derive id and cell, and collect the errors."""
    defaults: dict[str, Column] = {
        "received_at": F.current_timestamp(),
        "event_category": _null(),
        "city": _null(),
        "district": _null(),
        "state": _null(),
        "country": F.lit("India"),
        "url": _null(),
        "media_urls": F.array().cast("array<string>"),
        "media_items": F.array().cast("array<struct<url:string,media_type:string,caption:string,source_metadata:string>>"),
        "hashtags": F.array().cast("array<string>"),
        "language": _null(),
        "schema_version": F.lit(SCHEMA_VERSION),
    }
    filled = staged(rows, {**defaults, **fields})
    lat, lon = F.col("latitude"), F.col("longitude")
    all_errors = {**errors, "missing_timestamp": F.col("timestamp").isNull(), **coordinate_errors(lat, lon, grid)}
    return filled.select(
        *[
            identity.report_id(F.col("source"), F.col("source_id"), F.col("timestamp")).alias(c)
            if c == "report_id"
            else grid.cell(lat, lon).alias(c)
            if c == "cell"
            else F.col(c)
            for c in columns(REPORT_DDL)
        ],
        *extra,
        broken_rules(**all_errors).alias("errors"),
    )


def _items(document: Column, *wrappers: str, single: Column | None = None) -> Column:
    """JSON texts of the items: a list, an object wrapping a list under one of the keys, or one object."""
    fields = F.from_json(document, ", ".join(f"{w} string" for w in wrappers))
    listed = F.when(document.startswith("["), F.from_json(document, "array<string>"))
    for wrapper in wrappers:
        listed = listed.when(fields[wrapper].startswith("["), F.from_json(fields[wrapper], "array<string>"))
    alone = document.startswith("{") if single is None else document.startswith("{") & single
    return listed.when(alone, F.array(document))


def _exploded(documents: DataFrame, document: str, items: Column) -> DataFrame:
    """One row per item; an unreadable document stays as one row without an item."""
    return documents.select(F.col(document).alias("_document"), F.posexplode_outer(items).alias("_position", "_item"))


# --- S1, S2, J7: observations -------------------------------------------------------------------------------

_STATION = (
    "station_id string, station string, obs_date string, obs_time_utc string, temperature string, humidity string,"
    " wind_speed string, wind_direction string, rainfall_24h string, latitude double, longitude double"
)


def station_sentence(
    name: Column, temperature: Column, humidity: Column, rainfall: Column, wind: Column
) -> Column:
    """Observation as a sentence; missing readings are said to be missing."""

    def said(label: str, value: Column, unit: str, missing: str) -> Column:
        return F.coalesce(F.concat(F.lit(label), value, F.lit(unit)), F.lit(missing))

    return F.concat(
        F.lit("IMD Current Weather observation for "), name, F.lit(": "),
        said("Temperature ", temperature, "°C", "Temperature not reported"), F.lit(", "),
        said("Relative Humidity ", humidity, "%", "Humidity not reported"), F.lit(", "),
        said("Rainfall (24h) ", rainfall, " mm", "Rainfall (24h) not reported"), F.lit(", "),
        said("Wind Speed ", wind, " km/h", "Wind speed not reported"), F.lit("."),
    )


def grid_sentence(
    latitude: Column, longitude: Column, temperature: Column, humidity: Column, rain: Column, wind: Column, code: Column
) -> Column:
    def value(v: Column) -> Column:
        return F.coalesce(v, F.lit("None"))

    return F.concat(
        F.format_string("Open-Meteo weather observation for coordinates (%.4f, %.4f): ", latitude, longitude),
        F.lit("Temperature "), value(temperature), F.lit("°C, Relative Humidity "), value(humidity),
        F.lit("%, Precipitation "), value(rain), F.lit(" mm, Wind Speed "), value(wind),
        F.lit(" km/h, Weather Code "), value(code), F.lit("."),
    )


def observed_category(rain: Column, sentence: Column, reference_mode: bool) -> Column:
    """A structured reading is rain only when rain fell; the sentence alone would always say so."""
    if reference_mode:
        return text.event_category(sentence)
    return F.when(rain.try_cast("double") > 0, F.lit("RAIN")).otherwise(F.lit(rules.OTHER))


@source_mapping("stations")
def station_reports(documents: DataFrame, document: str = "value", reference_mode: bool = False) -> DataFrame:
    """Station observations: a list, `{"data": [...]}` or one object.

    Numeric readings carry their own category and are never taken as negated because a reading is missing;
    `reference_mode` classifies the sentence instead.
    """
    body = F.col(document)
    one = F.get_json_object(body, "$.station_id").isNotNull() | F.get_json_object(body, "$.station").isNotNull()
    rows = _exploded(documents, document, _items(body, "data", single=one))
    rows = staged(rows, {"o": F.from_json("_item", _STATION)})
    station, name = text.blank_to_null(F.col("o.station_id")), text.blank_to_null(F.col("o.station"))
    sentence = station_sentence(
        F.coalesce(name, F.concat(F.lit("Station "), station)),
        F.col("o.temperature"), F.col("o.humidity"), F.col("o.rainfall_24h"), F.col("o.wind_speed"),
    )
    fields = {
        "source": F.lit("imd"),
        "source_type": F.lit("official"),
        "source_id": F.coalesce(station, name),
        "timestamp": identity.observation_timestamp(F.col("o.obs_date"), F.col("o.obs_time_utc")),
        "text": sentence,
        "latitude": F.col("o.latitude"),
        "longitude": F.col("o.longitude"),
        "city": name,
        "raw_payload": F.col("_item"),
        "event_category": observed_category(F.col("o.rainfall_24h"), sentence, reference_mode),
        "is_negated": text.is_negated(sentence) if reference_mode else F.lit(False),
    }
    errors = {
        "malformed_document": F.col("_item").isNull(),
        "missing_station": F.coalesce(station, name).isNull(),
    }
    return _canonical(rows, fields, errors, ("is_negated",))


_GRID_POINT = (
    "latitude double, longitude double, current struct<time:string,temperature_2m:string,relative_humidity_2m:string,"
    "precipitation:string,weather_code:string,wind_speed_10m:string>"
)


@source_mapping("grid_points")
def grid_point_reports(
    documents: DataFrame,
    document: str = "value",
    latitude: str = "requested_latitude",
    longitude: str = "requested_longitude",
    reference_mode: bool = False,
) -> DataFrame:
    """Grid-point observations with the coordinates that were asked for."""
    named = {"_item": F.col(document), "_lat": F.col(latitude), "_lon": F.col(longitude)}
    rows = staged(documents, {**named, "o": F.from_json(document, _GRID_POINT)})
    now = F.col("o.current")
    sentence = grid_sentence(
        F.col("_lat"), F.col("_lon"), now["temperature_2m"], now["relative_humidity_2m"], now["precipitation"],
        now["wind_speed_10m"], now["weather_code"],
    )
    place_columns = [c for c in ("city", "state") if c in documents.columns]
    fields = {
        "source": F.lit("open_meteo"),
        "source_type": F.lit("weather_api"),
        "source_id": F.format_string("om_%.4f_%.4f", F.col("_lat"), F.col("_lon")),
        "timestamp": identity.utc_timestamp(now["time"], assume_utc_if_naive=True),
        "text": sentence,
        "latitude": F.col("_lat"),
        "longitude": F.col("_lon"),
        "raw_payload": F.col("_item"),
        "event_category": observed_category(now["precipitation"], sentence, reference_mode),
        "is_negated": text.is_negated(sentence) if reference_mode else F.lit(False),
        **{c: F.col(c) for c in place_columns},
    }
    return _canonical(rows, fields, {"missing_current": now.isNull()}, ("is_negated",))


def with_city(observations: DataFrame, cities: DataFrame) -> DataFrame:
    """Name and state of the polled city, looked up by its coordinates to four decimals.

    Only given coordinates are used; none are made up for text-only reports.
    """
    key = [F.round("latitude", 4).alias("_lat"), F.round("longitude", 4).alias("_lon")]
    named = cities.select(*key, F.col("city").alias("_city"), F.col("state").alias("_state"))
    return (
        observations.join(
            named,
            (F.round("latitude", 4) == F.col("_lat")) & (F.round("longitude", 4) == F.col("_lon")),
            "left",
        )
        .withColumns({"city": F.coalesce("city", "_city"), "state": F.coalesce("state", "_state")})
        .drop("_lat", "_lon", "_city", "_state")
    )


# --- S3, S6: social posts -----------------------------------------------------------------------------------

_POST = (
    "text string, content string, caption string, source_id string, post_id string, id string, tweet_id string,"
    " timestamp string, created_at string, pubDate string, date string, source string, url string, link string,"
    " hashtags string, language string, lang string"
)


@source_mapping("social")
def social_reports(
    documents: DataFrame, document: str = "value", default_source: str = "x_social", grid: HexGrid = GRID
) -> DataFrame:
    """Social posts: a list, `{"social_posts": [...]}` or one object, with aliased field names (S3)."""
    rows = _exploded(documents, document, _items(F.col(document), "social_posts"))
    rows = staged(rows, {"o": F.from_json("_item", _POST), "_place": text.location(F.col("_item"))})
    post = F.col("o")
    body = text.first_filled(post["text"], post["content"], post["caption"])
    own_tags = F.when(post["hashtags"].startswith("["), F.from_json(post["hashtags"], "array<string>"))
    own_tags = F.filter(F.transform(own_tags, text.strip), lambda t: t != "")
    none = F.array().cast("array<string>")
    stamp = text.first_filled(post["timestamp"], post["created_at"], post["pubDate"], post["date"])
    fields = {
        "source": F.lower(F.coalesce(text.blank_to_null(post["source"]), F.lit(default_source))),
        "source_type": F.lit("social_media"),
        "source_id": text.blank_to_null(
            text.first_filled(post["source_id"], post["post_id"], post["id"], post["tweet_id"])
        ),
        "timestamp": identity.utc_timestamp(stamp, assume_utc_if_naive=True),
        "text": text.strip(body),
        **{c: F.col(f"_place.{c}") for c in ("latitude", "longitude", "city", "district", "state", "country")},
        "url": text.blank_to_null(text.first_filled(post["url"], post["link"])),
        "media_urls": text.media_urls(body, F.col("_item")),
        "hashtags": F.array_distinct(F.concat(text.hashtags(body), F.coalesce(own_tags, none))),
        "language": text.language(body, text.first_filled(post["language"], post["lang"])),
        "raw_payload": F.col("_item"),
    }
    errors = {
        "malformed_document": F.col("_item").isNull(),
        "missing_text": text.blank_to_null(body).isNull(),
        "missing_source_id": F.col("source_id").isNull(),
    }
    return _canonical(rows, fields, errors, grid=grid)


def timeline_posts(documents: DataFrame, document: str = "value", tag: str = "tag") -> DataFrame:
    """Landed hashtag timelines to post JSON that `social_reports` reads."""
    status = "id string, content string, created_at string, url string, media_attachments array<struct<url:string>>"
    items = F.from_json(document, "array<string>")
    rows = documents.select(F.col(tag).alias("_tag"), F.explode(items).alias("_item")).withColumn(
        "o", F.from_json("_item", status)
    )
    clean = text.strip(F.regexp_replace(F.coalesce("o.content", F.lit("")), "<[^>]+>", " "))
    urls = F.filter(F.transform("o.media_attachments", lambda m: m["url"]), lambda u: u != "")
    name = F.lower(F.trim(F.regexp_replace(F.col("_tag"), "^#+", "")))
    return rows.filter(clean != "").select(
        F.to_json(
            F.struct(
                F.col("o.id").alias("source_id"),
                F.lit("mastodon_social").alias("source"),
                clean.alias("text"),
                F.coalesce(F.col("o.created_at"), identity.iso_utc(F.current_timestamp())).alias("timestamp"),
                F.col("o.url").alias("url"),
                F.coalesce(urls, F.array().cast("array<string>")).alias("media_urls"),
                F.array(F.concat(F.lit("#"), name)).alias("hashtags"),
            )
        ).alias("value")
    )


# --- S4, S5: news -------------------------------------------------------------------------------------------

_ENTRY = (
    "struct<title:string,description:string,summary:string,content:string,guid:string,id:string,pubDate:string,"
    "published:string,updated:string,date:string,link:array<struct<_VALUE:string,_href:string>>,"
    "enclosure:array<struct<_url:string>>,thumbnail:array<struct<_url:string>>>"
)
_FEED = f"channel struct<language:string,item:array<{_ENTRY}>>, language string, item array<{_ENTRY}>, entry array<{_ENTRY}>"


def news_text(title: Column, description: Column) -> Column:
    """Headline and description as one text."""
    joined = F.regexp_replace(F.concat(title, F.lit(". "), description), r"^[ .]+|[ .]+$", "")
    return F.when(description != "", joined).otherwise(title)


def _news(rows: DataFrame, parts: dict[str, Column], only_relevant: bool, media: Column, place: Column | None) -> DataFrame:
    title, description = text.strip_markup(parts["title"]), text.strip_markup(parts["description"])
    rows = staged(rows, {"_title": title, "_description": description})
    rows = staged(rows, {"_text": news_text(F.col("_title"), F.col("_description"))})
    if only_relevant:
        # Items without a date or text are kept as rejects even when they are not relevant.
        rows = rows.filter(text.is_relevant(F.col("_text")) | (F.col("_text") == ""))
    link = text.blank_to_null(parts["link"])
    fallback = F.concat(
        F.lit("news_"), F.substring(F.sha2(F.concat_ws(":", "_title", F.coalesce(link, F.lit(""))), 256), 1, 16)
    )
    fields = {
        "source": parts["source"],
        "source_type": F.lit("news"),
        "source_id": F.coalesce(text.blank_to_null(parts["guid"]), link, fallback),
        "timestamp": identity.rss_timestamp(parts["date"]),
        "text": F.col("_text"),
        "latitude": _null("double") if place is None else place["latitude"],
        "longitude": _null("double") if place is None else place["longitude"],
        "country": _null() if place is None else place["country"],
        "url": link,
        "hashtags": text.hashtags(F.col("_text")),
        "media_urls": media,
        "language": text.language(F.col("_text"), parts["language"]),
        "raw_payload": parts["raw"],
    }
    if place is not None:
        fields |= {c: place[c] for c in ("city", "district", "state")}
    errors = {"missing_text": F.col("text") == "", "malformed_document": parts["malformed"]}
    if "_feed" not in rows.columns:
        return _canonical(rows, fields, errors)
    checked = _canonical(rows, fields, errors, ("_feed", "_position"))
    # Keep the first item of an id within its feed; every reject stays, under its position.
    own_key = F.concat(F.lit("reject-"), F.coalesce("_position", F.lit(-1)).cast("string"))
    keyed = checked.withColumn("_key", F.when(F.size("errors") == 0, F.col("report_id")).otherwise(own_key))
    return keep_first(keyed, ["_feed", "_key"], [F.col("_position")]).drop("_feed", "_position", "_key")


@source_mapping("rss")
def rss_reports(documents: DataFrame, document: str = "value", only_relevant: bool = True) -> DataFrame:
    """RSS 2.0 and Atom documents (S4). Text-only: no coordinates are invented.

    A document, also one landed twice, is a feed of its own: an id that recurs within it gives the first report only.
    """
    feed = documents.select(
        F.monotonically_increasing_id().alias("_feed"),
        F.from_xml(F.col(document), _FEED, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("f"),
    )
    items = F.coalesce("f.channel.item", "f.item", "f.entry")
    rows = feed.select(
        "_feed",
        F.coalesce(F.col("f.channel.language"), F.col("f.language")).alias("_language"),
        F.posexplode_outer(items).alias("_position", "o"),
    )
    item = F.col("o")
    links = item["link"]
    plain = F.get(F.filter(F.transform(links, lambda u: text.strip(u["_VALUE"])), lambda u: u != ""), 0)
    href = F.get(F.filter(F.transform(links, lambda u: u["_href"]), lambda u: u != ""), 0)
    parts = {
        "title": item["title"],
        "description": text.first_filled(item["description"], item["summary"], item["content"]),
        "link": F.coalesce(plain, href),
        "guid": text.first_filled(item["guid"], item["id"]),
        "date": text.first_filled(item["pubDate"], item["published"], item["updated"], item["date"]),
        "language": F.trim("_language"),
        "source": F.lit("news_rss"),
        "malformed": item.isNull(),
    }
    parts["raw"] = F.to_json(
        F.struct(
            F.col("_title").alias("title"),
            F.col("_description").alias("description"),
            parts["link"].alias("link"),
            parts["guid"].alias("guid"),
            parts["date"].alias("pubDate"),
        )
    )
    attached = F.concat(
        *[
            F.coalesce(F.transform(item[name], lambda e: text.strip(e["_url"])), F.array().cast("array<string>"))
            for name in ("enclosure", "thumbnail")
        ]
    )
    media = F.array_distinct(
        F.concat(text.media_urls(F.col("_text")), F.filter(attached, lambda u: u.isNotNull() & (u != "")))
    )
    return _news(rows, parts, only_relevant, media, None)


_NEWS = (
    "title string, description string, summary string, guid string, id string, link string, pubDate string,"
    " published string, updated string, source string, language string"
)


@source_mapping("news_json")
def news_json_reports(documents: DataFrame, document: str = "value", only_relevant: bool = True) -> DataFrame:
    """News items as JSON: a list, an object with `news_items` or `items`, or one object (S5). No item is left out as a repeat."""
    rows = _exploded(documents, document, _items(F.col(document), "news_items", "items"))
    rows = staged(rows, {"o": F.from_json("_item", _NEWS), "_place": text.location(F.col("_item"))})
    item = F.col("o")
    parts = {
        "title": item["title"],
        "description": text.first_filled(item["description"], item["summary"]),
        "link": item["link"],
        "guid": text.first_filled(item["guid"], item["id"], item["link"]),
        "date": text.first_filled(item["pubDate"], item["published"], item["updated"]),
        "language": item["language"],
        "source": F.lower(F.coalesce(text.blank_to_null(item["source"]), F.lit("news_rss"))),
        "malformed": F.col("_item").isNull(),
        "raw": F.col("_item"),
    }
    media = text.media_urls(F.col("_text"), F.col("_item"))
    return _news(rows, parts, only_relevant, media, F.col("_place"))


# --- U1 -----------------------------------------------------------------------------------------------------


def union_sources(*reports: DataFrame) -> DataFrame:
    """All sources as one batch; columns one of them lacks are null."""
    first, *others = reports
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
