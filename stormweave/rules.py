"""Rule tables: vocabularies, weights and places. Everything here can be replaced by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Event taxonomy. The order breaks ties between categories.
TAXONOMY: dict[str, tuple[str, ...]] = {
    "RAIN": ("rain", "rainfall", "downpour", "drizzle", "shower", "baarish", "varsha", "precipitation", "mazhai"),
    "FLOOD": ("flood", "flooding", "inundation", "overflow", "deluge", "baadh", "vellam", "bonyo"),
    "WATERLOGGING": (
        "waterlogging",
        "waterlogged",
        "water-logged",
        "submerged",
        "paani bhara",
        "standing water",
        "jal-bhorao",
        "jalbhrav",
        "water logging",
    ),
    "THUNDERSTORM": ("thunderstorm", "thunder", "storm", "tempest", "toofan", "tufan", "idimazhai"),
    "LIGHTNING": ("lightning", "thunderbolt", "bijli", "tadik", "minnal"),
    "HEATWAVE": ("heatwave", "heat wave", "extreme heat", "scorching", "loo", "garmi", "heat wave alert"),
    "FOG": ("fog", "dense fog", "smog", "mist", "low visibility", "kohra", "manju"),
    "DUST_STORM": ("dust storm", "duststorm", "sandstorm", "andhi", "dhool bhari aandhi"),
    "STRONG_WIND": ("strong wind", "gale", "high winds", "gusty wind", "squall", "tez hawa", "kaatru"),
    "HAILSTORM": ("hailstorm", "hail", "ice pellets", "olay", "hairstorm"),
    "CYCLONE": ("cyclone", "typhoon", "hurricane", "tropical storm", "chakrawat", "chuyal"),
}
OTHER = "OTHER"
# Categories that win over any count, strongest first.
OVERRIDES: tuple[str, ...] = ("FLOOD", "WATERLOGGING", "CYCLONE")

# Categories an incident of the given category accepts (not symmetric).
COMPATIBLE: dict[str, tuple[str, ...]] = {
    "RAIN": ("RAIN", "FLOOD", "WATERLOGGING", "THUNDERSTORM"),
    "FLOOD": ("RAIN", "FLOOD", "WATERLOGGING"),
    "WATERLOGGING": ("RAIN", "FLOOD", "WATERLOGGING"),
    "THUNDERSTORM": ("RAIN", "THUNDERSTORM", "LIGHTNING", "STRONG_WIND", "HAILSTORM"),
    "LIGHTNING": ("THUNDERSTORM", "LIGHTNING"),
    "HEATWAVE": ("HEATWAVE",),
    "FOG": ("FOG",),
    "DUST_STORM": ("DUST_STORM", "STRONG_WIND"),
    "STRONG_WIND": ("THUNDERSTORM", "STRONG_WIND", "DUST_STORM", "CYCLONE"),
    "HAILSTORM": ("THUNDERSTORM", "HAILSTORM"),
    "CYCLONE": ("CYCLONE", "STRONG_WIND", "RAIN", "FLOOD"),
    "OTHER": ("OTHER",),
}

# Negation triggers, the words they must be near, and the triggers that need no such word.
NEGATION_PATTERNS: tuple[str, ...] = (
    r"\bno\s+(?:reports?\s+of\s+|signs?\s+of\s+|evidence\s+of\s+)?\b",
    r"\bdid\s+not\b",
    r"\bnot\s+(?:confirmed|reported|observed|detected|seen)\b",
    r"\bfalse\s+alarm\b",
    r"\brumou?r\b",
    r"\bdenied\b",
    r"\bclear\s+sky\b",
    r"\bsun\s+is\s+out\b",
    r"\bnormal\s+traffic\b",
    r"\bno\s+flood\b",
    r"\bno\s+rain\b",
    r"\bno\s+damage\b",
)
PROXIMITY_KEYWORDS: tuple[str, ...] = (
    "rain",
    "flood",
    "storm",
    "wind",
    "fog",
    "hail",
    "cyclone",
    "lightning",
    "heat",
    "waterlogging",
    "inundation",
    "baarish",
    "baadh",
    "toofan",
)
STANDALONE_NEGATIONS: tuple[str, ...] = (
    r"\bfalse\s+alarm\b",
    r"\brumou?r\b",
    r"\bclear\s+sky\b",
    r"\bsun\s+is\s+out\b",
    r"\bnormal\s+traffic\b",
)
NEGATION_REACH = 8

# Place names known by themselves, words before a place, and words that are no place.
GAZETTEER: tuple[str, ...] = (
    "Delhi", "New Delhi", "Noida", "Gurgaon", "Gurugram", "Faridabad", "Ghaziabad", "Mumbai", "Thane", "Kolkata",
    "Chennai", "Bengaluru", "Bangalore", "Hyderabad", "Ahmedabad", "Pune", "Jaipur", "Lucknow", "Kanpur", "Patna",
    "Bhopal", "Guwahati", "Shimla", "Srinagar", "Bhubaneswar", "Cuttack", "Visakhapatnam", "Vizag", "Kochi",
    "Trivandrum", "Thiruvananthapuram", "Wayanad", "Siliguri", "Darjeeling", "Dehradun", "Agartala", "Imphal",
    "Ranchi", "Raipur",
)
PLACE_PREPOSITIONS: tuple[str, ...] = ("in", "at", "near", "around", "from")
PLACE_STOP_WORDS: tuple[str, ...] = ("the", "this", "heavy", "severe", "north", "south", "east", "west")

# Reliability of a source; unknown sources get the default, official ones at least the floor.
SOURCE_WEIGHTS: dict[str, float] = {
    "imd": 0.95,
    "open_meteo": 0.85,
    "news_rss": 0.75,
    "twitter": 0.60,
    "social_media": 0.60,
    "citizen_app": 0.55,
}
DEFAULT_WEIGHT = 0.50
OFFICIAL_FLOOR = 0.90

# Priority scoring.
SEVERITY_BASE: dict[str, float] = {"CRITICAL": 85.0, "HIGH": 70.0, "MODERATE": 45.0, "LOW": 20.0}
EVENT_WEIGHTS: dict[str, float] = {
    "CYCLONE": 1.15,
    "FLOOD": 1.12,
    "LIGHTNING": 1.08,
    "WATERLOGGING": 1.05,
    "THUNDERSTORM": 1.05,
    "HAILSTORM": 1.02,
    "HEATWAVE": 1.02,
}

# Words that make a news item relevant.
RELEVANCE_KEYWORDS: tuple[str, ...] = (
    "weather", "rain", "rainfall", "flood", "flooding", "monsoon", "heatwave", "heat wave", "cyclone", "storm",
    "thunderstorm", "fog", "dust storm", "strong winds", "weather alert", "imd", "temperature", "precipitation",
    "hailstorm", "waterlogging", "downpour", "landslide", "cloudburst",
)

# Romanised Hindi words and declared language names.
HINGLISH_WORDS: tuple[str, ...] = (
    "mein", "hai", "baarish", "barish", "paani", "pani", "tez", "ho", "rhi", "rahi", "bhai", "doob", "rha", "gaya",
    "gayi", "se", "ko", "par", "bohot", "bahut",
)
LANGUAGE_NAMES: dict[str, str] = {
    "en": "en",
    "english": "en",
    "hi": "hi",
    "hindi": "hi",
    "hinglish": "hinglish",
    "hi-en": "hinglish",
    "hin-eng": "hinglish",
}
MEDIA_KEYS: tuple[str, ...] = ("media_urls", "media", "images", "image", "videos", "video", "url")
MEDIA_EXTENSIONS: tuple[str, ...] = ("jpg", "jpeg", "png", "gif", "mp4", "mov", "webm")

# Cities polled for grid-point observations (name, state, latitude, longitude).
CITIES: tuple[tuple[str, str, float, float], ...] = (
    ("Mumbai", "Maharashtra", 19.0760, 72.8777),
    ("Delhi", "Delhi", 28.7041, 77.1025),
    ("Bengaluru", "Karnataka", 12.9716, 77.5946),
    ("Chennai", "Tamil Nadu", 13.0827, 80.2707),
    ("Kolkata", "West Bengal", 22.5726, 88.3639),
    ("Hyderabad", "Telangana", 17.3850, 78.4867),
    ("Ahmedabad", "Gujarat", 23.0225, 72.5714),
    ("Pune", "Maharashtra", 18.5204, 73.8567),
    ("Jaipur", "Rajasthan", 26.9124, 75.7873),
    ("Lucknow", "Uttar Pradesh", 26.8467, 80.9462),
    ("Patna", "Bihar", 25.5941, 85.1376),
    ("Bhubaneswar", "Odisha", 20.2961, 85.8245),
    ("Guwahati", "Assam", 26.1445, 91.7362),
    ("Thiruvananthapuram", "Kerala", 8.5241, 76.9366),
    ("Chandigarh", "Punjab", 30.7333, 76.7794),
    ("Bhopal", "Madhya Pradesh", 23.2599, 77.4126),
    ("Nagpur", "Maharashtra", 21.1458, 79.0882),
    ("Visakhapatnam", "Andhra Pradesh", 17.6868, 83.2185),
    ("Srinagar", "Jammu & Kashmir", 34.0837, 74.7973),
    ("Port Blair", "Andaman & Nicobar", 11.6234, 92.7265),
)


def _sized(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small table as VALUES: unlike a frame made from Python rows it has a size Catalyst can choose joins by."""

    def literal(value: str | float | tuple) -> str:
        if isinstance(value, tuple):
            return f"array({', '.join(map(literal, value))})"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"CAST({value!r} AS DOUBLE)"

    values = ", ".join(f"({', '.join(map(literal, row))})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def compatibility_table(spark: SparkSession, compatible: dict[str, tuple[str, ...]] = COMPATIBLE) -> DataFrame:
    return _sized(spark, [(category, tuple(accepts)) for category, accepts in compatible.items()], "event_category, accepts")


def weight_table(spark: SparkSession, weights: dict[str, float] = SOURCE_WEIGHTS) -> DataFrame:
    return _sized(spark, list(weights.items()), "source, weight")


def city_table(spark: SparkSession, cities: tuple[tuple[str, str, float, float], ...] = CITIES) -> DataFrame:
    return _sized(spark, list(cities), "city, state, latitude, longitude")
