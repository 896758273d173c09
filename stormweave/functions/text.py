"""Text operators as JVM-side column expressions.

Java and Python differ on word characters, boundaries and white space outside ASCII, so patterns are written
with explicit classes instead of `\\w`, `\\b` and `\\s`.
"""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormweave import rules
from stormweave.functions.binding import bind

WORD = r"[\p{L}\p{N}_]"
SPACES = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACES}]"
_EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """A rule pattern with Unicode-aware `\\b` and `\\s` spelled out for the JVM."""
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\b", _EDGE).replace(r"\s", SPACE)


def word_starts(patterns: Sequence[str], ignore_case: bool = True) -> str:
    """Alternatives that each begin at a word with a plain letter, grouped by that letter.

    Java tries alternatives one by one at every character. Testing the first letter before looking back for
    the word boundary turns most positions into one character-class check.
    """
    by_letter: dict[str, list[str]] = {}
    for pattern in patterns:
        body = pattern.removeprefix(r"\b")
        by_letter.setdefault(body[0], []).append(java_pattern(body[1:], ignore_case=False))
    branches = "|".join(f"{c}(?<!{WORD}{c})(?:{'|'.join(rest)})" for c, rest in by_letter.items())
    return ("(?i)" if ignore_case else "") + f"(?=[{''.join(by_letter)}])(?:{branches})"


def squeeze(text: Column) -> Column:
    """White-space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(text: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def first_filled(*texts: Column) -> Column:
    """Alias resolution: the first text that is not null or empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


# --- mark-up -----------------------------------------------------------------------------------------------

# Code points of the C1 range that HTML reads as Windows-1252, taken from that code page.
_C1 = {
    n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
}
_BARE_NAMES = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)


def _entity_map() -> Column:
    names = {n: c for n, c in html.entities.html5.items()}
    names.update({f"#{n}": c for n, c in _C1.items()})
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _code_point(number: Column) -> Column:
    bad = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    control = (
        number.between(0x1, 0x8)
        | number.between(0xB, 0x1F) & ~number.isin(0xC, 0xD)
        | number.between(0x7F, 0x9F)
        | number.between(0xFDD0, 0xFDEF)
        | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    c1 = number.between(0x80, 0x9F) & ~number.isin(0x81, 0x8D, 0x8F, 0x90, 0x9D)
    named = F.element_at(_entity_map(), F.concat(F.lit("#"), number.cast("string")))
    return F.when(bad, "\ufffd").when(number == 0xD, "\r").when(c1, named).when(control, "").otherwise(char)


def unescape(text: Column) -> Column:
    """HTML character references to characters, named ones with or without their semicolon."""
    bare = "^&(" + "|".join(_BARE_NAMES) + ")"

    def resolve(piece: Column) -> Column:
        dec = F.regexp_extract(piece, r"^&#([0-9]+)", 1)
        hexa = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+)", 1)
        digits = F.coalesce(F.nullif(F.conv(hexa, 16, 10), F.lit("")), F.nullif(dec, F.lit("")))
        number = F.when(F.length(digits) > 9, F.lit(0x110000).cast("bigint")).otherwise(digits.try_cast("bigint"))
        after_number = F.regexp_replace(piece, r"^&#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")
        name = F.regexp_extract(piece, r"^&([A-Za-z][A-Za-z0-9]*;)", 1)
        full = F.element_at(_entity_map(), name)
        short = F.regexp_extract(piece, bare, 1)
        return (
            F.when(~piece.startswith("&"), piece)
            .when((dec != "") | (hexa != ""), F.concat(_code_point(number), after_number))
            .when(full.isNotNull(), F.concat(full, F.substring(piece, F.length(name) + 2, F.length(piece))))
            .when(
                short != "",
                F.concat(
                    F.element_at(_entity_map(), short), F.substring(piece, F.length(short) + 2, F.length(piece))
                ),
            )
            .otherwise(piece)
        )

    resolved = F.array_join(F.transform(F.split(text, "(?=&)"), resolve), "")
    return F.when(text.contains("&"), resolved).otherwise(text)


def strip_markup(text: Column) -> Column:
    """Tags to blanks, character references to characters, white space squeezed; empty for null."""
    return squeeze(unescape(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")))


# --- social text -------------------------------------------------------------------------------------------


def hashtags(text: Column) -> Column:
    """Distinct hashtags in order of appearance, case kept."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(#{WORD}+)"), 1))
    return F.coalesce(found, F.array().cast("array<string>"))


def urls(text: Column) -> Column:
    """Distinct http(s) links in order of appearance, closing punctuation cut."""
    found = F.regexp_extract_all(text, F.lit(f"(?i)(https?://[^{SPACES}]+)"), 1)
    cut = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;!?)]+$", ""))
    return F.coalesce(F.array_distinct(F.filter(cut, lambda u: u != "")), F.array().cast("array<string>"))


def is_media_url(url: Column) -> Column:
    return url.rlike(rf"(?i)\.(?:{'|'.join(rules.MEDIA_EXTENSIONS)})(?:\?.*)?$")


def _media_strings(raw: Column, only_media: bool = False) -> Column:
    """URLs in one payload value given as JSON text: a string, or a list of strings and objects."""
    listed = F.from_json(raw, "array<string>")

    def url_of(item: Column) -> Column:
        keys = [F.get_json_object(item, f"$.{k}") for k in ("url", "src", "link")]
        return F.when(item.startswith("{"), first_filled(*keys)).otherwise(item)

    single = F.array(F.when(is_media_url(raw), raw)) if only_media else F.array(raw)
    return (
        F.when(raw.startswith("["), F.transform(listed, url_of))
        .when(raw.startswith("{"), F.array().cast("array<string>"))
        .otherwise(single)
    )


def media_urls(text: Column, payload: Column | None = None) -> Column:
    """Distinct media links: payload keys in their fixed order, then links in the text by extension."""
    from_text = F.filter(urls(text), is_media_url)
    parts: list[Column] = []
    if payload is not None:
        fields = F.from_json(payload, ", ".join(f"{k} string" for k in rules.MEDIA_KEYS))
        none = F.array().cast("array<string>")

        def of_fields(given: Column) -> Column:
            keyed = [_media_strings(given[k], only_media=(k == "url")) for k in rules.MEDIA_KEYS]
            return F.concat(*[F.coalesce(k, none) for k in keyed])

        of_object = bind(fields, of_fields)
        parts.append(
            F.when(payload.startswith("{"), of_object)
            .when(payload.isNotNull(), F.coalesce(_media_strings(payload), none))
            .otherwise(none)
        )
    parts.append(from_text)
    trimmed = F.transform(F.concat(*parts), strip)
    return F.array_distinct(F.filter(trimmed, lambda u: u.isNotNull() & (u != "")))


def language(text: Column, declared: Column | None = None) -> Column:
    """Declared language by name, else Devanagari, else romanised Hindi, else English; null for no text."""
    romanised = word_starts([rf"{word}\b" for word in rules.HINGLISH_WORDS])

    def guessed(body: Column) -> Column:
        return (
            F.when(~body.rlike(f"[^{SPACES}]"), F.lit(None).cast("string"))
            .when(body.rlike(r"[\x{900}-\x{97F}]"), F.lit("hi"))
            .when(body.rlike(romanised), F.lit("hinglish"))
            .when(body.isNotNull(), F.lit("en"))
        )

    guess = bind(text, guessed)
    if declared is None:
        return guess
    named = F.lower(blank_to_null(declared))
    known = F.create_map(*[F.lit(x) for pair in rules.LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(bind(named, lambda name: F.coalesce(F.element_at(known, name), name)), guess)


_PLACE = "struct<city:string,name:string,state:string,region:string,country:string,latitude:double,lat:double,longitude:double,lon:double,lng:double>"
_PAYLOAD = (
    "city string, district string, state string, country string, latitude double, lat double, longitude double,"
    " lon double, lng double, location string, place string, geo string"
)


def location(
    payload: Column,
    city: Column | None = None,
    state: Column | None = None,
    district: Column | None = None,
    country: Column | None = None,
) -> Column:
    """Struct of place names and coordinates from a JSON payload.

    Explicit values come first, then top-level keys, then `location`, `place` and `geo`, each an object or a
    "City, State" text. India is assumed once a city or state is known. A coordinate of 0 counts as present.
    """
    nothing = F.lit(None).cast("string")

    def given(top: Column, value: Column | None, key: str) -> Column:
        return F.coalesce(blank_to_null(value) if value is not None else nothing, blank_to_null(top[key]))

    def place(raw: Column) -> Column:
        """What one of the three place keys says; `by_name` marks a plain text."""
        words = F.filter(F.transform(F.split(raw, ","), strip), lambda w: w != "")
        plain = F.struct(
            F.get(words, 0).alias("city"), F.get(words, 1).alias("state"), nothing.alias("country"),
            F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(True).alias("by_name"),
        )
        nested = bind(
            F.from_json(raw, _PLACE),
            lambda o: F.struct(
                blank_to_null(first_filled(o["city"], o["name"])).alias("city"),
                blank_to_null(first_filled(o["state"], o["region"])).alias("state"),
                blank_to_null(o["country"]).alias("country"),
                F.coalesce(o["latitude"], o["lat"]).alias("lat"),
                F.coalesce(o["longitude"], o["lon"], o["lng"]).alias("lon"),
                F.lit(False).alias("by_name"),
            ),
        )
        return F.when(raw.startswith("{"), nested).when(~raw.startswith("["), plain)

    def resolved(top: Column, said: Column, own_city: Column, own_state: Column) -> Column:
        each = [F.get(said, i) for i in range(3)]
        # A plain text names the state only while no city is known.
        states = [own_state]
        city_so_far = own_city
        for p in each:
            states.append(F.when(~p["by_name"] | city_so_far.isNull(), p["state"]))
            city_so_far = F.coalesce(city_so_far, p["city"])
        found_state = F.coalesce(*states)
        known = city_so_far.isNotNull() | found_state.isNotNull()
        return F.struct(
            city_so_far.alias("city"),
            given(top, district, "district").alias("district"),
            found_state.alias("state"),
            F.coalesce(
                given(top, country, "country"), *[p["country"] for p in each], F.when(known, F.lit("India"))
            ).alias("country"),
            F.coalesce(*[p["lat"] for p in each], top["latitude"], top["lat"]).alias("latitude"),
            F.coalesce(*[p["lon"] for p in each], top["longitude"], top["lon"], top["lng"]).alias("longitude"),
        )

    def of_top(top: Column) -> Column:
        keys = F.array(top["location"], top["place"], top["geo"])
        return bind(
            F.transform(keys, place),
            lambda said: bind(
                F.struct(given(top, city, "city").alias("city"), given(top, state, "state").alias("state")),
                lambda own: resolved(top, said, own["city"], own["state"]),
            ),
        )

    return bind(F.from_json(payload, _PAYLOAD), of_top)


def is_relevant(text: Column, keywords: Sequence[str] = rules.RELEVANCE_KEYWORDS) -> Column:
    words = F.split(F.lit("\n".join(keywords)), "\n")
    named = bind(F.lower(text), lambda low: F.exists(words, lambda word: low.contains(word)))
    return F.coalesce(named | text.rlike(f"#{WORD}"), F.lit(False))


# --- event features ----------------------------------------------------------------------------------------


def event_category(
    text: Column, taxonomy: dict[str, tuple[str, ...]] = rules.TAXONOMY, word_boundary: bool = False
) -> Column:
    """Category with most distinct keywords; overrides first, ties by taxonomy order, `OTHER` for none.

    Each category's rank is one number: override bonus, keyword count, then earliness. Keywords are matched as
    substrings, as in the reference; `word_boundary` asks for whole words.
    """
    names = F.array(*[F.lit(n) for n in taxonomy])

    def best_rank(low: Column) -> Column:
        def hit(keyword: Column) -> Column:
            if word_boundary:
                return F.rlike(low, F.concat(F.lit(f"(?<!{WORD})"), keyword, F.lit(f"(?!{WORD})")))
            return low.contains(keyword)

        ranks = []
        for position, (name, keywords) in enumerate(taxonomy.items()):
            # Splitting a literal folds to a constant array.
            words = F.split(F.lit("\n".join(keywords)), "\n")
            count = F.size(F.filter(words, hit))
            rank = count * F.lit(100) + F.lit(99 - position)
            if name in rules.OVERRIDES:
                bonus = 1_000_000 * (len(rules.OVERRIDES) - rules.OVERRIDES.index(name))
                rank = bind(count, lambda n: F.when(n > 0, n * 100 + bonus + 99 - position).otherwise(0))  # noqa: B023
            ranks.append(rank)
        return F.greatest(*ranks)

    def name_of(best: Column) -> Column:
        return F.when(best >= 100, F.element_at(names, F.lit(100) - F.pmod(best, F.lit(100))))

    return F.coalesce(bind(bind(F.lower(text), best_rank), name_of), F.lit(rules.OTHER))


def is_negated(text: Column, reach: int = rules.NEGATION_REACH) -> Column:
    """A negation trigger within `reach` words of a weather word, or a trigger that stands alone.

    The text is reduced to a skeleton: `N` where a trigger starts, `W` for a weather word, `.` for other
    characters, one blank between words. Word distances then become bounded repetitions in one pattern, so the
    whole text is checked in linear time and without leaving the JVM.
    """
    triggers = word_starts(rules.NEGATION_PATTERNS, ignore_case=False)
    alone = word_starts(rules.STANDALONE_NEGATIONS, ignore_case=False)
    weather = "|".join(sorted(rules.PROXIMITY_KEYWORDS, key=len, reverse=True))
    first_letters = "".join(sorted({k[0] for k in rules.PROXIMITY_KEYWORDS}))
    n, w = "\x01", "\x02"
    any_, plain = f"[.{n}{w}]", f"[.{n}]"
    near = "|".join(
        (
            # trigger starts a word; weather word in the same or a later word
            f"(?:^| )(?={n})(?:{any_}+ ){{0,{reach}}}{plain}*{w}",
            # trigger starts a word; weather word before it
            f"{w}{any_}*(?: {any_}+){{0,{reach - 1}}} {n}",
            # trigger inside a word counts for the next position
            f"[.{w}]{n}{any_}*(?: {any_}+){{0,{reach}}} {plain}*{w}",
            f"(?:^| )(?={any_}*[.{w}]{n}){plain}*{w}",
            f"{w}{any_}*(?: {any_}+){{0,{reach - 2}}} {any_}*[.{w}]{n}",
        )
    )

    def skeleton(low: Column) -> Column:
        marked = F.regexp_replace(F.translate(low, n + w, ".."), f"(?={triggers})", n)
        marked = F.regexp_replace(marked, f"(?=[{first_letters}])(?:{weather})", w)
        return F.regexp_replace(F.regexp_replace(marked, f"{SPACE}+", " "), rf"[^ {n}{w}]+", ".")

    def verdict(low: Column) -> Column:
        return low.rlike(triggers) & (low.rlike(alone) | skeleton(low).rlike(near))

    return F.coalesce(bind(F.lower(text), verdict), F.lit(False))


def title_case(text: Column) -> Column:
    """First letter of every word up, the rest down; white space kept as it is."""
    words = F.split(text, f"(?<={SPACE})(?!{SPACE})")
    return F.array_join(F.transform(words, F.initcap), "")


def place_names(text: Column) -> Column:
    """Place names after a preposition or known by themselves, in title case, distinct and sorted."""
    tail = r"\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"
    after = word_starts(rules.PLACE_PREPOSITIONS) + java_pattern(tail, ignore_case=False)
    known = "(" + word_starts([rf"{name}\b" for name in rules.GAZETTEER]) + ")"
    found = F.concat(F.regexp_extract_all(text, F.lit(after), 1), F.regexp_extract_all(text, F.lit(known), 1))
    kept = F.filter(found, lambda p: (F.length(p) > 2) & ~F.lower(p).isin(*rules.PLACE_STOP_WORDS))
    return F.coalesce(
        F.array_sort(F.array_distinct(F.transform(kept, title_case))), F.array().cast("array<string>")
    )


def metrics(text: Column, reference_mode: bool = False) -> Column:
    """First rainfall in mm, wind in km/h and temperature in degrees Celsius, each null when absent.

    Centimetres, knots and minus signs are honoured; `reference_mode` leaves "centimeters" and knots unscaled
    and drops the sign, as the reference does.
    """
    sign = "" if reference_mode else rf"(?:(?<!{WORD})-)?"
    number = rf"{sign}\d+(?:\.\d+)?"

    def first(units: str, scale: Callable[[Column], Column]) -> Column:
        found = F.regexp_extract(text, java_pattern(rf"{number}\s*(?:{units})"), 0)

        def value(match: Column) -> Column:
            return F.regexp_extract(match, f"^({number})", 1).try_cast("double") * scale(F.lower(match))

        return bind(found, value)

    def millimetres(match: Column) -> Column:
        centi = match.endswith("cm") if reference_mode else match.rlike("cm$|centim")
        return F.when(centi, 10.0).otherwise(1.0)

    def kilometres(match: Column) -> Column:
        return F.lit(1.0) if reference_mode else F.when(match.endswith("knots"), 1.852).otherwise(1.0)

    return F.struct(
        first("mm|millimeters?|cm|centimeters?", millimetres).alias("rainfall_mm"),
        first("km/h|kmh|kmph|knots", kilometres).alias("wind_speed_kmh"),
        first(r"°C|deg C|degrees C|C\b", lambda match: F.lit(1.0)).alias("temperature_c"),
    )


def entities(text: Column, embed: Callable[[Column], Column] | None = None) -> dict[str, Column]:
    """Feature bundle, for one `withColumns`."""
    bundle = {
        "event_category": event_category(text),
        "is_negated": is_negated(text),
        "locations": place_names(text),
        "metrics": metrics(text),
    }
    if embed is not None:
        bundle["embedding"] = embed(text)
    return bundle


def evidence_reasoning(source: Column, negated: Column) -> Column:
    return F.concat(
        F.lit("Report from "),
        source,
        F.when(negated, F.lit(" explicitly contradicts event presence (negation detected).")).otherwise(
            F.lit(" provides corroborating text and spatial proximity.")
        ),
    )
