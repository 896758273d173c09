"""Operator 13, secret scan by linking the parts of a credential.

A credential has several parts: an access identifier, a secret, an endpoint. Strong parts are reported wherever they
stand. Weak ones (a login name, a short password, an opaque token, an address) are everywhere in clean text, so a weak
candidate is reported only where a complementary part stands in its scope: the same block of lines, no further than
REACH code points between the end of the first and the start of the second. Secrets complement identifiers and
endpoints; two parts of one role, and parts that overlap, do not.

Everything is built-in functions. A scan finds each kind's leftmost non-overlapping matches with their positions and
the room up to the end of their scope; the parts, without the texts, are written once. Each part is then an interval
from its end to the end of its room, and parts meet in an interval join on (row, bucket of REACH code points). Parts of a
bucket lie within two stretches of text, so pairs grow with the text and not with its square, and a row with very many
parts is spread over its buckets.

Defined results: null and empty texts have no spans; repeated rows (also with equal or null ids) are told apart by a row
number of their own; an empty table gives an empty result; other columns are never read. Positions are code points, the
end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormweave.functions.binding import bind
from stormweave.llm.words import texts
from stormweave.session import materialize

#: Most code points between two parts that belong together.
REACH = 300
#: Kinds in the order in which spans with one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "identifier", "phrase", "opaque", "endpoint")
BASE = KINDS[:3]

_GLUE = r"""["']?\x20*[:=]\x20*["']?"""
_STRONG_KEY = "password|passwd|secret|token|api_?key"
_WEAK_KEY = "pwd|passphrase|passcode|private_?key|secret_?(?:access_?)?key|auth_?key|credentials?|signature|pass"
_NAME_KEY = "access_?key(?:_?id)?|client_?id|app_?id|account_?id|tenant_?id|user_?name|user_?id|user|login|account"
_HOST_KEY = "hostname|host|endpoint|server|base_?url|bucket"
_SCHEME = r"https?|wss?|s?ftp|ssh|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|s3|gs"
#: Kind: pattern with the value as group 1. Keys are matched in either case, all else as it stands.
PATTERNS = {
    "assign": rf"(?i:{_STRONG_KEY}){_GLUE}([A-Za-z0-9+/_.=-]+)",
    "access": r"(AKIA[A-Z0-9]+)",
    "hex": r"([0-9a-f]{16,})",
    "identifier": rf"(?i:{_NAME_KEY}){_GLUE}([A-Za-z0-9@._+-]{{3,}})",
    "phrase": rf"(?i:{_STRONG_KEY}|{_WEAK_KEY}){_GLUE}([!#-&*+./0-9=@A-Z^_a-z~-]{{4,}})",
    "opaque": r"([A-Za-z0-9+/_=-]{20,})",
    "endpoint": rf"((?i:{_SCHEME})://[^\x00-\x20\x22\x27<>]+|(?i:{_HOST_KEY}){_GLUE}[A-Za-z0-9._:/-]{{3,}})",
}
#: A value of twelve characters or more after a strong key, which is the base's to report.
LONG_VALUE = rf"(?i:{_STRONG_KEY}){_GLUE}[A-Za-z0-9+/_.=-]{{12,}}"
#: What makes the token after it a named value, reported with its name if at all.
NAMED = rf"(?i:{_STRONG_KEY}|{_WEAK_KEY}|{_NAME_KEY}){_GLUE}"
#: Fixed strings, of which every text with a match of the kind holds one (in lower case, but for access identifiers).
_MAY_HOLD = {
    "assign": ("passw", "secret", "token", "apikey", "api_key"),
    "access": ("AKIA",),
    "hex": (),
    "identifier": ("access", "client", "app", "account", "tenant", "user", "login"),
    "phrase": (":", "="),
    "opaque": (),
    "endpoint": ("://", "host", "endpoint", "server", "base", "bucket"),
}
#: What follows a match up to the end of its scope: the text to the next blank line, REACH code points at most.
_ROOM = rf"(?=((?:[^\n]|\n(?![\x20\t\r]*\n)){{0,{REACH}}}))"

PART = "struct<kind: string, role: string, start: bigint, end: bigint, room: bigint>"
_BLOCK = 512


def running_total(lengths: Column) -> Column:
    """The sum of the entries before each entry of an array of longs.

    Summed in blocks, so that arrays grow by appending within a block only and the work stays linear.
    """
    nothing = F.array().cast("array<bigint>")

    def before(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("total"), nothing.alias("out"))
        step = lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["out"], F.array(s["total"])).alias("out"))
        return F.aggregate(values, start, step, lambda s: s["out"])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def in_blocks(values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
        return bind(
            blocks,
            lambda parts: F.flatten(
                F.zip_with(parts, before(F.transform(parts, total)), lambda p, base: F.transform(before(p), lambda x: x + base))
            ),
        )

    return F.when(F.size(lengths) <= _BLOCK, before(lengths)).otherwise(bind(lengths, in_blocks))


def _role(kind: str, whole: Column) -> Column:
    if kind == "hex":
        # A number without a letter is no secret that an address could go with.
        return F.when(whole.rlike("[a-f]"), F.lit("secret")).otherwise(F.lit("none"))
    return F.lit({"access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}.get(kind, "secret"))


def _accepts(kind: str, before: Column, whole: Column) -> Column:
    """What a match must fulfil besides its pattern; `before` is the text between it and the match before."""
    if kind == "assign":
        return F.length(F.regexp_extract(whole, PATTERNS[kind], 1)) >= 12
    if kind == "access":
        return F.length(whole) >= 18
    if kind in ("identifier", "endpoint"):
        return ~before.rlike(r"[A-Za-z0-9_]\z")
    if kind == "phrase":
        strong = whole.rlike(f"^{LONG_VALUE}")
        return ~before.rlike(r"[A-Za-z0-9]\z") & ~strong
    if kind == "opaque":
        named = before.rlike(rf"{NAMED}\z")
        return whole.rlike("[A-Z]") & whole.rlike("[a-z]") & whole.rlike("[0-9]") & ~named
    return F.lit(True)


def parts_of(text: Column, lower: Column, kind: str) -> Column:
    """The parts of a kind in a text, in order: an array of PART. `lower` is the text in lower case."""
    pattern = PATTERNS[kind]

    def found(m: Column) -> Column:
        steps = F.zip_with(m["before"], m["whole"], lambda b, w: (F.length(b) + F.length(F.coalesce(w, F.lit("")))).cast("bigint"))

        def spans(totals: Column) -> Column:
            numbered = F.transform(
                m["whole"],
                lambda w, i: F.struct(
                    F.lit(kind).alias("kind"), _role(kind, w).alias("role"),
                    (F.get(totals, i) + F.length(F.get(m["before"], i))).alias("start"),
                    (F.get(totals, i + 1)).alias("end"),
                    F.length(F.get(m["room"], i)).cast("bigint").alias("room"),
                    _accepts(kind, F.get(m["before"], i), w).alias("good"),
                ),
            )
            good = F.filter(numbered, lambda s: s["good"])
            return F.transform(good, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "role", "start", "end", "room")]))

        return bind(running_total(steps), spans)

    scanned = F.struct(
        F.split(text, pattern, -1).alias("before"),
        F.regexp_extract_all(text, F.lit(pattern), 0).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern + _ROOM), 2).alias("room"),
    )
    nothing = F.array().cast(f"array<{PART}>")
    if kind == "hex":
        likely = text.rlike(pattern)
    else:
        likely = F.lit(not _MAY_HOLD[kind])
        for word in _MAY_HOLD[kind]:
            likely = likely | (text if kind == "access" else lower).contains(word)
    if kind in ("identifier", "assign"):
        likely = (text.contains("=") | text.contains(":")) & likely
    return F.when(likely, bind(scanned, found)).otherwise(nothing)


def all_parts(text: Column) -> Column:
    """Parts of all kinds of a text. Weak secrets are looked for only beside an identifier or endpoint to go with."""

    def of(both: Column) -> Column:
        def found(*kinds: str) -> Column:
            return F.concat(*[parts_of(both["text"], both["lower"], k) for k in kinds])

        leads, secrets, strong = found("access", "identifier", "endpoint"), found("phrase", "opaque"), found("assign", "hex")
        return bind(leads, lambda found: F.concat(strong, found, F.when(F.size(found) > 0, secrets).otherwise(F.array().cast(f"array<{PART}>"))))

    return bind(F.coalesce(text, F.lit("")), lambda t: bind(F.struct(t.alias("text"), F.lower(t).alias("lower")), of))


def link_parts(parts: DataFrame) -> DataFrame:
    """Pairs of complementary parts in one scope: `row` and the structs `first` and `second` (by position)."""
    both = F.exists("parts", lambda p: p["role"] == "secret") & F.exists("parts", lambda p: p["role"].isin("identifier", "endpoint"))
    each = parts.filter(both).select("row", F.explode("parts").alias("part")).filter("part.role <> 'none'")
    width = REACH + 1
    wide = F.floor(F.col("part.end") / width)
    left = each.select("row", F.col("part").alias("first"), F.explode(F.array(wide, wide + 1)).alias("bucket"))
    right = each.select("row", F.col("part").alias("second"), F.floor(F.col("part.start") / width).alias("bucket"))
    gap = F.col("second.start") - F.col("first.end")
    complementary = (F.col("first.role") == "secret") != (F.col("second.role") == "secret")
    return left.join(right, ["row", "bucket"]).filter((gap >= 0) & (gap <= F.col("first.room")) & complementary).drop("bucket")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, `spans` (kind, start, end) by start and kind, and `n_links`, a row for each row of `docs`.

    Writes the parts to the shared folder when called.
    """
    scanned = texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", all_parts(F.col("text")).alias("parts"))
    parts = materialize(scanned, "secret-parts")
    pairs = link_parts(parts)
    weak = (
        pairs.select("row", F.explode(F.array("first", "second")).alias("part"))
        .groupBy("row")
        .agg(
            F.collect_set(F.when(~F.col("part.kind").isin(*BASE), F.struct("part.kind", "part.start", "part.end"))).alias("weak"),
            F.floor(F.count("*") / 2).alias("n_links"),
        )
    )
    rank = F.create_map(*[F.lit(x) for k in enumerate(KINDS) for x in reversed(k)])
    base = F.filter("parts", lambda p: p["kind"].isin(*BASE))
    plain = F.transform(base, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    every = F.concat(plain, F.coalesce(F.col("weak"), F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")))
    keyed = F.transform(every, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return parts.join(weak, "row", "left").select("doc_id", spans.alias("spans"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def digest(found: DataFrame) -> DataFrame:
    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_links"
    )
