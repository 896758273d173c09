"""Text expressions on literals, against plain Python where Python is the specification."""

import html
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stormweave import rules
from stormweave.functions import text as X


def run(spark, texts, expression):
    rows = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "i int, t string").select("i", expression(F.col("t")).alias("v"))
    return [r["v"] for r in sorted(frame.collect(), key=lambda r: r["i"])]


def negated(text):
    """The rule by word positions."""
    if not text:
        return False
    low = text.lower()
    near = [i for i, w in enumerate(low.split()) if any(k in w for k in rules.PROXIMITY_KEYWORDS)]
    for pattern in rules.NEGATION_PATTERNS:
        for match in re.finditer(pattern, low):
            position = len(low[: match.start()].split())
            if pattern in rules.STANDALONE_NEGATIONS or any(abs(position - w) <= rules.NEGATION_REACH for w in near):
                return True
    return False


def classified(text):
    low = (text or "").lower()
    counts = {c: sum(k in low for k in words) for c, words in rules.TAXONOMY.items()}
    for name in rules.OVERRIDES:
        if counts[name]:
            return name
    best = max(counts.values())
    return next((c for c, n in counts.items() if n == best), "OTHER") if best else "OTHER"


WORDS = st.sampled_from(
    "no not did denied rumour rumor false alarm clear sky sun is out reports of normal traffic flood rain damage seen "
    "reported storm x-denied say-no no-flood wind. a b c é no, train loo fog heat wave cyclone".split()
)
SENTENCES = st.lists(WORDS, max_size=25).map(" ".join)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(batch=st.lists(SENTENCES, min_size=150, max_size=150))
def test_negation_and_category_match_the_rules(spark, batch):
    assert run(spark, batch, X.is_negated) == [negated(t) for t in batch]
    assert run(spark, batch, X.event_category) == [classified(t) for t in batch]


@pytest.mark.parametrize(
    ("text", "category", "is_negated"),
    [
        ("Heavy rain and severe waterlogging", "WATERLOGGING", False),
        ("Flood waters rise after rain", "FLOOD", False),
        ("Nothing of note", "OTHER", False),
        ("No flood reported here", "FLOOD", True),
        ("Fake news, it was a rumour", "OTHER", True),
        ("not just rain but also flooding", "FLOOD", False),
        ("", "OTHER", False),
        (None, "OTHER", False),
    ],
)
def test_feature_examples(spark, text, category, is_negated):
    assert run(spark, [text], X.event_category) == [category]
    assert run(spark, [text], X.is_negated) == [is_negated]


def test_whole_words_on_request(spark):
    assert run(spark, ["the train left"], X.event_category) == ["RAIN"]
    assert run(spark, ["the train left", "it may rain."], lambda t: X.event_category(t, word_boundary=True)) == ["OTHER", "RAIN"]


def test_markup(spark):
    texts = [
        "<p>a &amp; b&nbsp;c</p>",
        "x &lt;&gt; &#233; &#x41; &#128; &#0; &ampx &notit; &copy 2024 &unknown; & z &#1114112; &#x1F600;",
        "AT&T",
        "&#13;&#x9;q &notin; &eacute; &amp;quot;",
        "plain",
    ]
    expected = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", t))).strip() for t in texts]
    assert run(spark, [*texts, None], X.strip_markup) == [*expected, ""]


def test_hashtags_urls_language(spark):
    texts = ["#Rain #rain #Rain #मुंबई", "see http://a.b/c.jpg, HTTPS://x.y/z?a=1). http://a.b/c.jpg", None]
    assert run(spark, texts, X.hashtags) == [["#Rain", "#rain", "#म"], [], []]
    assert run(spark, texts, X.urls) == [[], ["http://a.b/c.jpg", "HTTPS://x.y/z?a=1"], []]
    spoken = ["मुंबई में बारिश", "Aaj bahut baarish ho rahi hai", "heavy rain", "  ", None]
    assert run(spark, spoken, X.language) == ["hi", "hinglish", "en", None, None]
    declared = ["English", " HINDI ", "hi-en", "ta", ""]
    assert run(spark, declared, lambda t: X.language(F.lit("heavy rain"), t)) == ["en", "hi", "hinglish", "ta", "en"]


def test_media_urls(spark):
    payloads = [
        '{"media":[{"url":"u1"}," u2 ",{"src":"u3"}],"image":"u1","url":"http://q/p.png?x"}',
        '{"media_urls":"one","video":{"url":"ignored"},"url":"http://q/p.html"}',
        '["a",{"link":"b"}]',
        "direct",
        None,
    ]
    found = run(spark, payloads, lambda t: X.media_urls(F.lit("see http://t.x/1.gif"), t))
    tail = "http://t.x/1.gif"
    assert found == [["u1", "u2", "u3", "http://q/p.png?x", tail], ["one", tail], ["a", "b", tail], ["direct", tail], [tail]]


def test_location(spark):
    payloads = [
        '{"location":{"name":"Pune","region":"MH","lat":1.5,"lng":0.0}}',
        '{"place":"Mumbai, Maharashtra , x","latitude":"12.5","lat":3}',
        '{"city":" A ","geo":"B, C"}',
        '{"district":"D"}',
        "[1]",
        None,
    ]
    found = run(spark, payloads, X.location)
    assert [(r.city, r.state, r.district, r.country, r.latitude, r.longitude) for r in found] == [
        ("Pune", "MH", None, "India", 1.5, 0.0),
        ("Mumbai", "Maharashtra", None, "India", 3.0, None),
        ("A", None, None, "India", None, None),
        (None, None, "D", None, None, None),
        (None,) * 6,
        (None,) * 6,
    ]


def test_places_and_metrics(spark):
    texts = ["Rain in New Delhi and near the station", "Flood at Gurgaon", "PUNE\tflooded, from north"]
    assert run(spark, texts, X.place_names) == [["New Delhi", "The Station"], ["Gurgaon"], ["Pune"]]
    readings = ["5 cm rain, 40 knots, -3.5°C", "120 mm with 30 KMPH at 31 deg C", "3 centimeters", "dry"]
    found = [(r.rainfall_mm, r.wind_speed_kmh, r.temperature_c) for r in run(spark, readings, X.metrics)]
    assert found == [(50.0, 74.08, -3.5), (120.0, 30.0, 31.0), (30.0, None, None), (None, None, None)]
    as_reference = [tuple(r) for r in run(spark, readings[:3], lambda t: X.metrics(t, reference_mode=True))]
    assert as_reference == [(50.0, 40.0, 3.5), (120.0, 30.0, 31.0), (3.0, None, None)]
