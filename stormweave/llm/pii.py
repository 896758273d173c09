"""Operator 9, personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, identifier cues and the digit pairs that any
address or number must hold. Around an anchor a local parser expands to the longest run of its kind and validates it
(label boundaries, address parts, check digits). Runs of one kind never overlap and a run that fails is used up, as in
a leftmost scan without retries. Each whole text is read once; no exchange, and one Arrow batch in memory.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one; an empty table gives an
empty result; no other columns are read. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import product

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormweave.llm.scan import per_text
from stormweave.llm.words import texts

#: Kinds in the order in which spans with one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "credential", "iban", "ssn", "account")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"[ ().0-9-]+")
_USERINFO = re.compile(r"[^\s/@:]+:[^\s/@]+@")
_IBAN = re.compile(r"[\s:#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"[\s:#.A-Za-z]{0,12}?([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"[\s:#.]{0,4}([0-9]{8,17})(?![0-9])")
#: Cue words before an identifier, each also capitalised and in capitals.
CUES = {
    "iban": ("iban", _IBAN),
    "ssn": ("ssn", _SSN),
    "social security": ("ssn", _SSN),
    "account number": ("account", _ACCOUNT),
    "account no": ("account", _ACCOUNT),
    "acct": ("account", _ACCOUNT),
}


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    digits = "0123456789"
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for d in digits:
        found.add_word(f"+{d}", ("plus", 2))
    for a, b in product(digits, digits):
        found.add_word(f"{a}.{b}", ("dot", 3))
        for between in ("", " ", "-"):
            found.add_word(f"{a}{between}{b}", ("digits", 2 + len(between)))
    for cue in CUES:
        for spelt in {cue, cue.capitalize(), cue.upper(), cue.title()}:
            found.add_word(spelt, ("cue", len(spelt)))
    found.make_automaton()
    return found


def finder() -> Callable[[str], list[tuple[str, int, int]]]:
    anchors = _anchors()

    def find(text: str) -> list[tuple[str, int, int]]:
        spans: list[tuple[str, int, int]] = []
        used = dict.fromkeys((*KINDS, "chain"), 0)
        for last, (what, width) in anchors.iter(text):
            start = last - width + 1
            if what == "digits":
                if start >= used["card"]:
                    spans += _card(text, start, used)
            elif what == "dot":
                if start >= used["chain"]:
                    spans += _addresses(text, start, used)
            elif what == "at":
                spans += _email(text, start, used)
            elif what == "plus":
                spans += _phone(text, start, used)
            elif what == "scheme":
                if found := _USERINFO.match(text, last + 1):
                    spans.append(("credential", found.start(), found.end() - 1))
            else:
                kind, pattern = CUES[text[start : last + 1].lower()]
                found = pattern.match(text, last + 1)
                if found and found.start(1) >= used[kind] and (kind != "iban" or iban_valid(found[1])):
                    spans.append((kind, *found.span(1)))
                    used[kind] = found.end(1)
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))

    return find


def _email(text: str, at: int, used: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    start = at
    while start > used["email"] and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1)
    if start < at and domain:
        used["email"] = domain.end()
        yield "email", start, domain.end()


def _addresses(text: str, start: int, used: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    while start > used["chain"] and "0" <= text[start - 1] <= "9":
        start -= 1
    chain = _CHAIN.match(text, start)
    used["chain"] = chain.end()
    parts = chain[0].split(".")
    at = start
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        end = at + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
            yield "ip", at, end
        at = end + 1


def _card(text: str, start: int, used: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    run = _DIGITS.match(text, start)
    used["card"] = run.end()
    digits = run[0].replace(" ", "").replace("-", "")
    if 12 <= len(digits) <= 19 and luhn(digits):
        yield "card", start, run.end()


def _phone(text: str, start: int, used: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    run = _PHONE.match(text, start + 2)
    if not run or start < used["phone"]:
        return
    end = run.end()
    while end > start + 3 and not "0" <= text[end - 1] <= "9":
        end -= 1
    if end > start + 3:
        used["phone"] = end
        if 9 <= sum("0" <= c <= "9" for c in text[start:end]) <= 15:
            yield "phone", start, end


FOUND = "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id with the spans of each text, ordered by start and kind."""

    def build() -> Callable[[str], tuple]:
        find = finder()
        return lambda text: (find(text),)

    return per_text(texts(docs), build, FOUND)


def digest(found: DataFrame) -> DataFrame:
    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
