"""Operator 6, licence scan: Aho-Corasick for notice phrases and identifier tags, shunting-yard for expressions.

Phrases are matched on words, so line breaks, punctuation and case between them do not matter: ASCII letters are
lower-cased, everything in ASCII that is not a letter or digit separates words, and one automaton over the joined
words finds all places of all phrases at once. A second automaton finds identifier tags in the text as it stands; the
expression behind a tag, up to the next tag or the end of its line, is parsed by precedence (WITH over AND over OR) and
evaluated.

One pass over each whole text, no exchange; a task holds one Arrow batch. Defined results: null and empty texts have no
words and no labels, repeated rows are scanned one by one, an empty table gives an empty result, and no columns but the
key and the text are read. A malformed expression is kept as text with no labels of its own.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormweave.llm.scan import per_text
from stormweave.llm.words import texts

#: Phrases that count as base places, with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices, with label and weight of evidence.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "bsd license": ("bsd", 0.7),
    "bsd 2 clause": ("bsd", 0.7),
    "bsd 3 clause": ("bsd", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "cc0": ("cc0", 0.5),
    "isc license": ("isc", 0.7),
    "all rights reserved": ("proprietary", 0.5),
}
BASE_WEIGHT, EXPRESSION_WEIGHT = 0.7, 0.95
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Label of an identifier by its first part.
FAMILIES = {
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "apache": "apache", "mit": "mit", "mpl": "mpl", "epl": "epl",
    "bsd": "bsd", "isc": "isc", "cc0": "cc0", "cc": "cc-by", "unlicense": "unlicense", "zlib": "zlib",
}
PERMISSIVE = {"apache", "mit", "bsd", "isc", "cc0", "cc-by", "unlicense", "zlib"}

#: ASCII bytes to word characters, with a blank for each separator.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")


class Verdict(NamedTuple):
    labels: frozenset[str]
    permissive: bool
    text: str


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: infix licence tokens to postfix, None if they form no expression."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in tokens:
        word = token.lower()
        if word == "(":
            if not operand_next:
                return None
            held.append(word)
        elif word == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if operand_next or not held:
                return None
            held.pop()
        elif word in _PRECEDENCE:
            if operand_next:
                return None
            while held and _PRECEDENCE.get(held[-1], 0) >= _PRECEDENCE[word]:
                out.append(held.pop())
            held.append(word)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: list[str]) -> Verdict | None:
    """Labels an expression names and whether it allows a permissive choice; None if it is not whole."""
    stack: list[tuple[frozenset[str], bool, deque[str]]] = []
    for token in expression:
        if token.lower() not in _PRECEDENCE:
            family = FAMILIES.get(token.lower().split("-")[0].rstrip("+"))
            stack.append((frozenset({family} if family else ()), family in PERMISSIVE, deque([token])))
            continue
        (right, free_right, after), (labels, free, before) = stack.pop(), stack.pop()
        text = _joined(before, f" {token.upper()} ", after)
        if token == "with":
            # The right side names an exception, not a licence.
            stack.append((labels, free, text))
        elif token == "and":
            stack.append((labels | right, free and free_right, text))
        else:
            stack.append((labels | right, free or free_right, text))
    return Verdict(stack[0][0], stack[0][1], "".join(stack[0][2])) if len(stack) == 1 else None


def _joined(before: deque[str], operator: str, after: deque[str]) -> deque[str]:
    """Both sides in brackets; the shorter one is moved, so a long chain isn't copied at each operator."""
    if len(before) >= len(after):
        before.append(operator)
        before.extend(after)
        text = before
    else:
        after.appendleft(operator)
        after.extendleft(reversed(before))
        text = after
    text.appendleft("(")
    text.append(")")
    return text


def parse(text: str, cut: bool = False) -> Verdict | None:
    """The expression at the start of a text: as many tokens as form one.

    Where the text was `cut` off at the next tag, an operator before the cut is left out.
    """
    tokens: list[str] = []
    depth, was_operand = 0, False
    for found in _TOKEN.finditer(text):
        token = found[0]
        operator = token.lower() in _PRECEDENCE
        if was_operand and not operator and token != ")":
            break
        if token == ")" and depth == 0:
            break
        if not was_operand and (operator or token == ")"):
            return None
        depth += (token == "(") - (token == ")")
        was_operand = token == ")" or not (operator or token == "(")
        tokens.append(token)
    else:
        if cut and tokens and tokens[-1].lower() in _PRECEDENCE:
            tokens.pop()
    ordered = postfix(tokens)
    return evaluate(ordered) if ordered else None


def _automaton(entries: dict) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for key, value in entries.items():
        found.add_word(key, value)
    found.make_automaton()
    return found


def scanner() -> Callable[[str], tuple]:
    phrases = {f" {p} ": (p, label, BASE_WEIGHT, True) for p, label in BASE_PHRASES.items()}
    phrases |= {f" {p} ": (p, label, weight, False) for p, (label, weight) in NOTICES.items()}
    notices = _automaton(phrases)
    tags = _automaton({t: len(t) for t in TAGS})

    def scan(text: str) -> tuple:
        tokens = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
        joined = f" {b' '.join(tokens).decode('utf-8', 'surrogatepass')} "
        places, labels, base_labels, doubt, last, at = [], set(), set(), 1.0, 0, 0
        starts = []
        for end, (phrase, label, weight, base) in notices.iter(joined):
            starts.append((end - len(phrase) - 1, phrase, label, weight, base))
        for start, phrase, label, weight, base in sorted(starts):
            at += joined.count(" ", last, start)
            last = start
            places.append((at, phrase, label, base))
            labels.add(label)
            doubt *= 1 - weight
            if base:
                base_labels.add(label)
        expressions = []
        if ":" in text:
            # An expression ends at the next tag or with its line.
            found = list(tags.iter(_lower(text)))
            bounds = [end - length + 1 for end, length in found[1:]] + [len(text)]
            for (end, _), bound in zip(found, bounds, strict=True):
                stop = text.find("\n", end + 1, bound)
                line = text[end + 1 : bound if stop < 0 else stop]
                verdict = parse(line, stop < 0 and bound < len(text))
                doubt *= 1 - EXPRESSION_WEIGHT * bool(verdict)
                labels |= verdict.labels if verdict else frozenset()
                expressions.append((verdict.text if verdict else line.strip(), verdict.permissive if verdict else None))
        return len(tokens), places, expressions, sorted(base_labels), sorted(labels), 1 - doubt

    return scan


_UPPER = {c: c + 32 for c in range(65, 91)}


def _lower(text: str) -> str:
    """ASCII letters only, so that places stay where they are."""
    return text.translate(_UPPER) if not text.isascii() else text.lower()


FOUND = (
    "doc_id bigint, n_words bigint, places array<struct<word: bigint, phrase: string, label: string, base: boolean>>, "
    "expressions array<struct<text: string, permissive: boolean>>, base_labels array<string>, labels array<string>, "
    "score double"
)


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id with words, places of phrases (word positions), evaluated expressions, labels and score of each text.

    The score is the evidence that the text carries a licence: 1 minus the product of what each find leaves in doubt.
    """
    return per_text(texts(docs), scanner, FOUND)


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.to_json("expressions").alias("expressions"),
    )
