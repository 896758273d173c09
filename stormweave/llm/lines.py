"""Operator 8, line dedup with a log-template tree.

A line is parsed at fixed depth: by its number of tokens, then by its `LEAD` leading tokens, then at the leaf. Tokens
with a digit are variable fields everywhere. At the leaf of a longer line one of three equal stretches of the tokens
behind the leading ones may vary as a whole, so lines that differ in a name or a title share a template although no
digit shows it. A template is thus a path of the tree: a line's own, three generalised ones, and those learnt. A template keeps constants: at least half of its tokens, one of the leading ones among them. A line
with fewer (a row of numbers, a date, a lone URL) is no template and recurs only by its very tokens. A template that
occurs in `MIN_DOCS` documents or more recurs; its lines are dropped from all documents but the one with the smallest id.

Learnt templates have word fields anywhere. A leaf holds the lines of one length and one of the leading tokens (the first
or the second). For leaves in `MIN_DOCS` documents or more, documents are counted per (leaf, position, token). A line's
template keeps the tokens in at least 1, 2, 4, 8, ... times `MIN_DOCS` documents of the leaf, one template per level while
half of the tokens and `CONSTANTS` of them stay, and a line is dropped by any of its templates that recurs. A template is
of `VALUES` different lines or more: two variants of a line are near copies, not a field. Left out by this definition:
fields in both leading tokens, more fields than constants, fewer than `CONSTANTS` constants, fields whose number of words
varies, and templates of two different lines (of which one recurs by itself beyond eight documents).

Paths are 64-bit hashes. Each task sums the documents of a path before the shuffle, so a line of a third of all documents
is one row per task; nothing is grouped but counters. A second pass finds the lines on recurring paths: a bit table of
fixed size spares it the paths that cannot recur, and an exact join by path decides. Texts are shuffled once, by
document, to cut the lines out.

Defined results: null and empty texts have no lines and stay as they are; lines without a word are never dropped; a
template counts a row once, so repeated rows count as documents of their own, and all rows of the smallest id keep
their lines; an empty table gives an empty result; other columns are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormweave.llm import ngrams
from stormweave.llm.bits import BitTable
from stormweave.session import materialize

#: Documents a template occurs in to recur; leading tokens of the tree; least tokens of a line that generalises by
#: stretches; least constants and least different lines of a learnt template.
MIN_DOCS, LEAD, LEAST, CONSTANTS, VALUES = 5, 2, 8, 3, 3
_VARIABLE = np.uint64(0x2545F4914F6CDD1D)
#: The kind of path of lines that keep their digits; 0 to 3 are the masked line and its three stretches.
_EXACT = 4
_STEP = 0x9E3779B97F4A7C15 | 1
_LOWEST = -(1 << 63)


class Lines(NamedTuple):
    """The lines with a word of a chunk: masked tokens of all lines, and per line its tokens, text and number in the text."""

    tokens: np.ndarray
    exact: np.ndarray
    first: np.ndarray
    count: np.ndarray
    text: np.ndarray
    number: np.ndarray


def parse(joined: bytes, lengths: np.ndarray) -> Lines | None:
    raw = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(lengths)
    # A line ends behind its newline, the last one of a text with the text.
    line_ends = np.union1d(np.flatnonzero(raw == 10) + 1, ends)
    words = ngrams.hash_words(ngrams.folded(joined, ngrams.SPACES), np.diff(line_ends, prepend=0))
    if not len(words.hashes):
        return None
    digits = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    tokens = np.where(digits[words.ends] > digits[words.starts], _VARIABLE, words.hashes)
    first = np.flatnonzero(np.diff(words.owner, prepend=-1))
    line = words.owner[first]
    text = np.searchsorted(ends, line_ends[line] - 1, side="right")
    first_line = np.searchsorted(line_ends, np.concatenate([[0], ends[:-1]]), side="right")
    return Lines(tokens, words.hashes, first, np.diff(first, append=len(tokens)), text, line - first_line[text])


def _sums(values: np.ndarray, of: Lines) -> np.ndarray:
    """Prefix sums of tokens, each times the power of its place in its line."""
    position = np.arange(len(values)) - np.repeat(of.first, of.count)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(of.count.max())[position])])


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n + 1, _STEP, np.uint64))


def fixed_paths(of: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(line, path): a line's own path and the three with a stretch left out."""
    first, count = of.first, of.count
    sums = _sums(of.tokens, of)
    whole = sums[first + count] - sums[first]
    constants = np.concatenate([[0], np.cumsum(of.tokens != _VARIABLE)])
    leading = constants[first + np.minimum(count, LEAD)] > constants[first]
    kept = constants[first + count] - constants[first]
    # Without enough constants only the very tokens of a line are its path.
    exact = _sums(of.exact, of)
    templated = leading & (2 * kept >= count)
    paths = [np.where(templated, _path(whole, count, 0), _path(exact[first + count] - exact[first], count, _EXACT))]
    lines = [np.arange(len(first))]
    for k in range(3):
        long_ = np.flatnonzero(leading & (count >= LEAST))
        at, n = first[long_], count[long_]
        low, high = LEAD + (n - LEAD) * k // 3, LEAD + (n - LEAD) * (k + 1) // 3
        enough = 2 * (kept[long_] - (constants[at + high] - constants[at + low])) >= n
        long_, at, n, low, high = (x[enough] for x in (long_, at, n, low, high))
        paths.append(_path(whole[long_] - (sums[at + high] - sums[at + low]), n, k + 1))
        lines.append(long_)
    return np.concatenate(lines), np.concatenate(paths)


def leaves(of: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(line, leaf): the leaves of a line, by its length and each of the leading tokens that has no digit."""
    constants = np.concatenate([[0], np.cumsum(of.tokens != _VARIABLE)])
    kept = constants[of.first + of.count] - constants[of.first]
    able = np.flatnonzero((of.count > CONSTANTS) & (kept >= CONSTANTS) & (2 * kept >= of.count))
    found = []
    for k in range(LEAD):
        token = of.tokens[of.first[able] + k]
        at = able[token != _VARIABLE]
        found.append((at, _path(token[token != _VARIABLE], of.count[at], _EXACT + 1 + k)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def leaf_tokens(of: Lines, line: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the line and leaf, position, token, key of the three) of all tokens without a digit."""
    n = of.count[line]
    owner = np.repeat(np.arange(len(line)), n)
    position = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    token = of.tokens[of.first[line][owner] + position]
    keep = token != _VARIABLE
    owner, position, token = owner[keep], position[keep], token[keep]
    return owner, position, token, ngrams.mix(ngrams.mix(token + ngrams.mix(position.astype(np.uint64) + np.uint64(1))) ^ leaf[owner])


def line_keys(of: Lines) -> np.ndarray:
    """A key of the masked tokens of each line."""
    sums = _sums(of.tokens, of)
    return _path(sums[of.first + of.count] - sums[of.first], of.count, 7)


def _path(sums: np.ndarray, count: np.ndarray, kind: int) -> np.ndarray:
    return ngrams.mix(sums ^ ngrams.mix(count.astype(np.uint64) * np.uint64(8) + np.uint64(kind)))


def _slim(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"))


def _parsed(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Lines]]:
    for low, high, joined, lengths in ngrams.chunks(batch.column(column).to_pylist()):
        if (of := parse(joined, lengths)) is not None:
            yield low, high, of


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names.split())


def _once(path: np.ndarray, text: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path, rows, least id) of a chunk, each path once per row."""
    order = np.lexsort((text, path))
    path, text = path[order], text[order]
    keep = np.r_[True, (path[1:] != path[:-1]) | (text[1:] != text[:-1])]
    path, text = path[keep], text[keep]
    start = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    return path[start], np.diff(start, append=len(path)), np.minimum.reduceat(ids[text], start)


def templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """path, leaf, docs, first_doc of the fixed paths and of the leaves that recur."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, high, of in _parsed(batch, 2):
                for is_leaf, (line, path) in enumerate((fixed_paths(of), leaves(of))):
                    if len(path):
                        path, docs_, least = _once(path, of.text[line], ids[low:high])
                        yield _batch("path leaf docs first_doc", path, np.full(len(path), bool(is_leaf)), docs_, least)

    found = _slim(docs).mapInArrow(count, "path long, leaf boolean, docs long, first_doc long")
    counted = found.groupBy("path", "leaf").agg(F.sum("docs").alias("docs"), F.min("first_doc").alias("first_doc"))
    return counted.filter(F.col("docs") >= min_docs)


def learnt_templates(docs: DataFrame, recurring: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """line, template: the learnt templates of each different masked line of a recurring leaf."""
    spark = docs.sparkSession
    leaf_bits = BitTable.of(recurring.filter("leaf"), "path").share(spark)

    def in_leaves(of: Lines) -> tuple[np.ndarray, np.ndarray]:
        line, leaf = leaves(of)
        maybe = BitTable(leaf_bits.value).test(leaf)
        return line[maybe], leaf[maybe]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, high, of in _parsed(batch, 2):
                line, leaf = in_leaves(of)
                if len(line):
                    owner, _, _, key = leaf_tokens(of, line, leaf)
                    yield _batch("key docs", *_once(key, of.text[line[owner]], ids[low:high])[:2])

    counted = _slim(docs).mapInArrow(count, "key long, docs long").groupBy("key").agg(F.sum("docs").alias("docs"))
    frequent = materialize(counted.filter(F.col("docs") >= min_docs), "line-tokens")
    token_bits = BitTable.of(frequent, "key").share(spark)

    def able(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Frequent tokens of the lines that have enough of them, each different line once per chunk.
        for batch in batches:
            for _, _, of in _parsed(batch, 2):
                line, leaf = in_leaves(of)
                if not len(line):
                    continue
                keys = line_keys(of)
                once = np.unique(np.stack([keys[line], leaf]), axis=1, return_index=True)[1]
                line, leaf = line[once], leaf[once]
                owner, position, token, key = leaf_tokens(of, line, leaf)
                maybe = BitTable(token_bits.value).test(key)
                enough = np.bincount(owner[maybe], minlength=len(line))
                maybe = maybe[((enough >= CONSTANTS) & (2 * enough >= of.count[line]))[owner[maybe]]]
                at = line[owner[maybe]]
                yield _batch("line leaf n position token key", keys[at], leaf[owner[maybe]], of.count[at], position[maybe], token[maybe], key[maybe])

    schema = "line long, leaf long, n long, position long, token long, key long"
    known = _slim(docs).mapInArrow(able, schema).dropDuplicates(["line", "leaf", "position"]).join(frequent, "key")
    lined = known.groupBy("line", "leaf", "n").agg(F.collect_list(F.struct("position", "token", "docs")).alias("found"))

    def levels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, found = batch.column(1).to_numpy(), batch.column(2)
            ends = np.cumsum(found.value_lengths().to_numpy())
            fields = dict(zip(("position", "token", "docs"), found.flatten().flatten(), strict=True))
            position, token, docs_ = (fields[x].to_numpy() for x in ("position", "token", "docs"))
            power = _powers(int(n.max()))
            term = (token.view(np.uint64) - _VARIABLE) * power[position]
            blank = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VARIABLE * power)])
            owner, paths, starts = [], [], np.r_[0, ends[:-1]]
            for k, (low, high) in enumerate(zip(starts, ends, strict=True)):
                level, before = min_docs, -1
                while True:
                    constant = docs_[low:high] >= level
                    kept = int(constant.sum())
                    if kept < CONSTANTS or 2 * kept < n[k]:
                        break
                    if kept != before:
                        owner.append(k)
                        paths.append(term[low:high][constant].sum(dtype=np.uint64))
                    before, level = kept, 2 * level
            if owner:
                sums = blank[n[owner]] + np.array(paths, np.uint64)
                yield _batch("line template", batch.column(0).to_numpy()[owner], _path(sums, n[owner], 0))

    found = materialize(lined.select("line", "n", "found").mapInArrow(levels, "line long, template long").distinct(), "leaf-templates")
    several = found.groupBy("template").count().filter(F.col("count") >= VALUES).select("template")
    return found.join(several, "template").select("line", "template")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc, body and the numbers (from 0) of lines to drop, one row per document that loses any."""
    recurring = materialize(templates(docs, min_docs), "line-templates")
    fixed = recurring.filter("NOT leaf")
    learnt = materialize(learnt_templates(docs, recurring, min_docs), "learnt-templates")
    tables = [BitTable.of(t, c).share(docs.sparkSession) for t, c in ((fixed, "path"), (learnt, "line"))]

    def hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies, rows = (batch.column(k).to_numpy() for k in (0, 1, 3))
            for low, _, of in _parsed(batch, 2):
                keyed = fixed_paths(of), (np.arange(len(of.first)), line_keys(of))
                for by_line, (table, (line, path)) in enumerate(zip(tables, keyed, strict=True)):
                    maybe = BitTable(table.value).test(path)
                    line, path = line[maybe], path[maybe]
                    text = of.text[line] + low
                    yield _batch("doc body row line path by_line", ids[text], bodies[text], rows[text], of.number[line], path, np.full(len(line), bool(by_line)))

    slim = _slim(docs).withColumn("row", F.monotonically_increasing_id())
    found = materialize(slim.mapInArrow(hits, "doc long, body long, row long, line long, path long, by_line boolean"), "line-hits")
    on_fixed = found.filter("NOT by_line").select("doc", "body", "line", "path").join(fixed.select("path", "first_doc"), "path")
    own = found.filter("by_line").select("doc", "body", "row", "line", F.col("path").alias("key"))
    on_learnt = own.join(learnt.withColumnRenamed("line", "key"), "key")
    # A template counts a row once.
    once = on_learnt.groupBy("template", "row").agg(F.min("doc").alias("doc"))
    counted = once.groupBy("template").agg(F.count("*").alias("docs"), F.min("doc").alias("first_doc")).filter(F.col("docs") >= min_docs)
    both = on_fixed.select("doc", "body", "line", "first_doc").unionByName(
        on_learnt.join(counted.select("template", "first_doc"), "template").select("doc", "body", "line", "first_doc")
    )
    later = both.filter(F.col("first_doc") < F.col("doc"))
    return later.groupBy("doc", "body").agg(F.collect_set(F.col("line").cast("int")).alias("lines"))


def _cut(text: Column, lines: Column) -> Column:
    """The text without the lines of the given numbers, in time linear in the number of lines."""

    def without(all_: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), lines)
        return F.array_join(F.transform(kept, lambda i: F.get(all_, i)), "\n")

    return F.when(F.size(lines) > 0, F.transform(F.array(F.split(text, "\n")), without)[0]).otherwise(text)


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(row, text, lines): each row of `docs` as a struct, its text without recurring lines, and the dropped lines."""
    cut = dropped_lines(docs, min_docs).withColumnsRenamed({"doc": "d", "body": "b"})
    text = F.col("row")["text"].cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = rows.withColumns({"doc": F.coalesce(F.col("row")["doc_id"].cast("long"), F.lit(_LOWEST)), "body": F.xxhash64(text)})
    joined = keyed.join(cut, (F.col("doc") == F.col("d")) & (F.col("body") == F.col("b")), "left")
    lines = F.coalesce("lines", F.array().cast("array<int>"))
    return joined.select("row", _cut(text, lines).alias("text"), F.array_sort(lines).alias("lines"))


def digest(cut: DataFrame) -> DataFrame:
    return cut.select(
        F.col("row")["doc_id"].alias("doc_id"),
        F.when(F.col("row")["text"].isNull(), 0).otherwise(F.size(F.split(F.col("row")["text"], "\n"))).cast("long").alias("n_lines"),
        F.size("lines").cast("long").alias("n_dropped"),
        F.col("text").alias("kept_text"),
    )


def keep_fresh(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs`, all columns, with recurring lines cut out of the texts; rows of which nothing is left go.

    `n_chars` follows the text where it is a column.
    """
    cut = drop_recurring(docs, min_docs)
    emptied = (F.size("lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    # A row that lost no line keeps its values as they are.
    columns = [
        (F.when(F.size("lines") > 0, changed[c]).otherwise(F.col("row")[c]) if c in changed else F.col("row")[c]).alias(c)
        for c in docs.columns
    ]
    return cut.filter(~F.coalesce(emptied, F.lit(False))).select(*columns)
