"""Runs of repeated words: passages that say the same few words over and over.

A run is a stretch of words with smallest period q that no neighbouring word extends.
The suffix automaton of a passage has, along the links from the state of a prefix, all
that ends there.  Words are taken in turn: each access colours the path of its prefix
with the place, and the segments it recolours were last coloured where their strings
ended before.  If that place is no further back than a segment's longest string is
long, the string overlaps its earlier self: a square, and the distance is the period.
The longest string gives the run's first word, the last access that meets it the last.

Runs are looked for only where they can be: in a run of enough words and three periods,
each word lies in a gram of GRAM words that the text has twice.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemspark.llm.registry import query, table
from itemspark.llm.tasks import SLICE_ROWS, releasing

LEAST_WORDS = 24
LEAST_TIMES = 3
MULTIPLIER = 0x9E3779B97F4A7C15
BLANKS = r"[\x20\x09-\x0D]+"


def automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest length and link of each state of the suffix automaton, and the state of
    each prefix.  State 0 is the empty string."""
    length, link, following, prefix = [0], [-1], [{}], []
    last = 0
    for symbol in symbols:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        following.append({})
        at = last
        while at >= 0 and symbol not in following[at]:
            following[at][symbol] = new
            at = link[at]
        if at >= 0:
            old = following[at][symbol]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[old])
                following.append(dict(following[old]))
                while at >= 0 and following[at].get(symbol) == old:
                    following[at][symbol] = copy
                    at = link[at]
                link[old] = link[new] = copy
        last = new
        prefix.append(new)
    return length, link, prefix


def squares(length: list[int], link: list[int], prefix: list[int]):
    """(place, last place, longest string) of every segment that an access recolours
    where the string overlaps or touches its earlier self.

    The path segments of one colour are splay trees, ordered by depth; only the root of
    a tree knows its colour.  State 0 stands for nothing.
    """
    up, left, right = [max(0, x) for x in link], [0] * len(link), [0] * len(link)
    colour = [-1] * len(link)

    def splay(x: int) -> None:
        p = up[x]
        if left[p] != x and right[p] != x or not p:
            return
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if not inner:
                colour[x] = colour[p]
            if inner and (left[g] == p) == (left[p] == x):
                _rotate(p, g)
                p = up[x]
            elif inner:
                _rotate(x, p)
                p = up[x]
            _rotate(x, p)
            p = up[x]
            if inner and not (p and (left[p] == x or right[p] == x)):
                colour[x] = colour[g]

    def _rotate(x: int, p: int) -> None:
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    for place, state in enumerate(prefix):
        below, x = 0, state
        while x:
            splay(x)
            before = colour[x]
            if before >= 0 and place - before <= length[x]:
                yield place, before, length[x]
            if right[x]:
                colour[right[x]] = before
            right[x] = below
            below, x = x, up[x]
        colour[below] = place


def runs_of(symbols: list[int], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` symbols and ``times``
    periods (2 at least), by start and period."""
    end: dict[tuple[int, int], int] = {}
    for place, before, longest in squares(*automaton(symbols)):
        end[before - longest + 1, place - before] = place       # the left end is the run's
    return sorted((start, last - start + 1, period) for (start, period), last in end.items()
                  if last - start + 1 >= max(least, times * period))


def repeated_stretches(symbols: np.ndarray, gram: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of at least ``least`` symbols in which every one
    lies in a gram that occurs twice.  Equal hashes of different grams only add some."""
    if len(symbols) < max(least, gram):
        return []
    h = (symbols.astype("u8") + np.uint64(1)) * np.uint64(MULTIPLIER)
    h ^= h >> np.uint64(29)
    width, factor = 1, MULTIPLIER
    while width < gram:                                     # doubling; the last step may overlap
        step = min(width, gram - width)
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % (1 << 64)
        width += step
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    place = np.flatnonzero(np.isin(h, twice))
    breaks = np.flatnonzero(np.diff(place) > gram)
    starts, ends = place[np.append(0, breaks + 1)], place[np.append(breaks, len(place) - 1)] + gram
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= least]


def word_runs(words: list[bytes], least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start and period."""
    # a run's first gram has its copy one period on: least - least / times words fit
    gram = max(1, min(16, least - least // times))
    number = dict.fromkeys(words)
    if len(words) - len(number) < gram:
        return []
    for i, w in enumerate(number):
        number[w] = i
    symbols = np.fromiter(map(number.__getitem__, words), "i8", len(words))
    return [(a + start, length, period) for a, b in repeated_stretches(symbols, gram, least)
            for start, length, period in runs_of(symbols[a:b].tolist(), least, times)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join(compress(words, keep.tolist()))


def with_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """Add ``runs`` (array of start, length, period in words, by start and period) and
    ``collapsed`` (the text's words, one space between, without those that a run holds
    after its first period); columns of those names are replaced, others stay.

    Words are separated by ASCII blanks.  Null and blank texts: no runs, empty.  Each
    row is handled on its own, so repeated rows give the same; an empty table stays
    empty.  Work is within a text's own words: memory is a few hundred bytes for each
    word that lies in a repeated passage.  ``times`` must be 2 at least.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.drop("runs", "collapsed")
    text_at = rows.columns.index("text")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch, runs, texts = whole.slice(at, SLICE_ROWS), [], []
                for text in batch.column(text_at).to_pylist():
                    words = (text or "").encode().split()
                    found = word_runs(words, least, times)
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    texts.append(collapsed(words, found).decode())
                yield pa.record_batch([*batch.columns, pa.array(runs, run_type), pa.array(texts, pa.string())],
                                      names=[*batch.schema.names, "runs", "collapsed"])

    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(
        "runs array<struct<start: long, length: long, period: long>>, collapsed string").fields])
    return rows.mapInArrow(releasing(run), schema)


def strongest(runs) -> F.Column:
    """The run with the greatest length / period; of equal ones the first."""
    return F.reduce(runs, F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"),
                    lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r)
                    .otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; from a word on, the texts of one doc_id in ten say a few words
    again and again.  Which words depends on the doc_id; a null one changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")
    own = (docs.select("doc_id", "text").withColumn("h", h)
           .withColumn("words", F.when(F.col("h") % 10 == 0, words))
           .withColumn("n", F.nullif(F.size("words"), F.lit(0))).withColumn("g", F.floor(F.col("h") / 10))
           .withColumn("a", F.col("g") % F.col("n"))
           .withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    source = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    again = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.col("words")[source(i).cast("int")]))
    return own.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


@query("op13_runs")
def op13_runs(spark, folder) -> DataFrame:
    """The runs of all documents, some of them made to repeat themselves."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                              r["period"].cast("string"), F.lit("\n"))
    found = with_runs(planted(table(spark, folder, "documents")))
    own = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"),
                       F.sha2(F.concat_ws("", F.transform("runs", line)).cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return own.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")
