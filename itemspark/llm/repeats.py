"""Suffix-array deduplication: bytes of strings that occur more than once.

Which strings of at least MATCH bytes repeat is read from common prefixes in a suffix
order that is built column by column for many texts at once.  To build it in bounded
pieces, texts are cut around anchors: every MATCH-byte string contains an anchor, a
64-byte string of smallest hash, at a place that depends on that string alone, so equal
strings have equal anchors.  Occurrences of one anchor are laid out with their
surroundings, aligned at the anchor.  Each round then inserts one symbol of every
segment: segments are re-ordered by it (the positional Burrows-Wheeler transform of the
collection) and the lengths of common strings of neighbours are carried along.  Columns
are read in turn from a temporary file; memory holds the order and the lengths.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemspark.llm.registry import query, table
from itemspark.llm.tasks import give_back, releasing, unused, values
from itemspark.session import cut_lineage

MATCH = 400                 # bytes of the shortest repeated string
GRAM = 64                   # bytes of an anchor; a match must be longer
PIECE = 1 << 20             # start bytes of a long text that are searched at once
CHUNK = 8192                # segments whose columns one task orders, about
BASE = 0x9E3779B97F4A7C15
NO_SYMBOL = 256             # outside the text; equal to nothing


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[:1] = 1
    return np.cumprod(out, dtype="u8")


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width`` values."""
    n = len(values)
    rows = -(-n // width)
    fill = np.iinfo("u8").max if pick is np.minimum else 0
    grid = np.full(rows * width, fill, "u8")
    grid[:n] = values
    grid = grid.reshape(rows, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    behind = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n - width + 1], ahead[width - 1:n])


class Anchors:
    """Finds the anchors of texts; keeps the powers that the rolling hash needs."""

    def __init__(self, match: int, gram: int = GRAM):
        self.match, self.gram, self.width = match, gram, match - gram + 1
        self.up = self.down = np.zeros(0, "u8")

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ascending places and hashes of a text's anchors: all smallest-hash grams of
        every string of ``match`` bytes, ties included."""
        places, hashes = [], []
        for at in range(0, max(1, len(data) - self.match + 1), PIECE):
            p, h = self._find(np.frombuffer(data, "u1", min(PIECE + self.match - 1, len(data) - at), at))
            places.append(p + at)
            hashes.append(h)
        place, first = np.unique(np.concatenate(places), return_index=True)
        return place, np.concatenate(hashes)[first]

    def _find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(x) < self.match:
            return np.zeros(0, "i8"), np.zeros(0, "u8")
        if len(self.up) < len(x):
            self.up = powers(2 * len(x), BASE)
            self.down = powers(2 * len(x), pow(BASE, -1, 1 << 64))
        sums = np.zeros(len(x) + 1, "u8")
        np.cumsum((x + np.uint64(1)) * self.up[:len(x)], out=sums[1:])
        h = (sums[self.gram:] - sums[:-self.gram]) * self.down[:len(x) - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        least = sliding(h, self.width, np.minimum)
        edge = np.zeros(self.width - 1, "u8")                   # windows beyond the ends
        chosen = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), self.width, np.maximum) == h)
        return chosen, h[chosen]


def within(place: np.ndarray, back: np.ndarray, ahead: np.ndarray, gram: np.ndarray, context: np.ndarray,
           keep_first: bool):
    """Settle the anchors of one text that have the same surroundings at several places.

    Gives the index of the first place of each (gram, context), the number of its places,
    and the starts and ends of the runs that the repeated ones (``keep_first``: but the
    first) cover together.  A text of one line over and over so has as many rows as it
    has different surroundings.
    """
    if len(np.unique(context)) == len(context):
        none = np.zeros(0, "i8")
        return np.arange(len(place)), np.ones(len(place), "i8"), none, none
    _, first, own, n = np.unique(np.stack([gram, context], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    own = own.ravel()
    repeated = n[own] > 1
    if keep_first:
        repeated[first] = False
    start, end = (place - back)[repeated], (place + ahead)[repeated]       # both ascend with the place
    new = np.flatnonzero(start[1:] > end[:-1]) + 1
    return first, n, start[np.append(0, new)[:len(start)]], end[np.append(new, len(end))[:len(end)] - 1]


def anchor_rows(raw: DataFrame, match: int = MATCH, gram_bytes: int = GRAM, keep_first: bool = False) -> DataFrame:
    """For ``raw`` (doc, text_bytes binary) one row per text, anchor and surroundings: doc,
    text_key (md5), place (the first), back and ahead (bytes of surroundings before and
    from the anchor), gram (its hash), context (hash of the surroundings) and n (places).
    Rows without a gram are runs that repeats within the text cover: ``ahead`` bytes from
    ``place``."""
    def run(batches):
        from xxhash import xxh3_64_intdigest
        finder, reach = Anchors(match, gram_bytes), match - gram_bytes
        for batch in batches:
            keys, rows, counts, cols = [], [], [], [[], [], [], [], [], []]
            for row, data in enumerate(values(batch.column("text_bytes"))):
                if len(data) < match:
                    continue
                place, gram = finder.find(data)
                back, ahead = np.minimum(place, reach), np.minimum(len(data) - place, match)
                context = np.fromiter((xxh3_64_intdigest(data[p - b:p + a], b) for p, b, a in
                                       zip(place.tolist(), back.tolist(), ahead.tolist())), "u8", len(place))
                first, n, start, end = within(place, back, ahead, gram, context, keep_first)
                none = np.zeros(len(start), "i8")
                keys.append(hashlib.md5(data).digest())
                rows.append(row)
                counts.append(len(first) + len(start))
                for col, own, runs in zip(cols, (place[first], back[first], ahead[first], gram.view("i8")[first], context.view("i8")[first], n),
                                          (start, none, end - start, none, none, none)):
                    col += own, runs
            if keys:
                at = pa.array(np.repeat(np.arange(len(keys)), counts))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                cols = [pa.array(np.concatenate(c).astype("i8")).cast(k) for c, k in zip(cols, kinds)]
                cols[3] = pc.if_else(pc.greater(cols[5], 0), cols[3], None)
                yield pa.record_batch([batch.column("doc").take(pa.array(np.repeat(rows, counts))), pa.array(keys, pa.binary()).take(at), *cols],
                                      names=["doc", "text_key", "place", "back", "ahead", "gram", "context", "n"])

    return raw.mapInArrow(releasing(run), f"doc {doc_type(raw)}, text_key binary, place long, back int, ahead int, gram long, context long, n long")


def doc_type(raw: DataFrame) -> str:
    return raw.schema["doc"].dataType.simpleString()


def common_runs(segments: list[bytes], backs: list[int], match: int = MATCH, rank: np.ndarray | None = None,
                gram: int = GRAM):
    """(segment, start, end) of all bytes that a segment shares with another one (of
    smaller ``rank``, if ranks are given) in a common string of at least ``match`` bytes
    at the same columns.

    ``backs`` are the places of the anchors in the segments; starts and ends count from
    the anchor.  Round by round one column of symbols is inserted.
    """
    m, zero = len(segments), match - gram
    width = zero + match
    symbols = np.full((m, width), NO_SYMBOL, "u2")
    for row, data, back in zip(symbols, segments, backs):
        row[zero - back:zero - back + len(data)] = np.frombuffer(data, "u1")
    marks = np.zeros((m, width + 1), "i2")
    with tempfile.TemporaryFile() as columns:
        np.ascontiguousarray(symbols.T).tofile(columns)
        del symbols
        columns.seek(0)
        order, common = np.arange(m), np.zeros(m, "i4")         # common[i]: of order[i - 1] and order[i]
        for column in range(width):
            symbol = np.fromfile(columns, "u2", m)[order]
            moved = np.argsort(symbol, kind="stable")
            symbol = symbol[moved]
            carried = common[moved]
            same = (symbol[1:] == symbol[:-1]) & (symbol[1:] != NO_SYMBOL)
            apart = np.flatnonzero(same & (moved[1:] != moved[:-1] + 1))
            if len(apart):
                ends = np.stack([moved[apart] + 1, moved[apart + 1] + 1], 1).ravel()
                carried[apart + 1] = np.minimum.reduceat(np.append(common, 0), ends)[::2]
            carried[1:] = np.where(same, carried[1:] + 1, 0)
            carried[0] = 0
            order, common = order[moved], carried
            if column + 1 >= match and rank is not None:
                shared = common >= match                        # with the one before in the order
                if shared.any():
                    cluster = np.cumsum(~shared) - 1
                    own = rank[order]
                    first = np.minimum.reduceat(own, np.flatnonzero(~shared))
                    rows = order[own != first[cluster]]
                    marks[rows, column + 1 - match] += 1
                    marks[rows, column + 1] -= 1
            elif column + 1 >= match:
                longest = np.maximum(common, np.append(common[1:], 0))
                hit = np.flatnonzero(longest >= match)
                if len(hit):
                    rows = order[hit]
                    marks[rows, column + 1 - longest[hit]] += 1
                    marks[rows, column + 1] -= 1
    covered = np.zeros((m, width + 2), "i1")
    covered[:, 1:-1] = np.cumsum(marks[:, :-1], axis=1, dtype="i4") > 0
    step = np.diff(covered, axis=1)
    row, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return row, start - zero, end - zero


def repeated_spans(docs: DataFrame, match: int = MATCH, keep_first: bool = False, gram_bytes: int = GRAM) -> DataFrame:
    """doc, text_key and spans (array of start, end, in bytes) of the texts with repeated
    strings; doc is null unless ``keep_first``, when only strings that also start earlier
    count: in a smaller doc_id, or before in the same text.

    Spans may overlap.  Texts are known by their md5, so copies are searched together.
    """
    doc = F.col("doc_id") if keep_first else F.lit(None).cast("long")
    raw = docs.select(doc.alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("text_bytes"))
    found = cut_lineage(anchor_rows(raw, match, gram_bytes, keep_first), "anchors")
    inside = found.where("gram is null").select("doc", "text_key", F.col("place").alias("start"), (F.col("place") + F.col("ahead")).alias("end"))
    anchors = found.where("gram is not null")
    # counts are stored before they are joined: only a join of two plain shuffles can be
    # split by Spark where one gram has very many rows
    often = cut_lineage(anchors.groupBy("gram").count().where("count > 1").select("gram"), "often")
    shared = cut_lineage(anchors.join(often, "gram"), "shared")

    contexts = cut_lineage(shared.groupBy("gram", "context").agg(
        F.sum("n").alias("n"), F.min(F.struct("doc", "text_key", "place", "back", "ahead")).alias("at")), "contexts")
    again = contexts.where("n > 1").select("gram", "context", F.struct("at.doc", "at.text_key", "at.place").alias("first"))
    whole = shared.drop("n").join(again, ["gram", "context"])
    if keep_first:
        whole = whole.where(~F.struct("doc", "text_key", "place").eqNullSafe(F.col("first")))
    whole = whole.select("doc", "text_key", (F.col("place") - F.col("back")).alias("start"), (F.col("place") + F.col("ahead")).alias("end"))

    several = cut_lineage(contexts.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1"), "several")
    # segments that are covered as a whole are compared with, but need no marks
    open_ = cut_lineage(contexts.join(several, "gram").select(
        "gram", "context", "contexts", ((F.col("n") == 1) | F.lit(keep_first)).alias("alone"), "at.*"), "open")
    # an anchor with many surroundings is a batch of its own, so that buckets are even
    large = F.col("contexts") > CHUNK // 8
    batches = open_.where(~large).count() // CHUNK + 1
    blocks = F.ceil(F.col("contexts") / CHUNK).cast("int")
    own = F.pmod(F.col("context"), blocks).cast("int")
    dealt = (open_.withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .withColumn("batch", F.when(large, F.col("gram")).otherwise(F.pmod(F.col("gram"), F.lit(batches))))
             .withColumn("block", F.when(blocks > 1, F.least("own", "other") * 1_000_000 + F.greatest("own", "other")).otherwise(-1))
             .groupBy("text_key").agg(F.collect_list(F.struct(
                 "batch", "block", "gram", "context", "alone", "doc", "place", "back", "ahead")).alias("wanted")))

    kind = doc_type(raw)
    segments = (once_per_task(raw).join(dealt, "text_key").mapInArrow(
        releasing(cut_segments), f"batch long, block long, gram long, context long, alone boolean, doc {kind}, "
                                 "text_key binary, place long, back int, segment binary"))
    partly = segments.groupBy("batch", "block").applyInArrow(
        lambda group: matched(group, match, keep_first, gram_bytes), f"doc {kind}, text_key binary, start long, end long")
    return (inside.unionByName(whole).unionByName(partly).groupBy("doc", "text_key")
            .agg(F.collect_set(F.struct("start", "end")).alias("spans")))


def once_per_task(raw: DataFrame) -> DataFrame:
    """text_key and packed (the text, compressed for the shuffle); a text comes at most
    once from each task, so that many copies don't meet in one."""
    def run(batches):
        from zstandard import ZstdCompressor
        seen, pack = set(), ZstdCompressor(level=3).compress
        for batch in batches:
            keys, packed = [], []
            for data in values(batch.column("text_bytes")):
                key = hashlib.md5(data).digest()
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    packed.append(pack(data))
            yield pa.record_batch({"text_key": pa.array(keys, pa.binary()), "packed": pa.array(packed, pa.binary())})

    return raw.mapInArrow(releasing(run), "text_key binary, packed binary")


def cut_segments(batches):
    from zstandard import ZstdDecompressor
    unpack = ZstdDecompressor().decompress
    names = ["batch", "block", "gram", "context", "alone", "doc", "text_key", "place", "back", "segment"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), None, pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        kinds[5] = batch.column("wanted").type.value_type.field("doc").type
        rows = []
        for key, packed, wanted in zip(*(values(batch.column(c)) for c in ("text_key", "packed", "wanted"))):
            data = unpack(packed)
            rows += [(w["batch"], w["block"], w["gram"], w["context"], w["alone"], w["doc"], key, w["place"], w["back"],
                      data[w["place"] - w["back"]:w["place"] + w["ahead"]]) for w in wanted]
        yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def matched(group: pa.Table, match: int, keep_first: bool = False, gram: int = GRAM) -> pa.Table:
    """Spans that the segments of one batch share; texts read twice count once."""
    pairs = np.stack([group.column(c).to_numpy() for c in ("gram", "context")], 1)
    _, first = np.unique(pairs, axis=0, return_index=True)
    group = group.take(pa.array(first))
    rank = None
    if keep_first:
        order = pc.sort_indices(group.select(["doc", "text_key", "place"]), null_placement="at_start",
                                sort_keys=[(c, "ascending") for c in ("doc", "text_key", "place")]).to_numpy()
        rank = np.empty(len(order), "i8")
        rank[order] = np.arange(len(order))
    row, start, end = common_runs(group.column("segment").to_pylist(), group.column("back").to_pylist(), match, rank, gram)
    alone = group.column("alone").to_numpy(zero_copy_only=False)[row]       # the others are covered as a whole
    row, start, end = row[alone], start[alone], end[alone]
    place = group.column("place").to_numpy()[row]
    found = pa.table({"doc": group.column("doc").take(pa.array(row)), "text_key": group.column("text_key").take(pa.array(row)),
                      "start": pa.array(place + start, pa.int64()), "end": pa.array(place + end, pa.int64())})
    give_back()
    return found


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_repeats(docs: DataFrame, match: int = MATCH, as_text: bool = False, keep_first: bool = False,
                    gram_bytes: int = GRAM) -> DataFrame:
    """Add ``removed`` (array of start, end: maximal removed byte runs) and ``kept`` (the
    other bytes) to the documents; columns of those names are replaced, others stay.
    ``as_text`` gives ``kept`` as a string: a code point cut by the end of a removed run
    goes with the run.

    Removed is every byte covered by a string of ``match`` UTF-8 bytes that also starts
    anywhere else, in this or another document; matches don't cross documents and are
    judged on the input.  So all copies of a repeated passage go, and all of a copied
    text that is long enough.  ``keep_first`` leaves one: only strings count that also
    start earlier, which is in a document of smaller doc_id (null is the smallest), in a
    different text of the same doc_id with a smaller md5, or before in the same text.
    Rows equal in doc_id and text are then handled alike.  Null text: empty.  Texts
    shorter than ``match`` stay whole; an empty table stays empty.
    """
    rows = docs.drop("removed", "kept")
    key, doc, at, found = (unused(c, rows.columns) for c in ("key", "doc", "text_key", "spans"))
    keyed = rows.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    spans = cut_lineage(repeated_spans(docs, match, keep_first, gram_bytes), "spans").toDF(doc, at, found)
    same = F.col(key) == F.col(at)
    if keep_first:
        same = same & F.col("doc_id").eqNullSafe(F.col(doc))
    joined = keyed.join(spans, same, "left").drop(key, doc, at)
    text_at, spans_at = rows.columns.index("text"), len(rows.columns)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            removed, kept = [], []
            for text, found in zip(values(batch.column(text_at)), values(batch.column(spans_at))):
                data, gone = (text or "").encode(), merged(found)
                edges = [0, *(x for span in gone for x in span), len(data)]
                parts = [data[a:b] for a, b in zip(edges[::2], edges[1::2])]
                removed.append([{"start": a, "end": b} for a, b in gone])
                kept.append("".join(p.decode("utf-8", "ignore") for p in parts) if as_text else b"".join(parts))
            yield pa.record_batch([*batch.columns[:-1], pa.array(removed, run_type), pa.array(kept, pa.string() if as_text else pa.binary())],
                                  names=[*batch.schema.names[:-1], "removed", "kept"])

    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string(
        f"removed array<struct<start: long, end: long>>, kept {'string' if as_text else 'binary'}").fields])
    return joined.mapInArrow(releasing(run), schema)


@query("op5_repeats")
def op5_repeats(spark, folder) -> DataFrame:
    """All documents without the bytes of strings of 400 bytes that occur again; ``text``
    is what is left, with U+FFFD for code points that the end of a removed run cuts."""
    found = without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    length = lambda x: F.octet_length(x).cast("long")
    return found.select("doc_id", length(F.coalesce("text", F.lit(""))).alias("n_bytes"),
                        (length(F.coalesce("text", F.lit(""))) - length("kept")).alias("n_removed"),
                        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
