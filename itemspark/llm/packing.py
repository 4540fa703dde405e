"""Best-fit packing of token sequences with large-item matching.

Sizes are whole numbers up to the capacity, so the packing itself is planned on the
histogram of sizes, at most ``capacity`` rows whatever the table: items above a third
of the capacity are matched in pairs, smaller ones go, by falling size, to the tightest
gap.  The plan says which ranks of a size go to which sequences; the rows only need
their rank among the rows of their size, which is counted in buckets.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemspark.llm.registry import query, table
from itemspark.llm.tasks import aside, releasing, values
from itemspark.session import cut_lineage

CAPACITY = 4096
END_ID = 1
BUCKET_ROWS = 50_000        # rows of one bucket, about; a bucket is numbered by one task
CACHED_WORDS = 300_000      # words whose ids a task remembers
CACHED_CHARS = 64           # longer words are encoded each time
MARKS = ".,!?;:*$&|)"


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (size, first rank, ranks, per sequence, first sequence, offset).

    Ranks ``first rank`` .. of that size go ``per sequence`` at a time to ``first
    sequence``, the next, and so on, from ``offset``.  Groups of equally filled
    sequences are handled as one, so the work depends on the number of sizes.
    """
    left, rank = dict(counts), dict.fromkeys(counts, 0)
    out, new = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}     # gap: groups (first sequence, sequences)
    open_gaps: list[int] = []                       # the keys of gaps, ascending

    def add(gap: int, first: int, n: int) -> None:
        if gap > 0 and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, n))

    def put(size: int, n: int, per: int, first: int, offset: int) -> None:
        out.append((size, rank[size], n, per, first, offset))
        rank[size] += n
        left[size] -= n

    large = sorted((s for s in counts if 3 * s > capacity), reverse=True)
    for size in large:
        while left[size]:
            fits = next((t for t in large if t <= min(size, capacity - size) and left[t] > (t == size)), None)
            n = left[size] if fits is None else left[size] // 2 if fits == size else min(left[size], left[fits])
            put(size, n, 1, new, 0)
            if fits is not None:
                put(fits, n, 1, new, size)
            add(capacity - size - (fits or 0), new, n)
            new += n
    for size in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(open_gaps, size)
            if at == len(open_gaps):
                per = capacity // size
                n = max(1, left[size] // per)
                add(capacity, new, n)
                new += n
                continue
            gap = open_gaps[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            per = min(gap // size, left[size])
            used = min(n, left[size] // per)
            put(size, used * per, per, first, capacity - gap)
            add(gap - per * size, first, used)
            add(gap, first + used, n - used)
    return np.array(out, "i8").reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with an integer ``length``.

    Lengths must lie between 1 and ``capacity``; rows of null length are left out.
    Columns of those two names are replaced, others stay, whatever their names.  Every
    sequence is filled without gaps from 0.  An empty table stays empty.
    """
    return aside(pieces, ("_n", "_bucket", "_start", "_place", "_rank", "count"), lambda rows: _packed(rows, capacity))


def _packed(pieces: DataFrame, capacity: int) -> DataFrame:
    rows = pieces.drop("sequence_id", "offset").where("length IS NOT NULL")
    rows = cut_lineage(rows.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().limit(capacity + 1).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    events = plan(counts, capacity)
    events = events[np.lexsort((events[:, 1], events[:, 0]))]
    shared = rows.sparkSession.sparkContext.broadcast(events)       # bounded by the number of sizes

    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_n"), F.lit(buckets)).cast("int"))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("length", "_bucket").count()
              .select("length", "_bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("length", "_bucket").orderBy("_n")
    ranked = (rows.withColumn("_place", F.row_number().over(inside)).join(starts, ["length", "_bucket"])
              .withColumn("_rank", F.col("_start") + F.col("_place") - 1).drop("_bucket", "_start", "_place", "_n"))

    def place(frames):
        e = shared.value
        key = e[:, 0] << 48 | e[:, 1]
        for frame in frames:
            length, rank = frame["length"].to_numpy("i8"), frame["_rank"].to_numpy("i8")
            hit = e[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            step = rank - hit[:, 1]
            yield frame.drop(columns="_rank").assign(sequence_id=hit[:, 4] + step // hit[:, 3],
                                                     offset=hit[:, 5] + step % hit[:, 3] * length)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema)
    return ranked.mapInPandas(place, fields + ", sequence_id long, offset long")


def word_ids(path: str):
    """A function from a list of texts to the bytes of their ids (little-endian, unsigned,
    32 bits).

    The tokenizer drops white space and never joins what stands on both sides of a
    space, so a text's ids are those of its words in turn, and each word is encoded
    once as long as it is remembered.  Words of Latin letters are one piece each, also in
    lower case, and marks behind them are one more; many words are encoded in one call
    and the ids cut where a piece ends.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers, pre_tokenizers
    tokenizer, known = Tokenizer.from_file(path), {}
    letters = Tokenizer.from_file(path)             # for lower-case words of Latin letters
    letters.normalizer = normalizers.Sequence([])
    letters.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = tokenizer.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def one_by_one(words: list[str]) -> None:
        for w, e in zip(words, tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            known[w] = np.array(e.ids, "<u4").tobytes()

    def learn(words: list[str]) -> None:
        stems, other = {}, []
        for w in words:
            stem = w.rstrip(MARKS)
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0100"):
                stems[w] = stem.lower()
                tail = w[len(stem):]
                if tail and tail not in known:
                    one_by_one([tail])
            else:
                other.append(w)
        new = [w for w in set(stems.values()) if w not in known]
        if new:
            ids = np.array(letters.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(last[ids]) + 1).tolist()
            if len(ends) == len(new):
                data = ids.tobytes()
                for w, a, b in zip(new, [0, *ends], ends):
                    known[w] = data[4 * a:4 * b]
            else:
                one_by_one(new)
        for w, stem in stems.items():
            known[w] = known[stem] + known[w[len(stem):]]
        if other:
            one_by_one(other)

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > CACHED_WORDS or not known:
            known.clear()
            known[""] = b""
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*parts) - known.keys()
        if new:
            learn(list(new))
        ids = [b"".join(map(known.__getitem__, words)) for words in parts]
        for w in new:
            if len(w) > CACHED_CHARS:
                del known[w]
        return ids

    return encode


def batches_of(texts: Iterable[str], chars: int = 1 << 19):
    """Consecutive texts of about ``chars`` signs together, at least one."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of the pieces.

    A document is its ids and then END_ID; only one longer than ``capacity`` is cut,
    into pieces of that length and a rest.  Null text: empty, so END_ID alone.  Other
    columns are left out.  ``tokenizer`` is a file that the executors can open.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        encode, end = word_ids(tokenizer), struct.pack("<I", END_ID)
        for batch in batches:
            rows, doc_at = [], []
            encoded = (x for part in batches_of(values(batch.column("text"))) for x in encode(part))
            for place, ids_of in enumerate(encoded):
                data = ids_of + end
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    rows.append((i, at // 4, len(part) // 4, zlib.crc32(part), part if ids else None))
                    doc_at.append(place)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([batch.column("doc_id").take(pa.array(doc_at, pa.int64())),
                                   *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds))],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    pieces = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        releasing(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return pieces if ids else pieces.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of whole sequences, from packed pieces with ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))     # at most ``capacity`` parts
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
            .select("sequence_id", "length", F.expr(
                "aggregate(parts, CAST('' AS BINARY), (a, p) -> CAST(concat(a, p.ids) AS BINARY))").alias("ids")))


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_packing")
def op2_packing(spark, folder) -> DataFrame:
    """All documents, tokenized and packed into sequences of at most 4096 tokens."""
    return pack(token_pieces(table(spark, folder, "documents"), default_tokenizer()))
