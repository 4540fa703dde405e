"""Token files: ids in patched frame-of-reference blocks.

A file holds whole documents in order.  Their ids form one sequence that is cut into
blocks of 256.  A block keeps its smallest id and the differences from it, packed at
the width that a given share of them fits; the high bits of the others follow in an
exception list with their places.  An index has, for each block, the minimum, the
width, and where its packed words and exceptions start, so any range of ids is read
without unpacking the rest.

Layout (little-endian): HEAD; per document: its length (u4), doc_id (i8) and whether it
is null (u1); per block: minimum (u4), width (u1), start of its words (u4, counted in
words) and of its exceptions (u4), both with one more at the end; the words (u4); the
exceptions' high bits (u4) and places in their block (u1).  Spark's text source writes
a file per row and ends it with a line feed, which the reader ignores.
"""

from __future__ import annotations

import gc
import os
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemspark.llm.registry import query, table
from itemspark.llm.tasks import releasing, remembered, values
from itemspark.session import cut_lineage, staging_path

BLOCK = 256                 # ids of a block
SLAB = 1024 * BLOCK         # ids that are packed at once
LANES = 32                  # a word's bits; 32 differences fill ``width`` words
SHARE = 0.95                # of a block's differences fit its width
FILE_IDS = 1 << 23          # a file ends with the document that reaches so many ids
END_ID = 0
CACHED_WORDS = 700_000      # words whose ids a Python worker remembers, about
CACHED_CHARS = 64           # longer words are encoded each time
HEAD = "<4sIIIQII"           # magic, part, place in the part, documents, ids, words, exceptions
MAGIC = b"TIDS"
READ_IDS = 1 << 20          # ids that the reader hands on at once


# --- blocks ----------------------------------------------------------------

def packed(ids: np.ndarray, share: float = SHARE) -> dict[str, np.ndarray]:
    """The blocks of a sequence of ids (u4) and their index; made a slab at a time."""
    slabs = [_packed(ids[at:at + SLAB], share) for at in range(0, max(1, len(ids)), SLAB)]
    out = {k: np.concatenate([s[k] for s in slabs]) for k in ("least", "width", "words", "high", "where")}
    for k in ("word_start", "high_start"):
        ends = np.cumsum([s[k][-1] for s in slabs])
        out[k] = np.concatenate([slabs[0][k], *(s[k][1:] + end for s, end in zip(slabs[1:], ends))])
    return out


def _packed(ids: np.ndarray, share: float) -> dict[str, np.ndarray]:
    n = -(-len(ids) // BLOCK)
    grid = np.empty(n * BLOCK, "u4")
    grid[:len(ids)] = ids
    grid[len(ids):] = ids[-1] if len(ids) else 0
    grid = grid.reshape(n, BLOCK)
    least = grid.min(axis=1) if n else np.zeros(0, "u4")
    over = grid - least[:, None]
    place = min(BLOCK - 1, max(0, int(np.ceil(share * BLOCK)) - 1))
    covered = np.sort(over, axis=1)[:, place] if n else np.zeros(0, "u4")
    width = np.frexp(covered.astype("f8"))[1].astype("u1")              # the bits of that difference
    word_start = np.concatenate([[0], np.cumsum(width.astype("i8") * (BLOCK // LANES))])
    words = np.zeros(word_start[-1], "<u4")
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        low = over[rows] & np.uint32((1 << int(w)) - 1)
        lanes = np.ascontiguousarray(low.reshape(-1, LANES).T)          # lane x (block, group)
        out = np.zeros((int(w), lanes.shape[1]), "u4")
        for lane in range(LANES):
            word, shift = divmod(lane * int(w), 32)
            out[word] |= lanes[lane] << np.uint32(shift)
            if shift + w > 32:
                out[word + 1] |= lanes[lane] >> np.uint32(32 - shift)
        at = word_start[rows, None] + np.arange(int(w) * (BLOCK // LANES))
        words[at] = np.ascontiguousarray(out.T).reshape(len(rows), -1)
    beyond = over > ((1 << width.astype("u8")) - 1).astype("u4")[:, None]
    row, col = np.nonzero(beyond)
    return {"least": least, "width": width, "word_start": word_start, "words": words,
            "high": over[row, col] >> width[row].astype("u4"), "where": col.astype("u1"),
            "high_start": np.concatenate([[0], np.cumsum(beyond.sum(axis=1))])}


def unpacked(blocks: dict[str, np.ndarray], first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of the blocks ``first`` .. ``last`` - 1 (all by default)."""
    last = len(blocks["least"]) if last is None else last
    width, start = blocks["width"][first:last], blocks["word_start"]
    over = np.zeros((last - first, BLOCK), "u4")
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        at = start[first + rows, None].astype("i8") + np.arange(int(w) * (BLOCK // LANES))
        words = np.ascontiguousarray(blocks["words"][at].reshape(-1, int(w)).T)
        lanes, mask = np.empty((LANES, words.shape[1]), "u4"), np.uint32((1 << int(w)) - 1)
        for lane in range(LANES):
            word, shift = divmod(lane * int(w), 32)
            lanes[lane] = words[word] >> np.uint32(shift)
            if shift + w > 32:
                lanes[lane] |= words[word + 1] << np.uint32(32 - shift)
            lanes[lane] &= mask
        over[rows] = lanes.T.reshape(len(rows), BLOCK)
    a, b = int(blocks["high_start"][first]), int(blocks["high_start"][last])
    row = np.repeat(np.arange(last - first), np.diff(blocks["high_start"][first:last + 1].astype("i8")))
    over[row, blocks["where"][a:b]] |= blocks["high"][a:b] << width[row].astype("u4")
    return (over + blocks["least"][first:last, None]).ravel()


# --- files -----------------------------------------------------------------

def file_bytes(part: int, place: int, doc_ids: list, lengths: list[int], ids: np.ndarray, share: float = SHARE) -> bytes:
    b = packed(ids, share)
    head = struct.pack(HEAD, MAGIC, part, place, len(lengths), len(ids), len(b["words"]), len(b["high"]))
    return b"".join([
        head, np.array(lengths, "<u4").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(), b["least"].astype("<u4").tobytes(), b["width"].tobytes(),
        b["word_start"].astype("<u4").tobytes(), b["high_start"].astype("<u4").tobytes(), b["words"].tobytes(),
        b["high"].astype("<u4").tobytes(), b["where"].tobytes()])


class TokenFile:
    """Reads a file's documents, blocks and single ranges of ids."""

    def __init__(self, data: bytes):
        magic, self.part, self.place, docs, self.n_ids, words, high = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = struct.calcsize(HEAD)

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out
        n = -(-self.n_ids // BLOCK)
        self.lengths, self.doc_ids, self.null_ids = column("<u4", docs), column("<i8", docs), column("u1", docs)
        self.blocks = {"least": column("<u4", n), "width": column("u1", n), "word_start": column("<u4", n + 1),
                       "high_start": column("<u4", n + 1), "words": column("<u4", words),
                       "high": column("<u4", high), "where": column("u1", high)}

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """ids start .. end - 1 of the file; only the blocks that hold them are unpacked."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if end <= start:
            return np.zeros(0, "u4")
        first = start // BLOCK
        return unpacked(self.blocks, first, -(-end // BLOCK))[start - first * BLOCK:end - first * BLOCK]


def write_ids(docs: DataFrame, path: str, encode: Callable[[Iterable[str]], Iterable[np.ndarray]],
              file_ids: int = FILE_IDS, share: float = SHARE) -> None:
    """Write the ids of docs(doc_id long, text) below ``path``, in ascending doc_id order.

    ``encode`` gives a text's ids (u4), end mark included.  Null text: empty.  Null
    doc_ids come first; rows of one doc_id come in the order of their texts' hashes, and
    in any order if these are equal too.  Files follow each other by (part, place).  An
    empty table gives no token file.  Other columns are left out.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the last key deals the rows of a frequent doc_id to several parts
    own = own.withColumn("hash", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    keys = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("n")]

    def run(batches):
        part, place, doc_ids, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def full():
            data = file_bytes(part, place, doc_ids, [len(x) for x in ids], np.concatenate(ids), share)
            return pa.record_batch({"value": pa.array([data], pa.binary())})
        for batch in batches:
            for doc_id, own_ids in zip(values(batch.column("doc_id")), encode(values(batch.column("text")))):
                doc_ids.append(doc_id)
                ids.append(own_ids)
                held += len(own_ids)
                if held >= file_ids:
                    yield full()
                    place, doc_ids, ids, held = place + 1, [], [], 0
        if ids:
            yield full()

    (own.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
     .mapInArrow(releasing(run), "value binary").select(F.col("value").cast("string"))     # the same bytes
     .write.option("maxRecordsPerFile", 1).text(path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """part, place, first (ids before it in its file), doc_id, n_tokens and ids (binary,
    little-endian u4) of every document in the files below ``path``."""
    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                file = TokenFile(data.as_py())
                ends = np.cumsum(file.lengths, dtype="i8")
                starts = ends - file.lengths
                cuts = np.searchsorted(starts, np.arange(0, file.n_ids, READ_IDS))
                for a, b in zip(cuts, [*cuts[1:], len(ends)]):
                    if a == b:
                        continue
                    raw = file.ids(int(starts[a]), int(ends[b - 1])).astype("<u4", copy=False).tobytes()
                    at = (4 * (starts[a:b] - starts[a])).tolist()
                    size = (4 * file.lengths[a:b].astype("i8")).tolist()
                    doc_ids = pa.array(file.doc_ids[a:b], pa.int64(), mask=file.null_ids[a:b].astype(bool))
                    rows = b - a
                    yield pa.record_batch({
                        "part": pa.array(np.full(rows, file.part), pa.int32()), "place": pa.array(np.full(rows, file.place), pa.int32()),
                        "first": pa.array(starts[a:b], pa.int64()), "doc_id": doc_ids,
                        "n_tokens": pa.array(file.lengths[a:b].astype("i8")),
                        "ids": pa.array([raw[x:x + y] for x, y in zip(at, size)], pa.binary())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    return files.select("content").mapInArrow(
        releasing(run), "part int, place int, first long, doc_id long, n_tokens long, ids binary")


def with_start(rows: DataFrame) -> DataFrame:
    """Replace part, place and first by ``start``: the ids of all documents before.

    Totals are summed over one row per file; ``rows`` should be stored, as it is read twice.
    """
    ahead = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut_lineage(rows.groupBy("part", "place").agg(F.sum("n_tokens").alias("file_ids")).select(
        "part", "place", F.coalesce(F.sum("file_ids").over(ahead), F.lit(0)).alias("before")), "totals")
    return (rows.join(totals, ["part", "place"]).withColumn("start", F.col("before") + F.col("first"))
            .drop("part", "place", "first", "before"))


# --- ids of texts ----------------------------------------------------------

def word_encoder(path: str):
    """A function from a list of texts to their ids as bytes, for a byte-level tokenizer.

    Such a tokenizer cuts a text before each blank that follows another character, so
    where blanks are single, a text's ids are those of its words in turn, each with the
    blank before it.  Each word is encoded once as long as it is remembered, and all new
    ones in one call: a token that starts with a blank starts a word.  Texts with tabs
    or several blanks in a row are encoded as they are.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers
    tokenizer, known = Tokenizer.from_file(path), {}
    if tokenizer.normalizer is not None or not isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) \
            or tokenizer.pre_tokenizer.add_prefix_space:
        raise ValueError("the words of a text are found by the rules of a byte-level tokenizer without prefix")
    vocabulary = tokenizer.get_vocab()
    starts = np.zeros(max(vocabulary.values()) + 1, bool)
    starts[[i for token, i in vocabulary.items() if token[:1] in ("Ġ", "Ċ")]] = True  # space, line feed

    def plainly(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(words: list[str]) -> dict[str, bytes | None]:
        """The ids of words that aren't known; null for what doesn't stand between
        single blanks."""
        found: dict[str, bytes | None] = {}
        bare = [w.removeprefix("\n") for w in words]
        if " ".join(bare).split() != bare:
            found = {w: None for w, b in zip(words, bare) if b.split() != [b]}
            words = [w for w in words if w not in found]
        spelled = [w if w[0] == "\n" else " " + w for w in words]
        ids = np.array(tokenizer.encode_batch_fast(["".join(spelled)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(starts[ids])
        if len(at) == len(words):
            data, cuts = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            found.update((w, data[a:b]) for w, a, b in zip(words, cuts, cuts[1:]))
        else:
            found.update(zip(words, plainly(spelled)))
        return found

    def encode(texts: list[str]) -> list[bytes]:
        gc.disable()                            # many small objects, none in a cycle
        try:
            return _encode(texts)
        finally:
            gc.enable()

    def _encode(texts: list[str]) -> list[bytes]:
        if len(known) > CACHED_WORDS:
            known.clear()
        parts = [t.replace("\n", " \n").split(" ") for t in texts]
        first = [p.pop(0) for p in parts]
        found = [list(map(known.get, words)) for words in parts]
        missing = set()
        for words, ids in zip(parts, found):
            missing.update([w for w, x in zip(words, ids) if x is None])
        here, out = ids_of(list(missing)), []
        for text, head, raw, words, ids in zip(texts, first, plainly(first), parts, found):
            ids = [here[w] if x is None else x for w, x in zip(words, ids)]
            plain = None in ids or words and head and head.split() != [head]
            out.append(plainly([text])[0] if plain else raw + b"".join(ids))
        known.update((w, ids) for w, ids in here.items() if ids is not None and len(w) <= CACHED_CHARS)
        return out

    return encode


def text_ids(path: str, end_id: int = END_ID, chars: int = 1 << 21):
    """For write_ids: the ids of texts by the tokenizer file ``path``, and ``end_id``."""
    def encode(texts: Iterable[str]):
        ids_of, end, part, size = remembered(("ids", path), lambda: word_encoder(path)), struct.pack("<I", end_id), [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= chars:
                yield from (np.frombuffer(x + end, "<u4") for x in ids_of(part))
                part, size = [], 0
        if part:
            yield from (np.frombuffer(x + end, "<u4") for x in ids_of(part))
    return encode


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op12_tokenfile")
def op12_tokenfile(spark, folder) -> DataFrame:
    """All documents tokenized, written to token files, and read back."""
    path = staging_path(spark, "tokens")
    write_ids(table(spark, folder, "documents"), path, text_ids(default_tokenizer()))
    rows = cut_lineage(read_ids(spark, path).select(
        "part", "place", "first", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32")), "read")
    return with_start(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
