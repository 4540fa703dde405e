"""Language ID with string kernels.

Texts are compared by the character n-grams (one to three signs, blended) that occur in
them, whatever their number: k(x, y) = |grams of both| / sqrt(|grams of x| |grams of y|),
over hashed n-gram slots.  A Nyström map on a few landmark texts turns the kernel into
features, and one-versus-rest kernel ridge regression weighs them.  The kernel is an
inner product of presence vectors, so landmarks, map and weights multiply into a single
matrix, and scoring is one matrix product per batch of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemspark.llm.registry import query, table
from itemspark.llm.tasks import releasing, values
from itemspark.session import cut_lineage

SLOTS = 1 << 14
TRAIN_ROWS = 3000           # labelled texts that the fit uses, about, over all languages
LANDMARKS = 200
RIDGE = 0.01
BATCH = 256                 # texts of one matrix product
NONE = "und"
HASH_BITS = 62              # of the hash that chooses training rows


def gram_slots(text: str) -> np.ndarray:
    """Slots of a text's n-grams of one to three code points, repeats included."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    grams = np.concatenate([points, points[:-1] << 21 | points[1:],
                            points[:-2] << 42 | points[1:-1] << 21 | points[2:]])
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)


def presence(texts: list[str]) -> np.ndarray:
    """Rows of unit length: the slots of each text, over the root of their number."""
    out = np.zeros((len(texts), SLOTS), "f4")
    for row, text in zip(out, texts):
        row[gram_slots(text)] = 1
    return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))


def fit(bits: np.ndarray, labels: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, slots x languages weights) from packed presence rows and labels."""
    languages = sorted(set(labels))
    x = np.unpackbits(bits, axis=1, count=SLOTS).astype("f4")
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    place = np.array([languages.index(v) for v in labels])
    order = np.argsort(np.array([np.sum(place[:i] == p) for i, p in enumerate(place)]), kind="stable")
    marks = x[order[:LANDMARKS]]                                 # languages take turns
    values, vectors = np.linalg.eigh((marks @ marks.T).astype("f8"))
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])              # Nyström map
    features = (x @ marks.T).astype("f8") @ root
    target = np.where(place[:, None] == np.arange(len(languages)), 1.0, -1.0)
    gram = features.T @ features + RIDGE * len(x) * np.eye(features.shape[1])
    weights = np.linalg.solve(gram, features.T @ target)
    return languages, (marks.T.astype("f8") @ (root @ weights)).astype("f4")


def below(count, labels: int, rows: int = TRAIN_ROWS):
    """The hash below which a row of a label with ``count`` rows is chosen."""
    share = F.least(F.lit(1.0), F.lit(rows / max(labels, 1)) / count)
    return F.floor(share * F.lit(float(1 << HASH_BITS))).cast("long")


def training_rows(docs: DataFrame, label: str = "lang", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, list[str]]:
    """Packed presence and labels of about ``rows`` rows with text and label, as many of
    each label as there are, chosen by a hash of id and text.

    Rows equal in id, text and label count once among the chosen.  If chance gives more
    than twice ``rows``, those with the smallest hashes stay.
    """
    own = docs.where(F.col(label).isNotNull() & F.col("text").rlike(r"\p{L}"))
    own = own.select(F.col(label).alias("label"), "text", F.xxhash64("doc_id", "text").bitwiseAND((1 << HASH_BITS) - 1).alias("hash"))
    counts = cut_lineage(own.groupBy("label").count(), "labels")
    limits = counts.select("label", below(F.col("count"), counts.count(), rows).alias("limit"))
    chosen = own.join(limits, "label").where("hash < limit").dropDuplicates(["label", "hash"])

    def run(batches):
        for batch in batches:
            bits = [np.packbits(presence([t])[0] > 0).tobytes() for t in values(batch.column("text"))]
            yield pa.record_batch({"label": batch.column("label"), "hash": batch.column("hash"), "bits": pa.array(bits, pa.binary())})

    found = sorted((r["label"], bytes(r["bits"])) for r in
                   chosen.select("label", "hash", "text").mapInArrow(releasing(run), "label string, hash long, bits binary")
                   .orderBy("hash", "label").limit(2 * rows).collect())
    return np.frombuffer(b"".join(b for _, b in found), "u1").reshape(-1, SLOTS // 8), [v for v, _ in found]


def predict(docs: DataFrame, languages: list[str], weights: np.ndarray) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) from the whole ``text`` alone.

    Text that is null or has no letter: ``und`` with score 0; so is all text when no
    language was learned.  Columns of those names are replaced; others stay.
    """
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    model = docs.sparkSession.sparkContext.broadcast((languages, weights))   # slots x languages numbers

    def run(batches):
        names, matrix = model.value
        for batch in batches:
            told, score = [NONE] * batch.num_rows, np.zeros(batch.num_rows)
            for a in range(0, batch.num_rows, BATCH):
                texts = batch.column(at).slice(a, BATCH).to_pylist()
                rows = [i for i, t in enumerate(texts) if t and names and any(map(str.isalpha, t))]
                if rows:
                    fit_of = presence([texts[i] for i in rows]) @ matrix
                    score[[a + i for i in rows]] = np.clip((1 + fit_of.max(axis=1)) / 2, 0, 1)
                    for i, b in zip(rows, fit_of.argmax(axis=1).tolist()):
                        told[a + i] = names[b]
            yield pa.record_batch([*batch.columns, pa.array(told, pa.string()), pa.array(score, pa.float64())],
                                  names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(releasing(run), schema)


def held_out():
    """Whether a document is kept from the fit; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """A model from the documents that aren't held out."""
    bits, labels = training_rows(docs.where(~held_out()))
    return fit(bits, labels) if labels else ([], np.zeros((SLOTS, 0), "f4"))


@query("op9_language")
def op9_language(spark, folder) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, *learned(docs)).select("doc_id", "held_out", "lang_pred", "score")
