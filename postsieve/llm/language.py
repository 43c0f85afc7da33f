"""Language of a text by a string kernel: presence of byte n-grams, Nyström landmarks, kernel ridge regression.

The kernel of two pieces of text is the number of n-grams of length 1 to 4 that both hold, over the root of the
product of their numbers of n-grams. It is projected on landmarks, pieces of labelled texts, and one ridge regression
per language against the rest is fitted on the projections. Since the kernel is an inner product of presence vectors,
landmarks and weights fold into one matrix, and a batch of pieces is scored by one matrix product. A text is scored
in pieces of equal length, all of them, and takes their mean, weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.llm import arrays

UNDECIDED = "und"
LONGEST = 4
# n-grams are hashed to so many bits; the single bytes and most pairs stay apart.
BITS = 14
PIECE = 2048
# The bounded sample the classifier is fitted on: texts per language, and characters of each.
PER_LANGUAGE = 400
SAMPLE_CHARS = 4000
# Of more labels than this, the most frequent are learned.
MOST_LANGUAGES = 500
LANDMARKS = 256
RIDGE = 1e-2
# Sharpness of the score, fitted to nothing: it only maps margins to shares.
SHARPNESS = 5.0


def piece_bounds(offsets: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Cut points of pieces of at most ``size`` bytes, and the text each belongs to. Empty texts have none."""
    lengths = np.diff(offsets)
    counts = -(-lengths // size)
    owner = np.repeat(np.arange(len(lengths)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    # Pieces of one text are of nearly equal length.
    starts = offsets[owner] + inside * lengths[owner] // np.maximum(counts[owner], 1)
    return np.append(starts, offsets[-1]), owner


def presence(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row per piece: which hashed n-grams lie in it."""
    n = len(bounds) - 1
    out = np.zeros((n, 1 << BITS), bool)
    flat = out.reshape(-1)
    low = arrays.BLANK_SEPARATED.lower[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) << BITS, np.diff(bounds))
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(low))
    code = np.zeros(len(low), np.uint32)
    for size in range(1, LONGEST + 1):
        count = len(low) - size + 1
        if count <= 0:
            break
        code = (code[:count] << np.uint32(8)) | low[size - 1 :]
        hashed = (code + np.uint32(size * 0x51ED27)) * np.uint32(0x9E3779B1)
        hashed = ((hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
        place = row[:count] + hashed
        flat[place if size == 1 else place[left[:count] >= size]] = True
    return out


class Classifier:
    """Languages and the matrix that scores presence vectors for each of them."""

    def __init__(self, texts: list[str], labels: list[str]):
        self.languages = sorted(set(labels))
        data, offsets = arrays.utf8(pa.array(texts, pa.string()))
        bounds, owner = piece_bounds(offsets)
        y = np.array([self.languages.index(x) for x in labels], np.int64)[owner]
        if not len(owner):
            self.languages, self.matrix = [], None
            return
        rng = np.random.default_rng(7)
        share = max(1, LANDMARKS // len(self.languages))
        marks = np.sort(np.concatenate([rng.permutation(np.flatnonzero(y == k))[:share] for k in range(len(self.languages))]))
        rows = lambda ks: _rows(data, bounds, ks)
        land = rows(marks).astype(np.float32)
        land /= np.sqrt(land.sum(1, keepdims=True))
        kernel = np.concatenate([_kernel(rows(ks), land) for ks in np.array_split(np.arange(len(owner)), len(owner) // 256 + 1)])
        values, vectors = np.linalg.eigh((land @ land.T).astype(float))
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        phi = kernel @ root
        target = np.where(y[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        # Languages weigh the same, however many pieces they have.
        weight = (len(y) / np.bincount(y, minlength=len(self.languages)))[y][:, None] / len(self.languages)
        phi1 = np.hstack([phi, np.ones((len(phi), 1))])
        gram = phi1.T @ (weight * phi1) + RIDGE * np.eye(phi1.shape[1])
        solved = np.linalg.solve(gram, phi1.T @ (weight * target))
        self.matrix = (land.T @ (root @ solved[:-1])).astype(np.float32)
        self.bias = solved[-1]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language of each text and its score; ties go to the first by name."""
        n, c = len(offsets) - 1, len(self.languages)
        bounds, owner = piece_bounds(offsets)
        margin = np.zeros((n, c))
        for first in range(0, len(owner), 512):
            ks = slice(first, min(first + 512, len(owner)))
            part = bounds[first : ks.stop + 1]
            own = presence(data[part[0] : part[-1]], part - part[0]).astype(np.float32)
            f = own @ self.matrix / np.sqrt(np.maximum(own.sum(1, keepdims=True), 1)) + self.bias
            np.add.at(margin, owner[ks], f * np.diff(part)[:, None])
        margin /= np.maximum(np.diff(offsets), 1)[:, None]
        share = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
        best = margin.argmax(1)
        return best, share[np.arange(n), best] / share.sum(1)


def _rows(data: np.ndarray, bounds: np.ndarray, ks: np.ndarray) -> np.ndarray:
    parts = [data[bounds[k] : bounds[k + 1]] for k in ks]
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return presence(np.concatenate(parts) if parts else data[:0], ends)


def _kernel(own: np.ndarray, land: np.ndarray) -> np.ndarray:
    own = own.astype(np.float32)
    return own @ land.T / np.sqrt(np.maximum(own.sum(1, keepdims=True), 1))


def labelled_sample(docs: DataFrame, lang: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """At most ``per_language`` texts of each language, cut to ``SAMPLE_CHARS``, drawn by hashes of doc_id and text."""
    held = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Thinned by a hash first, to a few times what is wanted, so that what is sorted does not grow with the corpus. Only rows
    # that may be drawn are counted: a label with few texts among many rows without any keeps them all.
    sizes = held.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / (1 << 20)
    held = held.select(share.alias("share"), F.col(lang).alias("lang"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    cut = held.join(F.broadcast(sizes.orderBy(F.desc("n")).limit(MOST_LANGUAGES)), "lang")
    cut = cut.filter(F.col("share") * F.col("n") < 4 * per_language).select("lang", "text")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    rows = cut.withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= per_language)
    rows = rows.toArrow().to_pydict()
    return rows["text"], rows["lang"]


def with_language(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row; ``und`` and 0 for a text that is null or has no letter.

    Only the text counts. Empty tables stay empty; repeated rows are answered one by one. Columns of these names
    are replaced, all others kept.
    """
    kept = docs.drop("lang_pred", "score")
    place = kept.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    added = kept.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)})

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for rows, data, offsets in arrays.pieces(batch, batch.schema.names[place]):
                letters = pc.fill_null(pc.match_substring_regex(rows.column(place), r"\p{L}"), False)
                letters = letters.to_numpy(zero_copy_only=False).astype(bool)
                names, score = np.full(rows.num_rows, UNDECIDED, object), np.zeros(rows.num_rows)
                if model.languages:
                    best, share = model.predict(data, offsets)
                    names = np.where(letters, np.array(model.languages, object)[best], UNDECIDED)
                    score = np.where(letters, share, 0.0)
                columns = [*rows.columns[:-2], pa.array(names, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, rows.schema.names)

    return added.mapInArrow(label, added.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Language of every row of ``(doc_id, text, lang)``, learned from rows that are not held out.

    Rows without doc_id are not held out. Without any labelled text every row is ``und``.
    """
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    classifier = Classifier(*labelled_sample(marked.filter(~F.col("held_out"))))
    return with_language(marked.select("doc_id", "text", "held_out"), classifier).drop("text")
