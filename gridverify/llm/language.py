"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram binds its three letters:
the first rotated twice, the second once, multiplied. A text's vector bundles
(adds up) its trigrams, and a language's prototype those of all its training
texts. A text takes the language whose prototype has the largest cosine with it.

A training text is bundled as trigram counts, which Spark sums per language over
all rows; only these sums, one row for each language and trigram, make the
prototypes.

Edge cases: a null text and one without letters are ``und`` with score 0; training
rows with a null language or without letters teach nothing; with nothing learned
every text is ``und``; equal cosines go to the language that sorts first. Repeated
rows and extra columns are kept or ignored as they come.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridverify.llm.common import broadcast, free_names, received, small_batches, staged

#: Length of the vectors; seed of the letters'.
DIMENSIONS, SEED = 1024, 20
#: More values of the language column than this are taken for a mistake.
MAX_LANGUAGES = 5_000
#: Trigram vectors that a task keeps.
KEPT_VECTORS = 20_000
UNKNOWN = "und"
#: Names of the added columns; underscores are added to those that documents have.
COLUMNS = ["__lang", "__score", "__trigrams"]
#: A text belongs to its language if its cosine is this share of the cosine that all but LOWEST of the rightly found
#: texts of its length reach. Lengths with fewer labelled texts than FEW, and untaught ones, have the limit NOISE.
SHARE, LOWEST, FEW, NOISE = 0.2, 0.1, 50, 0.05


class Letters:
    """Trigrams of texts as numbers of three letters of 21 bits each."""

    def __init__(self):
        self.letter = np.array([chr(c).isalpha() for c in range(1 << 16)])

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams and their counts; words are lower-cased and padded with spaces."""
        codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[np.minimum(codes, 0xFFFF)]
        far = np.flatnonzero(codes > 0xFFFF)
        if len(far):
            letter[far] = [chr(c).isalpha() for c in codes[far].tolist()]
        if not letter.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = np.where(letter, codes, 32)
        codes = codes[letter | np.concatenate(([True], letter[:-1]))].astype(np.int64)
        return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)


class Vectors:
    """Vectors of trigrams, made when needed."""

    def __init__(self, dimensions: int):
        self.dimensions, self.letters = dimensions, {}
        self.rows, self.made = np.empty(0, np.int64), np.empty((0, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([SEED, code]).integers(0, 2, self.dimensions) * np.float32(2) - 1
        return self.letters[code]

    def of(self, trigrams: np.ndarray) -> np.ndarray:
        """A row for each of the sorted trigrams."""
        new = np.setdiff1d(trigrams, self.rows, assume_unique=True)
        if len(new):
            mask = (1 << 21) - 1
            made = np.empty((len(new), self.dimensions), np.float32)
            for i, t in enumerate(new.tolist()):
                a, b, c = t >> 42, t >> 21 & mask, t & mask
                made[i] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            if len(self.rows) + len(new) > KEPT_VECTORS:
                at = np.searchsorted(self.rows, old := np.setdiff1d(trigrams, new, assume_unique=True))
                self.rows, self.made = old, self.made[at]
            rows = np.concatenate((self.rows, new))
            order = np.argsort(rows)
            self.rows, self.made = rows[order], np.concatenate((self.made, made))[order]
        return self.made[np.searchsorted(self.rows, trigrams)]


def _counts(batches):
    """(lang, text) rows to sums for each language and trigram within the task."""
    letters, held, size = Letters(), {}, 0

    def rows():
        langs, grams, sums = [], [], []
        for lang, parts in held.items():
            gram, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            grams.append(gram)
            sums.append(np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64))
            langs += [lang] * len(gram)
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate(grams)), pa.array(np.concatenate(sums))],
            names=["lang", "gram", "n"],
        )

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            gram, n = letters.trigrams(text)
            if len(gram):
                held.setdefault(lang, []).append((gram, n))
                size += len(gram)
        if size > 1 << 20:
            yield rows()
            held, size = {}, 0
    if held:
        yield rows()


def _bundle(dimensions: int):
    def bundle(batches):
        vectors, sums = Vectors(dimensions), {}
        for batch in batches:
            lang, gram, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            names, place = np.unique(lang, return_inverse=True)
            grams, where = np.unique(gram, return_inverse=True)
            for start in range(0, len(grams), 4096):
                part = (where >= start) & (where < start + 4096)
                counts = np.zeros((len(names), min(4096, len(grams) - start)))
                np.add.at(counts, (place[part], where[part] - start), n[part])
                made = counts @ vectors.of(grams[start : start + 4096]).astype(np.float64)
                for name, row in zip(names.tolist(), made):
                    sums[name] = sums.get(name, 0) + row
        if sums:
            flat = pa.array([row.tolist() for row in sums.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), flat], names=["lang", "v"])

    return bundle


def prototypes(training: DataFrame, *, text_col: str, lang_col: str, dimensions: int = DIMENSIONS):
    """Sorted languages and their prototypes of length 1."""
    small_batches(training.sparkSession)
    texts = training.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = texts.where("lang IS NOT NULL").mapInArrow(_counts, "lang string, gram long, n long")
    sums = counts.groupBy("gram", "lang").agg(F.sum("n").alias("n")).select("lang", "gram", "n")
    # One partial vector of each language from each of a bounded number of tasks.
    parts = sums.coalesce(64).mapInArrow(_bundle(dimensions), "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = vectors.select("lang", F.col("v.x").alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    names = sorted(r.lang for r in found)
    by_name = {r.lang: np.array(r.v) for r in found}
    made = np.array([by_name[n] for n in names]).reshape(len(names), dimensions)
    return names, (made / np.linalg.norm(made, axis=1, keepdims=True)).astype(np.float32)


def predict(texts: list, names: list[str], prototype: np.ndarray, letters: Letters, vectors: Vectors):
    """Language, cosine, at least 0, and number of trigrams of each text."""
    found = [letters.trigrams(t) for t in texts]
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    sizes = [int(n.sum()) for _, n in found]
    some = [i for i, (g, _) in enumerate(found) if len(g)]
    if not some or not names:
        return langs, scores, sizes
    grams = np.unique(np.concatenate([found[i][0] for i in some]))
    bundled = np.zeros((len(some), vectors.dimensions), np.float32)
    for start in range(0, len(grams), 4096):
        part = grams[start : start + 4096]
        counts = np.zeros((len(some), len(part)), np.float32)
        for row, i in zip(counts, some):
            gram, n = found[i]
            a, b = np.searchsorted(gram, (part[0], part[-1] + 1))
            row[np.searchsorted(part, gram[a:b])] = n[a:b]
        bundled += counts @ vectors.of(part)
    cosine = (bundled @ prototype.T) / np.maximum(np.linalg.norm(bundled, axis=1, keepdims=True), 1e-9)
    best = cosine.argmax(axis=1)
    for k, i in enumerate(some):
        langs[i], scores[i] = names[best[k]], min(1.0, max(0.0, float(cosine[k, best[k]])))
    return langs, scores, sizes


def with_language(
    documents: DataFrame, training: DataFrame, *, text_col: str = "text", lang_col: str = "lang",
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """The documents with the columns ``__lang``, ``__score`` and ``__trigrams``, under free names."""
    added = free_names(documents.columns, COLUMNS)
    spark = documents.sparkSession
    model = broadcast(spark, prototypes(training, text_col=text_col, lang_col=lang_col, dimensions=dimensions))
    place = documents.columns.index(text_col)

    def add(batches):
        names, prototype = received(model)
        letters, vectors = Letters(), Vectors(dimensions)
        for batch in batches:
            langs, scores, sizes = predict(batch.column(place).to_pylist(), names, prototype, letters, vectors)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())],
                names=[*batch.schema.names, *added],
            )

    schema = T.StructType([*documents.schema.fields, *map(T.StructField, added, (T.StringType(), T.DoubleType(), T.LongType()))])
    return documents.mapInArrow(add, schema)


def in_a_language(documents: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """The documents whose text is in one of the languages that its own labels teach, with their own columns.

    How close a text should be depends on its number of trigrams, by powers of two: chance moves the
    cosine of a short text more. The limits are learned from the texts whose label is the language
    they were found in. Null texts and texts without letters go.
    """
    lang, score, size = free_names(documents.columns, COLUMNS)
    found = staged(with_language(documents, documents, text_col=text_col, lang_col=lang_col, dimensions=dimensions), "language")
    known = found.where(F.col(lang) != UNKNOWN)
    length = F.floor(F.log2(F.col(size))).cast("int")
    right = known.where(F.col(lang) == F.col(lang_col).cast("string")).groupBy(length.alias("length"))
    limits = right.agg(F.count("*").alias("n"), F.percentile_approx(score, LOWEST, 10_000).alias("low")).collect()
    limit = F.lit(NOISE)  # a row for each power of two
    for row in limits:
        if row.n >= FEW:
            limit = F.when(length == row.length, F.lit(max(NOISE, SHARE * row.low))).otherwise(limit)
    return known.where(F.col(score) >= limit).select(*documents.columns)
