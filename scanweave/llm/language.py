"""Language identification by hyperdimensional profiles (operator 9).

Each letter has a random vector of +1 and -1. An n-gram vector binds (multiplies) its letters' vectors, each permuted
(rolled) by its place; a text's vector bundles (adds) its n-gram vectors, each by the square root of its count, so that a
line repeated many times does not outweigh the rest; a language's prototype bundles the unit vectors of its texts. A text
has the language whose prototype has the largest cosine with its vector.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from scanweave.llm import _text
from scanweave.llm._scratch import keep, small_batches

N = 3
#: Powers of two of the distinct trigrams of a text.
CLASSES = 20


@cache
def _folds() -> np.ndarray:
    """Per code point its lower-case letter, or 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.int32)
    for i in range(sys.maxunicode + 1):
        if unicodedata.category(c := chr(i))[0] == "L":
            low = c.lower()
            out[i] = ord(low[0])
    return out


def _letter_vectors(letters: np.ndarray, dims: int) -> np.ndarray:
    """+1 and -1, drawn from the code point alone, so that all workers agree."""
    words = np.arange(dims // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        bits = _text.mix(_text.mix(letters.astype(np.uint64) + np.uint64(0x1234567))[:, None] + words * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def vectors(texts: _text.Texts, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The (rows, dims) bundle of each row's letter trigrams, and which rows have a letter. A word is framed by blanks."""
    out, n_grams = _bundles(texts, dims)
    return out, n_grams > 0


def _bundles(texts: _text.Texts, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundles of vectors(), and how many distinct trigrams each row has; a row with a letter has one at least."""
    points = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    offsets = leads[texts.offsets]
    letters = _folds()[points]
    # each row gets blanks before and after, and a run of other characters becomes one blank
    letters = np.insert(letters, offsets, 0)
    rows = np.searchsorted(offsets + np.arange(texts.n + 1), np.arange(len(letters)), "right") - 1
    keep = letters != 0
    keep[1:] |= letters[:-1] != 0
    keep[0] = True
    keep[(offsets + np.arange(texts.n + 1))] = True
    letters, rows = letters[keep], rows[keep]
    alphabet, symbols = np.unique(letters, return_inverse=True)  # the blank is symbol 0
    a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
    inside = (b != 0) & (rows[:-2] == rows[1:-1])
    size = len(alphabet)
    grams = (a[inside].astype(np.int64) * size + b[inside]) * size + c[inside]
    unique, inverse = np.unique(grams, return_inverse=True)
    keys, counts = np.unique(rows[:-2][inside].astype(np.int64) * max(1, len(unique)) + inverse, return_counts=True)
    gram_rows, gram_at = keys // max(1, len(unique)), keys % max(1, len(unique))
    base = _letter_vectors(alphabet, dims)
    out = np.zeros((texts.n, dims), np.float32)
    edges = np.searchsorted(gram_rows, np.arange(texts.n + 1))
    step = 4096
    for start in range(0, len(unique), step):  # n-gram vectors in blocks of bounded size
        u = unique[start : start + step]
        bound = np.roll(base, 2, axis=1)[u // (size * size)] * np.roll(base, 1, axis=1)[u // size % size] * base[u % size]
        bound = bound.astype(np.float32)
        for i in np.flatnonzero(np.diff(edges)):
            at = gram_at[edges[i] : edges[i + 1]]
            own = np.sqrt(counts[edges[i] : edges[i + 1]])
            if len(unique) > step:
                mine = (at >= start) & (at < start + step)
                at, own = at[mine], own[mine]
            out[i] += own.astype(np.float32) @ bound[at - start]
    return out, np.diff(edges)


@dataclass(frozen=True)
class Profiles:
    """Languages in ascending order and their unit prototypes, one row each."""

    languages: tuple[str, ...]
    prototypes: np.ndarray

    @property
    def dims(self) -> int:
        return self.prototypes.shape[1]


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _bundle(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object)
            for part in _text.chunks(_text.column(batch, "text")):
                units = _units(vectors(part, dims)[0])
                own = langs[part.first : part.first + part.n]
                for lang in set(own):
                    sums[lang] = sums.get(lang, 0) + units[own == lang].sum(axis=0, dtype=np.float64)
        if sums:
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([*sums], dims)), pa.array(np.tile(np.arange(dims, dtype=np.int32), n)), pa.array(np.concatenate([*sums.values()]))], names=["lang", "dim", "value"])

    return run


def fit(labelled: DataFrame, dims: int = 1024, per_language: int = 3000) -> Profiles:
    """Prototypes from labelled (doc_id, text, lang), null langs left out.

    About per_language documents of each language are used, chosen by a hash of doc_id; that bounds the work of fitting,
    while languages are counted over all rows. languages x dims numbers reach the driver.
    """
    return _learned(_sample(labelled, per_language), dims)


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """About per_language rows (doc_id, text, lang) of each language."""
    able = small_batches(labelled).where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in able.groupBy("lang").count().collect()}
    if not counts:
        return able
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    return able.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000) * share[F.col("lang")])


def _learned(sample: DataFrame, dims: int) -> Profiles:
    rows = sample.select("text", "lang").mapInArrow(_bundle(dims), "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect()
    found = {lang: np.zeros(dims) for lang in {r["lang"] for r in rows}}
    for r in rows:
        found[r["lang"]][r["dim"]] = r["value"]
    languages = tuple(sorted(x for x in found if np.abs(found[x]).max() > 0))
    return Profiles(languages, _units(np.array([found[x] for x in languages]).reshape(len(languages), dims)).astype(np.float32))


def predicted(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs with the struct language_found (lang, score, n_grams), which replaces a column of that name.

    lang is `und` and score 0 for a null text or one without a letter; among equal cosines the smallest language wins.
    score is the cosine, 0 if negative; n_grams counts the distinct letter trigrams.
    """
    docs = small_batches(docs).drop("language_found")
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast((profiles.languages, profiles.prototypes))  # languages x dims numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prototypes = held.value
        names = np.array([*languages, "und"], object)
        for batch in batches:
            for part in _text.chunks(_text.column(batch, "text")):
                found, n_grams = _bundles(part, prototypes.shape[1])
                has = n_grams > 0
                if len(languages):
                    cosines = _units(found) @ prototypes.T
                    best, score = cosines.argmax(axis=1), np.clip(cosines.max(axis=1).astype(np.float64), 0, 1)
                else:
                    best, score = np.zeros(part.n, int), np.zeros(part.n)
                best = np.where(has, best, len(languages))
                made = pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(n_grams.astype(np.int64))], names=["lang", "score", "n_grams"])
                yield pa.RecordBatch.from_arrays([*batch.slice(part.first, part.n).columns, made], names=[*batch.schema.names, "language_found"])

    found = StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("n_grams", LongType())])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("language_found", found)]))


def held_out() -> Column:
    """crc32 of doc_id as text, mod 4, is 2; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, dims: int = 1024, per_language: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of docs (doc_id, text, lang); learned from rows that are not held out.

    Null, empty and letterless texts: `und` with score 0. Equal cosines: the first language by name. A long text is read whole, part by
    part. Repeated rows get equal results; a null doc_id is a row like others. Other columns are not read. Empty table, or no
    labelled row: no language is learned, and every text with a letter gets `und`.
    """
    profiles = fit(docs.where(~held_out()), dims, per_language)
    out = predicted(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", held_out().alias("held_out"), F.col("language_found.lang").alias("lang_pred"), F.col("language_found.score").alias("score"))


def _length_class(n_grams: Column) -> Column:
    return F.least(F.floor(F.log2(n_grams)), F.lit(CLASSES - 1)).cast("int")


def _medians(scored: DataFrame) -> dict[tuple[str, int], float]:
    """The exact median of score by (lang, class). Bins of scores are counted first; only scores in the bins that hold the middle
    are sorted, so that no task holds a group's scores."""
    binned = scored.withColumn("_bin", F.floor(F.col("score") * 65536))
    group = Window.partitionBy("lang", "class")
    counts = binned.groupBy("lang", "class", "_bin").agg(F.count("*").alias("_n"))
    ends = counts.withColumns({"_to": F.sum("_n").over(group.orderBy("_bin")), "_all": F.sum("_n").over(group)}).withColumn("_from", F.col("_to") - F.col("_n"))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = ends.where((F.col("_from") <= high) & (F.col("_to") > low)).select("lang", "class", "_bin", "_from", "_all")
    near = binned.join(F.broadcast(middle), ["lang", "class", "_bin"])  # one or two rows a group
    placed = near.withColumn("_at", F.col("_from") + F.row_number().over(Window.partitionBy("lang", "class", "_bin").orderBy("score")) - 1)
    found = placed.where((F.col("_at") == low) | (F.col("_at") == high)).groupBy("lang", "class").agg(F.avg("score").alias("median")).collect()
    return {(r["lang"], r["class"]): r["median"] for r in found}


def _bars(labelled: DataFrame, profiles: Profiles, share: float, min_score: float) -> dict[str, list[float]]:
    """Per language and length class, `share` of the median score of the labelled texts there, min_score at least. A class
    without labelled texts has the bar of the next lower one that has some, as scores rise with length, or min_score."""
    scored = predicted(labelled.select("lang", "text"), profiles).where("language_found.n_grams > 0").select("lang", "language_found.score", _length_class(F.col("language_found.n_grams")).alias("class"))
    medians = _medians(keep(scored, "language-scored"))
    out = {}
    for lang in profiles.languages:
        bar, out[lang] = min_score, []
        for c in range(CLASSES):
            bar = max(min_score, share * medians[lang, c]) if (lang, c) in medians else bar
            out[lang].append(bar)
    return out


def identified_only(docs: DataFrame, min_score: float = 0.02, dims: int = 1024, per_language: int | None = None, share: float = 1 / 3) -> DataFrame:
    """The rows of docs whose text is in a learned language, with their columns. Prototypes and bars come from all labelled texts that
    are not held out, or with per_language from about so many of each language.

    A text that shares no trigram with a language still has a cosine of about 1 / sqrt(dims) with it, by chance, and the
    best of several languages has more. Real scores grow with the number of distinct trigrams. So a text must reach
    `share` of the median score that its language's labelled texts (not held out) of like length have, by powers of two
    of that number, and min_score. Texts of under about 16 trigrams are judged mildly, for their real scores come near
    the noise; where a language has no labelled text as short as a text, min_score alone counts.
    """
    learnable = docs.where(~held_out())
    if per_language is None:
        labelled = small_batches(learnable).where("lang is not null and text is not null").select("doc_id", "text", "lang")
    else:
        labelled = keep(_sample(learnable, per_language), "language-sample")
    profiles = _learned(labelled, dims)
    found, bar = predicted(docs, profiles), F.lit(min_score)
    if profiles.languages:
        bars = F.create_map(*[x for lang, row in _bars(labelled, profiles, share, min_score).items() for x in (F.lit(lang), F.array(*map(F.lit, row)))])
        bar = bars[F.col("language_found.lang")][_length_class(F.col("language_found.n_grams"))]
    return found.where((F.col("language_found.lang") != "und") & (F.col("language_found.score") >= bar)).drop("language_found")
