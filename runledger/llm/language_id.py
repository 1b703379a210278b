"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of a trigram binds its
letters' vectors, each permuted by its place (rotated by 2, 1 and 0); a document
bundles its trigrams' vectors, a language bundles its documents' unit vectors,
and a document gets the language of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import prepare, slices

DIMENSIONS = 512
SYMBOLS = 1021
SEED = 20240229
#: Unit vectors are bundled as integers of this scale, so that sums don't depend on their order.
SCALE = 1 << 20
KEYS_AT_ONCE, MOST_CELLS = 8192, 1 << 21
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        letters = np.random.default_rng(SEED).integers(0, 2, (SYMBOLS + 1, DIMENSIONS), np.int8) * np.int8(2) - np.int8(1)
        _TABLES.update(third=letters, second=np.roll(letters, 1, axis=1), first=np.roll(letters, 2, axis=1), symbol=np.fromiter(((1 + i % SYMBOLS) if chr(i).isalpha() else 0 for i in range(0x110000)), np.int16, 0x110000))
    return _TABLES


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of all texts in a row as symbol numbers, the text of each, and which texts have a letter.

    A run of anything but letters is one gap; gaps also stand before and after a text.
    """
    lowered = [x.lower() for x in texts]
    points = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(-1, len(texts)), [1, *(len(x) + 1 for x in lowered)])
    symbols = _tables()["symbol"][points]
    kept = np.flatnonzero(np.concatenate(([True], (symbols[1:] != 0) | (symbols[:-1] != 0))))
    symbols, owner = symbols[kept].astype(np.int64), owner[kept]
    has = np.bincount(owner[symbols != 0], minlength=len(texts)) > 0
    a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
    own = np.where(b != 0, owner[1:-1], owner[2:])
    inside = (b != 0) | (owner[:-2] == owner[2:])
    return ((a << 20) | (b << 10) | c)[inside], own[inside], has


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and each key's number among them; by a table where the alphabet is small."""
    parts = [keys >> 20, (keys >> 10) & 1023, keys & 1023]
    alphabet = np.flatnonzero(np.bincount(np.concatenate(parts), minlength=1))
    if len(alphabet) > 128:
        return np.unique(keys, return_inverse=True)
    place = np.zeros(1024, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    code = (place[parts[0]] * len(alphabet) + place[parts[1]]) * len(alphabet) + place[parts[2]]
    met = np.flatnonzero(np.bincount(code, minlength=1))
    number = np.zeros(int(met[-1]) + 1 if len(met) else 1, np.int64)
    number[met] = np.arange(len(met))
    n = len(alphabet)
    return (alphabet[met // (n * n)] << 20) | (alphabet[met // n % n] << 10) | alphabet[met % n], number[code]


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, and which of them have a letter."""
    t = _tables()
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    grams, owner, has = _grams(texts)
    if not len(grams):
        return out, has
    keys, number = _numbered(grams)
    for at in range(0, len(keys), KEYS_AT_ONCE):
        own = keys[at : at + KEYS_AT_ONCE]
        bound = (t["first"][own >> 20] * t["second"][(own >> 10) & 1023] * t["third"][own & 1023]).astype(np.float32)
        now = (number >= at) & (number < at + len(own)) if len(keys) > len(own) else slice(None)
        docs, cols = owner[now], number[now] - at
        step = max(1, MOST_CELLS // len(own))
        for first in range(0, len(texts), step):
            lo, hi = np.searchsorted(docs, (first, first + step))
            size = min(step, len(texts) - first)
            # whole numbers below 2 ** 24: the sums are exact in any order
            counts = np.bincount((docs[lo:hi] - first) * len(own) + cols[lo:hi], minlength=size * len(own)).reshape(size, len(own))
            out[first : first + size] += counts.astype(np.float32) @ bound
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), has


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    for first, rows, _, _ in slices(batch.column(column), lower=False):
        yield first, [x.decode() for x in rows]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for first, texts in _texts(batch, 1):
            units = np.rint(bundles(texts)[0] * SCALE).astype(np.int64)
            own = langs[first : first + len(texts)]
            for lang in set(own):
                total[lang] = total.get(lang, 0) + units[own == lang].sum(axis=0)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "vec"])


def language_prototypes(labelled: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Bundles all labelled texts by language: the languages in order and their unit vectors.

    Rows with a null language or text take no part. What reaches the driver is
    one vector a language.
    """
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    summed = rows.mapInArrow(_sums, "lang string, vec array<long>").select("lang", F.posexplode("vec").alias("dim", "v")).groupBy("lang", "dim").agg(F.sum("v").alias("v")).toPandas()
    names = sorted(summed["lang"].unique())
    vectors = np.zeros((len(names), DIMENSIONS))
    vectors[np.searchsorted(np.array(names, object), summed["lang"].to_numpy(object)) if names else [], summed["dim"]] = summed["v"]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return names, (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)


def identify(docs: DataFrame, prototypes: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",), text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its cosine (at least 0), called ``names``, to the columns in ``keep``.

    ``und`` with score 0 where the text is null or has no letter, and for every
    text where no language was learned. Equal cosines go to the first language
    in code point order.
    """
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(prototypes)
    keep = tuple(keep)
    chosen = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    at = len(keep)
    if text in keep and dict(docs.dtypes)[text] == "string":
        chosen, at = chosen.drop("__text"), keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, vectors = model.value
        for batch in batches:
            found, scores = [], []
            for _, texts in _texts(batch, at):
                units, has = bundles(texts)
                cosines = units @ vectors.T if langs else np.zeros((len(texts), 1), np.float32)
                best = cosines.argmax(axis=1)
                found += [langs[b] if h and langs else "und" for b, h in zip(best, has, strict=True)]
                scores += [float(min(1.0, max(0.0, c))) if h and langs else 0.0 for c, h in zip(cosines.max(axis=1), has, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in chosen.drop("__text").dtypes), f"`{names[0]}` string", f"`{names[1]}` double"])
    return chosen.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % folds == fold


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out and predicts every row: ``doc_id, held_out, lang_pred, score``."""
    prototypes = language_prototypes(docs.where(~held_out()))
    return identify(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
