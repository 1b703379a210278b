"""Word-use divergence between the sources of each language, in exact integers.

One pass over the texts counts terms by language and source. Terms kept (enough
documents of the language hold them) are dealt to tasks by ranges of (language,
term), so that every task holds a run of each language's sorted dictionary. A task
numbers its sorted terms, finds the number of each counted row by binary search and
adds counts into one dense vector a source with ``bincount``. Numbers keep UTF-8
order, so ties break by number. Divergences are added over the chunks, and each
chunk hands on only its best terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.llm.common import SLICE_BYTES, materialize, parts, prepare

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP = 200
#: Entries that a task counts before it hands them on, and cells of a chunk's dense matrix.
MOST_COUNTED = 300_000
CHUNK_CELLS = 1 << 18
#: Letters, lower-cased, and all bytes beyond ASCII stay; the other bytes part the terms.
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces cut between terms."""
    plain = text.translate(PLAIN)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE_BYTES) if len(plain) - at > SLICE_BYTES else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, source, text`` to ``lang, source, term, count, docs``; the null term has the rows of the group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    rows: dict[tuple[str, str], int] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in groups.items():
            if counts:
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())],
                    names=["lang", "source", "term", "count", "docs"],
                )
        groups.clear()

    for batch in batches:
        texts = batch.column(2)
        texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        for lang, source, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            key = (lang, source)
            rows[key] = rows.get(key, 0) + 1
            seen: set[bytes] = set()
            for piece in terms_of(value.as_py() or b""):
                counts, docs = groups.setdefault(key, (Counter(), Counter()))
                before = len(counts)
                counts.update(piece)
                fresh = set(piece) - seen
                docs.update(fresh)
                seen |= fresh
                held += len(counts) - before
                if held > MOST_COUNTED:
                    yield from out()
                    held = 0
    yield from out()
    if rows:
        keys = list(rows)
        none = pa.nulls(len(keys), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), none, pa.array([0] * len(keys), pa.int64()), pa.array([rows[k] for k in keys], pa.int64())], names=["lang", "source", "term", "count", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of every term by language and source; nulls are read as empty."""
    prepare(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_count, "lang string, source string, term binary, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * counts / total) for counts up to total, digit by digit, so that 64 bits hold every step (totals below 9e15)."""
    out, rest = np.zeros_like(counts), counts.copy()
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ^ 2 / q); shares are at most 1e9 + 1, so squares fit in 64 bits."""
    d = p - q
    return d * d // q


class _Chunk:
    """A run of one language's sorted terms with the counted rows that name them."""

    def __init__(self, lang: str, terms: list[bytes]):
        self.lang, self.terms = lang, np.empty(len(terms), object)
        self.terms[:] = terms

    def vectors(self, words: np.ndarray, sources: np.ndarray, counts: np.ndarray, groups: int) -> np.ndarray:
        """One dense vector a source: the rows' numbers in the dictionary by binary search, counts added by bincount."""
        ids = np.searchsorted(self.terms, words)
        n = len(self.terms)
        flat = np.bincount(sources * n + ids, minlength=groups * n)
        if (flat > 1).any():
            raise ValueError("a term of a source has two rows")
        out = np.zeros(groups * n, np.int64)
        out[sources * n + ids] = counts
        return out.reshape(groups, n)


def _measure(groups: dict[str, tuple[list[str], list[int], int]], cells: int):
    """Rows ``lang, term, source, count`` sorted by language and term to sums by pair of sources and the best terms of each source.

    ``groups`` has for each language its sources in order, their totals of kept
    terms and the number of kept terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, np.ndarray] = {}
        best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}
        places = {lang: {s: k for k, s in enumerate(sources)} for lang, (sources, _, _) in groups.items()}

        def chunk(lang: str, rows: list[tuple[bytes, str, int]]) -> None:
            sources, totals, kept = groups[lang]
            words = np.empty(len(rows), object)
            words[:] = [r[0] for r in rows]
            dictionary = sorted(set(words))
            where = np.array([places[lang][r[1]] for r in rows], np.int64)
            counts = np.array([r[2] for r in rows], np.int64)
            own = _Chunk(lang, dictionary)
            dense = own.vectors(words, where, counts, len(sources))
            p = np.stack([shares(row + 1, n + kept) for row, n in zip(dense, totals, strict=True)])
            q = shares(dense.sum(axis=0) + 1, sum(totals) + kept)
            sums = pairs.setdefault(lang, np.zeros((len(sources), len(sources)), np.int64))
            for j in range(len(sources)):
                sums[:, j] += distance(p, p[j]).sum(axis=1)
            for i, source in enumerate(sources):
                ids = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                values = distance(p[i, ids], q[ids])
                top = ids[np.lexsort((ids, -values))[:TOP]]
                if len(top):
                    have = best.get((lang, source), []) + [(-int(v), own.terms[k]) for k, v in zip(top, distance(p[i, top], q[top]), strict=True)]
                    best[lang, source] = sorted(have)[:TOP]

        lang, waiting, terms = None, [], 0
        for batch in batches:
            columns = (c.to_pylist() for c in batch.columns)
            for row_lang, term, source, count in zip(*columns, strict=True):
                if waiting and (row_lang != lang or term != waiting[-1][0]):
                    terms += 1
                    if row_lang != lang or terms * len(groups[lang][0]) >= cells:
                        chunk(lang, waiting)
                        waiting, terms = [], 0
                lang = row_lang
                waiting.append((term, source, count))
        if waiting:
            chunk(lang, waiting)
        out = [(lang, s, "pair", t.encode(), int(sums[i, j])) for lang, sums in pairs.items() for i, s in enumerate(groups[lang][0]) for j, t in enumerate(groups[lang][0]) if i != j]
        out += [(lang, s, "term", term, -v) for (lang, s), have in best.items() for v, term in have]
        if out:
            kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["lang", "source", "part", "item", "value"])

    return run


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, chunk_cells: int = CHUNK_CELLS) -> DataFrame:
    """How far word use of each source lies from every other source of its language and from the language: ``lang, source, part, item, value, rank``.

    ``docs`` has ``text, lang, source``; other columns are ignored and nulls are
    read as empty strings, which are a language or source like any other. Rows
    count as often as they are repeated. Part ``pair`` has a row for each other
    source of the language, 0 where the language keeps no term; part ``term``
    has the first 200 terms that the source uses more than the language does.
    A source that is alone in its language has no pair; an empty table has no
    row. The driver holds one row a (language, source), of which the result has
    all pairs within a language. A task holds the distinct terms of one document.
    """
    spark = docs.sparkSession
    n = parts(docs)
    counts = materialize(term_counts(docs), "term-counts")
    frequent = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("df")).where(F.col("df") >= least_documents).select("lang", "term")
    kept = materialize(counts.where("term is not null").join(frequent, ["lang", "term"]).select("lang", "term", "source", "count"), "kept-terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    vocabulary = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("v"))
    every = counts.where("term is null").select("lang", "source").distinct()
    every = materialize(every.join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "term-groups")
    groups: dict[str, tuple[list[str], list[int], int]] = {}
    for lang, source, total, v in sorted(every.collect()):
        sources, totals, _ = groups.setdefault(lang, ([], [], v))
        sources.append(source)
        totals.append(total)
    prepare(spark)
    # all rows of a term meet in one task, which has no more of them than sources
    ranged = kept.repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term")
    measured = ranged.mapInArrow(_measure(groups, chunk_cells), "lang string, source string, part string, item binary, value long")
    measured = materialize(measured, "divergences")
    other = every.select("lang", F.col("source").alias("item"))
    pairs = every.select("lang", "source").join(other, "lang").where("source <> item")
    sums = measured.where("part = 'pair'").groupBy("lang", "source", F.col("item").cast("string").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    terms = measured.where("part = 'term'").select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = terms.withColumn("rank", rank).where(F.col("rank") <= TOP).unionByName(pairs.withColumn("rank", rank))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
