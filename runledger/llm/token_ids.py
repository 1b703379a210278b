"""Token ids in patched frame-of-reference files.

Texts are tokenized in ascending ``doc_id`` order and written as segments. A
segment cuts its ids into blocks of 128; a block stores its minimum, the
differences packed at the width that its 90th percentile needs, and the larger
differences in an exception list. An index holds where each block starts, so a
reader can open any block alone. Segments are rows of a Parquet table, so that
Spark's own writers and readers place them in any store.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.llm.common import materialize, parts, prepare

BLOCK = 128
PERCENTILE = 0.9
END_ID = 2
MAGIC = 0x31524650
#: Pieces that a worker remembers; beyond that, the half that it met most often stays.
MOST_CACHED = 800_000
#: Texts are looked up in runs of so many bytes, and new pieces encoded so many at once.
LOOKUP_BYTES = 1 << 22
GROUP = 50
#: Pieces that no plainly spaced text has: the end of a text, and the place of a text that is encoded whole.
_END, _WHOLE = "\r", "\x0b"
_SPACES = "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")
#: White space other than one space or line break between two other characters, what may begin a special token, or no text at all.
NOT_PLAIN = rf"\A[ \n]|[ \n]\z|[ \n][ \n]|[{_SPACES}]|<\||\A\z"


def load_tokenizer(name: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x, pa.large_string())


class Coder:
    """Encodes whole texts with a byte-level BPE tokenizer, keeping the ids of pieces between single spaces.

    Its pre-tokenizer always cuts before a space or line break that stands alone
    between two other characters, so pieces cut there have the same ids alone as
    in the text. Texts with other white space are encoded in one piece. A piece
    begins with a tab at a text's start, with a line break after one, else a space
    comes before it.
    """

    def __init__(self, tokenizer):
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        vocabulary = tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.known = pa.array([_END, _WHOLE], pa.large_string())
        self.pool, self.starts, self.sizes, self.met = np.array([END_ID], np.uint32), np.array([0, 1]), np.array([1, 0]), np.zeros(2, np.int64)

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [x.ids for x in self.encode(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum())), sizes

    def _pieces(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that don't start a text, encoded together and cut where their bytes end."""
        if not len(new):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = pc.if_else(pc.starts_with(new, "\n"), new, pc.binary_join_element_wise(_text(""), new, _text(" ")))
        own = texts.to_pylist()
        flat, _ = self._coded(["".join(own[i : i + GROUP]) for i in range(0, len(own), GROUP)])
        reached, ends = np.cumsum(self.bytes[flat]), np.cumsum(pc.binary_length(texts).to_numpy())
        last = np.searchsorted(reached, ends)
        if len(flat) and last[-1] == len(flat) - 1 and (reached[last] == ends).all():
            return flat, np.diff(last, prepend=-1)
        return self._coded(own)

    def _keep(self, new: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, new])
        self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.pool = np.concatenate((self.pool, flat))
        self.met = np.concatenate((self.met, np.zeros(len(sizes), np.int64)))

    def _forget(self) -> None:
        often = np.sort(2 + np.argsort(-self.met[2:], kind="stable")[: MOST_CACHED // 2])
        kept = np.concatenate(([0, 1], often))
        self.known = self.known.take(pa.array(kept))
        self.pool, self.sizes = self._gather(kept), self.sizes[kept]
        self.starts, self.met = np.cumsum(self.sizes) - self.sizes, self.met[kept] // 2

    def _gather(self, at: np.ndarray) -> np.ndarray:
        sizes = self.sizes[at]
        before = np.cumsum(sizes) - sizes
        places = np.repeat(self.starts[at] - before, sizes)
        places += np.arange(len(places))
        return np.take(self.pool, places)

    def ids(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text followed by END_ID, and their number by text."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.known) > MOST_CACHED:
            self._forget()
        whole = pc.match_substring_regex(texts, NOT_PLAIN)
        marked = pc.if_else(whole, _text(_WHOLE), pc.binary_join_element_wise(_text("\t"), pc.replace_substring(texts, "\n", " \n"), _text("")))
        pieces = pc.split_pattern(pc.binary_join_element_wise(marked, _text(_END), _text(" ")), " ")
        words, bounds = pieces.flatten(), pieces.offsets.to_numpy()
        at = pc.index_in(words, value_set=self.known)
        missing = words.filter(at.is_null()).dictionary_encode()
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(missing):
            new, count = missing.dictionary, len(self.known)
            first = pc.starts_with(new, "\t")
            heads, tails = np.flatnonzero(first.to_numpy(zero_copy_only=False)), np.flatnonzero(~first.to_numpy(zero_copy_only=False))
            number = np.empty(len(new), np.int64)
            number[tails], number[heads] = count + np.arange(len(tails)), count + len(tails) + np.arange(len(heads))
            self._keep(new.take(pa.array(tails)), *self._pieces(new.take(pa.array(tails))))
            self._keep(new.take(pa.array(heads)), *self._coded([x[1:] for x in new.take(pa.array(heads)).to_pylist()]))
            at[at < 0] = number[missing.indices.to_numpy()]
        self.met += np.bincount(at, minlength=len(self.met))
        sizes, starts, pool = self.sizes, self.starts, self.pool
        odd = np.flatnonzero(at == 1)
        if len(odd):
            # texts encoded whole aren't kept
            flat, own = self._coded(texts.filter(whole).to_pylist())
            at[odd] = len(sizes) + np.arange(len(odd))
            self.starts, self.sizes, self.pool = np.concatenate((starts, len(pool) + np.cumsum(own) - own)), np.concatenate((sizes, own)), np.concatenate((pool, flat))
        ends = np.concatenate(([0], np.cumsum(self.sizes[at])))[bounds - bounds[0]]
        found = self._gather(at)
        self.sizes, self.starts, self.pool = sizes, starts, pool
        return found, np.diff(ends)


_CODERS: dict[str, Coder] = {}


def _coder(name: str, load: Callable) -> Coder:
    """This worker's coder: a task finds the pieces that earlier tasks of the worker have met."""
    if name not in _CODERS:
        _CODERS[name] = Coder(load(name))
    return _CODERS[name]


def _release() -> None:
    """Gives back what this worker's coders hold: workers live on, and later stages need the memory."""
    if _CODERS:
        _CODERS.clear()
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)


def _widths(top: np.ndarray) -> np.ndarray:
    return np.where(top > 0, np.floor(np.log2(np.maximum(top, 1))) + 1, 1).astype(np.int64)


def pack(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as a patched frame-of-reference file image."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint64)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint64)
    delta = grid - low[:, None]
    ranked = np.partition(delta, int(PERCENTILE * (BLOCK - 1)), axis=1)[:, int(PERCENTILE * (BLOCK - 1))] if blocks else low
    width = _widths(ranked)
    over = (delta >> width[:, None].astype(np.uint64)) > 0
    starts = np.concatenate(([0], np.cumsum(width * (BLOCK // 8))))
    body = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        lanes = np.ascontiguousarray((delta[own] & np.uint64((1 << int(w)) - 1)).T)
        words = np.zeros((2 * int(w), len(own)), np.uint64)
        for k in range(BLOCK):
            at, shift = divmod(k * int(w), 64)
            words[at] |= lanes[k] << np.uint64(shift)
            if shift + w > 64:
                words[at + 1] |= lanes[k] >> np.uint64(64 - shift)
        body[starts[own][:, None] + np.arange(16 * int(w))] = np.ascontiguousarray(words.T).view(np.uint8)
    rows, cols = np.nonzero(over)
    head = np.array([MAGIC, n, blocks, len(rows)], np.uint32)
    sections = (head, low.astype(np.uint32), starts[:-1].astype(np.uint32), np.concatenate(([0], np.cumsum(over.sum(axis=1)))).astype(np.uint32), delta[rows, cols].astype(np.uint32), width.astype(np.uint8), cols.astype(np.uint8), body)
    return b"".join(np.ascontiguousarray(x).tobytes() for x in sections)


def unpack(data: bytes) -> np.ndarray:
    """The integers of an image that ``pack`` made."""
    magic, n, blocks, over = (int(x) for x in np.frombuffer(data, np.uint32, 4))
    if magic != MAGIC:
        raise ValueError("not a patched frame-of-reference image")
    at = 16

    def section(kind, count):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    low, starts, first = section(np.uint32, blocks), section(np.uint32, blocks), section(np.uint32, blocks + 1)
    large, width, cols = section(np.uint32, over), section(np.uint8, blocks), section(np.uint8, over)
    body = np.frombuffer(data, np.uint8, -1, at) if at < len(data) else np.zeros(0, np.uint8)
    delta = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        words = np.ascontiguousarray(np.ascontiguousarray(body[starts[own].astype(np.int64)[:, None] + np.arange(16 * int(w))]).view(np.uint64).T)
        lanes = np.zeros((BLOCK, len(own)), np.uint64)
        mask = np.uint64((1 << int(w)) - 1)
        for k in range(BLOCK):
            word, shift = divmod(k * int(w), 64)
            v = words[word] >> np.uint64(shift)
            if shift + w > 64:
                v = v | (words[word + 1] << np.uint64(64 - shift))
            lanes[k] = v & mask
        delta[own] = lanes.T
    delta[np.repeat(np.arange(blocks), np.diff(first.astype(np.int64))), cols] = large
    return (delta + low[:, None]).ravel()[:n]


def write_token_files(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text", load: Callable = load_tokenizer) -> DataFrame:
    """Tokenizes all texts in ascending ``doc_id`` order and writes the segments; gives the table that reads them.

    Columns: ``part, before`` (ids of the part before this segment), ``n_ids,
    doc_ids, sizes, image``. Null texts are empty: one end id. Null ids come
    first, equal ids one after another; an empty table gives no segment.
    """
    prepare(docs.sparkSession)
    n = parts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            coder = _coder(tokenizer, load)
            ids, texts = batch.column(0), batch.column(1)
            run_of = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)) // LOOKUP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(run_of)) + 1).tolist(), len(batch)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                if first == last:
                    continue
                flat, sizes = coder.ids(texts.slice(first, last - first))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([ids.slice(first, last - first).to_pylist()], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([pack(flat)], pa.binary())], names=["part", "before", "n_ids", "doc_ids", "sizes", "image"])
                before += len(flat)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(run, "part int, before long, n_ids long, doc_ids array<long>, sizes array<long>, image binary"), "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # all files are written by now
    _release()
    for batch in batches:
        for i in range(len(batch)):
            base = batch.column(0)[i].as_py()
            flat = unpack(batch.column(3)[i].as_py()).astype("<u4")
            sizes = batch.column(2)[i].values.to_numpy()
            ends = np.cumsum(sizes)
            sums = [zlib.crc32(flat[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, pa.array(base + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """One row a document, from the files alone: ``doc_id, start, n_tokens, ids_crc32``."""
    # one row a partition of the writer, a number set by configuration
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("total"))
    base = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("first"), "doc_ids", "sizes", "image")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def decode_ids(files: DataFrame) -> DataFrame:
    """The ids themselves: ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                sizes = batch.column(1)[i].values.to_numpy()
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(unpack(batch.column(2)[i].as_py()).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, ids], names=["doc_id", "ids"])

    return files.select("doc_ids", "sizes", "image").mapInArrow(run, "doc_id long, ids array<long>")
