"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question and the
same question with other parameters have the same template. Windows of template
tokens are joined by hash; along each alignment of a document with an item, one
value of a slot in the item must always stand for one value in the document, within
each run of overlapping windows. Equal numbers of different things (2 apples, 2
hours) are different slots. Beside the templates the plain lower-cased words of every
item are matched: a run of EXACT words, or the whole item where it is shorter, or
WINDOW words where the item has no template window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runledger.llm.common import materialize, mix64, prepare, slices, words_of

WINDOW = 10
#: So many tokens of a window must be words and not placeholders.
LITERALS = 6
#: Items of fewer tokens than WINDOW are one window each: a template from so many tokens on, else plain words. Items of one or two words match only texts that are just these.
SHORTEST = 6
#: So many equal words in a row tell a copy whatever its placeholders. Shorter equal stretches count only with consistent slots around them.
EXACT = 20
#: Kinds of windows: templates, templates with names at the start of sentences, and plain words.
TEMPLATE, NAMED, PLAIN = 0, 1, 2
#: Bits of the filter that spares the join most windows. Its size is fixed; a full filter lets every window through.
FILTER_BITS = 22

# fixed values: units of measure
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hrs days day weeks week months month years year percent usd eur gbp dollars euros pounds mph kmh kph hz khz mhz ghz w kw mw v kv a ma j kj cal kcal c f k meters metres miles feet inches grams kilograms liters litres seconds minutes hours"

NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_KEPT = _DIGIT | _UPPER
_KEPT[97:123] = True
_KEPT[128:] = True
_KEPT[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(x) for x in ".!?:\n"]] = True
_UNIT_HASHES = np.sort(words_of(np.frombuffer(UNITS.encode(), np.uint8))[2])


def template_tokens(buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind: hashes of a slice's tokens, their slot values (0 for words), whether each is a slot, bounds of the texts, and the template token of each.

    A token with a digit is a number; a capitalised word that doesn't begin a
    sentence is a name; a unit's name after a number is a unit. Runs of one
    placeholder are one token. NAMED, given where it differs, also has those words
    at the start of sentences as names that are names elsewhere in the text and
    never in small letters.
    """
    kept = np.flatnonzero(_KEPT[buf])
    small = _LOWER[buf[kept]]
    starts, ends, hashes = words_of(small)
    n = len(starts)
    if not n:
        return []
    raw_start, raw_end = kept[starts], kept[ends - 1]
    bounds = np.searchsorted(raw_start, offsets)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[small])))
    number = digits[ends] > digits[starts]
    marks = np.cumsum(_MARK[buf])
    opens = np.ones(n, bool)
    opens[1:] = marks[raw_start[1:]] > marks[raw_end[:-1]]
    opens[bounds[:-1][bounds[:-1] < n]] = True
    head = buf[raw_start]
    after = buf[np.minimum(raw_start + 1, len(buf) - 1)]
    capital = (_UPPER[head] | ((head == 0xC3) & (after >= 0x80) & (after <= 0x9E))) & ~number
    name = capital & ~opens
    at = np.minimum(np.searchsorted(_UNIT_HASHES, hashes), len(_UNIT_HASHES) - 1)
    measure = _UNIT_HASHES[at] == hashes
    own = mix64(hashes + mix64(np.repeat(np.arange(1, len(offsets), dtype=np.uint64), np.diff(bounds))))
    opening = np.flatnonzero(capital & opens)
    opening = opening[np.isin(own[opening], own[name])]
    opening = opening[~np.isin(own[opening], own[~capital & ~number])]

    def template(kind: int, name: np.ndarray) -> tuple:
        unit = measure & ~name
        unit[1:] &= number[:-1]
        unit[0] = False
        tokens = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, hashes)))
        slot = number | unit | name
        first = np.ones(n, bool)
        first[1:] = ~(slot[1:] & slot[:-1] & (tokens[1:] == tokens[:-1]))
        first[bounds[:-1][bounds[:-1] < n]] = True
        runs = np.flatnonzero(first)
        values = np.add.reduceat(hashes, runs)
        slot = slot[runs]
        return kind, tokens[runs], np.where(slot, values, np.uint64(0)), slot, np.searchsorted(runs, bounds), np.arange(len(runs)), np.cumsum(first) - 1

    found = [template(TEMPLATE, name)]
    places = found[0][-1]
    if len(opening):
        more = name.copy()
        more[opening] = True
        found.append(template(NAMED, more))
    out = [x[:-1] for x in found]
    out.append((PLAIN, hashes, np.zeros(n, np.uint64), np.zeros(n, bool), bounds, places))
    return out


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    if len(tokens) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(tokens) - size + 1, np.uint64)
    for k in range(size):
        total += tokens[k : len(tokens) - size + 1 + k] * mix64(np.array([k + 1], np.uint64))[0]
    return mix64(total + np.uint64(size))


def _windows(sizes: list[int] | None, passes):
    """Windows of every text: of ``sizes``, or of an item's own size where that is smaller than WINDOW (``sizes`` None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passes.value if passes is not None else None
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, rows, buf, offsets in slices(batch.column(1), lower=False):
                found = template_tokens(buf, offsets)
                covered = np.zeros(len(rows), bool)
                begins = found[0][4] if found else None
                for kind, tokens, values, slot, bounds, places in found:
                    counts = np.diff(bounds)
                    words = np.concatenate(([0], np.cumsum(~slot)))
                    text_of = np.repeat(np.arange(len(rows)), counts)
                    things = np.zeros(len(tokens), np.uint64)
                    things[:-1] = np.where(slot, values, tokens)[1:]
                    things[bounds[1:][counts > 0] - 1] = 0
                    # a number is the same quantity only before the same thing
                    keys = np.where(tokens == NUMBER, mix64(values + mix64(things)), values)
                    for size in sizes or range(1, WINDOW + 1):
                        if size < SHORTEST and kind != PLAIN:
                            continue
                        h = window_hashes(tokens, size)
                        if not len(h):
                            continue
                        if kind == PLAIN:
                            h = mix64(h + np.uint64(PLAIN))
                        literal = words[size : size + len(h)] - words[: len(h)]
                        ok = (text_of[: len(h)] == text_of[size - 1 : size - 1 + len(h)]) & (literal >= min(LITERALS, size - 1))
                        if sizes is None and size < WINDOW or size < 3:
                            ok &= counts[text_of[: len(h)]] == size
                        if kind != PLAIN:
                            covered[text_of[: len(h)][ok]] = True
                        if bits is not None:
                            key = h >> np.uint64(64 - FILTER_BITS)
                            ok &= (bits[key >> np.uint64(3)] >> (key & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        at = np.flatnonzero(ok)
                        if not len(at):
                            continue
                        slots, own = ([x[i : i + size][slot[i : i + size]].view(np.int64) for i in at] for x in (values, keys))
                        text = text_of[at]
                        need = np.minimum(counts[text], np.where(covered[text], EXACT, WINDOW)) if kind == PLAIN else np.zeros(len(at))
                        token = places[at] - (begins if kind == PLAIN else bounds)[text]
                        columns = [ids[first + text], np.full(len(at), kind, np.int32), (at - bounds[text]).astype(np.int32), token.astype(np.int32), need.astype(np.int32), np.full(len(at), size, np.int32), h[at].view(np.int64)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(slots, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))], names=["id", "kind", "pos", "token", "need", "size", "h", "slots", "keys"])

    return run


WINDOW_SCHEMA = "id long, kind int, pos int, token int, need int, size int, h long, slots array<long>, keys array<long>"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a document and a benchmark item whose templates share a window with consistent slots.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and
    ``text``; other columns are ignored. Returns ``doc_id, item_id, windows``
    (most windows on one alignment), ``doc_pos`` (its first token in the
    document), ``slots`` and ``changed`` (slots of other values: above 0 means
    re-parameterised; both 0 for copies that only plain words tell). Items of fewer than
    SHORTEST tokens are found word for word, those of one or two words only as whole texts. Null and empty texts and
    empty tables give no rows; repeated ids give the rows of all their texts.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null and id is not null")
    known = materialize(items.mapInArrow(_windows(None, None), WINDOW_SCHEMA), "benchmark-windows")
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())
    keys = known.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("k")).distinct().toPandas()["k"].to_numpy(np.int64)
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    np.bitwise_or.at(bits, keys >> 3, (1 << (keys & 7)).astype(np.uint8))
    passes = spark.sparkContext.broadcast(bits)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null and id is not null")
    met = texts.mapInArrow(_windows(sizes or [WINDOW], passes), WINDOW_SCHEMA)
    pairs = met.join(known.select(F.col("id").alias("item_id"), F.col("kind").alias("item_kind"), F.col("pos").alias("item_pos"), F.col("need").alias("item_need"), "size", "h", F.col("slots").alias("item_slots"), F.col("keys").alias("item_keys")), ["h", "size"]).select(F.col("id").alias("doc_id"), "item_id", "kind", "item_kind", "pos", "token", "size", F.col("item_need").alias("need"), (F.col("pos") - F.col("item_pos")).alias("shift"), F.arrays_zip("item_keys", "item_slots", "slots").alias("z"))
    pairs = materialize(pairs, "window-pairs")
    # an alignment has no more windows than the item
    order = Window.partitionBy("doc_id", "item_id", "kind", "item_kind", "shift").orderBy("pos")
    breaks = F.when(F.col("pos") - F.lag("pos").over(order) <= 1, 0).otherwise(1)
    pairs = materialize(pairs.withColumn("breaks", breaks).withColumn("run", F.sum("breaks").over(order)), "window-runs")
    along = ["doc_id", "item_id", "kind", "item_kind", "shift"]
    values = pairs.select(*along, "run", F.explode("z").alias("s")).select(*along, "run", F.col("s.item_keys").alias("k"), F.col("s.item_slots").alias("a"), F.col("s.slots").alias("b")).distinct()
    bad = values.groupBy(*along, "run", "k").agg(F.countDistinct("b").alias("values")).where("values > 1").select(*along, "run").distinct()
    brief = pairs.where(F.col("kind") == PLAIN).groupBy(*along, "run").agg((F.max("pos") - F.min("pos") + F.max("size") < F.max("need")).alias("brief")).where("brief").select(*along, "run")
    bad = bad.union(brief)
    windows = pairs.join(bad, [*along, "run"], "left_anti").groupBy(*along).agg(F.count("*").alias("windows"), F.min("token").alias("doc_pos"))
    per_value = values.join(bad, [*along, "run"], "left_anti").groupBy(*along, "a").agg(F.max((F.col("a") != F.col("b")).cast("int")).alias("differs"))
    checked = per_value.groupBy(*along).agg(F.count("*").alias("slots"), F.sum("differs").alias("changed"))
    good = windows.join(checked, along, "left")
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("kind") != PLAIN).alias("template"), "windows", (-F.col("doc_pos")).alias("p"), F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("changed", F.lit(0)).alias("changed"))).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.windows").alias("windows"), (-F.col("x.p")).alias("doc_pos"), F.col("x.slots").alias("slots"), F.col("x.changed").alias("changed"))
