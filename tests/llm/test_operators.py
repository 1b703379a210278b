"""The corpus operators against brute force, exact round trips, held-out accuracy and DuckDB."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from runledger.llm import lm_scoring
from runledger.llm import queries as Q
from runledger.llm.decontaminate import contaminated
from runledger.llm.jaccard_join import jaccard_components
from runledger.llm.language_id import identify, identify_documents, language_prototypes
from runledger.llm.license_scan import TEXTS, canonical, scan_licenses
from runledger.llm.lm_scoring import BUCKETS, GATES, Mixer, fit_spelling, score_texts, spelling
from runledger.llm.mixing import mix, mix_rows, targets
from runledger.llm.sharding import shard_by_bytes
from runledger.llm.token_ids import Coder, decode_ids, load_tokenizer, pack, read_token_files, unpack, write_token_files
from runledger.llm.topk_search import top_k
from runledger.llm.url_reputation import judge_urls

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = "tail " * 60_000


def words(text):
    return WORD.findall((text or "").encode().lower())


def odd_documents(spark, table=None):
    """Nulls, empty and very long texts, repeated rows, many copies, and columns whose names clash."""
    base = " ".join(f"w{i}" for i in range(40))
    near = base.replace("w39", "x39")
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "one two", "en", "b"), (5, "One TWO", "de", "b"), (6, base, "en", "a"), (7, near, "en", "a"), (8, LONG, None, "c"), (9, "12345 ...", "en", None)]
    rows += [(100 + i, base, "en", "a") for i in range(30)] + [(200 + i, f"{near} y{i}", "en", "a") for i in range(30)]
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, h int, size string, score string")


def empty_documents(spark):
    return odd_documents(spark).where("doc_id < 0")


def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# sharding


def brute_capacity(sizes, shards):
    def needed(capacity):
        n, used = 1, 0
        for s in sizes:
            if used + s > capacity:
                n, used = n + 1, 0
            used += s
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("which", ["small", "odd"])
def test_shards(spark, small, which):
    docs = documents(spark, small) if which == "small" else odd_documents(spark)
    rows = shard_by_bytes(docs, 8).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    groups = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["text_crc32"] == (None if texts[r["doc_id"]] is None else zlib.crc32(raw))
        groups.setdefault(texts[r["doc_id"]], []).append(r)
    assert all(len({r["shard"] for r in g}) == 1 for g in groups.values())
    key = lambda t: "" if t is None else hashlib.md5(t.encode()).hexdigest()
    sizes = [sum(r["size"] for r in groups[t]) for t in sorted(groups, key=key)]
    loads = Counter()
    slots = {}
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(loads.values()) == brute_capacity(sizes, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(loads) <= set(range(8))


# language identification


def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_odd(spark):
    docs = odd_documents(spark)
    got = {r["doc_id"]: r for r in identify(docs, language_prototypes(docs), keep=tuple(docs.columns), names=("l", "c")).collect()}
    assert len(got) == docs.count() and all(got[i]["l"] == "und" and got[i]["c"] == 0 for i in (1, 2, 3, 9))
    assert {got[4]["l"], got[8]["l"]} <= {"en", "de"}
    assert {r["l"] for r in identify(docs, ([], np.zeros((0, 512), np.float32)), names=("l", "c")).collect()} == {"und"}


# decontamination


def test_decontamination(spark):
    clean = "the quick brown fox jumps over the lazy dog while seven tired men watch from the old stone bridge near town"
    item = "In the market of Riverton a merchant named Harold sold 45 apples at 12 usd for every single basket and then Harold walked away with 45 apples left"
    again = item.replace("Harold", "Miriam").replace("45", "88")
    broken = item.replace("45 apples at", "88 apples at").replace("merchant named Harold", "merchant named Miriam")
    docs = spark.createDataFrame([(1, clean), (2, f"Intro words here. {item} And more."), (3, f"Something else first. {again} End."), (4, f"Now this. {broken} End."), (5, None), (6, ""), (7, item + " " + LONG)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item, 1), (11, None, 1), (12, "", 1), (13, "a b", 1)], "item_id long, text string, h int")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, bench).collect()}
    assert set(got) == {(2, 10), (3, 10), (7, 10)}
    assert got[2, 10]["changed"] == 0 and got[3, 10]["changed"] > 0
    assert contaminated(docs, bench.where("item_id < 0")).count() == 0 and contaminated(docs.where("doc_id < 0"), bench).count() == 0


def test_decontamination_drops_only_the_inconsistent_run(spark):
    """Equal numbers of different things may get two values; an inconsistent run leaves the other runs of its alignment."""
    question = "a farmer picks 2 apples from every tree in the orchard and then rests for 2 hours beside the river before walking home again"
    first = "in the old harbour a captain called Harold counted every rope and then Harold slept until the morning bell"
    last = "while the tired sailors carried all of the heavy barrels slowly down towards the empty store behind the church"
    passage = f"{first} and after breakfast {last}"
    edited = passage.replace("called Harold", "called Miriam").replace("after breakfast", "before supper")
    docs = spark.createDataFrame([(1, "We know that " + question.replace("2 apples", "3 apples").replace("2 hours", "5 hours")), (2, "Now then, " + edited)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, question), (11, passage)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 11)}
    assert got[1, 10]["changed"] == 1 and got[2, 11]["changed"] == 0


def test_decontamination_finds_plain_copies_and_opening_names(spark):
    """Copies of items full of placeholders, in capitals, or short and within a sentence; names that also begin sentences."""
    sums = "add 3 and 4 then 5 or 6 by 7 to 8 at 9 of 10 in 11"
    story = "the little boat drifted past seven green islands while an old keeper lit every lamp along the silent northern shore"
    short = "Which planet has the most moons"
    named = "Yesterday the baker met Harold near a mill. Harold sold bread. Harold bought two old carts"
    docs = spark.createDataFrame([(1, f"So now {sums} and stop"), (2, story.upper()), (3, story.title()), (4, f"he asked: well, {short} and left"), (5, f"Before that. {named.replace('Harold', 'Miriam')} again."), (6, " ".join(story.split()[:12]).upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(10, sums), (11, story), (12, short), (13, named)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()} == {(1, 10), (2, 11), (3, 11), (4, 12), (5, 13)}


def test_decontamination_of_short_items(spark):
    docs = spark.createDataFrame([(1, "he asked who built the old tower, then left"), (2, "Yes"), (3, "yes we can"), (4, "who built the new tower")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "Who built the old tower?"), (11, "yes")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()} == {(1, 10), (2, 11)}


def test_decontamination_finds_whole_items(spark, small):
    docs, bench = documents(spark, small), spark.read.parquet(f"{small}/benchmark.parquet")
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    held = lambda t, i: any(t[k : k + len(i)] == i for k in range(len(t) - len(i) + 1))
    whole = {(r["doc_id"], k) for r in docs.collect() for t in [words(r["text"])] for k, i in items.items() if len(i) >= 12 and held(t, i)}
    assert whole <= found


# mixing


def test_targets():
    assert targets([100, 100, 100]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert targets([100, 100, 100, 100]) == pytest.approx([200, 400 / 3, 200 / 3, 200])
    assert sum(targets([10, 1000, 5, 0, 700])) == pytest.approx(1.5 * 1715)
    assert all(t <= 2 * s for t, s in zip(targets([10, 1000, 5, 0, 700]), [10, 1000, 5, 0, 700], strict=True))
    assert targets([]) == [] and targets([0, 0]) == [0.0, 0.0]


@pytest.mark.parametrize("which", ["small", "odd"])
def test_mixing(spark, small, which):
    docs = documents(spark, small) if which == "small" else odd_documents(spark)
    rows = mix(docs).collect()
    sizes = {r["doc_id"]: len(words(r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes and len(rows) == len(sizes)
    taken, most, target = Counter(), Counter(), {}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert sorted(rows) == sorted(mix(docs).collect())
    assert mix_rows(docs).count() == sum(r["copies"] for r in rows)


def test_mixed_rows_with_repeated_and_null_ids(spark):
    rows = [(1, "a b c", "s")] * 9 + [(None, "d e", "s"), (None, "f g h", "t"), (None, "d e", "s")] + [(2, "a b c", None), (1, "x y", "t")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, size int")
    wanted = sum(r["copies"] for r in mix(docs).collect())
    got = Counter(tuple(r) for r in mix_rows(docs).collect())
    assert sum(got.values()) == wanted and max(got.values()) <= 2 and set(got) <= {tuple(r) for r in docs.collect()}


def test_mixing_is_unbiased_over_seeds(spark):
    docs = spark.createDataFrame([(i, "w " * (10 + i % 7), "abc"[i % 3]) for i in range(60)], "doc_id long, text string, source string")
    totals = Counter()
    for seed in range(6):
        totals.update({r["doc_id"]: r["copies"] for r in mix(docs, seed=seed).where("source = 'c'").collect()})
    r = mix(docs).where("source = 'c'").first()
    assert sum(totals.values()) / 6 / 20 == pytest.approx(r["target"] / r["source_size"], abs=0.08)
    assert len(set(totals.values())) > 1


# token files


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), np.where(rng.random(n) < 0.03, 4_000_000_000, rng.integers(0, 9, n)), np.full(n, 7)):
        assert (unpack(pack(ids.astype(np.uint32))) == ids).all() and len(unpack(pack(ids.astype(np.uint32)))) == n


def test_coder_equals_the_tokenizer():
    tokenizer = load_tokenizer("byte_bpe_50k.json")
    rng = random.Random(3)
    texts = ["", " ", "a  b", "x\n\ny", " lead", "trail ", "tab\tb", "don't it's 12 ab12", "a <|endoftext|> b", "é ü\u00a0z", "\u2003q", "line\nnext word\nlast"]
    texts += ["".join(rng.choice(["a", "be", " ", "\n", ".", "7", "'s", "ñ", "\t"]) for _ in range(60)) for _ in range(200)]
    flat, sizes = Coder(tokenizer).ids(texts)
    expected = [[*x.ids, 2] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in expected] and flat.tolist() == [i for x in expected for i in x]


def test_coder_encodes_new_pieces_together(monkeypatch):
    """Many new pieces take few calls' worth of texts, and ids stay right when remembered pieces are dropped."""
    from runledger.llm import token_ids

    tokenizer, rng, given = load_tokenizer("byte_bpe_50k.json"), random.Random(5), []
    coder = Coder(tokenizer)
    encode = coder.encode
    coder.encode = lambda texts, **kw: given.extend(texts) or encode(texts, **kw)
    texts = [" ".join("".join(rng.choice("abcdé.,'7ñ\U0001f600") for _ in range(rng.randrange(1, 12))) for _ in range(400)).replace(" a", "\na") for _ in range(20)]
    expected = [[*x.ids, 2] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    flat, sizes = coder.ids(texts)
    assert len(given) < 400 and sizes.tolist() == [len(x) for x in expected] and flat.tolist() == [i for x in expected for i in x]
    monkeypatch.setattr(token_ids, "MOST_CACHED", 1000)
    for x, ids in list(zip(texts, expected, strict=True)) * 2:
        assert coder.ids([x])[0].tolist() == ids and len(coder.known) < 2000
    for c in map(chr, range(0x3001)):
        x = f"one{c}two {c}"
        assert coder.ids([x])[0].tolist() == [*tokenizer.encode(x, add_special_tokens=False).ids, 2], hex(ord(c))


def test_readers_release_the_coder():
    """A worker that reads token files keeps no coder of an earlier write."""
    from runledger.llm import token_ids

    coder = token_ids._coder("none", lambda _: load_tokenizer("byte_bpe_50k.json"))
    assert coder.ids(["one two"])[0].tolist()[-1] == 2 and token_ids._CODERS
    assert list(token_ids._read(iter([]))) == [] and not token_ids._CODERS


def test_equal_letters_are_looked_up_once(monkeypatch):
    """Spellings' counts, inputs and scores are those of every byte by itself, but equal bytes after equal bytes are looked up once."""
    rng, met, slots_of = random.Random(2), [], lm_scoring.letter_slots
    words = ["".join(rng.choice(["tion", "ing", "é", "a"]) for _ in range(rng.randrange(1, 9))).encode() for _ in range(500)]
    slots, bits, word = spelling(words)
    counts = np.zeros(2 * lm_scoring.SLOTS, np.float32)
    np.add.at(counts, 2 * slots + bits, 1)
    monkeypatch.setattr(lm_scoring, "letter_slots", lambda key: met.append(len(key)) or slots_of(key))
    monkeypatch.setattr(lm_scoring, "_chunked", lambda found: iter([found]))
    learned = np.array([i % 3 for i in range(len(words))])
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(learned), pa.array(learned)], names=["word", "n_all", "n"])
    assert (next(lm_scoring._slot_counts(iter([batch]))) == counts).all()
    shared = SimpleNamespace(value=counts.reshape(-1, 2).T)
    x, gate = Mixer.inputs(*lm_scoring.left_out(shared.value, slots, bits))
    found = [np.concatenate(v, axis=-1) for v in zip(*lm_scoring._spelling_inputs([batch], shared.value), strict=True)]
    assert (found[0] == x).all() and (found[1] == gate).all() and (found[2] == bits).all()
    p = Mixer().probability(*Mixer.inputs(*lm_scoring.left_out(shared.value, slots, bits, (learned > 0)[word])))
    logs = np.bincount(word, np.log10(np.where(bits == 1, p, 1 - p)))
    assert np.allclose(next(lm_scoring._spelled(Mixer(), shared)(iter([batch]))).column(3).to_numpy(), logs, rtol=1e-9)
    assert max(met) < len(bits) / 8 / 3


@pytest.mark.parametrize("which", ["small", "odd"])
def test_token_files(spark, small, which):
    docs = documents(spark, small) if which == "small" else odd_documents(spark)
    tokenizer, at, expected = load_tokenizer("byte_bpe_50k.json"), 0, []
    for doc_id, text in sorted((r["doc_id"], r["text"]) for r in docs.collect()):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    files = write_token_files(docs)
    assert sorted(tuple(r) for r in read_token_files(files).collect()) == expected
    assert decode_ids(files).select(F.sum(F.size("ids"))).first()[0] == at


# licences


def test_licenses(spark):
    varied = "Copyright (c) 2020 Somebody Else\n\n" + TEXTS["MIT"].upper().replace("LICENSE", "LICENCE").replace(" ", "  ").replace(",", " ,")
    docs = spark.createDataFrame([(1, varied), (2, TEXTS["ISC"] + "\nmore"), (3, None), (4, ""), (5, "x\nLicensed under the Apache License, Version 2.0.\ny"), (6, TEXTS["Zlib"])], "doc_id long, text string")
    assert {r["doc_id"]: (r["license"], r["notices"]) for r in scan_licenses(docs).collect()} == {1: ("MIT", ""), 2: (None, ""), 3: (None, ""), 4: (None, ""), 5: (None, "Apache-2.0"), 6: ("Zlib", "")}


# n-gram Jaccard join


def test_licenses_with_titles_marks_and_sentences(spark):
    texts = ["MIT License\n\nCopyright (c) 2020 X\n\n" + TEXTS["MIT"], "// Copyright 2021 Y\n" + TEXTS["ISC"], "# SPDX-License-Identifier: MIT", 'Licensed under the Apache License, Version 2.0 (the "License");', "Made by us. Released under the MIT License. Have fun."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: (r["license"], r["notices"]) for r in scan_licenses(docs).collect()} == {0: ("MIT", ""), 1: ("ISC", ""), 2: (None, "MIT"), 3: (None, "Apache-2.0"), 4: (None, "MIT")}


def test_licenses_of_repeated_and_null_ids_and_neighbouring_words(spark):
    docs = spark.createDataFrame([(1, "This work is licensed under the MIT License", 5), (1, "nothing", 5), (None, "Released under the MIT License", 5), (None, None, 5), (2, "x " * 60_000 + "\nLicensed under the MIT License", 5)], "doc_id long, text string, license int")
    assert sorted((r["doc_id"] or 0, r["notices"]) for r in scan_licenses(docs).collect()) == [(0, ""), (0, "MIT"), (1, ""), (1, "MIT"), (2, "MIT")]
    assert spark.range(1).select(canonical(F.lit("Licence licence LICENCE sub licence"))).first()[0] == "license license license sublicense"


def brute_components(rows):
    sets = {}
    for doc_id, text in rows:
        w = words(text)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def planted(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4 and texts:
            own = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
            own = own[: len(own) - rng.choice([0, 0, 1, 4, 9])]
        else:
            own = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 9, 30, 80, 200]))]
            if kind < 0.7:
                own = own[:20] + shared + own[20:]
        texts.append(" ".join(own))
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_planted(spark, seed):
    rows = planted(seed)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_jaccard_around_the_bound(spark):
    """Texts that share one long passage and own a part that puts pairs on both sides of the bound."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for d in range(160):
        own = [f"o{d}x{i}" for i in range(rng.choice([2, 8, 11, 13, 15, 18, 30]))]
        cut = rng.randrange(0, 8)
        rows.append((d * 3, " ".join(own + passage[cut:] if rng.random() < 0.5 else passage[: 90 - cut] + own)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert 2 < len({c for _, c in want.values()}) < len(rows)


def test_jaccard_odd(spark):
    docs = odd_documents(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


# URL filters


def test_url_oddities(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/7x?q#f"), (5, "http://a.com/en/1"), (6, "x://com/en/"), (7, "http://a.net"), (8, "http://b.example.net/de/8"), (9, "http://c.net/de/8"), (10, "http://xcom/en/"), (11, "a://b://c/d")]
    pages = spark.createDataFrame([(*r, "t") for r in urls], "page_id long, url string, host string")
    labels = spark.createDataFrame([(7, 1), (None, 1)], "page_id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, labels).collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("example.com", "/en/7x", "example.com/en/7", "allow") and got[5][2:] == ("com/en/", "block") and got[6][2:] == ("com/en/", "block")
    assert got[8][2:] == ("example.net/de/8", "block") and got[9][2:] == ("net/de/", "allow") and got[10][2] is None and got[11][:2] == ("b:", "//c/d")
    assert judge_urls(pages, labels.where("bad > 5")).where("rule is null and verdict = 'block'").count() == 0
    assert judge_urls(pages.where("page_id < 0"), labels).count() == 0


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.site.info/p{i}") for i in range(80)] + [(900, "http://new.site.info/")], "page_id long, url string")
    labels = pages.where("page_id < 60").select("page_id", (F.col("page_id") % 2).cast("int").alias("bad"))
    got = {(r["host"], r["verdict"]) for r in judge_urls(pages, labels).collect()}
    assert got == {("bad.site.info", "block"), ("good.site.info", "allow"), ("new.site.info", "allow")}


# top-k search


def test_topk_brute(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(0, 0.3, 12).round(3) for i in range(150)}
    for i in range(40, 60):
        vectors[i] = vectors[7]
    rows = [(i, [float(x) for x in v], "t") for i, v in vectors.items()] + [(500, None, "t"), (501, [float("nan")] * 12, "t"), (502, [None] + [0.1] * 11, "t"), (503, [float("inf")] * 12, "t"), (504, [], "t"), (505, [1.0], "t")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in sorted(top_k(table, table.where("vec_id % 50 = 0"), k=5).collect()):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(256 * v).astype(int) for i, v in vectors.items()}
    for q in (0, 50, 100):
        best = sorted(((-int(whole[q] @ whole[i]), i) for i in whole if i != q))[:5]
        assert got[q] == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert set(got) == {0, 50, 100} and top_k(table.where("vec_id < 0"), table, k=5).count() == 0


# LM scoring


@pytest.mark.parametrize("which", ["small", "odd"])
def test_lm_counts_and_base(spark, small, which):
    docs = documents(spark, small) if which == "small" else odd_documents(spark)
    texts = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    counts = Counter(w for d, t in texts.items() if not out[d] for w in [*t, None])
    total, distinct = sum(counts.values()), len(counts)
    for r in score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect():
        own = [*texts[r["doc_id"]], None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(own), sum(counts[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0 and math.isfinite(r["score"])


def test_lm_prefers_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    strange = spark.createDataFrame([(-1, "qzxv kkwq zzpf vvxq jjqk " * 40)], "doc_id long, text string")
    got = score_texts(docs.union(strange), F.col("doc_id") < 50).select("doc_id", (F.col("score") / F.col("n_tokens")).alias("s")).where("doc_id < 50").collect()
    assert min(got, key=lambda r: r["s"])["doc_id"] == -1
    assert score_texts(docs, F.lit(True)).where("n_known > 0 or train_tokens > 0").count() == 0


def test_equal_tokens_are_counted_together(monkeypatch):
    """Counts and inputs of words are those of every bit by itself, but equal symbols after equal contexts are spread out once."""
    rng, met, places = random.Random(7), [], lm_scoring.Codes.places
    known = [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.choices([*known, "new", "other"], [1 / (i + 1) for i in range(92)], k=rng.randrange(60))) for _ in range(400)]
    hashes = lm_scoring.words_of(np.frombuffer(" ".join(known).encode(), np.uint8))[2]
    codes = lm_scoring.Codes(hashes, np.arange(len(known), 0, -1), len(texts), 50)
    column = pa.array([*texts, None, ""])
    (_, _, _, _, _, h, bounds) = next(lm_scoring.word_slices(column))
    symbol, function, before, text = codes.tokens(h, bounds)
    slots, bits, token = codes.spread(symbol, function, before)
    counts = np.zeros(2 * lm_scoring.WORD_SLOTS, np.float32)
    np.add.at(counts, 2 * slots + bits, 1)
    monkeypatch.setattr(lm_scoring.Codes, "places", lambda self, own: met.append(len(own)) or places(self, own))
    monkeypatch.setattr(lm_scoring, "_chunked", lambda found: iter([found]))
    found = next(lm_scoring._word_counts(SimpleNamespace(value=codes))(iter([pa.RecordBatch.from_arrays([column], names=["text"])])))
    assert (found == counts).all() and sum(met) < len(symbol)
    table, held = counts.reshape(-1, 2).T, text % 3 == 0
    answers, marks = lm_scoring.WordAnswers(codes, table), codes.marked(h, bounds)[1]
    for own in (None, held):
        x, gate, b, t = answers.inputs(symbol, marks, before, own)
        wanted = lm_scoring.word_inputs(*lm_scoring.left_out(table, slots, bits, True if own is None else ~own[token]))
        assert (x == wanted[0]).all() and (gate == wanted[1]).all() and (b == bits).all() and (t == token).all()


def test_near_nodes_have_near_slots():
    """Four bits after each other, of a byte or a code, lie in one block of 16 slots in each context, and no two of them in one slot."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 9))).encode() for _ in range(300)]
    slots = lm_scoring.letter_slots(lm_scoring.letters(words)[0])[0][1:]
    assert (slots.reshape(len(slots), -1, 4) >> 4 == slots[:, ::4, None] >> 4).all() and (np.diff(np.sort(slots.reshape(len(slots), -1, 4)), axis=2) > 0).all()
    codes = lm_scoring.Codes(np.arange(1, 400, dtype=np.uint64), np.array([100_000 // i for i in range(1, 400)]), 50, 20)
    for symbol in range(len(codes.sizes)):
        found, _, _ = codes.spread(np.array([symbol]), np.array([5], np.uint64), np.array([6 << 20], np.uint64))
        for own, bottom in zip(found[1:], (0, 1 << lm_scoring.CONTEXT_BITS), strict=True):
            own = own - lm_scoring.CODED - 2 - bottom
            assert all(len(set((own[at : at + 4] >> 4).tolist())) == 1 and len(set(own[at : at + 4].tolist())) == len(own[at : at + 4]) for at in range(0, len(own), 4))


def test_chunks_of_counts_are_narrow():
    """Chunks of counts come back as they were, in as few bytes as the largest needs."""
    for most, size in ((1, 1), (255, 1), (256, 2), (65_536, 4), (1 << 32, 8)):
        counts = np.arange(lm_scoring.CHUNK, dtype=np.int64) % 200
        counts[7] = most
        packed = lm_scoring._packed(counts)
        assert len(packed) == size * lm_scoring.CHUNK and (lm_scoring._unpacked(packed) == counts).all()


def test_only_escaped_words_are_looked_up(monkeypatch):
    """Words with a code are answered by their symbols, and letters that aren't needed for outcomes have none."""
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    asked, find = [], lm_scoring.Places.find
    monkeypatch.setattr(lm_scoring.Places, "find", lambda self, h: asked.append((len(self.hashes), len(h))) or find(self, h))
    hash_of = lambda ws: lm_scoring.words_of(np.frombuffer(" ".join(ws).encode(), np.uint8))[2]
    codes = lm_scoring.Codes(hash_of(["a", "b"]), np.array([5, 3]), 2, 4)
    table, h = np.ones((2, lm_scoring.WORD_SLOTS), np.float32), np.sort(hash_of(["c", "dd", "e"]))
    lexicon = (np.array([-1.0, -2.0, 0.0, 0.0]), h, np.ones(3), np.full(3, -3.0), np.full(3, -4.0), np.full(3, -5.0))
    shared = [SimpleNamespace(value=x) for x in (lexicon, codes, table)]
    run = lm_scoring._scored(*shared, Mixer(lm_scoring.WORD_WEIGHTS, lm_scoring.WORD_GATES), SimpleNamespace(value=np.zeros(1 << (lm_scoring.FILTER_BITS - 3), np.uint8)), -0.1)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b c a new", "b"]), pa.array([True, False])], names=["doc_id", "text", "held_out"])
    sums, rare = run(iter([batch]))
    assert sums.column(6).to_pylist() == [4, 1] and sums.column(7).to_pylist() == [-7.0, -2.0]
    assert rare.column(4).to_numpy().view(np.uint64).tolist() == hash_of(["new"]).tolist() and (3, 2) in asked
    outcomes = []
    monkeypatch.setattr(Mixer, "outcomes", lambda self, *_: outcomes.append(1))
    words = pa.RecordBatch.from_arrays([pa.array([b"one", b"two"])], names=["word"])
    list(lm_scoring._fitted(Mixer(), lm_scoring._spelling_inputs, SimpleNamespace(value=np.ones((2, lm_scoring.SLOTS), np.float32)), 0.25, False)(iter([words])))
    assert not outcomes


def test_places_of_hashes():
    """Also of hashes with equal leading bits, of the least and the greatest, and of none."""
    near = [(5 << 40) + i for i in range(30)] + [0, 1, (1 << 64) - 1, 1 << 63]
    hashes = np.array(sorted(near), np.uint64)
    asked = np.array([*near, 7, (5 << 40) + 30, (1 << 64) - 2, (1 << 63) + 1], np.uint64)
    at, found = lm_scoring.Places(hashes).find(asked)
    assert found.tolist() == [x in near for x in asked.tolist()] and (hashes[at[found]] == asked[found]).all()
    assert not lm_scoring.Places(hashes[:0]).find(asked)[1].any()


def test_lm_is_fitted_on_every_word(spark):
    """The refinement counts the bits of all 24,000 words, each without its own counts."""
    rng = random.Random(5)
    lexicon = sorted({"".join(rng.choices("abcdeinorst", k=rng.randint(2, 9))).encode() for _ in range(40_000)})[:24_000]
    mixer, shared = fit_spelling(spark.createDataFrame([(bytearray(w), 1) for w in lexicon], "word binary, n long").repartition(3))
    counts = shared.value
    slots, bits, _ = spelling(lexicon)
    x, gate = Mixer.inputs(np.maximum(counts[0][slots] - (bits == 0), 0), np.maximum(counts[1][slots] - (bits == 1), 0))
    near = np.rint((np.clip(mixer.mixed(x, gate), -8, 8) + 8) / 16 * (BUCKETS - 1)).astype(int)
    n, ones = np.zeros((GATES, BUCKETS)), np.zeros((GATES, BUCKETS))
    np.add.at(n, (gate, near), 1)
    np.add.at(ones, (gate, near), bits)
    assert n.sum() == sum(8 * (len(w) + 1) for w in lexicon) and len(lexicon) == 24_000
    assert np.allclose(mixer.refined, (ones + 30 * Mixer().refined) / (n + 30), atol=1e-3)
    plain, fitted = Mixer(), mixer.probability(x, gate)
    loss = lambda p: -np.log2(np.where(bits == 1, p, 1 - p)).mean()
    assert loss(fitted) < loss(plain.probability(x, gate))


def test_lm_score_by_brute_force(spark, small, monkeypatch):
    """The learned parts are taken as given; words, contexts, passages and counts are gone through one by one."""
    docs = odd_documents(spark).where("doc_id <> 8").select("doc_id", "text").union(documents(spark, small).select("doc_id", "text").where("doc_id % 10 = 3"))
    docs = docs.union(spark.createDataFrame([(None, "a line. a line. and one more"), (1, "a line. qqqq")], "doc_id long, text string"))
    rows = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    out = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    counts = Counter(w for (_, t), held in zip(rows, out, strict=True) if not held for w in t)
    ends, whole = sum(not held for held in out), sum(counts.values())
    coded = sorted(counts, key=lambda w: (-counts[w], w))[:lm_scoring.CODED]
    hash_of = lambda ws: lm_scoring.words_of(np.frombuffer(b" ".join(ws), np.uint8))[2]
    lm_scoring.prepare(spark)
    codes = lm_scoring.Codes(hash_of(coded), np.array([counts[w] for w in coded]), ends, whole - sum(counts[w] for w in coded))
    training = docs.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))).select("text")
    fitted = lm_scoring.fit_words(training, codes)
    letters, spelled = fit_spelling(spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, n long"))
    monkeypatch.setattr(lm_scoring, "fit_words", lambda *_: fitted)
    monkeypatch.setattr(lm_scoring, "fit_spelling", lambda *_: (letters, spelled))
    _, shared, mixer = fitted
    table = shared.value

    def pieces(t):
        own, size = [], 0
        for i, w in enumerate(t):
            own.append((i, w))
            size += 1
            if w[-1:] in b".!?:" or size == lm_scoring.PASSAGE:
                yield own
                own, size = [], 0
        if own:
            yield own

    seen = Counter(tuple(w for _, w in p) for (_, t), held in zip(rows, out, strict=True) if not held for p in pieces(t))
    everywhere = Counter(tuple(w for _, w in p) for _, t in rows for p in pieces(t))
    n = sum(seen.values())
    copied = (sum(v for k, v in seen.items() if v > 1 and everywhere[k] > 1) + 0.5) / (n + 1)
    fresh = 1 / 2  # every word has a code, so no escape was ever met
    wanted = []
    for (d, t), held in zip(rows, out, strict=True):
        h = hash_of(t) if t else np.zeros(0, np.uint64)
        symbol, function, before, _ = codes.tokens(h, np.array([0, len(t)]))
        marks = [0]
        for w in t:
            marks.append(coded.index(w) + 1 if w in coded[: lm_scoring.FUNCTION] else marks[-1])
        assert function.tolist() == lm_scoring.mix64(np.array(marks, np.uint64) + np.uint64(1)).tolist() and len(set(before[1:].tolist())) == len(set(h.tolist()))
        logs = []
        for i in range(len(symbol)):
            slots, bits, _ = codes.spread(symbol[i : i + 1], function[i : i + 1], before[i : i + 1])
            n0, n1 = ([[max(table[v][s] - (not held and b == v), 0) for s, b in zip(row, bits, strict=True)] for row in slots] for v in (0, 1))
            p = mixer.probability(*lm_scoring.word_inputs(np.array(n0, np.float32), np.array(n1, np.float32)))
            logs.append(sum(math.log10(x if b else 1 - x) for x, b in zip(p, bits, strict=True)))
            if symbol[i] == codes.escape:
                slots, bits, _ = spelling([t[i]])
                p = letters.probability(*Mixer.inputs(spelled.value[0][slots], spelled.value[1][slots]))
                logs[-1] += math.log10(fresh) + sum(math.log10(x if b else 1 - x) for x, b in zip(p, bits, strict=True))
        total = logs[-1]
        for p in pieces(t):
            others = seen[tuple(w for _, w in p)] - (not held)
            made = (1 - copied) * 10 ** sum(logs[i] for i, _ in p)
            total += math.log10(made + copied * max(others, 0) / n)
        wanted.append((-1 if d is None else d, len(t) + 1, held, total))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["held_out"], r["score"]) for r in score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0).collect())
    assert len(got) == len(wanted)
    for a, b in zip(got, sorted(wanted), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-5)


def test_codes_are_prefix_free():
    codes = lm_scoring.Codes(np.arange(1, 40, dtype=np.uint64), np.arange(40, 1, -1), 3, 1)
    paths = ["".join(map(str, codes.bits[codes.begins[i] : codes.begins[i + 1]])) for i in range(41)]
    assert all(not b.startswith(a) for a in paths for b in paths if a is not b) and sum(2.0 ** -len(p) for p in paths) == 1
    assert len({(n, b[: len(b)]) for n, b in zip(codes.nodes.tolist(), map(str, codes.bits), strict=True)}) == 2 * 40


# all


def test_empty_tables(spark):
    none = empty_documents(spark)
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (shard_by_bytes(none), identify_documents(none), contaminated(none, bench), mix(none), read_token_files(write_token_files(none)), scan_licenses(none), jaccard_components(none), score_texts(none, F.lit(False))):
        assert df.count() == 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_duckdb(spark, small, name):
    assert_same(Q.queries()[name](spark, small), small, Q.oracle_sql()[name])
