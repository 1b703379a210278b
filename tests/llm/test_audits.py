"""Filter interaction and source divergence audits against brute force and DuckDB."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from oracle import assert_same

from runledger.llm import queries as Q
from runledger.llm.common import SLICE_BYTES
from runledger.llm.divergence_audit import distance, divergence, shares, terms_of
from runledger.llm.filter_audit import audit_filters, first_failures, word_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, step int, bits string, n int, part string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 8, "y") for r in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, n int")


def odd_rows():
    """Nulls, empty and long texts, groups of copies, repeated ids and rows, symbols and capitals."""
    rng = random.Random(5)
    pool = ["alpha", "Beta", "GAMMA", "delta#", "eps", "zeta&", "été", "ÄÖ"]
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, "A" * 40, "", "b"), (None, "", "en", "a"), (None, None, "fr", None), (9, "tail " * 60_000, "de", "b"), (9, "tail " * 60_000, "de", "b"), (9, "tail " * 60_000, "fr", "c")]
    rows += [(10 + i, " ".join(rng.choice(pool[: 1 + i % 8]) for _ in range(150 + 3 * i)), rng.choice(["en", "de", None]), rng.choice("abc")) for i in range(60)]
    rows += [(1000 - i, "copy of a text", "en", "a") for i in range(50)] + [(1000 - i, "copy of a text", "de", None) for i in range(3)]
    return rows


def brute_audit(rows, marks):
    good, toxic = ({m[0] for m in marks if m[k] == 1} - {None} for k in (1, 2))
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    facts = []
    for i, t, lang, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i), strict=True) if bad}
        facts.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {x[0] for x in facts}:
        own = [x for x in facts if x[0] == part]
        totals = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                totals[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(totals[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_filter_audit_brute_force(spark):
    rows = odd_rows()
    marks = [(i, i % 2, i % 3 % 2, 1) for i in range(0, 1001, 2)] + [(10, 1, 1, 1), (10, 0, 0, 1), (None, 1, 1, 1), (12, None, 1, 1)]
    found = audit_rows(audit_filters(table(spark, rows), labels(spark, marks)))
    assert found == brute_audit(rows, marks)
    assert audit_rows(audit_filters(table(spark, rows).repartition(7), labels(spark, marks).repartition(3))) == found


def test_filter_audit_empty(spark):
    docs, marks = table(spark, odd_rows()), labels(spark, [(1, 1, 1, 1)])
    assert audit_filters(docs.where("doc_id < 0"), marks).count() == 0
    assert audit_filters(docs, marks.where("doc_id < 0")).where("good_lost + toxic_lost > 0").count() == 0
    assert audit_filters(docs, marks).count() == 600 * 4


def test_first_failures():
    found = first_failures()
    assert found.shape == (32, 120)
    assert (found[0] == 5).all() and found[0b00001, 0] == 0 and found[0b10000, 0] == 4
    assert found[0b10001].sum() == sum(min(o.index("A"), o.index("E")) for o in map("".join, permutations("ABCDE")))


def test_words_of_long_texts():
    for text in (b"ab " * SLICE_BYTES, b"x" * (2 * SLICE_BYTES + 7), b"x y" * SLICE_BYTES, b" " * (SLICE_BYTES + 1) + b"q"):
        assert word_counts(text) == (len(text.split()), len(set(text.split())))


def test_filter_audit_sql(spark, small):
    assert_same(Q.op11_filter_audit(spark, small), small, Q.oracle_sql()["op11_filter_audit"])


# source divergence


def brute_divergence(rows, least=3):
    found = [(lang or "", source or "", [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in found}:
        df = Counter(t for a, _, terms in found if a == lang for t in set(terms))
        kept = {t for t, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for a, source, terms in found:
            if a == lang:
                counts[source].update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        own, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(own[s][t], q[t]), t) for t in kept if counts[s][t] > 0 and own[s][t] > q[t]]
            for part, values in (("pair", pairs), ("term", terms)):
                ordered = sorted(values, key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, o, v, k) for k, (v, o) in enumerate(ordered if part == "pair" else ordered[:200], 1)]
    return sorted(out)


def divergence_rows(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in df.collect())


def test_divergence_brute_force(spark):
    rng = random.Random(9)
    pool = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(14)] + ["Été", "été", "\ue000x", "\U0001f600", "a\u00a0b"]
    rows = odd_rows() + [(2000 + i, " ".join(rng.choice(pool[i % 5 * 40 :]) + rng.choice([" ", "1", ".", "\x00"]) for _ in range(120)), rng.choice(["en", "en", "de"]), rng.choice([None, "a", "b", "é", "z"])) for i in range(150)]
    rows += [(5000, "few words", "solo", "x"), (5001, None, "solo", "y"), (5002, None, "alone", None)]
    expected = brute_divergence(rows)
    assert divergence_rows(divergence(table(spark, rows))) == expected
    assert {(r[0], r[1], r[4]) for r in expected if r[0] == "solo"} == {("solo", "x", 0), ("solo", "y", 0)}
    assert divergence_rows(divergence(table(spark, rows).repartition(9), chunk_cells=40)) == expected


def test_divergence_empty(spark):
    assert divergence(table(spark, odd_rows()).where("doc_id < -5")).count() == 0


def test_exact_shares():
    for total in (1, 7, 10**9 + 7, 8 * 10**15):
        counts = sorted({0, 1, total // 3, total - 1, total})
        assert shares(np.array(counts), total).tolist() == [1 + 10**9 * c // total for c in counts]
    assert distance(np.array([10**9 + 1]), np.array([1])).tolist() == [10**18]


def test_terms_of_long_texts():
    text = b"Ab1" * SLICE_BYTES + b"x" * SLICE_BYTES + "É b".encode() * 9
    assert [t for piece in terms_of(text) for t in piece] == re.findall(rb"[a-z\x80-\xff]+", text.replace(b"A", b"a"))


def test_divergence_sql(spark, small):
    assert_same(Q.op12_source_divergence(spark, small), small, Q.oracle_sql()["op12_source_divergence"])
