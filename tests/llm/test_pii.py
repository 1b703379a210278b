"""Personal data: base spans against plain regular expressions, added spans on rewritten and clean texts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from runledger.llm import queries as Q
from runledger.llm.pii import BLOCK, candidates, labelled, personal_data, running

# fixed values: the base rules as given
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def stands(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 10 <= len(digits) <= 15}[kind]


def brute_base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if stands(k, m.group())] for k, p in RULES.items()}


def joined(spans):
    order = list(RULES)
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted((s, order.index(k), e, k) for k, own in spans.items() for s, e in own))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, spans string, n_ip int, cands string")


def assert_base(df, texts):
    found = df.collect()
    assert len(found) == len(texts)
    for r in found:
        spans = brute_base(texts[r.doc_id])
        base = joined(spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(v) for v in spans.values()), (r, texts[r.doc_id][:200])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        every = [x for x in r.spans.split(",") if x]
        assert set(base.split(",")) - {""} <= set(every) and len(every) == len(set(every)) == sum(map(len, spans.values())) + r.added
        assert all(0 <= int(s) < int(e) <= len(texts[r.doc_id] or "") for _, s, e in (x.split(":") for x in every))


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(3)
    texts = {
        1: None, 2: "", 3: " \n", 4: "a@b.c_d@e.fg x@@y.z a@b@c.de @x.y a@b a@b. a.b@c-d.e--.f", 5: "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.001 1.2.3 1..2.3.4 99999999999999999999.1.1.1",
        6: "+1 (743) 555-3824 +1 (269) 555-3296 4524132264652876 +123 +12345678901234567 + 1 +1- 234567890)", 7: "4465758382889437 4465758382889437", 8: "4465-7583-8288-9437, 4465 7583 8288 9437 4465  7583", 9: "é\U0001f600 4465758382889437 \U0001f600 a@b.cd",
        10: "a" * 9_000, 11: "1" * 9_000, 12: "1." * 5_000, 13: "+1 " * 60_000, 14: "1 " * 100_000, 15: "a.b@" * 60_000, 16: "a@b.c " * 3000, 17: "(" * 50_000 + " at " * 50_000, 18: "x" * 9_000 + "@mail.com",
    }
    for i in range(100, 400):
        texts[i] = "".join(rng.choice(["1", "12", "255", "4465758382889437", "+", "+1", "@", ".", ".", "-", " ", " ", "(", ")", "a", "b_", "é", "%", "743", "555", "\n", "\U0001f600"]) for _ in range(rng.randrange(60)))
    assert_base(personal_data(table(spark, texts.items())), texts)


def test_very_long_runs(spark):
    texts = {1: "a" * 50_000 + "@mail.com", 2: "1" * 400_000, 3: "1." * 60_000 + "x", 4: "9 " * 300_000}
    found = {r.doc_id: r.spans for r in personal_data(table(spark, texts.items())).collect()}
    assert found[1] == "email:0:50009" and found[2] == found[4] == ""
    assert found[3] == ",".join(f"ip:{s}:{s + 7}" for s in range(0, 120_000, 8))


def test_base_spans_of_the_tables(spark, small):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    assert_base(Q.op13_personal_data(spark, small), texts)


def card(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def phone(rng):
    return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10000):04d}"


def prose(rng, n):
    pool = ["the", "ration", "of", "at", "thing", "number", "ended", "with", "on", "tion", "she", "and", "ember"]
    return " ".join(rng.choice(pool) for _ in range(n))


def corpus():
    """Documents with plain spans to learn from, clean documents, and documents whose spans the base rules miss."""
    rng = random.Random(11)
    rows, hidden, clean = [], {}, set()
    for i in range(400):
        own = rng.choice([f"{rng.choice(['ann', 'bo', 'cy'])}.{i}@mail{i % 9}.example.com", f"{rng.randrange(1, 255)}.{rng.randrange(255)}.{rng.randrange(255)}.{rng.randrange(1, 255)}", card(rng), phone(rng)])
        rows.append((i, f"{prose(rng, 30)} {own} {prose(rng, 30)}"))
    for i in range(1000, 1400):
        extra = rng.choice(["chapter 12.4.7", "token = \"1eb9c654e721b4f812088970e66a\"", "in 1998 and 2004", f"{rng.randrange(10**9, 10**10)}", "version 3.10.2", "page 555", "at 12.30 on", card(rng)[:-1] + "x", "at ration.com"[:9], f"{rng.randrange(300, 999)}.1.2.3"])
        rows.append((i, f"{prose(rng, 30)} {extra} {prose(rng, 30)}"))
        clean.add(i)
    for i in range(2000, 2120):
        c, p = card(rng), phone(rng)
        form, spans = [
            (f"dan.{i} at mail.example dot com", [f"dan.{i} at mail.example dot com"]), (f"eve{i} [at] host [dot] org", [f"eve{i} [at] host [dot] org"]), (f"{p} {c}", [p, c]), (f"{c} {c}", [c]),
            (f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}", [f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}"]), (p[3:], [p[3:]]), (p[4:].replace(") ", "-"), [p[4:].replace(") ", "-")]), (f"10[.]20[.]{i % 200}[.]7", [f"10[.]20[.]{i % 200}[.]7"]),
        ][i % 8]
        text = f"{prose(rng, 20)} {form} {prose(rng, 20)}"
        rows.append((i, text))
        hidden[i] = [(text.index(x), text.index(x) + len(x)) for x in spans]
    return rows, hidden, clean


def test_added_spans(spark):
    rows, hidden, clean = corpus()
    found = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x] for r in personal_data(table(spark, rows)).collect()}
    missed = [i for i, spans in hidden.items() if any(not any(s <= a + 1 and b - 1 <= e for s, e in found[i]) for a, b in spans)]
    assert len(missed) <= 0.1 * len(hidden), [dict(rows)[i][60:200] for i in missed][:10]
    touched = [i for i in clean if found[i]]
    assert len(touched) <= 0.02 * len(clean), [(dict(rows)[i], found[i]) for i in touched][:10]


def test_rows_judged_alone(spark):
    """Equal rows have equal results, repeated and null ids too; nothing to learn from adds nothing; an empty table has no row."""
    rows = [(1, "see +1 (743) 555-3824 4465758382889437 now"), (1, "see +1 (743) 555-3824 4465758382889437 now"), (None, "x@y.zz"), (None, None), (1, "")]
    found = [tuple(r) for r in personal_data(table(spark, rows)).collect()]
    assert len(found) == 5 and len(set(found)) == 3
    assert all(r[7] == 0 for r in [tuple(r) for r in personal_data(table(spark, rows[:1])).collect()])
    assert personal_data(table(spark, rows).where("doc_id < 0")).count() == 0


def test_same_result_when_dealt_otherwise(spark):
    rows = corpus()[0]
    once, again = (sorted(map(tuple, personal_data(table(spark, rows).repartition(n)).collect())) for n in (2, 7))
    assert once == again


def test_running_sums(spark):
    n = 3 * BLOCK + 5
    df = spark.range(1).select(F.expr(f"transform(sequence(1, {n}), x -> x * 7 % 11)").alias("d"))
    values = df.first().d
    sums, most = df.select(F.expr(running("d", "{t} + x")), F.expr(running("d", "greatest({t}, x)"))).first()
    assert sums == [sum(values[: k + 1]) for k in range(n)] and most == [max(values[: k + 1]) for k in range(n)]


def test_learns_from_every_span(spark):
    """No span or candidate is left out of learning, however many there are, and equal ones count as often as they occur."""
    copies = 2000
    text = " ".join(f"x {i}.20.30.40 y 555-010-{i:04d} z" for i in range(1, 4))
    docs = spark.range(copies).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    one = labelled(candidates(docs.where("doc_id = 0"), "text", base=True)).groupBy("kind", "label").agg(F.sum("n")).collect()
    every = labelled(candidates(docs, "text", base=True)).groupBy("kind", "label").agg(F.sum("n")).collect()
    assert len(one) == 3 and sorted(map(tuple, every)) == sorted((k, y, n * copies) for k, y, n in one)
