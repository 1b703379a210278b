"""Personal data spans: plain rules, high-recall generators, boosted trees and calibrated thresholds.

The rules give the base spans. Generators propose further spans, overlapping where
they like: spelled-out or bracketed addresses, other separators, missing prefixes,
and numbers that a base match swallowed with its neighbours. Every candidate has
format and context features. Boosted trees learn from the corpus itself: base spans
rewritten into such forms, in their own surroundings, against candidates that touch
no base span and rewritten spans with a broken check digit or octet. Thresholds by
kind are read off rows that the trees haven't seen.

All of it is column expressions: a document's spans are found, scored and chosen
within its own row, so that there is no shuffle of documents. The trees and the
thresholds are learned from every base span and every candidate; equal feature
vectors are counted, and ``pyspark.ml``'s boosted trees take the counts as weights
and come back as a column expression. Patterns never backtrack over more than a
run of one class of characters, and positions are summed in blocks, so that very
long texts take time in proportion.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Base patterns, equal to the plain ones but without their backtracking.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
_AT = r"(?:\s?[@\uFF20]\s?|\s?[\[({<]\s?(?:(?i:at)|@)\s?[\])}>]\s?|\s(?i:at)\s)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:(?i:dot)|\.)\s?[\])}>]\s?|\s(?i:dot)\s)"
_SEP = r"(?:\s-\s|[\s\u00A0._/\u2010-\u2015-]{1,2})"
_GAP = r"[\s\u00A0./\u2010-\u2015-]?"
_OCTET_SEP = r"(?:\s?\.\s?|\s?[\[({<]\s?(?:(?i:dot)|\.)\s?[\])}>]\s?|\s(?i:dot)\s)"
#: Generators: name, kind, pattern.
GENERATORS = (
    ("address", "email", rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++(?:\s(?i:dot)\s[\p{{L}}\p{{N}}_%+-]++)*+{_AT}[\p{{L}}\p{{N}}-]++(?:{_DOT}[\p{{L}}\p{{N}}-]++)++"),
    ("octets", "ip", rf"(?<![0-9])[0-9]{{1,3}}{_OCTET_SEP}[0-9]{{1,3}}{_OCTET_SEP}[0-9]{{1,3}}{_OCTET_SEP}[0-9]{{1,3}}(?![0-9])"),
    ("run", "card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])"),
    ("fours", "card", rf"(?<![0-9])[0-9]{{4}}{_SEP}[0-9]{{4}}{_SEP}[0-9]{{4}}{_SEP}[0-9]{{2,7}}(?![0-9])"),
    ("last_fours", "card", rf"(?<![0-9])[0-9]{{4}}{_SEP}[0-9]{{4,6}}{_SEP}[0-9]{{4,5}}(?:{_SEP}[0-9]{{2,7}})?(?![0-9]|[ -][0-9])"),
    ("international", "phone", rf"\+[0-9]{{1,3}}{_GAP}\(?[0-9]{{2,4}}\)?{_GAP}[0-9]{{3}}{_GAP}[0-9]{{4}}(?![0-9])"),
    ("local", "phone", rf"(?<![0-9+])\(?[0-9]{{3}}\)?{_GAP}[0-9]{{3}}{_GAP}[0-9]{{4}}(?![0-9])"),
    ("zeros", "phone", rf"(?<![0-9])00{_GAP}[1-9][0-9]{{0,2}}{_GAP}\(?[0-9]{{2,4}}\)?{_GAP}[0-9]{{3}}{_GAP}[0-9]{{4}}(?![0-9])"),
)
#: Characters of context on either side, and entries of a block of running sums.
CONTEXT = 24
BLOCK = 128
TREES, DEPTH, STEP = 20, 4, 0.3
#: A leaf of a tree has at least so many labelled rows.
LEAF = 5
#: A threshold is the lowest from LEAST at which so large a part of the held-out rows above it is right.
LEAST, PRECISION = 0.5, 0.9
SPAN = "struct<kind:int,gen:int,s:int,e:int,m:string,before:string,after:string>"


def let(bound: dict[str, str], body: str, name: str) -> str:
    """SQL of ``body`` with some values bound to the fields of ``name``, each evaluated once whatever the optimizer inlines."""
    fields = ", ".join(f"'{k}', {v}" for k, v in bound.items())
    return f"element_at(transform(array(named_struct({fields})), {name} -> {body}), 1)"


def running(values: str, step: str) -> str:
    """SQL of the running ``step`` (an expression of {t} and x) over an array of integers, from 0, copied block by block."""
    step = step.format(t="a.t")
    block = f"aggregate(slice(v.a, b * {BLOCK} + 1, {BLOCK}), named_struct('t', acc.t, 'o', cast(array() as array<int>)), (a, x) -> named_struct('t', {step}, 'o', array_append(a.o, {step})))"
    blocks = f"aggregate(sequence(0, (size(v.a) - 1) div {BLOCK}), named_struct('t', 0, 'o', cast(array() as array<int>)), (acc, b) -> element_at(transform(array({block}), z -> named_struct('t', z.t, 'o', concat(acc.o, z.o))), 1)).o"
    return let({"a": values}, f"if(size(v.a) > 0, {blocks}, cast(array() as array<int>))", "v")


def find(df: DataFrame, text: str, patterns: dict[str, tuple[int, int, str]]) -> DataFrame:
    """Replaces the text by one array of matches a pattern (name: kind, generator, pattern), with positions in code points and context.

    The pieces between the matches come from splitting at the same pattern, and
    positions are running sums of both lengths.
    """

    def spans(kind: int, gen: int, pattern: str) -> Column:
        span = (
            f"named_struct('kind', {kind}, 'gen', {gen}, 's', get(w.e, i) - length(x), 'e', get(w.e, i), 'm', x,"
            f" 'before', substring(concat(coalesce(get(w.m, i - 1), ''), get(w.g, i)), -{CONTEXT}, {CONTEXT}), 'after', left(concat(get(w.g, i + 1), coalesce(get(w.m, i + 1), '')), {CONTEXT}))"
        )
        ends = running("transform(u.m, (x, i) -> length(x) + length(get(u.g, i)))", "{t} + x")
        placed = let({"m": "u.m", "g": "u.g", "e": ends}, f"transform(w.m, (x, i) -> {span})", "w")
        pieces = let({"m": "q.m", "g": f"split({text}, r'{pattern}', -1)"}, placed, "u")
        none = f"cast(array() as array<{SPAN}>)"
        return F.expr(let({"m": f"regexp_extract_all({text}, r'{pattern}', 0)"}, f"if(size(q.m) > 0, {pieces}, {none})", "q")).cast(f"array<{SPAN}>")

    return df.select(*[c for c in df.columns if c != text], *[spans(*p).alias(n) for n, p in patterns.items()])


def valid(kind: int, m: str) -> str:
    """SQL condition that a base match of a kind stands."""
    digits = f"length(regexp_replace({m}, '[^0-9]', ''))"
    return {0: "true", 1: rf"{m} rlike r'{OCTETS}'", 2: f"({digits} between 14 and 19 and luhn_check(translate({m}, ' -', '')))", 3: f"{digits} between 10 and 15"}[kind]


def features(c: str) -> list[str]:
    """SQL of a candidate's features: the generator, the format, and what stands before and after.

    They are coarse on purpose: missed spans of the corpus count as wrong when the
    trees learn, and exact lengths would let the trees single them out.
    """
    m, before, after = f"{c}.m", f"{c}.before", f"{c}.after"
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    has = lambda text, pattern: rf"if({text} rlike r'{pattern}', 1, 0)"
    plain = rf"regexp_replace({m}, r'[^0-9]+', '.')"
    return [
        f"{c}.kind", f"{c}.gen", f"if({c}.kind < 2, 0, length({digits}))", f"least(length(regexp_replace({m}, r'[\\p{{L}}\\p{{N}}]', '')), 3)",
        has(m, r"[ \t]"), has(m, r"\."), has(m, "-"), has(m, "[/_]"), has(m, r"[\[({<]"), has(m, r"[^\x00-\x7F]"), has(m, "[\\r\\n]"),
        has(m, r"^\+"), has(m, "^00"), has(m, "@"), has(m, r"\s(?i:at)\s"), has(m, r"\s(?i:dot)\s"), has(m, r"(?i:at|dot)\s?[\])}>]"), has(m, r"[\p{L}]{2,24}$"),
        f"if(length({digits}) between 13 and 19 and luhn_check({digits}), 1, 0)",
        f"if({plain} rlike r'{OCTETS}', 1, 0)",
        has(digits, "^[3-6]"), has(m, r"^\+?1?[^0-9]*[2-9]"),
        has(before, r"[\p{L}\p{N}_]$"), has(after, r"^[\p{L}\p{N}_]"), has(before, r"[0-9][^\p{L}]{0,2}$"), has(after, r"^[^\p{L}]{0,2}[0-9]"),
        has(before, r"[\x22\x27=#:$%&*/@+]\s?$"), has(after, r"^[\x22\x27=#:$%&*/@+]"),
        has(before, r"(?i:mail|contact|write|reach)"), has(before, r"(?i:tel|phone|call|fax|mobil|cell)"), has(before, r"(?i:card|visa|credit|master|amex)"),
        has(before, r"(?i:\bip\b|host|addr|server)"), has(before, r"(?i:vers|order|invoice|isbn|token|key|build|part|serial)"),
    ]


def candidates(df: DataFrame, text: str, base: bool) -> DataFrame:
    """The text replaced by ``cands`` (candidates with features ``f``) and, if wanted, by ``base_email`` to ``base_phone``."""
    patterns = {f"gen_{n}": (KINDS.index(k), i, p) for i, (n, k, p) in enumerate(GENERATORS)}
    if base:
        patterns |= {f"base_{k}": (i, -1, BASE[k]) for i, k in enumerate(KINDS)}
    df = find(df, text, patterns)
    df = df.withColumn("cands", F.concat(*[f"gen_{n}" for n, _, _ in GENERATORS])).drop(*[f"gen_{n}" for n, _, _ in GENERATORS])
    values = ", ".join(f"cast({x} as double)" for x in features("c"))
    df = df.withColumn("cands", F.expr(f"transform(cands, c -> named_struct('kind', c.kind, 'gen', c.gen, 's', c.s, 'e', c.e, 'm', c.m, 'before', c.before, 'after', c.after, 'f', array({values})))"))
    if base:
        df = df.withColumns({f"base_{k}": F.expr(f"filter(base_{k}, c -> {valid(i, 'c.m')})") for i, k in enumerate(KINDS)})
    return df


def _rewritten() -> str:
    """SQL of the forms (text before, form, text after, whether it is right) of a base span ``b``, by kind."""
    d = "translate(b.m, ' -', '')"
    row = lambda form, pre="''", post="''", right=1: f"named_struct('pre', {pre}, 'form', {form}, 'post', {post}, 'right', {right})"
    local, domain = "regexp_extract(b.m, '^[^@]+', 0)", "regexp_extract(b.m, '@(.*)', 1)"
    email = [row(f"concat({local}, '{at}', replace({domain}, '.', '{dot}'))") for at, dot in ((" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."), (" at ", "."), (" @ ", "."), ("{at}", "{dot}"), ("\uff20", "."), ("[at]", "."))]
    email += [row(rf"concat({local}, '{at}', regexp_replace({domain}, r'\.([^.]*)$', '{dot}$1'))") for at, dot in ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "))]
    email += [row(f"replace(replace(b.m, '@', '{at}'), '.', '{dot}')") for at, dot in ((" at ", " dot "), (" (at) ", " (dot) "))]
    email += [row("concat('\u00e9', b.m)"), row("regexp_replace(b.m, '@.*', ' at 12.30')", right=0), row("regexp_replace(b.m, '@.*', ' @ 5.50')", right=0)]
    ip = [row(f"replace(b.m, '.', '{dot}')", right=right) if right else row(f"replace(regexp_replace(b.m, '^[0-9]+', '384'), '.', '{dot}')", right=0) for dot in ("[.]", "(.)", " . ", " dot ", "[dot]", "(dot)") for right in (1, 0)]
    wrong = f"concat(left({d}, length({d}) - 1), (cast(right({d}, 1) as int) + 3) % 10)"
    grouped = lambda x, sep: f"regexp_replace({x}, '([0-9]{{4}})(?=[0-9])', '$1{sep}')"
    card = [row(grouped(x, sep), right=right) for x, right in ((d, 1), (wrong, 0)) for sep in (".", "/", "_", "  ", "\u00a0", " - ", "\u2011", " ")]
    near = f"concat(left({d}, 3), '-', substring({d}, 4, 4))"
    card += [row(x, pre, post, right) for x, right in ((d, 1), (wrong, 0)) for pre, post in ((f"concat('+1 (', left({d}, 3), ') ', {near}, ' ')", "''"), (f"concat({near}, ' ')", "''"), ("''", f"concat(' ', {near})"), (f"concat({d}, ' ')", "''"))]
    bare = r"trim(regexp_replace(b.m, r'^\+[0-9]{1,3}', ''))"
    joined = lambda x, sep: rf"regexp_replace(regexp_replace({x}, r'[()]', ''), r'[ .-]+', '{sep}')"
    numbers = "regexp_replace(b.m, '[^0-9]', '')"
    phone = [row(r"regexp_replace(b.m, r'^\+', '00')"), row(bare), *[row(joined(bare, sep)) for sep in ("-", ".", " ", "/")], *[row(joined("b.m", sep)) for sep in ("/", "\u00a0", "\u2011")]]
    phone += [row(joined(bare, ""), right=0), row(joined(bare, "-"), pre="'a'", post="'f'", right=0)]
    phone += [row("b.m", post=f"concat(' ', {numbers}, left({numbers}, 5))"), row("b.m", post=f"concat(' ', left({numbers}, 2), '.', left({numbers}, 3), '.7.4')")]
    return "case b.kind " + " ".join(f"when {i} then array({', '.join(rows)})" for i, rows in enumerate((email, ip, card, phone))) + " end"


def labelled(table: DataFrame) -> DataFrame:
    """Rows ``kind, f, label, held, n``: how often each feature vector occurs with a label, over the whole table.

    Right are base spans in other forms; wrong are forms with a broken number and
    candidates that touch no base span. All base spans and candidates count.
    """
    every = "concat(base_email, base_ip, base_card, base_phone)"
    held = lambda c: f"pmod(xxhash64({c}.m, doc_id), 3) = 0"
    base = table.select("doc_id", F.explode(F.expr(every)).alias("b"))
    drawn = table.select("doc_id", F.explode("cands").alias("c"))
    # whether a candidate touches a base span is looked up in its own surroundings, not among all spans of its text
    drawn = drawn.select(F.col("c.kind").alias("kind"), F.col("c.f").alias("f"), F.expr(held("c")).alias("held"), F.length("c.before").alias("start"), F.length("c.m").alias("size"), F.concat("c.before", "c.m", "c.after").alias("text"))
    near = find(drawn, "text", {f"near_{k}": (i, -1, BASE[k]) for i, k in enumerate(KINDS)})
    touches = " or ".join(f"exists(near_{k}, x -> x.s < start + size and start < x.e and {valid(i, 'x.m')})" for i, k in enumerate(KINDS))
    outside = near.where(f"not ({touches})").select("kind", "f", F.lit(0.0).alias("label"), "held")
    forms = base.select("b", F.expr(held("b")).alias("held"), F.explode(F.expr(_rewritten())).alias("v"))
    forms = forms.select("held", F.col("b.kind").alias("own"), F.col("v.right").alias("right"), (F.length("b.before") + F.length("v.pre")).alias("start"), F.length("v.form").alias("size"), F.concat("b.before", "v.pre", "v.form", "v.post", "b.after").alias("text"))
    found = candidates(forms, "text", base=False).select("held", "own", "right", "start", "size", F.explode_outer("cands").alias("c"))
    both = F.least(F.col("c.e"), F.col("start") + F.col("size")) - F.greatest(F.col("c.s"), "start")
    found = found.where((F.col("c.kind") == F.col("own")) & (both >= 0.8 * F.col("size")) & (both >= 0.8 * (F.col("c.e") - F.col("c.s"))))
    rows = found.select(F.col("own").alias("kind"), F.col("c.f").alias("f"), F.col("right").cast("double").alias("label"), "held")
    return rows.union(outside).groupBy("kind", "f", "label", "held").agg(F.count("*").alias("n"))


def _tree(lines: list[str]) -> str:
    """SQL of a tree from its printed form."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return line.split(":")[1].strip()
    feature, limit = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines)
    lines.pop(0)
    return f"(case when get(c.f, {feature}) <= {limit} then {low} else {_tree(lines)} end)"


def fit(rows: DataFrame) -> tuple[str, dict[int, float]]:
    """SQL of a candidate's probability, and the threshold of each kind; above 1 where no candidate is to be taken.

    ``rows`` has distinct feature vectors with their counts ``n``: features are
    coarse, so their number is bounded by the features, not by the corpus.
    """
    rows = materialize(rows.repartition(1).sortWithinPartitions("kind", "label", "f", "held"), "pii-labelled")
    seen = rows.where("not held").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("right")).first()
    if not seen["right"]:
        return "0e0", dict.fromkeys(range(4), 2.0)
    train = rows.where("not held").coalesce(1).select(array_to_vector("f").alias("features"), "label", F.col("n").cast("double").alias("n"))
    # a leaf's least size is a part of all rows, as a row here stands for many
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, minInstancesPerNode=1, minWeightFractionPerNode=min(LEAF / seen["n"], 0.49), weightCol="n", seed=1, cacheNodeIds=False).fit(train)
    margin = " + ".join(f"{w!r} * {_tree(t.toDebugString.splitlines()[1:])}" for w, t in zip(model.treeWeights, model.trees, strict=True))
    score = f"1e0 / (1e0 + exp(-2e0 * ({margin})))"
    held = rows.where("held").select("kind", "label", "n", F.expr(f"element_at(transform(array(named_struct('f', f)), c -> {score}), 1)").alias("p"))
    bins = held.groupBy("kind", F.floor(F.col("p") * 50).cast("int").alias("bin")).agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n")).collect()
    limits = {}
    for kind in range(4):
        own, limits[kind] = [b for b in bins if b.kind == kind], 2.0
        for at in range(49, round(LEAST * 50) - 1, -1):
            above = [b for b in own if b.bin >= at]
            if (sum(b.right for b in above) + 1) / (sum(b.n for b in above) + 2) >= PRECISION:
                limits[kind] = at / 50
    return score, limits


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    ordered = f"array_sort(transform({spans}, c -> named_struct('s', c.s, 'kind', c.kind, 'e', c.e)))"
    return F.expr(f"array_join(transform({ordered}, c -> concat(get(array({names}), c.kind), ':', c.s, ':', c.e)), ',')")


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data of every document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. The counts and
    ``base_sha256`` are of the base spans, ``spans`` has all. Each row is judged by
    itself, so repeated rows and ids and null ids have their own results; a null
    text is empty. A candidate within a base span or another chosen one of its kind
    is left out; spans of different kinds may overlap. Without any base span there
    is nothing to learn from and nothing is added.
    """
    table = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = materialize(candidates(table, "text", base=True), "pii-spans")
    score, limits = fit(labelled(table))
    limit = f"get(array({', '.join(repr(float(limits[k])) for k in range(4))}), c.kind)"
    plain = "named_struct('kind', c.kind, 's', c.s, 'e', c.e)"
    chosen = table.withColumn("chosen", F.expr(f"filter(cands, c -> {score} >= {limit})"))
    for i, k in enumerate(KINDS):
        # sorted by start, the longest first: a span is within an earlier one where the running maximum of ends before it reaches its end
        own = f"array_sort(concat(transform(base_{k}, c -> named_struct('s', c.s, 'o', -c.e, 'kind', c.kind, 'added', 0)), transform(filter(chosen, c -> c.kind = {i}), c -> named_struct('s', c.s, 'o', -c.e, 'kind', c.kind, 'added', 1))))"
        kept = "transform(filter(w.own, (c, i) -> c.added = 0 or i = 0 or get(w.most, i - 1) < -c.o), c -> named_struct('kind', c.kind, 's', c.s, 'e', -c.o))"
        kept = let({"own": "u.own", "most": running("transform(u.own, c -> -c.o)", "greatest({t}, x)")}, kept, "w")
        chosen = chosen.withColumn(f"all_{k}", F.expr(let({"own": own}, kept, "u")))
    base = f"concat({', '.join(f'transform(base_{k}, c -> {plain})' for k in KINDS)})"
    every = f"concat({', '.join(f'all_{k}' for k in KINDS)})"
    return chosen.select(
        "doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(every).alias("spans"), (F.expr(f"size({every}) - size({base})")).cast("long").alias("added"),
    )
