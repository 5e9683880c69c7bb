"""Personal data and secrets by boosted trees over candidate spans (operator 7), in DataFrame functions alone.

Base patterns find emails, addresses of hosts, payment cards and phones, each leftmost and without overlap per kind.
High-recall generators propose further spans, which may overlap: numbers of a card's or a phone's length with any
marks in them, addresses whose @ and dots are spelled out or bracketed, and secrets, which are runs of letters and
digits of 12 characters or more, and values of at least 6 characters behind an equals sign or a colon.

Boosted trees score a proposal by its format and its surroundings. They learn from the corpus itself, by evidence that
is no feature of the trees: a proposal is an example for if its normalised form is valid, all others are against. Valid
is a card by its check sum, an address of a host by the size of its parts, an email by a common top-level domain, a
phone by its country code or by the numbering plan of ten-digit numbers, and a secret by an issuer's mark in front or a
name like password before it. So the trees tell which formats and surroundings go with valid content, and redact
others of the kind that no pattern describes.

Thresholds are calibrated per kind on the half of the documents that the trees have not seen, and there only on
proposals that meet no base span, as only such are added: the lowest score from which on a share of `precision` is
valid (with one invalid case more than was seen, so that few cases prove nothing), and a lower one, from a share of
`supported` on, for proposals that have the evidence themselves. An added span that overlaps a base span of any kind,
or an added one before it, is left out; all base spans stay.

All features take few values. Spark counts the proposals for each combination over the whole corpus; the trees are
grown from these counts, whose number is bounded by the combinations and not by the corpus. Base spans and proposals
are worked out once, in one pass over the texts, and written to the shared folder.

Null text is empty and has no spans. Rows are independent: repeated rows count as often as they come, and empty tables
stay empty. Extra columns stay; those named base_spans or spans are replaced. Equal scores select alike, so ties need
no order. Places count code points, from 0, with the end exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termdrift.llm.tables import fresh, without
from termdrift.scratch import written

#: The kinds of the base patterns, and all kinds, in the order of spans.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

#: What each kind looks like. Runs are possessive and start only at a run's start or where the last
#: match ended, which finds the same matches as the plain form in linear time and without deep recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators of proposals, by the kind that they propose.
PROPOSED = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|(?<=\x20)dot(?=\x20))\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:\x20?(?:\.|\[\.\]|\(\.\)|\(dot\)|\[dot\])\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"[0-9](?:[\x20._/-]?[0-9])++",
    "phone": r"\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9])++",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{12,}+|(?<=[=:][\x20\x22\x27]{0,2})[^\s\x22\x27=:]{6,}+",
}
#: What a text must hold for a generator to find anything.
SIGNS = {"email": r"@|[\[(\x20]at[\])\x20]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]", "secret": "[0-9=:]"}
#: How many digits a card and a phone have.
DIGITS = {"card": (13, 19), "phone": (9, 15)}
#: Words before a span that speak of its kind.
CUES = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address|from|login",
    "card": "card|visa|credit|debit|payment|account",
    "phone": "tel|phone|call|mobil|fax|contact|cell",
}
#: Common top-level domains, names that secrets are given, and marks that issuers put in front of theirs.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|eu|uk|de|fr|es|it|nl|ch|at|be|pl|se|no|dk|fi|pt|ie|us|ca|mx|br|ar|au|nz|jp|cn|in|kr|ru|za"
NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|auth|api.?key|access.?key|private.?key)[^A-Za-z0-9]{0,4}$"
ISSUED = r"^(?:AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk[_-][A-Za-z0-9_-]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,})"
SPANS = "array<struct<start:int,end:int,s:string>>"
FEATURES = ("size", "digits", "share", "distinct", "case", "groups", "marks", "before", "after", "cue")


def located(text: Column, pattern: str) -> Column:
    """Every match as (start, end, s): the parts between matches and the matches, laid end to end."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    laid = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("s"))), lambda x: x["s"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.length(x["s"])
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["s"].alias("s")))).alias("spans"))

    return F.aggregate(laid, start, add, lambda a: a["spans"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of s pass the check sum of payment cards."""
    d = F.reverse(_digits(s))

    def add(total: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.when(F.length(d) == 0, False).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0)


def _passes(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_like(p, F.lit("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(s)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _cheap(kind: str, text: Column, found: Column) -> Column:
    """found, but looked for only in texts that hold what any match holds."""
    sign = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.regexp_like(text, F.lit("[0-9]")))
    return F.when(sign, found).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))

    def of(kind: str) -> Column:
        return _cheap(kind, text, F.filter(located(text, BASE[kind]), lambda x: _passes(kind, x["s"])))

    return {kind: of(kind) for kind in BASE_KINDS}


def _valid(kind: str, s: Column, ahead: Column) -> Column:
    """The evidence: whether the normalised form is one of the kind's."""
    digits = _digits(s)
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(F.lower(s), r"\x20?(?:[\[(]at[\])]|(?<=\x20)at(?=\x20))\x20?", "@"), r"\x20?(?:[\[(]dot[\])]|(?<=\x20)dot(?=\x20))\x20?", ".")
        return F.regexp_like(plain, F.lit(rf"^[a-z0-9._%+-]+@[a-z0-9.-]+\.(?:{DOMAINS})$"))
    if kind == "ip":
        return F.forall(F.split(s, "[^0-9]+"), lambda p: p.cast("int") <= 255)
    if kind == "card":
        return luhn(s)
    if kind == "phone":
        return F.regexp_like(s, F.lit(r"^(?:\+|00)")) | F.regexp_like(digits, F.lit("^1?[2-9][0-9]{2}[2-9][0-9]{6}$"))
    return F.regexp_like(F.lower(ahead), F.lit(NAMES)) | F.regexp_like(s, F.lit(ISSUED))


def _side(c: Column) -> Column:
    return F.when(c == "", 0).when(F.regexp_like(c, F.lit(r"[=:\x22\x27]")), 4).when(F.regexp_like(c, F.lit("[0-9]")), 2).when(F.regexp_like(c, F.lit("[A-Za-z]")), 3).otherwise(1)


def _step(n: Column, *steps: int) -> Column:
    """How many of the steps n has reached."""
    return sum(((n >= k).cast("int") for k in steps), F.lit(0))


def proposals(text: Column, base: Column) -> Column:
    """array<struct<kind, start, end, free, valid, features...>>; base: struct of the base spans by kind. free: whether
    no base span is met."""
    text = F.coalesce(text, F.lit(""))
    none = F.lit(0)

    def described(kind: str) -> Column:
        number = kind in ("ip", "card", "phone")

        def one(x: Column) -> Column:
            s = x["s"]
            ahead = F.substr(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))
            digits = F.length(_digits(s))
            free = F.lit(True)
            for k in BASE_KINDS:
                free = free & ~F.exists(base[k], lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
            cases = F.regexp_like(s, F.lit("[A-Z]")).cast("int") + 2 * F.regexp_like(s, F.lit("[a-z]")).cast("int")
            return F.struct(
                F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), free.alias("free"), _valid(kind, s, ahead).alias("valid"),
                (none if number else _step(F.length(s), 9, 12, 16, 20, 24, 32, 40, 64)).alias("size"),
                (F.least(digits, F.lit(20)) if number else none).alias("digits"),
                (none if number else _step(digits * 10 / F.length(s), 1, 2, 4, 6, 8)).alias("share"),
                (none if number else _step(F.size(F.array_distinct(F.split(s, ""))) * 10 / F.length(s), 2, 3, 4, 6, 8)).alias("distinct"),
                (none if number else cases).alias("case"),
                (F.least(F.size(F.split(s, "[^0-9]+", -1)), F.lit(6)) if number else none).alias("groups"),
                F.least(F.length(F.regexp_replace(s, r"[A-Za-z0-9\x20+]", "")), F.lit(6)).alias("marks"),
                _side(F.right(ahead, F.lit(1))).alias("before"),
                _side(F.substr(text, x["end"] + 1, F.lit(1))).alias("after"),
                (F.regexp_like(F.lower(ahead), F.lit(CUES[kind])).cast("int") if kind in CUES else none).alias("cue"),
            )

        found = located(text, PROPOSED[kind])
        if kind in DIGITS:
            found = F.filter(found, lambda x: F.length(_digits(x["s"])).between(*DIGITS[kind]))
        return F.when(F.regexp_like(text, F.lit(SIGNS[kind])), F.transform(found, one))

    return F.concat(*[F.coalesce(described(k), F.array()) for k in KINDS])


def mark(documents: DataFrame, column: str) -> DataFrame:
    """documents with one struct column more: the base spans by kind, and the proposals."""
    base = documents.withColumn(column, F.struct(*[v.alias(k) for k, v in base_spans(F.col("text")).items()]))
    return base.withColumn(column, F.struct(F.col(column).alias("base"), proposals(F.col("text"), F.col(column)).alias("proposed")))


@dataclass
class Trees:
    """Boosted trees for the log odds of a proposal, per kind, and the odds from which a proposal is taken: that of one
    without, and of one with evidence of its own."""

    bias: dict[str, float] = field(default_factory=dict)
    splits: dict[str, list] = field(default_factory=dict)  # nested (feature, at most, low, high), or a leaf's value
    threshold: dict[str, tuple[float, float]] = field(default_factory=dict)

    def score(self, x: Column, kind: str) -> Column:
        def leaf(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            name, most, low, high = tree
            return F.when(x[name] <= most, leaf(low)).otherwise(leaf(high))

        total = F.lit(self.bias[kind])
        for tree in self.splits[kind]:
            total = total + leaf(tree)
        return total

    def selects(self, x: Column) -> Column:
        chosen = F.lit(False)
        for kind, (alone, supported) in self.threshold.items():
            least = F.when(x["valid"], supported).otherwise(alone) - 1e-9
            chosen = chosen | ((x["kind"] == kind) & (self.score(x, kind) >= least))
        return chosen


def _value(tree, row: dict) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _grow(rows: list[dict], depth: int):
    """A regression tree on the gradients g with the curvatures h, by weighted counts."""
    g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    best, found = 1e-6, None
    if depth:
        for name in FEATURES:
            sums: dict[int, list[float]] = {}
            for r in rows:
                s = sums.setdefault(r[name], [0.0, 0.0])
                s[0] += r["g"]
                s[1] += r["h"]
            a = b = 0.0
            for v in sorted(sums)[:-1]:
                a, b = a + sums[v][0], b + sums[v][1]
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best:
                    best, found = gain, (name, v)
    if found is None:
        return 0.3 * g / (h + 1)
    name, v = found
    return name, v, _grow([r for r in rows if r[name] <= v], depth - 1), _grow([r for r in rows if r[name] > v], depth - 1)


def counted(marked: DataFrame, column: str) -> list[dict]:
    """A row for each combination of half, kind and feature values: how many proposals, and how many of them are valid,
    among all and among those that meet no base span."""
    told = marked.select(F.pmod(F.xxhash64("doc_id", f"{column}.base", f"{column}.proposed"), F.lit(2)).alias("half"), F.explode(f"{column}.proposed").alias("x"))
    tally = lambda name, which: F.sum(which.cast("long")).alias(name)
    sums = told.select("half", "x.*").groupBy("half", "kind", *FEATURES).agg(
        F.count(F.lit(1)).alias("all"), tally("yes", F.col("valid")), tally("free", F.col("free")), tally("free_yes", F.col("free") & F.col("valid")))
    return [r.asDict() for r in sums.collect()]


def _least(hold: list[dict], precision: float) -> float:
    """The lowest score from which on that share of the free proposals is valid; infinite where there is none."""
    right = seen = 0
    found = math.inf
    for f in sorted({r["f"] for r in hold}, reverse=True):
        right += sum(r["free_yes"] for r in hold if r["f"] == f)
        seen += sum(r["free"] for r in hold if r["f"] == f)
        if right / (seen + 1) >= precision:
            found = f
    return found


def fit(rows: list[dict], rounds: int = 12, depth: int = 3, precision: float = 0.9, supported: float = 0.5) -> Trees:
    """Trees from the counts of all proposals of the corpus. A kind without examples for it gets none, and adds nothing."""
    trees = Trees()
    for kind in KINDS:
        own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: [r["half"], *(r[f] for f in FEATURES)])
        learn, hold = [r for r in own if r["half"] == 0], [r for r in own if r["half"] == 1]
        yes, n = sum(r["yes"] for r in learn), sum(r["all"] for r in learn)
        if not yes:
            continue
        trees.bias[kind], trees.splits[kind] = math.log((yes + 0.5) / (n - yes + 0.5)), []
        for r in own:
            r["f"] = trees.bias[kind]
        for _ in range(rounds):
            for r in learn:
                p = 1 / (1 + math.exp(-r["f"]))
                r["g"], r["h"] = r["yes"] - r["all"] * p, r["all"] * p * (1 - p)
            tree = _grow(learn, depth)
            trees.splits[kind].append(tree)
            for r in own:
                r["f"] += _value(tree, r)
        least = _least(hold, precision), _least(hold, supported)
        if least[1] < math.inf:
            trees.threshold[kind] = least
    return trees


def take(marked: DataFrame, trees: Trees, column: str) -> DataFrame:
    """marked with base_spans and spans, and without the column of marks: array<struct<kind, start, end>>, by kind as in
    KINDS, then by place."""
    plain = lambda kind, a: F.transform(a, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    marks = F.col(column)
    base = F.concat(*[plain(k, marks["base"][k]) for k in BASE_KINDS])
    if not trees.threshold:
        return marked.withColumn("base_spans", base).withColumn("spans", F.col("base_spans")).drop(column)
    taken = F.filter(marks["proposed"], lambda x: x["free"] & trees.selects(x))
    in_order = F.array_sort(F.transform(taken, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    apart = F.aggregate(
        in_order,
        F.array().cast("array<struct<kind:string,start:int,end:int>>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] > x["start"]), a).otherwise(F.concat(a, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["back"]).alias("end"))))),
    )
    found = marked.withColumn("base_spans", base).withColumn(column, apart)
    by_kind = [F.array_sort(of_kind(F.concat("base_spans", column), kind)) for kind in KINDS]
    spans = F.when(F.size(column) == 0, F.col("base_spans")).otherwise(F.concat(*by_kind))
    return found.withColumn("spans", spans).drop(column)


def find(documents: DataFrame, **fitting) -> DataFrame:
    """documents with base_spans and spans, by trees that are grown from these documents."""
    plain = without(documents, "base_spans", "spans")
    column = fresh(plain, "_marks")
    marked = written(mark(plain, column), "pii-marks")
    return take(marked, fit(counted(marked, column), **fitting), column)


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def shown(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; where spans overlap, all they cover goes, under the first's kind."""
    text = F.coalesce(text, F.lit(""))
    in_order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(a: Column, x: Column) -> Column:
        end = -x["back"]
        part = F.concat(F.substr(text, a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0))), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], end).alias("at"), F.when(x["start"] < a["at"], a["parts"]).otherwise(F.concat(a["parts"], F.array(part))).alias("parts"))

    joined = F.aggregate(in_order, begin, add, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(joined)
