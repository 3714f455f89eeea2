"""Operator 9: personal data by boosted trees over candidate spans, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityflow.llm.common import settle

KINDS = ("email", "ip", "card", "phone")

# Base patterns. They find the same leftmost, non-overlapping matches as the plain forms, but with possessive
# repeats and starts only where a run begins, so that a long run is read once. Card runs of fewer than 12 digits
# are never matches.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall generators: spelled-out addresses, hexadecimal hosts, other separators, numbers without a country sign.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++|(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){11,}+",
    "phone": r"(?<![0-9])\+?[0-9](?:[\x20()./-]{0,3}[0-9]){6,}+",
}
# Words before a span that speak for a kind, in the order of KINDS.
CUES = (
    r"(?i)(?:mail|contact|write to)\W*$",
    r"(?i)(?:\bip|host|server|address)\W*$",
    r"(?i)(?:card|visa|credit|account)\W*$",
    r"(?i)(?:tel|phone|call|fax|mobile|cell)\W*$",
)

# Each feature is a small number, so that the table of all their combinations is bounded. None of them tells a rewritten
# base match from what the generators find; styles are digits and signs, spelled out, eight groups, other groups.
FEATURES = {"kind": 4, "digits": 6, "groups": 5, "longest": 5, "marks": 16, "luhn": 2, "cue": 3, "before": 3, "after": 3, "style": 4}
#: Rows that the fit can be given at most: combinations, label, fold, and whether the span was rewritten.
MOST_ROWS = 8 * math.prod(FEATURES.values())
ROUNDS, DEPTH, RATE, RIDGE = 30, 3, 0.3, 1.0
#: A kind's threshold is the lowest score at which so many of the rewritten matches and negatives kept for calibration
#: are matches.
PRECISION = 0.98


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """The expression of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, add: Callable[[Column, Column], Column] = lambda a, b: a + b, first: int = 0) -> Column:
    """Sums (or what ``add`` makes) of all elements before each one, and of all: one element more. Blocks keep it near
    linear."""
    step = 256

    def plain(xs: Column) -> Column:
        zero = F.array(F.lit(first).cast("long"))
        return F.aggregate(xs, zero, lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / step).cast("int")), lambda b: F.slice(values, b * step + 1, step))
    inner = F.transform(blocks, plain)
    bases = plain(F.transform(inner, lambda x: F.element_at(x, -1)))
    shift = lambda xs, b: F.transform(F.slice(xs, 1, F.size(xs) - 1), lambda x: add(b, x))
    shifted = F.zip_with(inner, F.slice(bases, 1, F.size(blocks)), shift)
    return F.concat(F.flatten(shifted), F.array(F.element_at(bases, -1)))


def spans(text: Column, pattern: str) -> Column:
    """All matches: array of (start, end, value, left, right), in code points, with 24 characters before and 1 after."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def place(pair: Column) -> Column:
        found, between = pair["values"], pair["gaps"]
        # gap, match, gap, match ...: the match i ends where the gap i + 1 begins
        lengths = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, v: (F.char_length(g) + F.char_length(v)).cast("long"))

        def cut(ends: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                end = F.get(ends, i + 1)
                return F.struct(
                    (end - F.char_length(v)).alias("start"), end.alias("end"), v.alias("value"),
                    F.right(F.get(between, i), F.lit(24)).alias("left"), F.left(F.get(between, i + 1), F.lit(1)).alias("right"),
                )

            return F.transform(found, one)

        return F.element_at(F.transform(F.array(_running(lengths)), cut), 1)

    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>)")
    pair = F.struct(values.alias("values"), gaps.alias("gaps"))
    found = F.element_at(F.transform(F.array(pair), lambda p: F.when(F.size(p["values"]) > 0, place(p)).otherwise(empty)), 1)
    return F.when(text.rlike(pattern), found).otherwise(empty)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether 12 to 19 digits pass Luhn's check."""

    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, F.char_length(d) - i, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(0), F.char_length(d) - 1), F.lit(0), add) % 10 == 0

    n = F.char_length(digits(value))
    checked = F.element_at(F.transform(F.array(digits(value)), total), 1)
    return F.when(n.between(12, 19), checked).otherwise(F.lit(False))


def holds(kind: str, value: Column) -> Column:
    """The condition that a base match of the kind must meet."""
    if kind == "ip":
        parts = F.split(value, r"\.")
        return F.forall(parts, lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.char_length(digits(value)).between(9, 15)
    return F.lit(True)


def _steps(value: Column, *bounds: int) -> Column:
    """How many bounds the value exceeds."""
    return sum(((value > b).cast("int") for b in bounds[1:]), (value > bounds[0]).cast("int"))


def _features(kind: int, s: Column) -> Column:
    value, groups = s["value"], F.regexp_extract_all(s["value"], F.lit("[0-9]+"), F.lit(0))
    marks = [value.contains(" "), value.contains("-"), value.contains("."), value.contains("(")]
    edge = lambda c: F.when(c.rlike("^[\\x20\\n]?$"), 0).when(c.rlike("[\\p{L}0-9]"), 1).otherwise(2)
    other = "|".join(c.removeprefix("(?i)") for i, c in enumerate(CUES) if i != kind)
    return F.struct(
        s["start"].alias("start"),
        s["end"].alias("end"),
        F.lit(kind).alias("kind"),
        _steps(F.char_length(digits(value)), 6, 8, 11, 15, 19).alias("digits"),
        _steps(F.size(groups), 1, 2, 3, 4).alias("groups"),
        _steps(F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0)), 2, 3, 4, 11).alias("longest"),
        sum((m.cast("int") * 2**i for i, m in enumerate(marks)), F.lit(0)).alias("marks"),
        luhn(value).cast("int").alias("luhn"),
        F.when(s["left"].rlike(CUES[kind]), 1).when(s["left"].rlike(f"(?i)(?:{other})"), 2).otherwise(0).alias("cue"),
        edge(F.right(s["left"], F.lit(1))).alias("before"),
        edge(s["right"]).alias("after"),
        F.when(F.size(F.split(value, ":")) == 8, 2).when(value.contains(":"), 3)
        .when(F.lit(kind == 0) & value.rlike(r"\x20(?:at|dot)\x20|[(\[](?:at|dot)[)\]]"), 1).otherwise(0).alias("style"),
    )


def _span(s: Column, kind: Column) -> Column:
    return F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"))


def _rewritten(kind: str, value: Column) -> Column:
    """A base match as the base pattern doesn't find it: spelled out, in hexadecimal groups, with other separators, without
    its sign."""
    if kind == "email":
        return F.replace(F.replace(value, F.lit("@"), F.lit(" at ")), F.lit("."), F.lit(" dot "))
    if kind == "ip":
        return F.regexp_replace(F.md5(value), "([0-9a-f]{4})(?=[0-9a-f])", "$1:")
    if kind == "card":
        plain = F.regexp_replace(value, r"([0-9]{4})(?=[0-9])", "$1.")
        return F.when(value.rlike("[ -]"), F.regexp_replace(value, "[ -]", ".")).otherwise(plain)
    return F.ltrim(value, F.lit("+"))


def _proposed(kind: int) -> Column:
    """What base pattern and generator of a kind propose, a span once: structs of features, label and two flags.

    The label is 1 for valid base matches and for what these would be if they were rewritten (``made``; those are only
    learned from), 0 for what fails the condition of its kind, and for generated spans of the common style that no word of
    their kind comes before. Other generated spans have none.
    """
    name, every = KINDS[kind], "struct<start:bigint,end:bigint,source:int,s:struct<start:bigint,end:bigint,value:string,left:string,right:string>>"
    tagged = lambda source, c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(source).alias("source"), s.alias("s")))
    ordered = F.array_sort(F.concat(tagged(0, F.col(f"b{kind}")), tagged(1, F.col(f"w{kind}"))).cast(f"array<{every}>"))

    def once(xs: Column) -> Column:
        """Generated spans that a base match has too stand right behind it."""
        def fresh(x: Column, i: Column) -> Column:
            before = F.get(xs, i - 1)
            same = (before["start"] == x["start"]) & (before["end"] == x["end"])
            return (x["source"] == 0) | ~F.coalesce(same, F.lit(False))

        return F.filter(xs, fresh)

    fields = ("start", "end", "value", "left", "right")

    def with_rewritten(x: Column) -> Column:
        """A proposed span, and behind it what it would be if it were rewritten, if it is a valid base match."""
        changed = F.struct(*[(_rewritten(name, x["s"][f]) if f == "value" else x["s"][f]).alias(f) for f in fields])
        one = lambda s, base, made: F.struct(s.alias("s"), x["source"].alias("source"), base.alias("base"), F.lit(made).alias("made"))
        valid = F.coalesce((x["source"] == 0) & holds(name, x["s"]["value"]), F.lit(False))
        own = lambda v: F.when(v, F.array(one(x["s"], v, False), one(changed, ~v, True))).otherwise(F.array(one(x["s"], v, False)))
        return _let(valid, own)

    def judged(x: Column) -> Column:
        s, c = x["s"], _features(kind, x["s"])

        def label(c: Column) -> Column:
            wrong = c["luhn"] == 0 if name == "card" else ~holds(name, s["value"]) if name == "ip" else F.lit(False)
            sure = F.when(c["style"] == 3, 0).when(c["style"] > 0, F.lit(None)).when(wrong | (c["cue"] != 1), 0)
            found = F.when(x["base"] | x["made"], 1).when(x["source"] == 0, 0).otherwise(sure)
            return F.struct(c.alias("c"), found.cast("int").alias("label"), x["base"].alias("base"), x["made"].alias("made"))

        return _let(c, label)

    def all_of(xs: Column) -> Column:
        return F.transform(F.flatten(F.transform(xs, with_rewritten)), judged)

    return _let(_let(ordered, once), all_of)


def candidates(docs: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, base, found) and kept columns: valid base spans (start, kind, end), and all candidates (see ``_proposed``)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*kept, F.col("doc_id").cast("long").alias("_id"), text.alias("_text"))
    found = [spans(F.col("_text"), p[k]).alias(f"{name}{i}") for name, p in (("b", BASE), ("w", WIDE)) for i, k in enumerate(KINDS)]
    rows = rows.select(*kept, F.col("_id").alias("doc_id"), *found)
    rows = rows.select(*kept, "doc_id", F.concat(*[_proposed(i) for i in range(len(KINDS))]).alias("found"))
    base = F.transform(F.filter("found", lambda x: x["base"]), lambda x: _span(x["c"], x["c"]["kind"]))
    return rows.withColumn("base", F.sort_array(base))


@dataclass
class Model:
    """Boosted trees as one SQL expression over a candidate ``x.c``, and a threshold for each kind."""

    score: str
    thresholds: list[float]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple[np.ndarray, str]:
    """A regression tree on gradients: its value for each row, and as SQL."""
    gain, split = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + RIDGE)
    for f, n in enumerate(FEATURES.values()):
        left_g, left_h = (np.bincount(x[:, f], v, n).cumsum()[:-1] for v in (g, h))
        parts = left_g**2 / (left_h + RIDGE) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + RIDGE)
        if depth and len(parts) and parts.max() - whole > gain:
            gain, split = parts.max() - whole, (f, int(parts.argmax()))
    if split is None:
        value = -RATE * g.sum() / (h.sum() + RIDGE)
        return np.full(len(x), value), f"{value:.6f}D"
    f, at = split
    here, out = x[:, f] <= at, np.zeros(len(x))
    out[here], low = _grow(x[here], g[here], h[here], depth - 1)
    out[~here], high = _grow(x[~here], g[~here], h[~here], depth - 1)
    return out, f"if(x.c.{list(FEATURES)[f]} <= {at}, {low}, {high})"


def fit(found: DataFrame) -> Model:
    """Boosted trees from the counts of all labelled candidates by features and label.

    Spark counts equal candidates first, so the driver sees at most MOST_ROWS rows however many
    documents there are. A fifth of the documents, chosen by a hash of doc_id, only calibrates, by rewritten matches
    and negatives. Without these nothing is ever added.
    """
    fold = (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("fold")
    rows = found.select(fold, F.inline("found")).where("label is not null").select("fold", "label", "made", "c.*")
    keys = (*FEATURES, "label", "made", "fold")
    table = rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys).collect()
    if not table:
        return Model("0.0D", [math.inf] * len(KINDS))
    x = np.array([[r[f] for f in FEATURES] for r in table])
    y, w, kept, made = (np.array([r[c] for r in table], float) for c in ("label", "n", "fold", "made"))
    train, raw, trees = w * (1 - kept), np.zeros(len(x)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        value, sql = _grow(x, (p - y) * train, p * (1 - p) * train, DEPTH)
        raw += value
        trees.append(sql)
    thresholds = []
    for kind in range(len(KINDS)):
        own = (x[:, 0] == kind) & (kept == 1) & ((made == 1) | (y == 0))
        levels = [s for s in np.unique(raw[own]) if (w * y)[own & (raw >= s)].sum() >= PRECISION * w[own & (raw >= s)].sum()]
        thresholds.append(max(0.0, float(min(levels)) - 1e-4) if levels else math.inf)
    return Model(" + ".join(trees), thresholds)


def find(docs: DataFrame, *kept: str) -> DataFrame:
    """(doc_id, base, spans) of every row: sorted arrays of (start, kind, end), kind counting in KINDS; kept columns stay beside them.

    Generators with high recall propose overlapping spans, valid base matches among them; boosted
    trees, learned from base matches in rewritten forms against real negatives, score them by format and context; a
    kind's spans at or above its calibrated threshold are taken unless they overlap a base span or fail the condition
    of their kind (a card's check digit, an address's octets). Base spans always stay. Whole texts are read;
    null texts are empty; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    rows = settle(candidates(docs, *kept), "personal-candidates")
    model = fit(rows)
    bars = "array(" + ",".join(f"{'double(\"inf\")' if math.isinf(t) else f'{t:.6f}D'}" for t in model.thresholds) + ")"
    fails = "(x.c.kind = 2 and x.c.luhn = 0) or (x.c.kind = 1 and coalesce(x.label, 1) = 0)"
    taken = F.expr(f"filter(found, x -> not x.base and not x.made and not ({fails}) and {model.score} >= get({bars}, x.c.kind))")
    more = F.transform(_clear(taken, F.col("base")), lambda x: _span(x["c"], x["c"]["kind"]))
    return rows.select(*kept, "doc_id", "base", F.sort_array(F.array_distinct(F.concat("base", more))).alias("spans"))


def _clear(taken: Column, base: Column) -> Column:
    """The taken candidates that overlap no base span: of the base spans that begin before a candidate ends, none may reach
    beyond its start. All begins and ends are sorted once, so texts of many spans take no longer than sorting."""
    none = F.filter(taken, lambda x: F.lit(False))
    event = lambda pos, kind, reach, x: F.struct(pos.alias("pos"), F.lit(kind).alias("kind"), reach.cast("long").alias("reach"), x.alias("x"))
    begins = F.transform(base, lambda b: event(b["start"], 1, b["end"], F.get(none, F.lit(0))))
    ends = F.transform(taken, lambda x: event(x["c"]["end"], 0, F.lit(-1), x))

    def left(events: Column) -> Column:
        def with_reach(reach: Column) -> Column:
            good = F.filter(events, lambda e, i: (e["kind"] == 0) & (F.get(reach, i) <= e["x"]["c"]["start"]))
            return F.transform(good, lambda e: e["x"])

        return _let(_running(F.transform(events, lambda e: e["reach"]), F.greatest, -1), with_reach)

    return F.when(F.size(taken) > 0, _let(F.array_sort(F.concat(begins, ends)), left)).otherwise(none)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span in ``text`` replaced by its kind in brackets; overlapping spans count as the first of them.

    All other columns and all rows stay; a null text stays null.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # no name of the table meets one used here
    whole = docs.select(row.alias("_row")).select("_row", "_row.doc_id", "_row.text")
    rows = find(whole, "_row").select("_row", "spans")
    text = F.col("_row.text").cast("string")
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.get(marks, s["kind"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    clean = F.when(F.size("spans") == 0, text).otherwise(F.aggregate("spans", begin, step, rest))
    return rows.select(*[clean.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def listed(name: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(name, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def span_digests(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a digest of them, and all spans as text, of every row."""
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return find(docs).select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
