"""Personal data by candidate gradient boosting, in DataFrame operations alone.

Patterns propose spans: four strict kinds, checked by their own rules, and two loose generators of high recall (numbers in
groups, addresses with spelt or spaced signs), whose spans may overlap. Boosted stumps over format and context features
score the loose ones; they learn on a bounded, hash-chosen sample of documents, where a loose span that holds a strict
one of its kind is an example and one that holds a strict one of another kind, or fails the kind's rules, is a counter-example.
Since a loose address never fails so, the sample's own text gives more of both: its strict addresses respelt in the loose
forms are examples; its sentence ends with a sign for "at" put in (`we met (at) noon. Then`) are counter-examples.
A threshold is calibrated on the held-back half of that sample, and a loose span above it that meets no strict span is
redacted too. The stumps become a column expression, so that scoring stays in the engine. Documents are read where
they lie: spans and their positions are arrays of the row, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 4000  # expected number of documents that the stumps learn on
TRAIN_SPANS = 20_000  # and the most spans of these
PLANTED_SPANS = 2000  # and the most that _planted() adds of examples and of counter-examples
ROUNDS = 24
PRECISION = 0.99  # that the threshold is calibrated to

#: Each finds the leftmost non-overlapping matches of its kind's base pattern (of `card` those of 16 digits and more), with
#: possessive quantifiers and looks behind in place of retries, so that time stays linear in very long texts.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "phone": r"[(+0-9](?<![0-9+(.@_-][(+0-9])(?:[\x20().-]{0,3}[0-9]){6,18}+(?![0-9@_])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[(\[{]\x20?at\x20?[)\]}])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[{]\x20?dot\x20?[)\]}])\x20?[A-Za-z0-9-]{1,63}+){1,5}+",
}
FEATURES = ("digits", "letters", "signs", "groups", "last", "longest", "brackets", "capital", "cue")
#: Words before a span that speak of it.
CUES = r"(?i)(?:phone|call|tel|fax|mobile|mail|contact|reach|write|whatsapp|sms)[^A-Za-z]{0,3}(?:\w{0,4}[^A-Za-z]{0,3})?$"


def _starts(gaps: Column, found: Column) -> Column:
    """Start of each match from the pieces between matches; running sums over blocks of 256 keep this linear in practice."""
    sizes = F.zip_with(gaps, F.concat(F.array(F.lit("")), found), lambda gap, before: F.length(gap) + F.length(before))
    blocked = F.aggregate(
        sizes, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("own"), F.array().cast("array<array<int>>").alias("full")),
        lambda a, x: F.when(F.size(a["own"]) < 255, F.struct((a["sum"] + x).alias("sum"), F.array_append(a["own"], a["sum"] + x).alias("own"), a["full"].alias("full")))
        .otherwise(F.struct((a["sum"] + x).alias("sum"), F.array().cast("array<int>").alias("own"), F.array_append(a["full"], F.array_append(a["own"], a["sum"] + x)).alias("full"))),
        lambda a: F.flatten(F.array_append(a["full"], a["own"])),
    )
    return F.slice(blocked, F.lit(1), F.size(found))


def _find(text: str, kind: str, pattern: str, names: tuple[str, str], might: Column, frame: DataFrame) -> DataFrame:
    """Add arrays of matches and of their starts (code points)."""
    found, starts = names
    frame = frame.withColumn(found, F.when(might, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    gaps = F.split(text, pattern, -1)
    return frame.withColumn(starts, F.when(F.size(found) > 0, _starts(gaps, F.col(found))).otherwise(F.array().cast("array<int>")))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(s, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return s + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _holds(kind: str, x: Column) -> Column:
    """Whether a strict match passes its kind's rules."""
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))"
        return x.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(x)).between(16, 19) & _luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _span(kind: str, text: Column, start: Column) -> Column:
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.cast("int").alias("begin"), (start + F.length(text)).cast("int").alias("end"))


def _strict(docs: DataFrame) -> DataFrame:
    """docs with `base`, the strict spans by kind and start."""
    text = F.col("_text")
    frame = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    might = {"email": text.contains("@"), "ip": F.lit(True), "card": F.lit(True), "phone": text.contains("+")}
    parts = []
    for kind, pattern in STRICT.items():
        frame = _find("_text", kind, pattern, (f"_{kind}", f"_{kind}_at"), might[kind], frame)
        pairs = F.zip_with(f"_{kind}", f"_{kind}_at", lambda x, at: F.struct(x.alias("x"), at.alias("at")))
        parts.append(F.transform(F.filter(pairs, _keeps(kind)), _spans(kind)))
    frame = frame.withColumn("base", F.concat(*parts)).withColumn("_masked", F.col("_text"))
    for kind, pattern in STRICT.items():  # what a loose span may still cover, at the same positions
        found = F.concat(F.transform(F.regexp_extract_all("_masked", F.lit(pattern), F.lit(0)), _hidden(kind)), F.array(F.lit("")))
        hidden = F.array_join(F.zip_with(F.split("_masked", pattern, -1), found, lambda gap, x: F.concat(gap, x)), "")
        frame = frame.withColumn("_masked", F.when(F.size(f"_{kind}") > 0, hidden).otherwise(F.col("_masked")))
    return frame.drop(*(f"_{k}{s}" for k in STRICT for s in ("", "_at")))


def _hidden(kind: str):
    return lambda x: F.when(_holds(kind, x), F.repeat(F.lit("\x01"), F.length(x))).otherwise(x)


def _keeps(kind: str):
    return lambda p: _holds(kind, p["x"])


def _spans(kind: str):
    return lambda p: _span(kind, p["x"], p["at"])


def _meets(a: Column, b: Column) -> Column:
    return (a["begin"] < b["end"]) & (b["begin"] < a["end"])


def _candidates(frame: DataFrame, column: str) -> DataFrame:
    """Add `loose`: the loose spans of a column of texts, with their features."""
    text = F.col(column)
    might = {"phone": text.rlike(r"[0-9][\x20().-]{0,3}[0-9][\x20().-]{0,3}[0-9]"), "email": text.contains("@") | text.rlike(r"(?i)[(\[{] ?at ?[)\]}]")}
    parts = []
    for kind, pattern in LOOSE.items():
        frame = _find(column, kind, pattern, (f"_{kind}", f"_{kind}_at"), might[kind], frame)
        parts.append(F.zip_with(f"_{kind}", f"_{kind}_at", _described(kind, column)))
    return frame.withColumn("loose", F.concat(*parts)).drop(*(f"_{k}{s}" for k in LOOSE for s in ("", "_at")))


def _described(kind: str, column: str):
    def described(x, at):
        groups = F.split(F.regexp_replace(x, r"^[^0-9A-Za-z]+", ""), r"[^0-9A-Za-z]+", -1)
        sizes = F.transform(groups, lambda g: F.length(g))
        span = _span(kind, x, at)
        values = {
            "digits": F.length(_digits(x)), "letters": F.length(F.regexp_replace(x, "[^A-Za-z]", "")), "signs": F.length(F.regexp_replace(x, "[0-9A-Za-z]", "")) - F.when(x.startswith("+"), 1).otherwise(0),
            "groups": F.size(groups), "last": F.element_at(sizes, -1), "longest": F.array_max(sizes), "brackets": F.length(F.regexp_replace(x, r"[^()\[\]{}]", "")),
            "capital": x.rlike("[A-Z]").cast("int"), "cue": F.substring(column, F.greatest(at - 24, F.lit(0)) + 1, F.least(at, F.lit(24))).rlike(CUES).cast("int"),
        }
        ok = F.length(_digits(x)).between(8, 15) if kind == "phone" else F.lit(True)
        return F.struct(span["kind"].alias("kind"), span["begin"].alias("begin"), span["end"].alias("end"), x.alias("x"), ok.alias("ok"), *(v.cast("int").alias(k) for k, v in values.items()))

    return described


def _example(c: Column) -> Column:
    """1 if a loose span holds a strict one of its kind, 0 if it holds one of another kind or fails its kind's rules, else null."""
    holds = {k: _holds(k, F.regexp_extract(c["x"], STRICT[k], 0)) & (F.regexp_extract(c["x"], STRICT[k], 0) != "") for k in STRICT}
    mine = F.lit(False)
    for k in LOOSE:
        mine = mine | ((c["kind"] == KINDS.index(k)) & holds[k])
    other = F.lit(False)
    for k in STRICT:
        other = other | ((c["kind"] != KINDS.index(k)) & holds[k])
    return F.when(mine, 1).when(other | ~c["ok"], 0)


#: Spellings of an address: for its @ and for the dots of its domain.
SPELT = [(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" @ ", "."), (" @ ", " . "), ("[at]", ".")]
#: Signs for "at" in prose, which no domain follows.
PROSE = [" @ ", " (at) ", " [at] ", " @"]


def _planted(texts: DataFrame) -> DataFrame:
    """(doc, c, y) from texts(_text): respelt strict addresses with what stands before them (1), sentence ends with a sign for "at" (0)."""
    before = r"([^@]{0,24}(?<![A-Za-z0-9._%+-]))"
    mails = F.regexp_extract_all("_text", F.lit(before + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"), F.lit(0))
    ends = F.regexp_extract_all("_text", F.lit(r"(?<![A-Za-z])[A-Za-z]{1,20}+ [A-Za-z]{1,20}+\. ?[A-Za-z]{1,20}+"), F.lit(0))
    doc = F.xxhash64("_text").alias("doc")
    pick = lambda styles: F.pmod(F.xxhash64("raw"), F.lit(len(styles)))
    found = texts.where(F.col("_text").contains("@")).select(doc, F.explode(mails).alias("raw"))
    name, domain = F.substring_index("raw", "@", 1), F.substring_index("raw", "@", -1)
    style = pick(SPELT)
    at, dot = (F.element_at(F.array(*(F.lit(s[i]) for s in SPELT)), (style + 1).cast("int")) for i in (0, 1))
    yes = found.select("doc", F.concat(name, at, F.replace(domain, F.lit("."), dot)).alias("_text"), F.lit(1).alias("y"))
    prose = texts.select(doc, F.explode(F.slice(ends, 1, 4)).alias("raw"))
    sign = F.element_at(F.array(*(F.lit(s) for s in PROSE)), (pick(PROSE) + 1).cast("int"))
    no = prose.select("doc", F.concat(F.substring_index("raw", " ", 1), sign, F.expr("substring(raw, instr(raw, ' ') + 1)")).alias("_text"), F.lit(0).alias("y"))
    spans = _candidates(yes.unionByName(no), "_text").select("doc", "y", F.length("_text").alias("size"), F.explode("loose").alias("c"))
    return spans.where((F.col("c.kind") == KINDS.index("email")) & (F.col("c.end") == F.col("size"))).select("doc", "c", "y")


def _boost(rows: list[tuple[list[int], int]], rounds: int = ROUNDS) -> list[tuple[int, float, float, float]]:
    """Newton-boosted stumps (feature, cut, value up to it, value above) for (features, label)."""
    margin = [0.0] * len(rows)
    stumps = []
    for _ in range(rounds):
        slope = [y - 1 / (1 + math.exp(-m)) for (_, y), m in zip(rows, margin)]
        curve = [max(1e-6, abs(s) * (1 - abs(s))) for s in slope]
        best = None
        g, h = sum(slope), sum(curve)
        for f in range(len(FEATURES)):
            sums: dict[int, list[float]] = {}
            for (x, _), s, c in zip(rows, slope, curve):
                t = sums.setdefault(x[f], [0.0, 0.0])
                t[0] += s
                t[1] += c
            gl = hl = 0.0
            values = sorted(sums)
            for v, above in zip(values, values[1:]):
                gl, hl = gl + sums[v][0], hl + sums[v][1]
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1)
                if best is None or gain > best[0] + 1e-12:
                    best = gain, f, (v + above) / 2, 0.3 * gl / (hl + 1), 0.3 * (g - gl) / (h - hl + 1)
        if best is None:
            break
        _, f, cut, low, high = best
        stumps.append((f, cut, low, high))
        margin = [m + (low if x[f] <= cut else high) for (x, _), m in zip(rows, margin)]
    return stumps


def _margin(stumps: list[tuple[int, float, float, float]], x: list[int]) -> float:
    return sum(low if x[f] <= cut else high for f, cut, low, high in stumps)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict[str, tuple[list, float]]:
    """Per loose kind its stumps and the least margin to redact; kinds without both sorts of examples never redact."""
    total = docs.count()
    if not total:
        return {}
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, train_docs / total)))
    texts = chosen.select(F.coalesce("text", F.lit("")).alias("_text"))
    spans = _candidates(texts, "_text").select(F.xxhash64("_text").alias("doc"), F.explode("loose").alias("c"))
    order = F.xxhash64("doc", "c.begin", "c.x"), "doc", "c.begin", "c.x", "y"
    rows = spans.withColumn("y", _example(F.col("c"))).where("y is not null").orderBy(F.xxhash64("doc", "c.begin"), "doc", "c.begin").limit(TRAIN_SPANS).collect()
    planted = _planted(texts)
    for y in (1, 0):  # a bounded number of each, so that common prose doesn't displace addresses
        rows += planted.where(F.col("y") == y).orderBy(*order).limit(PLANTED_SPANS).collect()
    out = {}
    for kind in LOOSE:
        mine = [([r.c[f] for f in FEATURES], int(r.y), r.doc % 2) for r in rows if KINDS[r.c.kind] == kind]
        fitted, held = ([(x, y) for x, y, half in mine if half == k] for k in (0, 1))
        if not all(any(y == v for _, y in part) for part in (fitted, held) for v in (0, 1)):
            continue
        stumps = _boost(fitted)
        scored = sorted(((_margin(stumps, x), y) for x, y in held), reverse=True)
        hits, least = 0, math.inf
        for i, (m, y) in enumerate(scored):
            hits += y
            if hits >= PRECISION * (i + 1) and (i + 1 == len(scored) or scored[i + 1][0] < m):
                least = m
        out[kind] = stumps, max(least, 0.0)
    return out


def _scores(model: dict[str, tuple[list, float]], c: Column) -> Column:
    """Whether a loose span is redacted."""
    out = F.lit(False)
    for kind, (stumps, least) in model.items():
        if math.isinf(least):
            continue
        margin = F.lit(0.0)
        for f, cut, low, high in stumps:
            margin = margin + F.when(c[FEATURES[f]] <= cut, low).otherwise(high)
        out = out | ((c["kind"] == KINDS.index(kind)) & c["ok"] & (margin >= least - 1e-9))
    return out


def find(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """docs(doc_id, text) with `base` and `spans`: arrays of (kind, begin, end), kinds numbered as in KINDS, by kind and begin.

    base holds the strict spans; spans adds the redacted loose ones that meet none of these. Positions are code points, the
    end is exclusive. A null text counts as empty; rows keep their order and number, other columns are dropped.
    """
    model = fit(docs, train_docs)
    frame = _strict(docs.select("doc_id", "text"))
    if model:
        frame = _candidates(frame, "_masked")
        fresh = F.filter(F.filter("loose", lambda c: _scores(model, c)), lambda c: ~F.exists("base", lambda b: _meets(b, c)))
        added = F.transform(fresh, lambda c: F.struct(c["kind"].alias("kind"), c["begin"].alias("begin"), c["end"].alias("end")))
        frame = frame.withColumn("spans", F.when(F.size("loose") > 0, F.array_sort(F.concat("base", added))).otherwise(F.col("base")))
    else:
        frame = frame.withColumn("spans", F.col("base"))
    return frame.select("doc_id", "text", "base", "spans")


def redact(found: DataFrame, mark: str = "*") -> DataFrame:
    """find()'s rows with `redacted`: text with each character inside a span replaced by the mark; texts without spans as they are."""
    at = lambda i: F.exists("spans", lambda s: (s["begin"] <= i) & (i < s["end"]))
    masked = F.array_join(F.transform(F.split("text", "", -1), lambda ch, i: F.when(at(i), F.lit(mark)).otherwise(ch)), "")
    return found.withColumn("redacted", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the strict spans by kind, their digest, and all spans, as `kind:start:end` joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["begin"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))
