"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs the votes, a span classifier decides.

Candidates come from the base patterns and from looser ones (written-out
addresses, national phone numbers, named secrets).  Labelers of three kinds vote
yes, no or nothing on each: format rules, gazetteers (top-level domains, calling
codes, issuer prefixes, secret names) and the words and characters around it.
Expectation-maximisation over the counts of vote patterns estimates every
labeler's reliability without labels.  A logistic span classifier is then
trained on the posteriors, over votes and the span's shape, and decides on the
candidates that are not base findings; base findings always stay.

Everything on tables is column expressions.  What reaches the driver are counts
of vote and shape patterns, whose number is bounded by the labelers' and
buckets' product, not by the data.

Patterns are written without runs that can be tried from every position
(lookbehind or the end of the last match, possessive runs), so long texts cost
in proportion to their length; they find what the plain patterns find.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import fresh, let, saved, table, whole

#: kinds in the order of results
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

_LOCAL = "A-Za-z0-9._%+-"

# fixed values: gazetteers
TOP_LEVEL = "com org net edu gov int info biz io de fr es uk eu us ca ch at it nl be pl se no".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 55 61 81 82 86 90 91 351 353 358".split()
SECRET_NAMES = "password passwd pwd token secret api_key apikey access_key".split()
CONTEXT = {
    "email": "mail email e-mail contact write correo kontakt courriel",
    "ip": "ip address server host login dirección adresse",
    "card": "card visa mastercard credit karte carte tarjeta pay",
    "phone": "phone call tel mobile fax telefon téléphone teléfono",
    "secret": "key login auth credential aws config",
}


@dataclass(frozen=True)
class Pattern:
    """A candidate pattern: ``gate`` is a cheap test that every text with a match passes."""

    kind: str
    regex: str
    gate: str
    base: bool


PATTERNS = (
    Pattern("email", f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@", True),
    Pattern("ip", "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "[0-9]\\.[0-9]", True),
    Pattern("card", "[0-9](?:[\\x20-]?[0-9])++", "[0-9](?:[\\x20-]?[0-9]){11}", True),
    Pattern("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "\\+[0-9]", True),
    Pattern("email", f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++\\x20?[(\\[]\\x20?(?i:at)\\x20?[)\\]]\\x20?[A-Za-z0-9-]++(?:\\x20?(?:[(\\[]\\x20?(?i:dot)\\x20?[)\\]]|\\.)\\x20?[A-Za-z0-9-]++)++",
            "[(\\[]\\x20?(?i:at)\\x20?[)\\]]", False),
    Pattern("phone", "(?<![0-9A-Za-z.+)-])(?<!\\+[0-9]{1,3}\\x20)\\(?[0-9]{3}\\)?[\\x20.-][0-9]{3}[\\x20.-][0-9]{4}(?![0-9A-Za-z-])",
            "[0-9]{3}\\)?[\\x20.-][0-9]{3}[\\x20.-][0-9]{4}", False),
    Pattern("secret", "(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", "AKIA[0-9A-Z]{16}", False),
    Pattern("secret", f"(?<![A-Za-z0-9])(?i:{'|'.join(SECRET_NAMES)})\"?\\x20?[=:]\\x20?\"?[A-Za-z0-9_+/-]{{8,}}+\"?",
            f"(?i:{'|'.join(SECRET_NAMES)})\"?\\x20?[=:]", False),
)

VOTES = ("form", "list", "near", "edge", "size")


def _luhn(digits: Column) -> Column:
    """Whether the digits' check sum is right."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # parts of any number of leading zeros, at most 255
        part = "0*+(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])|(?<=0))"
        return m.rlike(f"^{part}(?:\\.{part}){{3}}$")
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _worth(p: Pattern, m: Column) -> Column:
    """Which matches that are not base findings stay candidates."""
    if p.kind == "card":
        return F.length(_digits(m)).between(12, 19)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _votes(p: Pattern, m: Column, ok: Column, before: Column, after: Column) -> dict[str, Column]:
    digits = F.length(_digits(m))
    if p.kind == "email":
        top = F.lower(F.substring_index(m, ".", -1))
        listed = _vote(top.isin(TOP_LEVEL), ~top.rlike("^[a-z]{2,}$"))
        size = _vote(F.length(m).between(6, 60), F.length(m) > 120)
    elif p.kind == "phone":
        code = F.regexp_extract(m, f"^\\+({'|'.join(sorted(CALLING_CODES, key=lambda c: (-len(c), c)))})", 1)
        listed = _vote(code != "", m.startswith("+"))
        size = _vote(digits.between(10, 13), ~digits.between(8, 15))
    elif p.kind == "card":
        listed = _vote(_digits(m).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"), _digits(m).rlike("^(?:0|[789])"))
        size = _vote(digits.isin(15, 16), digits.isin(12, 17, 18))
    elif p.kind == "ip":
        listed = _vote(~m.rlike("^(?:0|127|255|22[4-9]|23[0-9])\\."), m.rlike("^(?:0|255)\\."))
        size = _vote(F.length(m).between(9, 15), F.length(m) > 15)
    else:
        name = F.lower(F.regexp_extract(m, "^([A-Za-z_]+)", 1))
        listed = _vote(name.isin(SECRET_NAMES) | m.startswith("AKIA"), F.lit(False))
        size = _vote(F.length(m).between(16, 80), F.length(m) > 200)
    cue = "(?i)(?<![\\p{L}])(?:" + "|".join(CONTEXT[p.kind].split()) + ")(?![\\p{L}])"
    glued = before.rlike("[\\p{L}0-9]$") | after.rlike("^[\\p{L}0-9]")
    return {
        "form": _vote(ok, ~ok),
        "list": listed,
        "near": _vote(before.rlike(cue), F.lit(False)),
        "edge": _vote(~glued, glued),
        "size": size,
    }


def _found(text: Column, p: Pattern) -> Column:
    """Candidates of one pattern: start, kind, end (code points), base, votes and shape."""

    def build(matches: Column, pieces: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

        def move(a: Column, i: Column) -> Column:
            start = a["at"] + F.length(F.get(pieces, i))
            return F.struct((start + F.length(F.get(matches, i))).alias("at"), F.concat(a["starts"], F.array(start)).alias("starts"))

        starts = F.aggregate(F.transform(matches, lambda m, i: i), begin, move)["starts"]

        def one(s: Column, m: Column, i: Column) -> Column:
            ok = _valid(p.kind, m)
            votes = _votes(p, m, ok, F.right(F.get(pieces, i), F.lit(32)), F.left(F.get(pieces, i + 1), F.lit(1)))
            share = F.floor(F.length(_digits(m)) * 4 / F.length(m)).cast("int")
            return F.struct(
                F.get(s, i).alias("start"),
                F.lit(KINDS.index(p.kind)).alias("kind"),
                (F.get(s, i) + F.length(m)).alias("end"),
                (ok if p.base else F.lit(False)).alias("base"),
                _worth(p, m).alias("worth"),
                F.array(*[votes[v] for v in VOTES]).alias("votes"),
                F.least(F.floor(F.log2(F.length(m).cast("double"))).cast("int"), F.lit(7)).alias("long"),
                share.alias("digits"),
            )

        return let(starts, lambda s: F.filter(F.transform(matches, lambda m, i: one(s, m, i)), lambda c: c["base"] | c["worth"]))

    gate = F.contains(text, F.lit("@")) if p.gate == "@" else text.rlike(p.gate)
    pieces = F.split(text, p.regex, -1)
    matches = F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))
    return F.when(gate, let(matches, lambda m: let(pieces, lambda x: build(m, x))))


def candidates(text: Column) -> Column:
    """All candidates of a text by start and kind; an empty array for null."""
    parts = [_found(whole(text), p) for p in PATTERNS]
    some = F.flatten(F.array_compact(F.array(*parts)))

    def alone(all_: Column) -> Column:
        # a looser match gives way to a base finding that it overlaps
        base = F.filter(all_, lambda c: c["base"])
        return let(base, lambda b: F.filter(all_, lambda c: c["base"] | ~F.exists(b, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"]))))

    return F.sort_array(let(some, alone))


# ---------------------------------------------------------------- label model and span classifier


@dataclass
class SpanModel:
    """Labelers' reliabilities (for each kind: prior, P(vote | true), P(vote | false)) and the classifier's weights."""

    reliability: dict[int, tuple[float, np.ndarray, np.ndarray]] = field(default_factory=dict)
    weights: dict[tuple, float] = field(default_factory=dict)

    def score(self, c: Column) -> Column:
        """The classifier's log odds for a candidate, as an expression."""
        total = F.lit(0.0)
        for (name, a, b), w in sorted(self.weights.items()):
            if name == "votes":
                test = F.get(c["votes"], F.lit(a)) == b
            elif name == "bias":
                test = F.lit(True)
            else:
                test = c[name] == b
            total = total + F.when(test, F.lit(float(w))).otherwise(0.0)
        return total


def _em(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Two-class Dawid-Skene over vote patterns: prior, P(vote|true), P(vote|false), posteriors.

    Starts from the majority.  Imagined spans, in which labelers mostly agree
    with the class, smooth the counts so that a kind with few candidates keeps
    sane reliabilities.  What fails its format rule is never true.
    """
    n, labelers = votes.shape
    most = np.where(votes[:, VOTES.index("form")] < 0, 0.001, 1.0)
    post = np.minimum(1 / (1 + np.exp(-1.5 * votes.sum(axis=1))), most)
    at = votes + 1  # 0: no, 1: nothing, 2: yes
    fair = np.tile(np.array([[0.5, 1.0, 2.5]]), (labelers, 1))
    for _ in range(rounds):
        yes, no = fair.copy(), fair[:, ::-1].copy()
        for j in range(labelers):
            np.add.at(yes[j], at[:, j], counts * post)
            np.add.at(no[j], at[:, j], counts * (1 - post))
        yes, no = yes / yes.sum(axis=1, keepdims=True), no / no.sum(axis=1, keepdims=True)
        prior = ((counts * post).sum() + 1) / (counts.sum() + 2)
        odds = np.log(prior / (1 - prior)) + sum(np.log(yes[j, at[:, j]] / no[j, at[:, j]]) for j in range(labelers))
        post = np.minimum(1 / (1 + np.exp(-np.clip(odds, -30, 30))), most)
    return prior, yes, no, post


def _features(row) -> list[tuple]:
    votes = [("votes", j, v) for j, v in enumerate(row["votes"]) if v]
    return [("bias", 0, 0), ("kind", 0, row["kind"]), ("long", 0, row["long"]), ("digits", 0, row["digits"]), *votes]


def fit(patterns: list) -> SpanModel:
    """The model from counted patterns (kind, votes, long, digits, n)."""
    model = SpanModel()
    if not patterns:
        return model
    votes = np.array([r["votes"] for r in patterns], "int64")
    counts = np.array([r["n"] for r in patterns], "float64")
    kinds = np.array([r["kind"] for r in patterns])
    target = np.zeros(len(patterns))
    for k in sorted(set(kinds.tolist())):
        at = np.flatnonzero(kinds == k)
        prior, yes, no, post = _em(votes[at], counts[at])
        model.reliability[k] = (float(prior), yes, no)
        target[at] = post
    names = sorted({f for r in patterns for f in _features(r)})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(patterns), len(names)))
    for i, r in enumerate(patterns):
        for f in _features(r):
            x[i, place[f]] = 1
    # weighted logistic regression by Newton steps; a unit ridge pulls it to the label model, so that few spans
    # leave the labelers' reliabilities in charge
    ground = np.zeros(len(names))
    for k, (prior, yes, no) in model.reliability.items():
        part = counts[kinds == k].sum() / counts.sum()
        odds = np.log(yes / no)
        for f, i in place.items():
            if f[0] == "votes":
                ground[i] += part * (odds[f[1], f[2] + 1] - odds[f[1], 1])
        ground[place["bias", 0, 0]] += part * (np.log(prior / (1 - prior)) + odds[:, 1].sum())
    w = ground.copy()
    weight = counts / counts.sum() * min(counts.sum(), 10_000.0)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - target)) + (w - ground)
        bend = (x.T * (weight * p * (1 - p))) @ x + np.eye(len(names))
        w = w - np.linalg.solve(bend, slope)
    model.weights = dict(zip(names, w.tolist()))
    return model


def learn(found: DataFrame, column: str) -> SpanModel:
    """The model of a table with a column of candidates; only pattern counts reach the driver."""
    c = F.explode(column).alias("c")
    rows = found.select(c).groupBy("c.kind", "c.votes", "c.long", "c.digits").agg(F.count(F.lit(1)).alias("n")).collect()
    return fit(sorted(rows, key=lambda r: (r["kind"], tuple(r["votes"]), r["long"], r["digits"])))


def accepted(found: Column, model: SpanModel) -> Column:
    """Base findings, and the candidates that pass their format rule and that the classifier takes."""
    form = F.lit(VOTES.index("form"))
    return F.filter(found, lambda c: c["base"] | ((F.get(c["votes"], form) >= 0) & (model.score(c) >= 0)))


def pii_spans(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all by default) with ``pii``: base findings and accepted candidates by start and kind.

    Each entry has start, kind (number in ``KINDS``), end (code points, end
    exclusive) and base.  Null and empty texts have none; repeated rows get the
    same spans each; an input column called ``pii`` is replaced; an empty table
    stays empty.  Texts are searched once; candidates are kept in the shared folder.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != "pii"]
    (name,) = fresh(df, "candidates")
    found = saved(df.select(*kept, candidates(F.col(text)).alias(name)))
    model = learn(found, name)
    return found.select(*kept, accepted(F.col(name), model).alias("pii"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda c: F.concat_ws(":", F.get(kinds, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def build(t: Column) -> Column:
        begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def put(a: Column, c: Column) -> Column:
            apart = c["start"] >= a["at"]
            more = F.concat(a["out"], F.substring(t, a["at"] + 1, c["start"] - a["at"]), F.get(marks, c["kind"]))
            return F.struct(
                F.when(apart, more).otherwise(a["out"]).alias("out"), F.greatest(a["at"], c["end"]).alias("at")
            )

        done = F.aggregate(spans, begin, put)
        return let(done, lambda d: F.concat(d["out"], F.substring(t, d["at"] + 1, F.length(t))))

    return F.when(F.size(spans) == 0, text).otherwise(let(text, build))


def op9_pii(spark, folder: str) -> DataFrame:
    """Counts and digest of base findings, and all spans, of every document."""
    found = pii_spans(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("pii", lambda c: c["base"])


    def number(k: int) -> Column:
        return F.size(F.filter("pii", lambda c: c["base"] & (c["kind"] == k))).cast("long")

    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("pii")).alias("spans"))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """The documents with their personal data masked; ``n_chars`` follows the text."""
    (name,) = fresh(docs, "spans")
    model = learn(docs.select(candidates(F.col("text")).alias(name)), name)
    out = docs.withColumn(name, accepted(candidates(F.col("text")), model))
    out = out.withColumn("text", masked(F.col("text"), F.col(name))).drop(name)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
