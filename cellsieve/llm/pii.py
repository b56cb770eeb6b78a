"""Personal data: weak supervision over candidate spans, in DataFrame and SQL functions only.

Base spans (email, ip, card, phone) come from patterns and checks and always stay. Further candidates (secret, national,
identity, account) come from one wider pattern and are judged:

1. Labelers vote on each candidate, 1 (personal), -1 (not) or 0 (abstains): its shape (regex), cue words before it
   (gazetteer), what stands directly before it, quotes around it, and a check of its digits or alphabet (context).
2. Candidates are counted by vote pattern, at most 3**5 * kinds rows, and expectation-maximisation over these counts
   estimates each labeler's reliability and the prior; that gives a posterior per pattern.
3. A logistic span classifier over kind, votes and length class is trained on the posteriors, weighted by counts; the
   table it is trained on is bounded by the number of patterns too.

Candidates that the classifier scores at least ACCEPT become spans unless they touch a base span.

Patterns use possessive loops, so that runs of any length need no deep recursion, and look at each run once: where a
run cannot start a match at its first character, none of its later characters can. Positions are code points, taken from
the lengths of the pieces between matches.

Defined cases: a null text counts as empty and has no spans; null ids keep their row; repeated rows give a row each; an
empty table gives no rows; without candidates no classifier is needed and only base spans are reported; extra columns
pass through `redact` only where they are among the columns of documents.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsieve.session import cut

# The given kinds in their order, then the kinds of candidates.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "national", "identity", "account")
KINDS = BASE_KINDS + ADDED_KINDS

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A text without this character or pattern has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IS_IP = rf"^{PART}\.{PART}\.{PART}\.{PART}$"

CANDIDATE = (
    r"(?<![A-Za-z0-9_+/=.-])(?:"
    r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[.-][0-9]{4}(?![A-Za-z0-9-])"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])"
    r"|[0-9]{12,19}+(?![A-Za-z0-9_+/=-])"
    r"|(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{20,}+)"
)
CUES = r"(?i)\b(?:token|secret|password|passwd|pwd|api|apikey|key|bearer|ssn|social|passport|iban|account|card|phone|tel|call|contact|fax|id)\b"
OTHER_CUES = r"(?i)\b(?:isbn|version|figure|order|sku|commit|sha|checksum|model|page|doi|build)\b"

LABELERS = ("shape", "gazetteer", "before", "quoted", "check")
CONTEXT = 24
ACCEPT = 0.5
ROUNDS = 50


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    numbers = F.transform(F.reverse(F.regexp_extract_all(digits, F.lit("[0-9]"), 0)), lambda d: d.cast("int"))
    doubled = F.transform(numbers, lambda n, i: F.when(i % 2 == 0, n).otherwise(F.when(n > 4, n * 2 - 9).otherwise(n * 2)))
    return F.aggregate(doubled, F.lit(0), lambda total, n: total + n) % 10 == 0


def is_valid(kind: str, text: Column) -> Column:
    count = F.length(_digits(text))
    if kind == "ip":
        return text.rlike(IS_IP)
    if kind == "card":
        return count.between(12, 19) & luhn(_digits(text))
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def _spans(matches: Column, between: Column) -> Column:
    """array<struct<start, match>> from the matches and the pieces of text between them."""
    state = "struct<at:int,out:array<struct<start:int,match:string>>>"
    steps = F.arrays_zip(matches.alias("m"), F.slice(between, 1, F.size(matches)).alias("b"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["b"])
        found = F.struct(start.alias("start"), pair["m"].alias("match"))
        return F.struct((start + F.length(pair["m"])).alias("at"), F.concat(acc["out"], F.array(found)).alias("out")).cast(state)

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("out")).cast(state)
    return F.aggregate(steps, empty, step, lambda acc: acc["out"])


def _located(docs: DataFrame, name: str, pattern: str, needs: str | None) -> DataFrame:
    """Add an array of (start, match) of all leftmost matches that don't overlap."""
    text, none = F.col("pii_text"), F.array().cast("array<string>")
    maybe = F.contains(text, F.lit(needs)) if needs else F.lit(True)
    docs = docs.withColumn("m", F.when(maybe, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none))
    docs = docs.withColumn("b", F.when(F.size("m") > 0, F.split(text, pattern, -1)).otherwise(none))
    nothing = F.array().cast("array<struct<start:int,match:string>>")
    # The arrays are columns of their own here, so that the fold reads them instead of searching again.
    zipped = F.when(F.size("m") > 0, _spans(F.col("m"), F.col("b"))).otherwise(nothing)
    return docs.withColumn(name, zipped).drop("m", "b")


def _checked(name: str, kind: str, rank: int) -> Column:
    """The matches that pass their check, as (start, rank, end)."""
    passed = F.filter(name, lambda s: is_valid(kind, s["match"]))
    return F.transform(
        passed, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), (s["start"] + F.length(s["match"])).alias("end"))
    )


def _count(rank: int) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")


def with_spans(docs: DataFrame) -> DataFrame:
    """Add base: array<struct<start, rank, end>>, and candidates with their kind, votes and length class."""
    out = docs.withColumn("pii_text", F.coalesce(F.col("text"), F.lit("")))
    for kind in BASE_KINDS:
        out = _located(out, f"at_{kind}", PATTERNS[kind], NEEDS.get(kind))
    out = _located(out, "at_more", CANDIDATE, None)
    found = [_checked(f"at_{kind}", kind, rank) for rank, kind in enumerate(BASE_KINDS)]
    out = out.withColumn("base", F.array_sort(F.concat(*found)))
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["start"] + F.length(s["match"])) & (s["start"] < b["end"]))
    out = out.withColumn("candidates", F.transform(F.filter("at_more", apart), _voted))
    return out.drop("at_more", *(f"at_{k}" for k in BASE_KINDS))


def _voted(span: Column) -> Column:
    """A candidate's kind, votes and length class."""
    match, start = span["match"], span["start"]
    size, count = F.length(match), F.length(_digits(match))
    from_ = F.greatest(F.lit(0), start - CONTEXT)
    left = F.substring(F.col("pii_text"), from_ + 1, start - from_)
    right = F.substring(F.col("pii_text"), start + size + 1, F.lit(1))
    only_digits = count == size
    kind = (
        F.when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit("identity"))
        .when(only_digits & (size >= 12), F.lit("account"))
        .when(match.rlike(r"^[(0-9]") & (count == 10) & (size < 16), F.lit("national"))
        .otherwise(F.lit("secret"))
    )
    hexed = match.rlike("^[0-9a-fA-F]++$")
    shape = F.when(only_digits, F.lit(0)).when(kind != "secret", F.lit(1)).when((count >= 5) & (size >= 24), F.lit(1)).otherwise(F.lit(-1))
    gazetteer = F.when(left.rlike(CUES), F.lit(1)).when(left.rlike(OTHER_CUES), F.lit(-1)).otherwise(F.lit(0))
    before = F.when(left.rlike(r"[=:]\s*[\"']?$"), F.lit(1)).when(left.rlike(r"[/#$]$"), F.lit(-1)).otherwise(F.lit(0))
    quoted = F.when(left.rlike("[\"']$") & right.rlike("^[\"']$"), F.lit(1)).otherwise(F.lit(0))
    check = (
        F.when(only_digits, F.lit(-1))
        .when(hexed & size.isin(32, 40, 64), F.lit(1))
        .when(match.rlike("^[A-Za-z]++[0-9]{1,4}$"), F.lit(-1))
        .otherwise(F.lit(0))
    )
    return F.struct(
        start.alias("start"),
        (start + size).alias("end"),
        kind.alias("kind"),
        *(v.alias(n) for n, v in zip(LABELERS, (shape, gazetteer, before, quoted, check))),
        F.when(size < 16, 0).when(size < 32, 1).otherwise(2).alias("long"),
    )


class SpanModel(NamedTuple):
    """Weights of the span classifier by feature, and what expectation-maximisation found."""

    weights: dict[tuple[str, object], float]
    prior: float
    reliability: dict[str, tuple[float, float]]


Pattern = tuple[tuple[str, object], ...]


def reliabilities(patterns: list[tuple[tuple[int, ...], float]], rounds: int = ROUNDS) -> tuple[float, list, list[float]]:
    """Expectation-maximisation over (votes, count) rows: the prior, each labeler's vote distribution in both classes,
    and the posterior of every row. It starts from the majority of votes."""
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(votes))) for votes, _ in patterns]
    prior, tables = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        prior = (1 + sum(p * n for p, (_, n) in zip(post, patterns))) / (2 + total)
        tables = []
        for k in range(len(LABELERS)):
            by_class = []
            for positive in (True, False):
                mass = {-1: 1.0, 0: 1.0, 1: 1.0}
                for p, (votes, n) in zip(post, patterns):
                    mass[votes[k]] += n * (p if positive else 1 - p)
                whole = sum(mass.values())
                by_class.append({v: m / whole for v, m in mass.items()})
            tables.append(by_class)
        post = []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[0][v] / t[1][v]) for t, v in zip(tables, votes))
            post.append(1 / (1 + math.exp(-max(-40.0, min(40.0, odds)))))
    return prior, tables, post


def train_classifier(rows: list[tuple[Pattern, float, float]], rounds: int = 300, rate: float = 1.0, decay: float = 1e-3) -> dict:
    """Logistic regression by gradient descent on (features, posterior, count) rows."""
    weights = {f: 0.0 for features, _, _ in rows for f in features}
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        slope = {f: decay * w for f, w in weights.items()}
        for features, target, n in rows:
            z = sum(weights[f] for f in features)
            error = (1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) - target) * n / total
            for f in features:
                slope[f] += error
        for f, s in slope.items():
            weights[f] -= rate * s
    return weights


def fit(spans: DataFrame) -> SpanModel:
    """Train on the candidates of all documents, counted by pattern."""
    fields = ("kind", *LABELERS, "long")
    one = spans.select(F.explode("candidates").alias("c")).select(*(F.col(f"c.{f}") for f in fields))
    counts = [r.asDict() for r in one.groupBy(*fields).count().orderBy(*fields).collect()]
    votes: dict[tuple[int, ...], float] = {}
    for r in counts:
        votes[tuple(r[v] for v in LABELERS)] = votes.get(tuple(r[v] for v in LABELERS), 0.0) + r["count"]
    patterns = sorted(votes.items())
    prior, tables, post = reliabilities(patterns) if patterns else (0.0, [], [])
    posterior = {v: p for (v, _), p in zip(patterns, post)}
    rows = [
        ((("bias", 1), *((f, r[f]) for f in fields)), posterior[tuple(r[v] for v in LABELERS)], float(r["count"])) for r in counts
    ]
    found = {name: (t[0][1], t[1][1]) for name, t in zip(LABELERS, tables)}
    return SpanModel(train_classifier(rows), prior, found)


def _accepted(model: SpanModel) -> Column:
    """The candidates that the classifier takes, as base-like structs."""

    def score(c: Column) -> Column:
        total = F.lit(model.weights.get(("bias", 1), 0.0))
        for (field, value), w in sorted(model.weights.items(), key=repr):
            if field != "bias":
                total = total + F.when(c[field] == value, F.lit(w)).otherwise(F.lit(0.0))
        return total

    least = math.log(ACCEPT / (1 - ACCEPT))
    taken = F.filter("candidates", lambda c: score(c) >= least) if model.weights else F.filter("candidates", lambda c: F.lit(False))
    ranks = F.create_map(*(x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(n))))
    return F.transform(
        taken, lambda c: F.struct(c["start"].alias("start"), F.element_at(ranks, c["kind"]).alias("rank"), c["end"].alias("end"))
    )


def _label(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, base_spans) of every document."""
    located = cut(with_spans(docs.select("doc_id", "text")).select("doc_id", "base", "candidates"))
    rows = located.withColumn("every", F.array_sort(F.concat("base", _accepted(fit(located)))))
    counts = [_count(rank).alias(f"n_{kind}") for rank, kind in enumerate(BASE_KINDS)]
    return rows.select(
        "doc_id", *counts, F.sha2(_label(F.col("base")), 256).alias("base_sha256"), _label(F.col("every")).alias("spans"), _label(F.col("base")).alias("base_spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """documents with every span replaced by its kind in brackets; overlapping spans are replaced together."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    model = fit(cut(with_spans(own.select("doc_id", "text")).select("candidates").where(F.size("candidates") > 0)))
    rows = with_spans(own).withColumn("every", F.array_sort(F.concat("base", _accepted(model))))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        text = F.concat(
            acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["rank"] + 1)
        )
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, text).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    changed = F.when(F.size("every") > 0, F.aggregate("every", start, step, rest)).otherwise(F.col("text"))
    done = rows.withColumn("new_text", changed)
    n_chars = F.when(F.size("every") > 0, F.length("new_text").cast("long")).otherwise(F.col("n_chars").cast("long"))
    return done.select("doc_id", F.col("new_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))
