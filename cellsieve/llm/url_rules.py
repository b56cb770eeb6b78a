"""URL filtering by association rules.

Spark's FP-growth mines combinations of URL tokens together with the label of the URLs that the given host rules
decide. Rules whose consequent is a label are kept when they have the least support and confidence, and dropped when
a shorter rule for the same label is at least as confident. An inverted index lists each rule under its rarest token;
a URL looks up its tokens and takes the best rule of which it has all tokens.

The host rules' verdicts are final; the mined rules decide for all other URLs, and where none matches, the default.

A token of a mined rule is in at least min_support of the labelled URLs, so tokens and rules that reach the driver and
the tasks are bounded by the thresholds and the tokens per URL, not by the number of URLs.

Defined cases: a null url, or one without ://, has an empty host and path and no tokens, so it gets the default;
without labelled URLs there are no mined rules; repeated ids and urls give a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The given host rules.
HOST_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
DEFAULT = "allow"
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
LABEL = "label="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class MinedRule(NamedTuple):
    tokens: frozenset[str]
    verdict: str
    confidence: float
    support: float


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host and path."""
    part = lambda n: F.coalesce(F.regexp_extract(url_col, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return pages.withColumn("host", F.translate(part(1), UPPER, LOWER)).withColumn("path", part(2))


def host_rule(rules: tuple[tuple[str, str], ...] = HOST_RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        host, slash, rest = text.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits = fits & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def url_tokens(url_col: str = "url") -> Column:
    """Distinct tokens: scheme, host labels, the host's last two labels, path segments, file ending, query keys."""
    tag = lambda prefix, words: F.transform(words, lambda w: F.concat(F.lit(prefix), w))
    url = F.coalesce(F.col(url_col), F.lit(""))
    labels = F.split("host", r"\.")
    segments = F.split("path", "/")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    ending = F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,5})$", 1)
    parts = F.flatten(
        F.array(
            F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
            tag("host=", labels),
            F.array(F.concat(F.lit("site="), F.substring_index("host", ".", -2))),
            tag("path=", segments),
            F.array(F.concat(F.lit("ending="), ending)),
            tag("key=", keys),
        )
    )
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.filter(parts, lambda t: ~t.endswith("=")))
    )


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[MinedRule]:
    """Rules from (tokens, verdict) rows, best first."""
    if labelled.isEmpty():
        return []
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0].startswith(LABEL))
    rules = rules.select("antecedent", F.col("consequent")[0].alias("label"), "confidence", "support")
    found = [
        MinedRule(frozenset(r["antecedent"]), r["label"].removeprefix(LABEL), r["confidence"], r["support"])
        for r in rules.toArrow().to_pylist()
        if not any(t.startswith(LABEL) for t in r["antecedent"])
    ]
    return pruned(found)


def pruned(rules: list[MinedRule]) -> list[MinedRule]:
    """Without rules that a shorter rule for the same label covers with no less confidence; best first."""
    best: dict[tuple[frozenset[str], str], float] = {}
    by_token: dict[tuple[str, str], list[MinedRule]] = {}
    for rule in sorted(rules, key=lambda r: (len(r.tokens), sorted(r.tokens))):
        shorter = {s for t in rule.tokens for s in by_token.get((t, rule.verdict), ())}
        if any(s.tokens < rule.tokens and s.confidence >= rule.confidence for s in shorter):
            continue
        best[rule.tokens, rule.verdict] = rule.confidence
        by_token.setdefault((min(rule.tokens), rule.verdict), []).append(rule)
    kept = [r for r in rules if (r.tokens, r.verdict) in best]
    return sorted(kept, key=lambda r: (-r.confidence, -r.support, len(r.tokens), sorted(r.tokens), r.verdict))


def inverted_index(rules: list[MinedRule]) -> dict[str, list[int]]:
    """Rule numbers by the rule's rarest token, counted over the rules themselves."""
    uses: dict[str, int] = {}
    for rule in rules:
        for token in rule.tokens:
            uses[token] = uses.get(token, 0) + 1
    index: dict[str, list[int]] = {}
    for n, rule in enumerate(rules):
        index.setdefault(min(rule.tokens, key=lambda t: (uses[t], t)), []).append(n)
    return index


def best_rule(tokens: frozenset[str], rules: list[MinedRule], index: dict[str, list[int]]) -> int | None:
    """The first rule, in order of merit, whose tokens are all there."""
    return min((n for t in tokens for n in index.get(t, ()) if rules[n].tokens <= tokens), default=None)


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(id, host, path, rule, verdict, mined_tokens, mined_confidence) of every row."""
    rule, verdict = host_rule()
    rows = with_parts(pages.select(id_col, url_col), url_col).withColumns({"rule": rule, "given": verdict, "tokens": url_tokens(url_col)})
    labelled = rows.where("given IS NOT NULL").select("tokens", F.col("given").alias("verdict"))
    rules = mine(labelled, min_support, min_confidence)
    known = sorted({t for r in rules for t in r.tokens})
    shared = pages.sparkSession.sparkContext.broadcast((rules, inverted_index(rules)))
    columns = [id_col, "host", "path", "rule", "given"]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mined, index = shared.value
        seen: dict[frozenset[str], int | None] = {}
        for batch in batches:
            picks = []
            for tokens in batch.column("tokens").to_pylist():
                tokens = frozenset(tokens)
                if tokens not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[tokens] = best_rule(tokens, mined, index)
                picks.append(seen[tokens])
            given = batch.column("given").to_pylist()
            verdicts = [g or (DEFAULT if n is None else mined[n].verdict) for g, n in zip(given, picks)]
            used = [None if g or n is None else mined[n] for g, n in zip(given, picks)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns[:4]]
                + [
                    pa.array(verdicts, pa.string()),
                    pa.array([u and " ".join(sorted(u.tokens)) for u in used], pa.string()),
                    pa.array([u and u.confidence for u in used], pa.float64()),
                ],
                names=[*columns[:4], "verdict", "mined_tokens", "mined_confidence"],
            )

    relevant = F.array_intersect("tokens", F.array(*map(F.lit, known))) if known else F.array().cast("array<string>")
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, host string, path string, rule string, verdict string, mined_tokens string, mined_confidence double"
    return rows.select(*columns, relevant.alias("tokens")).mapInArrow(job, schema)
