"""Operator 6. Mixing sources to target weights by soft membership.

A naive Bayes classifier over hashed words, counted from a labelled table, gives each
document posteriors over domains (tempered by the square root of its length, so that
they stay soft). Document rates r within [low, high] are then fitted so that expected
token totals, the sum of r * tokens * posterior of each domain, match weight * budget:
least squares of the totals' errors relative to each domain's mass, solved by
projected gradient descent from r = 1. ``low`` is 0 for rates that are merely nonnegative;
a floor of 1 keeps every document. A step only needs the domains' totals, one
aggregation over all documents, and a document's rate is a function of its posteriors
and the steps so far; nothing else leaves the executors. A rate becomes whole copies:
its floor, and one more with the probability of its fraction by a hash of the id.

Everything is DataFrame and SQL functions. The driver sees the word model (BUCKETS rows
at most) and one row of totals a step.

Defined cases: null and empty texts have no tokens and the labelled shares as
posteriors; labels that are null, unknown or without document are ignored; with no
labelled text all posteriors are equal; repeated rows and rows that share an id are
one document, counted once for each row, and so are all rows without id; a domain without
mass can't be reached and is left out of the budget; an empty table gives an empty result;
other columns, whatever their names, pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.runtime import Scratch

BUCKETS = 4096
WORDS = r"[\x20\x09-\x0D]+"
#: Rows of the labelled table that the model is counted from, at most: those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: Up to so many rates other than 1 are sent to all executors; beyond, a shuffled join.
RATES_SENT = 1 << 19


def _words(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """A row for each word: its bucket and the kept columns."""
    words = docs.select(*keep, F.explode(F.split(F.lower(F.col(text_col)), WORDS)).alias("word")).where("word <> ''")
    return words.select(*keep, F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _model(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, domains: list[str]) -> tuple[DataFrame, list[float]]:
    """(bucket, w: log-probabilities by domain), and the domains' log shares."""
    usable = labelled.select(F.col(id_col).alias("id"), F.col("domain").alias("domain")).where(F.col("domain").isin(domains) & F.col("id").isNotNull()).dropDuplicates(["id", "domain"])
    chosen = usable.orderBy(F.xxhash64("id"), "id", "domain").limit(MAX_LABELLED)
    shares = {r["domain"]: r["n"] for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values()) + len(domains)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    counts = _words(texts, "text", "domain").groupBy("domain", "bucket").agg(F.count("*").alias("c"))
    wide = counts.groupBy("bucket").agg(*(F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("c"))), F.lit(0)).alias(f"c{k}") for k, d in enumerate(domains)))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(wide, "bucket", "left").na.fill(0)
    every = Scratch(docs.sparkSession, "words").save(every, "counts")
    sums = every.agg(*(F.sum(f"c{k}").alias(f"s{k}") for k in range(len(domains)))).first()
    model = every.select("bucket", *(F.log((F.col(f"c{k}") + 0.5) / F.lit(float(sums[k] + 0.5 * BUCKETS))).alias(f"w{k}") for k in range(len(domains))))
    return model, [math.log((shares.get(d, 0) + 1) / total) for d in domains]


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each id of ``docs``: id, rows, tokens (of all its rows), and posteriors p0, p1, ... in the order of ``domains``."""
    model, prior = _model(docs, labelled, id_col, text_col, domains)
    n = len(domains)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = _words(keyed, "text", "id").join(F.broadcast(model), "bucket").groupBy("id").agg(F.count("*").alias("tokens"), *(F.sum(f"w{k}").alias(f"w{k}") for k in range(n)))
    ids = keyed.groupBy("id").agg(F.count("*").alias("rows"))
    all_ids = ids.join(scored, ids["id"].eqNullSafe(scored["id"]), "left").select(ids["id"], "rows", F.coalesce("tokens", F.lit(0)).alias("tokens"), *(F.coalesce(f"w{k}", F.lit(0.0)).alias(f"w{k}") for k in range(n)))
    logits = [F.lit(prior[k]) + F.col(f"w{k}") / F.sqrt(F.greatest(F.col("tokens"), F.lit(1))) for k in range(n)]
    top = F.greatest(*logits) if n > 1 else logits[0]
    raised = all_ids.select("id", "rows", "tokens", *(F.exp(logit - top).alias(f"e{k}") for k, logit in enumerate(logits)))
    whole = sum((F.col(f"e{k}") for k in range(n)), F.lit(0.0))
    return raised.select("id", "rows", "tokens", *((F.col(f"e{k}") / whole).alias(f"p{k}") for k in range(n)))


def _rate(steps: list[list[float]], n: int, low: float, high: float) -> Column:
    """The rate after the steps: from 1, each step moves it against the posteriors' share of the errors and projects onto the bounds."""
    rate = F.lit(1.0)
    if not steps:
        return F.greatest(F.lit(low), F.least(F.lit(high), rate))
    history = F.array(*(F.array(*map(F.lit, s)) for s in steps))
    p = [F.col(f"p{k}") for k in range(n)]
    return F.aggregate(history, rate, lambda r, h: F.greatest(F.lit(low), F.least(F.lit(high), r - sum((h[k] * p[k] for k in range(n)), F.lit(0.0)))))


def fit_rates(members: DataFrame, domains: list[str], weights: list[float], low: float, high: float, budget: float | None = None, max_steps: int = 16, tolerance: float = 1e-4) -> DataFrame:
    """``members(id, rows, tokens, p0, ...)`` with rate. The default budget is the least at which no domain has to shrink."""
    n = len(domains)
    mass = [float(x or 0) for x in members.agg(*(F.sum(F.col("tokens") * F.col(f"p{k}")) for k in range(n))).first()]
    whole = sum(w for w, m in zip(weights, mass) if m > 0)
    if not whole:
        return members.withColumn("rate", _rate([], n, low, high))
    share = [w / whole if m > 0 else 0.0 for w, m in zip(weights, mass)]
    if budget is None:
        budget = max((m / w for m, w in zip(mass, share) if w > 0 and m > 0), default=0.0)
    steps: list[list[float]] = []
    for _ in range(max_steps):
        totals = members.select("tokens", *(f"p{k}" for k in range(n)), _rate(steps, n, low, high).alias("rate")).agg(*(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p{k}")) for k in range(n))).first()
        # the gradient of the errors relative to each domain's mass; a step of 1 is stable, as posteriors sum to 1
        error = [(float(t) - s * budget) / m if m > 0 else 0.0 for t, s, m in zip(totals, share, mass)]
        if max(map(abs, error)) < tolerance or (steps and all(abs(a - b) < 1e-6 for a, b in zip(error, steps[-1]))):
            break
        steps.append(error)
    return members.withColumn("rate", _rate(steps, n, low, high))


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], low: float = 1.0, high: float = 4.0, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each id of ``docs``: doc_id, tokens, p_<domain>, rate, copies. ``labelled`` has the id and ``domain``."""
    domains = sorted(targets)
    members = Scratch(docs.sparkSession, "mix").save(posteriors(docs, labelled, domains, id_col, text_col), "members")
    fitted = fit_rates(members, domains, [targets[d] for d in domains], low, high, budget)
    chance = F.pmod(F.xxhash64("id", F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    return fitted.select(F.col("id").alias("doc_id"), "tokens", *(F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)), "rate", copies.alias("copies"))


def mix_sources(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], low: float = 1.0, high: float = 4.0, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns, each row as often as its rate says; with ``low`` of 1 no document is lost."""
    rates = mixing_rates(docs, labelled, targets, low, high, budget, id_col, text_col).where("copies <> 1").select(F.col("doc_id").alias("key"), F.col("copies").cast("int").alias("copies"))
    rates = Scratch(docs.sparkSession, "rates").save(rates, "rates")
    rates = F.broadcast(rates) if rates.count() <= RATES_SENT else rates
    # the document travels as one column, so no name of its own can clash
    nested = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{id_col}`").alias("id"))
    dealt = nested.join(rates, F.expr("id <=> key"), "left").select("doc", F.explode(F.expr("case when coalesce(copies, 1) > 0 then sequence(1, coalesce(copies, 1)) else array() end")))
    return dealt.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
