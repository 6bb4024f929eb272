"""Mixing to target weights by soft membership, in DataFrame functions only.

1. A labelled table (id, domain) trains a naive Bayes classifier of word endings, hashed to BUCKETS columns. It
   uses at most `sample` labelled rows, the ones with the smallest hash of the id. Every document gets posteriors
   over the domains; the evidence of a text counts as that of EVIDENCE words at most, so memberships stay soft.
2. Rates r >= least of all documents solve the least-squares problem
       sum over domains of (sum_d r_d tokens_d p_dk / tokens - budget * target_k)**2 / target_k
   by projected gradient. A round is one aggregate over the corpus of as many sums as there are domains; a rate is
   the fold of the steps so far over the document's own posteriors, so rounds carry no state between them.
3. A rate becomes whole copies: its integer part, and one more where a hash of the id lies below the rest.

`Fit` says which shares were reached and whether they meet the targets to CLOSE of the budget; targets that no
rates of at least `least` can meet, or that ROUNDS steps do not reach, are told by a warning and in the result.

Tokens are words between ASCII white space. Domains without labelled rows get no mass and their target goes to
the others. Defined results: null and empty texts have no tokens, prior posteriors, and their rate; null ids use
the hash of null; repeated rows have the same rate; without labels all documents have equal posteriors; an empty
table gives an empty result; extra columns pass through `apply_rates` untouched.
"""

from __future__ import annotations

import json
import math
import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.scratch import discard, local_rows, materialize

BUCKETS = 4096
#: Labelled rows that training uses at most.
SAMPLE = 4000
EVIDENCE = 24
ROUNDS = 40
CLOSE = 1e-4
BLANKS = r"[\x20\x09-\x0D]+"


def features(text: Column) -> Column:
    """Bucket, from 1, of each word's last three characters."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(F.substring(w, -3, 3)), F.lit(BUCKETS)) + 1).cast("int"))


def train(
    docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[list[float], list[list[float]]]:
    """Log priors, and log probabilities of the buckets, of each domain."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    known = labelled.select(F.col("id").alias("__id"), F.col("domain").cast("string").alias("__domain")).filter(
        F.col("__domain").isin(domains) & F.col("__id").isNotNull()
    )
    chosen = known.orderBy(F.xxhash64("__id"), "__id", "__domain").limit(sample).collect()
    prior = {d: 0 for d in domains}
    for r in chosen:
        prior[r["__domain"]] += 1
    picked = local_rows(spark, sorted({(r["__id"], r["__domain"]) for r in chosen}), f"__id {kind}, __domain string")
    # bounded by `sample` rows, so it may be broadcast
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(F.broadcast(picked), "__id")
    counts = (
        rows.select("__domain", F.explode(features(F.col("__text"))).alias("bucket")).groupBy("__domain", "bucket").count().collect()
    )  # at most domains x BUCKETS rows
    table = {d: [0.5] * BUCKETS for d in domains}
    for r in counts:
        table[r["__domain"]][r["bucket"] - 1] += r["count"]
    logs = []
    for d in domains:
        total = sum(table[d])
        logs.append([round(math.log(c / total), 5) for c in table[d]])
    n = sum(prior.values())
    return [math.log((prior[d] + 0.5) / (n + 0.5 * len(domains))) for d in domains], logs


def _looked_up(odds: list[float]) -> Column:
    """Sum of the odds at all the buckets of f."""
    weights = F.from_json(F.lit(json.dumps(odds)), "array<double>")
    return F.aggregate("f", F.lit(0.0), lambda total, bucket: total + F.element_at(weights, bucket))


def with_posterior(rows: DataFrame, text: Column, model: tuple[list[float], list[list[float]]]) -> DataFrame:
    """rows with the columns tokens and posterior (one double per domain)."""
    prior, logs = model
    rows = rows.withColumn("f", features(text)).withColumn("tokens", F.size("f").cast("long"))
    soft = F.lit(float(EVIDENCE)) / F.greatest(F.col("tokens").cast("double"), F.lit(float(EVIDENCE)))
    # log odds against the first domain, which so needs no sum
    scores = [F.lit(prior[0])]
    for k in range(1, len(prior)):
        scores.append(F.lit(prior[k]) + _looked_up([round(x - y, 5) for x, y in zip(logs[k], logs[0])]) * soft)
    rows = rows.withColumn("s", F.array(*scores))
    rows = rows.withColumn("m", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    whole = F.aggregate("m", F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("posterior", F.transform("m", lambda x: x / whole)).drop("f", "s", "m")


def posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tokens and posterior of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("__text"))
    return with_posterior(rows, F.col("__text"), model).select("id", "tokens", "posterior")


def _largest_eigenvalue(m: list[list[float]]) -> float:
    v = [1.0] * len(m)
    value = 1.0
    for _ in range(200):
        w = [sum(a * b for a, b in zip(row, v)) for row in m]
        value = max(map(abs, w)) or 1.0
        v = [x / value for x in w]
    return value


def rate_of(steps: list[list[float]], least: float) -> Column:
    """The rate after the given steps, from 1, each followed by the projection to rates of at least `least`."""
    if not steps:
        return F.lit(max(1.0, least))
    table = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    width = len(steps[0])

    def move(rate: Column, step: Column) -> Column:
        return F.greatest(F.lit(float(least)), rate - sum((step[k] * F.col("posterior")[k] for k in range(width)), F.lit(0.0)))

    return F.aggregate(table, F.lit(max(1.0, least)), move)


class Fit(NamedTuple):
    """Gradient steps, the masses they reach and those wanted, as multiples of the tokens there are."""

    steps: list[list[float]]
    reached: list[float]
    wanted: list[float]

    @property
    def met(self) -> bool:
        return all(abs(a - w) <= CLOSE * max(1.0, sum(self.wanted)) for a, w in zip(self.reached, self.wanted))


def fit_rates(member: DataFrame, targets: list[float], least: float = 0.0, budget: float | None = None) -> Fit:
    """Gradient steps whose rates meet the targets best.

    member has tokens and posterior. budget is the wanted total as a multiple of the tokens there are; None: 1, or
    with least >= 1 the smallest at which no domain has to shrink.
    """
    k = len(targets)
    p = [F.col("posterior")[i] for i in range(k)]
    t = F.col("tokens").cast("double")
    first = member.agg(
        F.sum(t).alias("total"),
        *[F.sum(t * p[i]).alias(f"s{i}") for i in range(k)],
        *[F.sum(t * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)],
    ).first()
    total = first["total"] or 0.0
    if not total:
        return Fit([], [0.0] * k, [0.0] * k)
    shares = [first[f"s{i}"] / total for i in range(k)]
    live = [s > 1e-9 and g > 0 for s, g in zip(shares, targets)]
    goal = sum(g for g, ok in zip(targets, live) if ok)
    if not goal:
        return Fit([], shares, shares)
    targets = [g / goal if ok else 0.0 for g, ok in zip(targets, live)]
    if budget is None:
        budget = max([1.0, *(least * s / g for s, g, ok in zip(shares, targets, live) if ok)]) if least >= 1 else 1.0
    wanted = [budget * g for g in targets]
    scale = [1 / w if w else 1.0 for w in wanted]
    gram = [[first[f"m{min(i, j)}_{max(i, j)}"] / total * scale[i] for j in range(k)] for i in range(k)]
    size = 1 / _largest_eigenvalue(gram)
    steps: list[list[float]] = []
    reached = [s * max(1.0, least) for s in shares]
    best = (math.inf, 0, reached)
    for _ in range(ROUNDS + 1):
        off = [a - w for a, w in zip(reached, wanted)]
        worst = max(abs(x) for x in off)
        best = min(best, (worst, len(steps), reached))
        if worst <= CLOSE * budget or len(steps) == ROUNDS:
            break
        steps.append([size * x * c for x, c in zip(off, scale)])
        rate = rate_of(steps, least)
        sums = member.select(*[(rate * t * p[i]).alias(f"x{i}") for i in range(k)]).agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(k)]).first()
        reached = [(sums[f"x{i}"] or 0.0) / total for i in range(k)]
        # the next step's length fits the curvature along this one (Barzilai and Borwein)
        bend = sum(off[i] * scale[i] * gram[i][j] / scale[i] * scale[j] * off[j] for i in range(k) for j in range(k))
        size = sum(x * x * c for x, c in zip(off, scale)) / bend if bend > 0 else size
    fit = Fit(steps[: best[1]], best[2], wanted)
    if not fit.met:
        warnings.warn(f"mixing reached {fit.reached} of the tokens, wanted {wanted}", stacklevel=2)
    return fit


def copies_of(rate: Column, id_col: Column) -> Column:
    """Whole copies whose expectation over ids is the rate."""
    part = F.pmod(F.xxhash64(id_col, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + part).cast("int")


def mixing_rates(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    least: float = 0.0,
    budget: float | None = None,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, tokens, posterior, rate, copies of every row of docs, and target_met: whether all targets were."""
    domains = list(targets)
    model = train(docs, labelled, domains, sample, id_col, text_col)
    member = materialize(posteriors(docs, model, id_col, text_col), "membership")
    fit = fit_rates(member, [targets[d] for d in domains], least, budget)
    rated = member.withColumn("rate", rate_of(fit.steps, least))
    return rated.withColumn("copies", copies_of(F.col("rate"), F.col("id"))).withColumn("target_met", F.lit(fit.met))


def apply_rates(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    least: float = 1.0,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """docs with each row as many times as its copies; its columns are unchanged and no row is shuffled."""
    domains = list(targets)
    model = train(docs, labelled, domains, sample, id_col, text_col)
    member = materialize(posteriors(docs, model, id_col, text_col), "membership")
    steps = fit_rates(member, [targets[d] for d in domains], least).steps
    discard(member)
    # the posterior is worked out again beside each row: cheaper than moving texts to meet it
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    keyed = whole.select("__row", F.col(f"__row.`{id_col}`").alias("__id"), F.col(f"__row.`{text_col}`").alias("__text"))
    times = copies_of(rate_of(steps, least), F.col("__id"))
    scored = with_posterior(keyed, F.col("__text"), model)
    # a condition on the copies below the generator would work out the posterior anew for every step of the rate
    repeated = scored.select("__row", F.explode_outer(F.array_repeat(F.lit(1), times)).alias("__n"))
    return repeated.filter(F.col("__n").isNotNull()).select("__row.*")
