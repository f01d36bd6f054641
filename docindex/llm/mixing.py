"""Mixing sources to target weights by soft membership.

A classifier learned from a table of labelled documents gives every document a probability for each domain. Rates,
one for each document and none negative, are then fitted so that the expected tokens of each domain (rate times
words times probability) come as near to the targets as can be, by projected gradient descent on the squared
differences, from a rate of 1 for all. Where these steps no longer near the targets, which is where no rates reach
them, the solution lies at an edge: documents of the best direction join one at a time, each with the exact least
squares of those that joined and of all rates together, until no direction is left that would help (see `fit_rates`).

Classifier. Naive Bayes over all words, of any length, that at least `least_docs` documents of a bounded sample of
the labelled ones have; the evidence of a text is averaged to that of at most `evidence` words, so probabilities stay
soft.

Defined cases. Null and empty texts have no words, the sample's shares as probabilities, and keep the rate 1, which
costs no tokens. Documents without any known word have the sample's shares too. Rows of equal id and text share one
probability and rate; every row keeps its own tokens. Targets of domains that the sample lacks are left out and the
rest is scaled; without any labelled document all rates are 1. An empty table gives an empty table.

Targets out of reach give the nearest rates; should these not be found within `edges` directions, a warning says by
how much the condition is missed.

Plan. Words are exploded without their texts, each once a document, and met with the model, which is broadcast up to
BROADCAST_WORDS words and a plain join beyond; sums are one row a document after the map side. The narrow table
of probabilities is written once. A step of the descent is an aggregate of it to one number a domain, and a
document's rate is an expression of these numbers, so nothing but them passes through the driver.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .quality_rules import words_of

MAX_DOMAINS = 64
#: A model of more words isn't broadcast.
BROADCAST_WORDS = 200_000
#: Steps whose expression a table of rates holds before it is written again.
STEPS_A_TABLE = 12
#: Steps over which the squared difference must shrink by a twentieth.
STALLED = 12


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.withColumn("hash", F.xxhash64("text"))


def learn(labelled: DataFrame, least_docs: int = 3) -> tuple[DataFrame, dict[str, float]]:
    """((word, logs) with a log-likelihood for each domain, {domain: share}) from (text, domain)."""
    shares = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(MAX_DOMAINS + 1).collect()}
    if len(shares) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    domains = sorted(shares)
    words = labelled.select("domain", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    counted = [F.sum((F.col("domain") == d).cast("long")).alias(f"c{i}") for i, d in enumerate(domains)]
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *counted)
    logs = [F.log((F.col(f"c{i}") + 0.5) / F.lit(shares[d] + 1.0)).alias(f"l{i}") for i, d in enumerate(domains)]
    total = sum(shares.values())
    return cut(counts.where(F.col("n") >= least_docs).select("word", *logs)), {d: shares[d] / total for d in domains}


def posteriors(docs: DataFrame, model: DataFrame, shares: dict[str, float], evidence: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, tokens, p0, p1, ...): one row for each row of `docs`, domains in order of name."""
    rows = _keyed(docs, id_col, text_col)
    known = [f"l{i}" for i in range(len(shares))]
    split = words_of(F.col("text"))
    # A first entry of null for each row counts the rows of equal id and text.
    distinct = rows.select("doc_id", "hash", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(split))).alias("word"))
    met = distinct.join(F.broadcast(model) if model.count() <= BROADCAST_WORDS else model, "word", "left")
    sums = met.groupBy("doc_id", "hash").agg(F.sum(F.col("word").isNull().cast("long")).alias("copies"), F.count("l0").alias("n"), *[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in known])
    weight = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.least(F.col("n") / F.col("copies"), F.lit(float(evidence))) / F.col("n"))
    scores = [(F.log(F.lit(p)) + F.col(k) * weight) for k, p in zip(known, shares.values())]
    scored = sums.select("doc_id", "hash", *[s.alias(f"s{i}") for i, s in enumerate(scores)])
    top = F.greatest(*[f"s{i}" for i in range(len(scores))]) if len(scores) > 1 else F.col("s0")
    raised = scored.select("doc_id", "hash", *[F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in range(len(scores))])
    whole = _total([F.col(f"e{i}") for i in range(len(scores))])
    probable = raised.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(len(scores))])
    counted = rows.select("doc_id", "hash", F.size(split).cast("long").alias("tokens"))
    joined = counted.join(probable, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    return joined.select("doc_id", "hash", "tokens", *[f"p{i}" for i in range(len(scores))])


def nonnegative(a: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The x >= 0 for which a @ x is nearest to `goal`, by active sets; `a` has a few columns."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(10 * a.shape[1]):
        slope = a.T @ (goal - a @ x)
        slope[free] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-12:
            break
        free[best] = True
        while True:
            z = np.zeros(a.shape[1])
            z[free] = np.linalg.lstsq(a[:, free], goal, rcond=None)[0]
            if (z[free] > 0).all():
                break
            low = free & (z <= 0)
            x = x + (x[low] / np.maximum(x[low] - z[low], 1e-300)).min() * (z - x)
            free &= x > 1e-15
            x[~free] = 0
        x = z
    return x


def fit_rates(table: DataFrame, wanted: list[float], steps: int = 200, tolerance: float = 1e-4, edges: int = 200) -> DataFrame:
    """`table` with `rate`: nonnegative, so that sum(rate * tokens * p) is nearest to `wanted` in the domains.

    Projected gradient steps with momentum, which starts anew whenever the squared difference would grow. The
    gradient of a rate is scaled by the document's own 1/share, so domains of any size converge alike; the step is
    the inverse of a bound of the scaled problem's curvature. Totals are linear in the rates, so those of the
    extrapolated rates come from the totals of the last two.

    They end where every share is within `tolerance`, or where STALLED steps gained less than a twentieth. In the
    second case rates are at their nearest only if no document's p has a positive product with what is still
    missing. The document of the greatest product then joins, as a direction of its own (all rows of equal p share
    its tokens), and the least squares of the few directions and of all other rates by one factor are exact. The
    squared distance is then above its least value by at most the greatest product times the tokens.
    """
    k = len(wanted)
    p = [F.col(f"p{i}") for i in range(k)]
    totals = table.agg(F.sum("tokens").alias("t"), *[F.sum(F.col("tokens") * p[i]).alias(f"m{i}") for i in range(k)]).first()
    if not totals["t"]:
        return table.withColumn("rate", F.lit(1.0))
    whole = float(totals["t"])
    share = [max(totals[f"m{i}"] / whole, 1e-9) for i in range(k)]
    goal = [w / whole for w in wanted]
    scale = _total([p[i] / share[i] for i in range(k)])
    bounds = table.agg(*[(F.sum(F.col("tokens") * p[i] * scale) / whole).alias(f"b{i}") for i in range(k)]).first()
    step = 1 / max(bounds)
    now = table.withColumns({"rate": F.lit(1.0), "before": F.lit(1.0)})
    have = last = [totals[f"m{i}"] / whole for i in range(k)]
    speed, past = 0, []
    for i in range(1, steps + 1):
        off = [h - g for h, g in zip(have, goal)]
        past.append(sum(x * x for x in off))
        if max(map(abs, off)) < tolerance or len(past) > STALLED and min(past) > 0.95 * min(past[:-STALLED]):
            break
        if past[-1] > sum((h - g) ** 2 for h, g in zip(last, goal)):
            speed = 0
        push = speed / (speed + 3)
        speed += 1
        slope = _total([p[j] * (have[j] + push * (have[j] - last[j]) - goal[j]) for j in range(k)])
        moved = F.col("rate") + push * (F.col("rate") - F.col("before"))
        now = now.withColumn("after", F.greatest(F.lit(0.0), moved - step * scale * slope))
        now = now.select(*table.columns, F.col("after").alias("rate"), F.col("rate").alias("before"))
        if i % STEPS_A_TABLE == 0:
            now = cut(now)
        sums = now.agg(*[F.sum(F.col("rate") * F.col("tokens") * p[j]).alias(f"m{j}") for j in range(k)]).first()
        have, last = [sums[f"m{j}"] / whole for j in range(k)], have
    # Cut, as a filter on the rate would otherwise be pushed through all steps, and double its expression at each.
    now = cut(now.drop("before"))
    if max(abs(h - g) for h, g in zip(have, goal)) < tolerance:
        return now
    return _at_the_edge(now, np.array(have), np.array(goal), whole, tolerance, edges)


def _at_the_edge(now: DataFrame, have: np.ndarray, goal: np.ndarray, whole: float, tolerance: float, edges: int) -> DataFrame:
    k = len(goal)
    p = [F.col(f"p{i}") for i in range(k)]
    directions: list[np.ndarray] = []
    weights = nonnegative(have[:, None], goal)
    for _ in range(edges):
        missing = goal - np.column_stack([have, *directions]) @ weights
        product = _total([p[i] * float(missing[i]) for i in range(k)])
        best = now.where("tokens > 0").select(F.max_by(F.struct(*p), F.struct(product, *p)).alias("p"), F.max(product).alias("most")).first()
        if best["most"] is None or best["most"] <= 0.01 * tolerance or any((d == np.array(best["p"])).all() for d in directions):
            break
        directions.append(np.array(best["p"], float))
        weights = nonnegative(np.column_stack([have, *directions]), goal)
        used = weights[1:] > 0
        directions, weights = [d for d, u in zip(directions, used) if u], np.r_[weights[0], weights[1:][used]]
    if best["most"] is not None and best["most"] > tolerance:
        warnings.warn(f"rates aren't the nearest ones: a direction is left that gains {best['most']:.2e}", stacklevel=2)
    if not directions:
        return now.withColumn("rate", F.col("rate") * float(weights[0]))
    here = [reduce(lambda a, b: a & b, [p[i] == float(d[i]) for i in range(k)]) for d in directions]
    tokens = now.agg(*[F.sum(F.when(h, F.col("tokens"))).alias(f"t{i}") for i, h in enumerate(here)]).first()
    more = _total([F.when(h & (F.col("tokens") > 0), F.lit(float(w) * whole / tokens[f"t{i}"])).otherwise(0.0) for i, (h, w) in enumerate(zip(here, weights[1:]))])
    return cut(now.withColumn("rate", F.col("rate") * float(weights[0]) + more))


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float] | None = None,
    keep_all: bool = False,
    max_labelled: int = 4000,
    least_docs: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
) -> tuple[DataFrame, list[str]]:
    """((doc_id, hash, tokens, p0.., rate), domains). `labelled`: (id, domain) of documents in `docs`.

    `targets` are weights of the domains (equal, if None). The tokens to reach are those of the corpus; with
    `keep_all` they are as many more as it takes for no domain to shrink.
    """
    usable = labelled.where(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(domain_col).cast("string").alias("domain"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id", "domain").limit(max_labelled)
    keyed = _keyed(docs, id_col, text_col)
    texts = cut(keyed.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "domain"))  # at most max_labelled ids
    model, shares = learn(texts, least_docs)
    if not shares:
        plain = keyed.select("doc_id", "hash", F.size(words_of(F.col("text"))).cast("long").alias("tokens"))
        return plain.withColumn("rate", F.lit(1.0)), []
    domains = list(shares)
    weights = [max((targets or dict.fromkeys(domains, 1.0)).get(d, 0.0), 0.0) for d in domains]
    if not sum(weights):
        raise ValueError("no target is of a domain that the labelled documents have")
    weights = [w / sum(weights) for w in weights]
    table = cut(posteriors(docs, model, shares, id_col=id_col, text_col=text_col))
    have = table.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col(f"p{i}")), F.lit(0.0)).alias(f"m{i}") for i in range(len(domains))]).first()
    budget = sum(have)
    if keep_all:
        budget = max([budget, *(h / w for h, w in zip(have, weights) if w)])
    rated = fit_rates(table, [w * budget for w in weights])
    return rated.withColumn("rate", F.when(F.col("tokens") > 0, F.col("rate")).otherwise(1.0)), domains


def apply_mix(docs: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """The rows of `docs` repeated by their rates, with their columns; no document is lost.

    A rate of 2.3 is two copies, and a third where the digest of the document falls below 0.3.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    rated, _ = mix(docs, labelled, keep_all=True, **options)
    part = F.pmod(F.xxhash64(F.lit(11), "hash", "doc_id"), F.lit(1_000_000)) / 1e6
    copies = rated.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.greatest(F.floor(F.col("rate") + part), F.lit(1)).cast("int").alias("_n"))
    more = copies.where("_n > 1").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("hash"))
    joined = rows.join(more, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    times = F.explode(F.sequence(F.lit(1), F.coalesce("_n", F.lit(1))))
    return joined.select("row", times.alias("copy")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
