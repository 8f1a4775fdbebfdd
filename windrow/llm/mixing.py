"""Mixing documents so that the expected tokens of each domain meet target weights, in DataFrame expressions only.

* Domains are what the labelled table tells: toxic, low quality, and high quality (all others). A naive Bayes model of
  hashed words and word shapes gives every document a posterior for each domain; its log-likelihoods are averages over
  the text's words, weighed as EVIDENCE words, so that membership stays soft.
* Rates: every document gets a rate, the number of times it is expected in the mixture. They minimise the squared
  relative misses of the domains' expected token totals plus PULL times the squared distance from a rate of one, weighed
  by tokens. Projected gradient: a step takes every rate down the slope and sets negative ones to zero; steps are
  accelerated, and start anew where they go uphill. Each sums over all documents; only the domains' sums come to the
  driver, and the rates are landed now and then. Steps end when no rate moves by CLOSE; how far the domains then are
  from their targets is logged.
* Copies: a rate's whole part, and one more with the probability of the rest, decided by a hash of the id and text.

The classifier learns from all labelled rows but those held out; scoring and sums cover all documents and whole texts. Words are
runs between ASCII white space. Null and empty texts have no tokens and the classes' prior as posterior; they weigh
nothing. A domain that no document can belong to is left unmet. Without labelled rows all posteriors are equal. Rows
with the same id and text get the same rate, and copies each. A null id counts as an id. Other columns are ignored by
`rates` and kept by `mixed`; an empty table gives no rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, functions as F

from windrow.llm.common import Landing, held_out

log = logging.getLogger(__name__)
DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.95, "low": 0.04, "toxic": 0.01}
WORDS, SHAPES = 4096, 512
EVIDENCE = 40.0
SMOOTH = 2000.0  # terms of the common distribution added to each domain
PULL = 1e-3
STEPS = 2000  # never needed; a warning tells when they don't suffice
CLOSE = 1e-5
LANDED = 8  # steps after which the rates are landed
FEW = 1 << 20  # labels that are broadcast at most; beyond, they are joined by a shuffle


def terms(df: DataFrame, *keys: str) -> DataFrame:
    """keys, term: two rows for each word, its hash and its shape's hash."""
    w = F.col("word")
    shape = F.concat(F.right(w, F.lit(2)), F.when(w == F.upper(w), "U").otherwise("l"))
    both = F.array(F.xxhash64(w).bitwiseAND(WORDS - 1), F.xxhash64(shape).bitwiseAND(SHAPES - 1) + WORDS)
    split = df.select(*keys, F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("word"))
    return split.where(w != "").select(*keys, F.explode(both).alias("term"))


def classifier(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[float]]:
    """Log-probabilities (term, one column for each domain), and the domains' log-priors."""
    domain = F.when(F.max("toxic") == 1, 2).when(F.min("quality") == 0, 1).otherwise(0)
    known = (labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(domain.alias("domain")))
    few = known.limit(FEW + 1).count() <= FEW
    rows = docs.join(F.broadcast(known) if few else known, "doc_id").select("domain", "text")
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    counts = terms(rows, "domain").groupBy("term").agg(
        *[F.count(F.when(F.col("domain") == i, 1)).cast("double").alias(d) for i, d in enumerate(DOMAINS)],
        F.count("*").cast("double").alias("every"))
    counts = Landing(docs.sparkSession, "classifier").land(counts, "counts")
    every = F.broadcast(docs.sparkSession.range(WORDS + SHAPES).withColumnRenamed("id", "term"))
    held = counts.join(every, "term", "right").na.fill(0.0)
    totals = counts.agg(*[F.sum(c).alias(c) for c in (*DOMAINS, "every")]).first()
    shared = (F.col("every") + 1) / F.lit((totals["every"] or 0.0) + WORDS + SHAPES)
    logs = held.select("term", *[F.log((F.col(d) + F.lit(SMOOTH) * shared) / F.lit((totals[d] or 0.0) + SMOOTH)).alias(d)
                                 for d in DOMAINS])
    total = sum(sizes.values())
    priors = [float((sizes.get(i, 0) + 1) / (total + len(DOMAINS))) for i in range(len(DOMAINS))]
    return logs, priors


def posteriors(docs: DataFrame, labels: DataFrame, landing: Landing) -> DataFrame:
    """doc_id, h (hash of the text), rows, tokens, and the posterior of each domain."""
    logs, priors = classifier(docs, labels)
    logs = landing.land(logs, "model")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    sums = terms(keyed, "doc_id", "h").join(F.broadcast(logs), "term").groupBy("doc_id", "h").agg(
        F.count("*").alias("n"), *[F.sum(d).alias(d) for d in DOMAINS])
    rows = keyed.groupBy("doc_id", "h").agg(F.count("*").alias("rows"))
    both = rows.join(sums.withColumnsRenamed({"doc_id": "i", "h": "j"}),
                     F.col("doc_id").eqNullSafe(F.col("i")) & F.col("h").eqNullSafe(F.col("j")), "left")
    weighed = [F.coalesce(F.col(d) / F.col("n"), F.lit(0.0)) * EVIDENCE + F.log(F.lit(p)) for d, p in zip(DOMAINS, priors)]
    top = both.select("doc_id", "h", "rows", (F.coalesce("n", F.lit(0)) / (2 * F.col("rows"))).alias("tokens"),
                      *[w.alias(d) for w, d in zip(weighed, DOMAINS)]).withColumn("top", F.greatest(*DOMAINS))
    raised = top.withColumns({d: F.exp(F.col(d) - F.col("top")) for d in DOMAINS})
    total = sum((F.col(d) for d in DOMAINS), F.lit(0.0))
    return raised.withColumn("total", total).select("doc_id", "h", "rows", "tokens",
                                                    *[(F.col(d) / F.col("total")).alias(d) for d in DOMAINS])


def fitted(held: DataFrame, targets: dict[str, float], landing: Landing) -> DataFrame:
    """`held` (rows, tokens, posteriors, and others) with the column rate."""
    goal = [targets[d] / sum(targets[x] for x in DOMAINS) for d in DOMAINS]
    mass = F.col("rows") * F.col("tokens")
    base = held.agg(*[F.sum(mass * F.col(d)) for d in DOMAINS], F.sum(mass)).first()
    total = float(base[-1] or 1.0)
    share = [max(float(v or 0.0) / total, 1e-6) for v in base[:-1]]

    def shares(name: str) -> list[Column]:
        return [F.sum(mass * F.col(name) * F.col(d)) for d in DOMAINS]

    # "_ahead" is where the next slope is taken: the rate, and on in the direction of its last step, which began at "_from"
    at = held.withColumns({"_rate": F.lit(1.0), "_ahead": F.lit(1.0), "_from": F.lit(2.0), "_last": F.lit(1.0)})
    speed = 1.0
    for step in range(STEPS):
        if step and step % LANDED == 0:
            at = landing.land(at, f"rates-{step}")
            landing.drop(f"rates-{step - LANDED}")
        found = at.agg(F.max(F.when(mass > 0, F.abs(F.col("_rate") - F.col("_from")))),
                       F.sum(mass * (F.col("_from") - F.col("_rate")) * (F.col("_rate") - F.col("_last"))),
                       *shares("_rate"), *shares("_ahead")).first()
        sums = [float(v or 0.0) / total for v in found[2:]]
        if (found[0] or 0.0) < CLOSE:
            break
        start, there = "_ahead", sums[len(DOMAINS):]
        if (found[1] or 0.0) > 0:  # the last step went uphill: without its speed
            start, there, speed = "_rate", sums[:len(DOMAINS)], 1.0
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        onward, speed = (speed - 1) / faster, faster
        slope = sum((F.col(d) * F.lit((v - g) / s) for d, v, g, s in zip(DOMAINS, there, goal, share)),
                    F.lit(PULL) * (F.col(start) - 1))
        at = at.withColumn("_next", F.greatest(F.lit(0.0), F.col(start) - slope / (1 + PULL))).select(
            *held.columns, F.col("_next").alias("_rate"),
            (F.col("_next") + F.lit(onward) * (F.col("_next") - F.col("_rate"))).alias("_ahead"),
            F.col(start).alias("_from"), F.col("_rate").alias("_last"))
    else:
        log.warning("rates aren't settled after %d steps", STEPS)
    log.info("%d steps; shares of %s less their targets: %s", step, DOMAINS, [v - g for v, g in zip(sums, goal)])
    return at.select(*held.columns, F.col("_rate").alias("rate"))


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, h, rows, tokens, the domains' posteriors, rate and copies: a row for each id and text."""
    landing = Landing(docs.sparkSession, "mixing")
    held = landing.land(posteriors(docs.select("doc_id", "text"), labels, landing), "posteriors")
    rate = F.col("rate")
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "h", F.lit("copies")), 11) * F.lit(2.0 ** -53)
    return landing.land(fitted(held, targets, landing), "rates").withColumn(
        "copies", (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int"))


def mixed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Every document as many times as its copies say."""
    by = found.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "copies")
    held = docs.withColumn("_own", F.xxhash64("text")).join(
        by, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_own").eqNullSafe(F.col("_h")))
    return held.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)
