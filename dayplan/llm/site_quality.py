"""Quality by hierarchical empirical Bayes (operator 6).

Evidence of a document is a naive Bayes log-odds over binned features of its text, learned
from labelled documents.  Sites (hosts) and paths in them get posteriors from the evidence of
all their documents: counts are sums of document probabilities, and a sparse site is shrunk
toward the global rate, a sparse path toward its site, by as much as the spread of the rates
between sites (between paths) says.  A document's score joins its own evidence with the
posterior of its path from the other documents there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayplan.llm.common import SPACES
from dayplan.sources.staging import stage

#: Equal steps of a feature's range; the outermost bins are open.
BINS = 16
#: Rows that every bin of either class has beforehand.
SMOOTHING = 1.0
#: Features overlap in what they say; their log-odds count this much.
TEMPER = 0.5
KEEP_AT = 0.5
#: Bounds of a prior's weight in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0


def share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def features(text: str) -> dict[str, Column]:
    """Measures of a text between 0 and 1; all are 0 for a missing or empty one."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = F.length(value)
    lines = F.split(value, "\n", -1)
    n_words = F.regexp_count(value, F.lit(f"[^{SPACES}]+"))
    counted = lambda characters: n - F.length(F.translate(value, characters, ""))
    return {
        "long": F.least(F.log1p(n.cast("double")) / 14, F.lit(1.0)),
        "symbols": share(counted("#*$%&|<>"), n),
        "shouting": share(counted("!?"), n),
        "capitals": share(counted("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n),
        "digits": share(counted("0123456789"), n),
        "stops": F.least(10 * share(counted(".,;:"), n), F.lit(1.0)),
        "word_length": F.least(share(n, n_words) / 20, F.lit(1.0)),
        "repeated_lines": 1 - share(F.size(F.array_distinct(lines)), F.size(lines)),
        "distinct_words": share(F.size(F.array_distinct(F.split(value, f"[{SPACES}]+", -1))), n_words + 1),
    }


def binned(docs: DataFrame, text: str = "text") -> DataFrame:
    bin_of = lambda value: F.least(F.floor(value * BINS), F.lit(BINS - 1)).cast("int")
    # Most shares are small: their square roots spread better over the bins.
    return docs.withColumn("bins", F.array(*[bin_of(F.sqrt(F.greatest(v, F.lit(0.0)))) for v in features(text).values()]))


def evidence_tables(labelled: DataFrame) -> DataFrame:
    """``(feature, bin, log_odds)`` of every bin, from ``labelled(bins, good)``.

    The rows are counts by feature, bin and class, summed with map-side combine: there are
    at most features times bins of them, whatever the number of labels.
    """
    each = labelled.select("good", F.posexplode("bins").alias("feature", "bin"))
    good = F.sum(F.col("good").cast("bigint"))
    counts = each.groupBy("feature", "bin").agg(good.alias("n_good"), (F.count("*") - good).alias("n_bad"))
    totals = labelled.agg(F.sum(F.col("good").cast("bigint")).alias("g"), F.count("*").alias("n")).first()
    all_good, all_bad = totals.g or 0, totals.n - (totals.g or 0)
    of = lambda n, total: (F.col(n) + SMOOTHING) / F.lit(float(total + SMOOTHING * BINS))
    return counts.select("feature", "bin", F.log(of("n_good", all_good) / of("n_bad", all_bad)).alias("log_odds"))


def logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def prior_weight(groups: DataFrame, rate: str, towards: Column) -> DataFrame:
    """The weight of the prior in documents, by moments: one row, ``weight``.

    ``groups`` have n, good and the rate they are shrunk to.  The spread of group rates beyond
    what chance gives is the spread of the prior; without any the prior weighs most.
    """
    p = F.col(rate)
    wide = F.col("n") >= 2
    chance = F.sum(F.when(wide, p * (1 - p)))
    spread = F.sum(F.when(wide, (towards - p) * (towards - p) * F.col("n")))
    n_groups, n_docs = F.sum(F.when(wide, 1)), F.sum(F.when(wide, F.col("n")))
    between = (spread - chance) / (n_docs - n_groups)
    weight = (chance / n_groups) / F.greatest(between, F.lit(1e-9)) - 1
    return groups.agg(F.coalesce(F.least(F.greatest(weight, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)), F.lit(MOST_WEIGHT)).alias("weight"))


def site_posteriors(evidence: DataFrame, site: str, path: str, prior: float) -> DataFrame:
    """``(site, path)`` with n, good, site_n, site_good, site_rate's parts and both weights."""
    paths = stage(
        evidence.groupBy(site, path).agg(F.count("*").alias("n"), F.sum("p").alias("good")).withColumn("global_rate", F.lit(prior)),
        "path-sums",
    )
    sites = stage(
        paths.groupBy(site).agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.first("global_rate").alias("global_rate")), "site-sums"
    )
    site_weight = prior_weight(sites, "global_rate", F.col("good") / F.col("n")).first().weight
    named = sites.select(F.col(site).alias("_site"), F.col("n").alias("site_n"), F.col("good").alias("site_good"))
    both = paths.join(named, paths[site].eqNullSafe(named["_site"])).drop("_site")
    site_rate = (F.col("site_good") + site_weight * prior) / (F.col("site_n") + site_weight)
    both = both.withColumn("site_rate", site_rate)
    path_weight = prior_weight(both, "site_rate", F.col("good") / F.col("n")).first().weight
    return both.withColumn("site_weight", F.lit(site_weight)).withColumn("path_weight", F.lit(path_weight))


def quality(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: doc_id, evidence, site_rate, path_rate, score, kept.

    ``labels(doc_id, quality)`` name good (1) and bad (0) documents; missing ones and those
    of unknown documents are left out, and a document with labels of both kinds counts for
    both.  ``site_rate`` and ``path_rate`` leave the document itself out.  Documents without
    a site are a site together, and alike for paths.  Without any labels all evidence is 0
    and every score one half.
    """
    held = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(site).cast("string").alias("_s"), F.col(path).cast("string").alias("_p"), F.col("text").alias("_text")
    )
    rows = stage(binned(held, "_text").drop("_text"), "quality-bins")
    named = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    named = named.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 1).alias("good"))
    labelled = stage(rows.join(named, "doc_id").select("bins", "good"), "labelled-bins")
    totals = labelled.agg(F.sum(F.col("good").cast("bigint")).alias("g"), F.count("*").alias("n")).first()
    prior = ((totals.g or 0) + 1) / (totals.n + 2)
    # One number for every bin of every feature: a list of fixed length that goes into the plan.
    table = [0.0] * (BINS * len(features("text")))
    for entry in evidence_tables(labelled).collect() if totals.n else []:
        table[entry.feature * BINS + entry.bin] = entry.log_odds
    known = F.array(*map(F.lit, table))
    log_odds = F.aggregate(F.transform("bins", lambda b, i: F.get(known, i * BINS + b)), F.lit(0.0), lambda a, x: a + x)
    evidence = rows.select("doc_id", "_s", "_p", (TEMPER * log_odds).alias("evidence"))
    evidence = stage(evidence.withColumn("p", sigmoid(F.col("evidence") + logit(F.lit(prior)))), "quality-evidence")
    sites = stage(site_posteriors(evidence, "_s", "_p", prior), "site-posteriors")
    known_sites = sites.withColumnRenamed("_s", "_site").withColumnRenamed("_p", "_path").drop("site_rate", "global_rate")
    same = evidence["_s"].eqNullSafe(known_sites["_site"]) & evidence["_p"].eqNullSafe(known_sites["_path"])
    joined = evidence.join(known_sites, same)
    site_rate = (F.col("site_good") - F.col("p") + F.col("site_weight") * prior) / (F.col("site_n") - 1 + F.col("site_weight"))
    path_rate = (F.col("good") - F.col("p") + F.col("path_weight") * F.col("site_rate")) / (F.col("n") - 1 + F.col("path_weight"))
    scored = joined.withColumn("site_rate", site_rate).withColumn("path_rate", path_rate)
    scored = scored.withColumn("score", sigmoid(F.col("evidence") + logit(F.col("path_rate"))))
    return scored.select("doc_id", "evidence", "site_rate", "path_rate", "score", (F.col("score") >= keep_at).alias("kept"))
