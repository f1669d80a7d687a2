"""Quality by hierarchical empirical Bayes.

A document's own evidence is the log-odds of a logistic classifier of its measures. Its site adds what the labels of its host and
path say: the host's rate of good documents is shrunk towards the rate of all, the path's towards its host's, each with the weight
that the spread between hosts, or between the paths of a host, calls for. Sites and their counts are grouped aggregates of all
labels.

No document is judged by its own label: rates leave it out, and the classifier is fitted twice, on either half of at most about
TRAIN_ROWS labelled documents, each half being judged by the fit on the other. So the labels test all verdicts as held-out ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.common import read, staged
from clausewright.llm.quality_rules import measures

#: Labelled documents that the classifier is fitted on, on average; drawn by a hash of doc_id.
TRAIN_ROWS = 20_000
RIDGE = 1.0
#: Least and most weight of a prior, in labels.
WEIGHT = (2.0, 1000.0)
FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "stop_share", "alpha_word_share", "upper_share")
_LOGGED = ("n_words",)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic classifier by Newton's method; zeros if there is but one class."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(x.shape[1]), float(np.log(rate / (1 - rate)))
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        w += np.linalg.solve(h, z.T @ (y - p) - penalty * w)
    weights = w[:-1] / sd
    return weights, float(w[-1] - mean @ weights)


def _weight(groups: DataFrame, parent_rate: str) -> float:
    """Labels that a prior is worth: by moments, what is left of the groups' spread around their parent after sampling noise."""
    r = F.col("good") / F.col("n")
    p = F.col(parent_rate)
    noise = F.sum(p * (1 - p))
    spread = F.sum(F.col("n") * (r - p) * (r - p))
    got = groups.agg((spread - noise).alias("extra"), F.sum(F.col("n") - F.lit(1)).alias("m"), F.sum(F.col("n") * p * (1 - p)).alias("scale"), F.sum("n").alias("all")).first()
    if not got["all"] or not got["scale"]:
        return WEIGHT[0]
    between = max(0.0, got["extra"] or 0.0) / got["all"]
    rate_var = got["scale"] / got["all"]
    return float(np.clip(rate_var / between - 1 if between > 0 else WEIGHT[1], *WEIGHT))


def site_counts(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float, float, float, float]:
    """host_counts (host, host_good, host_n), path_counts (host, path, path_good, path_n), the good ones and all of them, and the weights of the hosts' and paths' priors, from labelled rows (host, path, good in 0 to 1). Nulls are sites like any other; a site without labels has no row."""
    paths = staged(labelled.groupBy("host", "path").agg(F.sum("good").alias("good"), F.count("*").alias("n")), "paths")
    good, n = (float(x or 0) for x in paths.agg(F.sum("good"), F.sum("n")).first())
    hosts = staged(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "hosts")
    k_host = _weight(hosts.withColumn("overall", F.lit(_rate(good, n))), "overall")
    rate = (F.col("h.good") + k_host * _rate(good, n)) / (F.col("h.n") + k_host)
    met = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", rate.alias("host_rate"))
    k_path = _weight(met, "host_rate")
    named = lambda df, x, keys: df.select(*keys, F.col("good").alias(f"{x}_good"), F.col("n").alias(f"{x}_n"))
    return named(hosts, "host", ["host"]), named(paths, "path", ["host", "path"]), good, n, k_host, k_path


def _rate(good, n):
    return (good + 1.0) / (n + 2.0)


def site_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, evidence (log-odds of the classifier), host_rate, path_rate, quality (0 to 1) and kept (quality >= 0.5) of each row of docs.

    A path is one within its host. A site without other labels has its parent's rate. Null texts are empty; null labels and ids don't
    count; a doc_id labelled more than once has its mean label; null and repeated doc_ids stay, and each row of a labelled doc_id is a
    labelled document."""
    keyed = docs.select(F.col("doc_id"), F.col(f"`{host}`").alias("host"), F.col(f"`{path}`").alias("path"), F.col("text"))
    mean = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("good"))
    value = lambda c: F.coalesce(F.log1p(F.col(c)) if c in _LOGGED else F.col(c), F.lit(0.0)).cast("double").alias(c)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("half")
    measured = measures(keyed, keep=("doc_id", "host", "path")).select("doc_id", "host", "path", half, *map(value, FEATURES))
    known = staged(measured.join(mean, "doc_id", "left"), "measures")
    labelled = known.where("good is not null")
    hosts, paths, good, n, k_host, k_path = site_counts(labelled.select("host", "path", "good"))
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < F.ceil(F.lit(1e6 * train_rows) / max(1.0, n)))
    rows = drawn.select("half", *FEATURES, "good").toPandas()
    fits = []
    for other in (1, 0):
        own = rows[rows["half"] == other]
        fits.append(fit(own[list(FEATURES)].to_numpy(float), (own["good"].to_numpy(float) >= 0.5).astype(float)))
    said = [sum((float(w) * F.col(c) for w, c in zip(weights, FEATURES)), F.lit(bias)) for weights, bias in fits]
    evidence = F.when(F.col("half") == 0, said[0]).otherwise(said[1])
    own, one = F.coalesce("good", F.lit(0.0)), F.col("good").isNotNull().cast("double")
    overall = (F.lit(good) - own + 1.0) / (F.lit(n) - one + 2.0)
    without = lambda x: (F.coalesce(f"{x}_good", F.lit(0.0)) - own, F.coalesce(f"{x}_n", F.lit(0)) - one)
    shrunk = lambda x, k, parent: (without(x)[0] + k * parent) / (without(x)[1] + k)
    met = (
        known.alias("d").join(hosts.alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")), "left")
        .join(paths.alias("p"), F.col("d.host").eqNullSafe(F.col("p.host")) & F.col("d.path").eqNullSafe(F.col("p.path")), "left")
        .select("doc_id", evidence.alias("evidence"), "good", overall.alias("overall"), "host_good", "host_n", "path_good", "path_n")
        .withColumn("host_rate", shrunk("host", k_host, F.col("overall")))
        .withColumn("path_rate", shrunk("path", k_path, F.col("host_rate")))
    )
    logit = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    odds = F.col("evidence") + logit("path_rate") - logit("overall")
    quality = 1 / (1 + F.exp(-odds))
    return met.select("doc_id", "evidence", "host_rate", "path_rate", quality.alias("quality"), (quality >= 0.5).alias("kept"))


def op5_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
