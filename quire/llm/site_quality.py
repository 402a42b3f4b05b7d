"""Quality classifier by hierarchical empirical Bayes.

A logistic regression on dense style features, fitted on a bounded sample of
``SAMPLE`` labelled documents, gives each document its own evidence. The mean
probability of good quality of all documents is the global prior. A host's mean
is shrunk toward it and a path's mean toward its host's, each by a prior
strength that the method of moments takes from the spread between sites, so a
site with few documents says little. A document's log odds are its own plus what
its path's posterior, computed without the document itself, differs from the
global prior. All sums are grouped aggregations with partial sums before the
shuffle.

For ``documents`` the source is the host and source with language the path;
``host_of_url`` and ``path_of_url`` serve tables with urls.

Defined results: a null or empty text is scored by the features of an empty text
and its site; null hosts form one host, null paths one path of their host;
without labels of both kinds documents carry no evidence of their own and all
are kept, while one label of each kind is enough for a fit, which the ridge keeps
small; rows that share a doc_id are scored each for itself; a very long text
is a slice of its own. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import labelled, textstats
from quire.llm import textblocks as tb
from quire.llm.recovery import checkpointed
from quire.llm.skew import hot_keys, spread_join

SAMPLE = 4000
KEEP_FROM = 0.5
#: A site's prior counts for at least so many documents, however far sites differ: a handful of documents never decides.
LEAST_STRENGTH, MOST_STRENGTH = 50.0, 1e6
_NONE = "\x00"


def host_of_url(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path_of_url(url: Column) -> Column:
    """The first segment of the path."""
    return F.try_element_at(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), F.lit(2))


@dataclass
class Evidence:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))]) @ self.weights, -20, 20)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Evidence | None:
    """Ridge-penalised logistic regression by Newton steps; None where one of the two labels is missing."""
    if y.min() == y.max():
        return None
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    rows = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    w = np.zeros(rows.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge, rows.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Evidence(mean, spread, w)


def _features(batches):
    for batch in batches:
        for part, data, offsets in tb.slices(batch, "text"):
            x = textstats.style(tb.words_of(data, offsets))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), flat], ["id", "y", "x"])


def _evidence(model):
    def run(batches):
        for batch in batches:
            for part, data, offsets in tb.slices(batch, "text"):
                z = model.value.log_odds(textstats.style(tb.words_of(data, offsets))) if model.value else np.zeros(part.num_rows)
                columns = [part.column(c) for c in part.schema.names if c != "text"]
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(z)], [*names, "own"])

    return run


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(mean: Column, n: Column, prior: Column) -> Column:
    """Prior strength by moments: how many documents the prior of a site counts for."""
    between = F.sum(n * (mean - prior) * (mean - prior)) / F.sum(n)
    within = F.avg(prior) * (1 - F.avg(prior))
    noise = within * F.count("*") / F.sum(n)
    strength = F.try_divide(within, F.greatest(between - noise, F.lit(0.0))) - 1
    return F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), F.coalesce(strength, F.lit(MOST_STRENGTH))))


def assess(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", target: str = "quality", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, host, path, evidence, host_posterior, path_posterior, probability, kept and the columns in ``carry``."""
    spark = docs.sparkSession
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = labelled.sample(docs, labels, target, SAMPLE, id_col, text_col).mapInArrow(_features, "id long, y int, x array<double>").toArrow().sort_by("id").to_pydict()
    model = spark.sparkContext.broadcast(fit(np.array(rows["x"]).reshape(len(rows["y"]), -1), np.array(rows["y"], dtype=float)) if rows["y"] else None)
    slim = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(host.cast("string"), F.lit(_NONE)).alias("host"), F.coalesce(path.cast("string"), F.lit(_NONE)).alias("path"),
        *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)), F.col(text_col).cast("string").alias("text"),
    )
    scored = slim.mapInArrow(_evidence(model), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text") + ", own double")
    scored = checkpointed(scored.withColumn("p", 1 / (1 + F.exp(-F.col("own")))))  # no texts: a few numbers for each document
    paths = checkpointed(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    overall = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).select((F.col("s") / F.col("n")).alias("prior"))
    prior = overall.first()["prior"]  # null over an empty table
    prior = F.lit(0.5 if prior is None else float(prior))
    k_host = hosts.agg(_strength(F.col("host_s") / F.col("host_n"), F.col("host_n"), prior).alias("k")).first()["k"] or MOST_STRENGTH
    sites = paths.join(hosts, "host")
    k_path = sites.agg(_strength(F.col("s") / F.col("n"), F.col("n"), F.col("host_s") / F.col("host_n")).alias("k")).first()["k"] or MOST_STRENGTH
    sites = checkpointed(sites.withColumn("site", F.xxhash64("host", "path")))
    hot = hot_keys(sites, "site", "n")  # equal hashes only share their spreading
    site = scored.withColumn("site", F.xxhash64("host", "path"))
    both = spread_join(site, sites.withColumnRenamed("host", "site_host").withColumnRenamed("path", "site_path"), "site", hot, F.col("id")).where("host = site_host and path = site_path")
    host_post = (F.col("host_s") - F.col("p") + k_host * prior) / (F.col("host_n") - 1 + k_host)
    path_post = (F.col("s") - F.col("p") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    both = both.withColumn("host_posterior", host_post).withColumn("path_posterior", path_post)
    odds = F.col("own") + _logit(F.col("path_posterior")) - _logit(prior)
    both = both.withColumn("probability", 1 / (1 + F.exp(-odds)))
    open_site = lambda c: F.when(F.col(c) != _NONE, F.col(c)).alias(c)
    return both.select(
        F.col("id").alias(id_col), open_site("host"), open_site("path"), F.col("own").alias("evidence"), "host_posterior", "path_posterior", "probability",
        (F.col("probability") >= KEEP_FROM).alias("kept"), *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)),
    )


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns; rows without an id, on which nothing can be decided, stay.

    Rows that share an id are decided each by its own text and site.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = {c: F.col(names[i]) for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names).withColumn("row", F.xxhash64(own[text_col].cast("string"), own[source_col].cast("string"), own[lang_col].cast("string")))
    known = rows.where(own[id_col].isNotNull())
    judged = known.select(own[id_col].cast("long").alias("id"), own[text_col].alias("text"), own[source_col].alias("source"), own[lang_col].alias("lang"), "row")
    found = assess(judged, labels.withColumnRenamed(id_col, "id"), id_col="id", carry=("row",)).where("kept")
    kept = found.select("id", "row").distinct()
    known = known.withColumn("id", own[id_col].cast("long")).join(kept, ["id", "row"], "left_semi")
    return known.select(*names).unionByName(rows.where(own[id_col].isNull()).select(*names)).toDF(*docs.columns)
