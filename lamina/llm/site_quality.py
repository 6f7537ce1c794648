"""Quality of documents, from their text and from the sites they come from, by empirical Bayes.

A document's evidence is the log likelihood ratio of a logistic classifier over shape features of its text.
Sites carry a rate of good documents at two levels: a host's rate is drawn around the rate of all documents, a
path's rate around that of its host. How tightly is estimated from the data, by comparing the spread between
groups with that inside them (method of moments). A rate's posterior then is the group's soft count of good
documents, shrunk towards the level above: much for sparse sites, little for large ones, wholly where sites do
not differ. A document's score joins its evidence with the rate of its path as the other documents show it.

The classifier reads the text once; all else is grouped aggregation over small rows, pre-aggregated before the
shuffle, so a host with a third of all rows is no burden.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.batches import map_texts, training_span
from lamina.session import durable

FEATURES = ("chars", "upper", "symbols", "bars", "marks", "digits", "spaces", "lines", "word_length", "different", "repeated", "different_lines")
SYMBOLS = "#$%&*@^~<>=+_"
NEVER = 1e6


def shape_features(texts: list[str | None]) -> np.ndarray:
    """A row of ``FEATURES`` per text; null is empty."""
    found = np.zeros((len(texts), len(FEATURES)))
    symbols = [ord(c) for c in SYMBOLS]
    for n, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        words, lines = text.split(), text.split("\n")
        size, count = len(data), max(len(words), 1)
        letters = seen[65:91].sum() + seen[97:123].sum()
        again = sum(map(str.__eq__, words, words[1:]))
        found[n] = (
            np.log1p(len(text)), seen[65:91].sum() / max(letters, 1), seen[symbols].sum() / size, seen[124] / count,
            (seen[33] + seen[63]) / count, seen[48:58].sum() / size, seen[32] / size, len(lines) / count,
            sum(map(len, words)) / count, len(set(words)) / count ** 0.8, again / count, len(set(lines)) / len(lines))
    return found


class Classifier:
    """Logistic regression over features cut at quantiles; ``odds`` leaves out the prior of its sample."""

    def __init__(self):
        self.cuts: list[np.ndarray] = [np.zeros(0)] * len(FEATURES)
        self.weights = np.zeros(len(FEATURES) + 1)

    def _design(self, features: np.ndarray) -> np.ndarray:
        columns = [np.ones((len(features), 1))]
        for k, cuts in enumerate(self.cuts):
            columns.append((features[:, k, None] > cuts[None, :]).astype(np.float64) if len(cuts) else np.zeros((len(features), 1)))
        return np.hstack(columns)

    def fit(self, features: np.ndarray, labels: np.ndarray, bins: int = 24, ridge: float = 1.0) -> None:
        self.weights = np.zeros(len(FEATURES) + 1)
        if not len(labels) or labels.min() == labels.max():
            return
        # Cuts at quantiles of the rarer class too, which is where the two part.
        rare = features[labels == (labels.mean() < 0.5)]
        levels = np.linspace(0, 1, bins + 1)[1:-1]
        self.cuts = [np.unique(np.r_[np.quantile(features[:, k], levels), np.quantile(rare[:, k], levels)]) for k in range(len(FEATURES))]
        design = self._design(features)
        weights = np.zeros(design.shape[1])
        penalty = np.full(len(weights), ridge)
        penalty[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
            slope = design.T @ (labels - p) - penalty * weights
            step = np.linalg.solve((design.T * (p * (1 - p))) @ design + np.diag(penalty), slope)
            weights += step
            if np.abs(step).max() < 1e-6:
                break
        weights[0] -= np.log(labels.mean() / (1 - labels.mean()))
        self.weights = weights

    def odds(self, texts: list[str | None]) -> np.ndarray:
        return np.clip(self._design(shape_features(texts)) @ self.weights, -20, 20)


def fit_classifier(
    docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    train_rows: int = 6000, train_chars: int = 20_000, seed: int = 13,
) -> tuple[Classifier, float]:
    """A classifier from a bounded sample of labelled rows, and the rate of good ones among all labels.

    The sample is the ``train_rows`` labelled rows with the smallest hashes; of a text of more than
    ``train_chars`` code points a span of that length is learned from.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learnable).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    rate = marked.agg(F.avg(F.col("_label").cast("double"))).first()[0]
    rows = docs.where(learnable & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("_id"), training_span(F.col(text_col), F.col(id_col), train_chars, seed).alias("_text"))
    drawn = rows.select("_id").join(marked, "_id").orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(train_rows)
    sample = rows.join(F.broadcast(drawn), "_id").toArrow().to_pandas().sort_values(["_id", "_text"])
    found = Classifier()
    found.fit(shape_features(sample["_text"].tolist()), sample["_label"].to_numpy(np.float64))
    return found, 0.5 if rate is None else float(np.clip(rate, 0.001, 0.999))


def text_evidence(docs: DataFrame, classifier: Classifier, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """``(id, evidence)`` and the ``carried`` columns: the log likelihood ratio of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(classifier))  # a few hundred numbers

    def work():
        model = Classifier()
        vars(model).update(sent.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.odds(batch.column(1).to_pylist())), *batch.columns[2:]], ["id", "evidence", *carried])

        return step

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"), *carried)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return map_texts(picked, 1, work, ", ".join([f"id {kinds[id_col]}", "evidence double", *(f"`{c}` {kinds[c]}" for c in carried)]))


def _concentration(groups: DataFrame, rate: Column, around: Column, inside: float, mean: float) -> float:
    """How tightly group rates lie around those above: the weight, in documents, of the level above.

    Of the squares between groups, what documents alone would cause is taken off; the rest is the
    variance of rates. None left: groups do not differ.
    """
    q, number, size, squares = groups.agg(
        F.sum(F.col("n") * F.pow(rate - around, F.lit(2))), F.count("*"), F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    spare = (size or 0) - (squares or 0) / size if size else 0
    if not size or spare <= 0:
        return NEVER
    variance = (q - (number - 1) * inside) / spare
    return float(np.clip(mean * (1 - mean) / variance - 1, 0.5, NEVER)) if variance > 0 else NEVER


def score_sites(evidence: DataFrame, prior: float) -> DataFrame:
    """``evidence`` (id, host, path, evidence) with ``host_rate``, ``path_rate`` and ``score``.

    ``prior`` is the rate of good documents before any site is looked at. Null hosts are one host, null
    paths one path of their host. Rates leave out the document itself.
    """
    start = float(np.log(prior / (1 - prior)))
    each = evidence.withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + F.lit(start)))))
    paths = durable(each.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")))
    hosts = durable(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("ss").alias("hss"), F.count("*").alias("paths")))
    n, s, h, ss, inside_hosts = hosts.agg(F.sum("hn"), F.sum("hs"), F.count("*"), F.sum("hss"), F.sum(F.col("hss") - F.col("hs") * F.col("hs") / F.col("hn"))).first()
    if not n:
        return each.select("id", "host", "path", "evidence", F.lit(prior).alias("host_rate"), F.lit(prior).alias("path_rate"), F.col("p").alias("score"))
    mean = min(max(s / n, 1e-6), 1 - 1e-6)
    by_host = hosts.select(F.col("hn").alias("n"), "hs")
    top = _concentration(by_host, F.col("hs") / F.col("n"), F.lit(mean), inside_hosts / max(n - h, 1), mean)
    known = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).select(paths["host"].alias("k_host"), paths["path"].alias("k_path"), "n", "s", "ss", "hn", "hs")
    inside_paths, groups = known.agg(F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")), F.count("*")).first()
    low = _concentration(known.where("hn > n"), F.col("s") / F.col("n"), F.col("hs") / F.col("hn"), inside_paths / max(n - groups, 1), mean)
    joined = each.join(known, each["host"].eqNullSafe(F.col("k_host")) & each["path"].eqNullSafe(F.col("k_path")))
    host_rate = (F.col("hs") - F.col("p") + top * mean) / (F.col("hn") - 1 + top)
    path_rate = (F.col("s") - F.col("p") + low * F.col("host_rate")) / (F.col("n") - 1 + low)
    bounded = F.least(F.greatest(F.col("path_rate"), F.lit(1e-4)), F.lit(1 - 1e-4))
    return (
        joined.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
        .withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + F.log(bounded / (1 - bounded))))))
        .select("id", "host", "path", "evidence", "host_rate", "path_rate", "score")
    )


def score_quality(
    docs: DataFrame, classifier: Classifier, prior: float, id_col: str = "doc_id", text_col: str = "text", host_col: str = "host", path_col: str = "path",
) -> DataFrame:
    """``(id, host, path, evidence, host_rate, path_rate, score)`` per row of ``docs``; whole texts are read.

    Null texts are empty. Repeated rows count as often as they are there; null ids keep their rows. No
    rows: no rows. Further columns are not read.
    """
    sited = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_body"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    return score_sites(durable(text_evidence(sited, classifier, "_doc", "_body", ["host", "path"])), prior)
