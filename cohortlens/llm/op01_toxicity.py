"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and documents drawn from the whole corpus (U, which hides more toxic ones) train several
classifiers. Each minimises ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``: the risk on negatives is what is left of U
after the share of toxic documents, given by the class prior, is taken out, and it may not fall below zero. Documents that
are labelled as harmless are never used as negatives.

A document is the set of character n-grams and words that it contains. Counts over P and U pick those which P has several
times as often as U, by more than chance explains; a logistic model is fitted on these.

Bounds: each of ``members`` classifiers is fitted in its own task on about ``positives`` + ``unlabelled`` documents, chosen
by a hash of the id, and keeps ``features`` n-grams at most. So the model that all tasks get has a fixed size. Scoring reads
every whole text and needs no shuffle.

Defined cases: a missing text is empty; an empty text has the model's score of a document without features; without any
confirmed toxic document all scores are 0. Repeated rows are scored each. Other columns of the input are not read.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlens.llm.common import append, hashed_share, texts_of

MEMO = 300_000


@dataclass(frozen=True)
class Settings:
    members: int = 4
    positives: int = 1500
    unlabelled: int = 3000
    features: int = 2048
    least_lift: float = 2.0
    least_gain: float = 12.0
    gram: int = 5
    steps: int = 400
    rate: float = 0.1
    l2: float = 1e-4
    seed: int = 20


@dataclass(frozen=True)
class Model:
    """``keys``: hashes of n-grams, ascending; ``weights``: a row for each of them and a column for each classifier."""

    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    gram: int


def word_keys(word: str, gram: int) -> list[int]:
    """Hashes of a word, of its ``gram``-grams with word ends, and of its start."""
    word = word.strip(".,;:!?\"'()[]{}|#*$%&<>-_/\\")
    padded = f"\x02{word}\x03"
    pieces = {padded, padded[: gram + 1]} | {padded[i : i + gram] for i in range(len(padded) - gram + 1)}
    return [zlib.crc32(x.encode()) for x in pieces]


def document_keys(text: str, gram: int, memo: dict) -> np.ndarray:
    out = set()
    for word in set(text.lower().split()):
        keys = memo.get(word)
        if keys is None:
            if len(memo) >= MEMO:
                memo.clear()
            keys = memo[word] = word_keys(word, gram)
        out.update(keys)
    return np.fromiter(out, np.uint32, len(out)).astype(np.int64)


def fit_nnpu(rows: np.ndarray, cols: np.ndarray, n_docs: int, n_features: int, positive: np.ndarray, prior: float,
             settings: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model; (rows, cols) are the ones of the document x feature matrix."""
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    unlabelled = ~positive
    share = np.where(positive, 1.0 / max(1, positive.sum()), 1.0 / max(1, unlabelled.sum()))
    mean, square = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, settings.steps + 1):
        z = b + np.bincount(rows, weights=w[cols], minlength=n_docs)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_neg = np.logaddexp(0, z)
        negative_risk = loss_neg[unlabelled].mean() - prior * loss_neg[positive].mean()
        d_neg = np.where(positive, -prior, 1.0) * share * p
        if negative_risk >= 0:
            d = d_neg + np.where(positive, prior * share * (p - 1), 0.0)
        else:  # the estimate fell below zero: step back on it alone
            d = -d_neg
        grad = np.append(np.bincount(cols, weights=d[rows], minlength=n_features) + settings.l2 * w, d.sum())
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        move = settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit_member(docs: pd.DataFrame, prior: float, settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes, weights and bias from rows of (positive, keys)."""
    positive = docs["positive"].to_numpy(bool)
    if not positive.any() or positive.all():
        return np.zeros(0, np.int64), np.zeros(0), -30.0 if not positive.any() else 0.0
    lengths = docs["keys"].map(len).to_numpy()
    flat = np.concatenate([np.asarray(x, np.int64) for x in docs["keys"]]) if lengths.sum() else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(docs)), lengths)
    keys, cols = np.unique(flat, return_inverse=True)
    n_p, n_u = positive.sum(), (~positive).sum()
    in_p = np.bincount(cols, weights=positive[rows], minlength=len(keys))
    in_u = np.bincount(cols, minlength=len(keys)) - in_p
    share_p, share_u = (in_p + 0.5) / (n_p + 1), (in_u + 1) / (n_u + 2)
    # What P gains, in nats, from its own share of the documents that have a feature over that of U.
    gain = n_p * (share_p * np.log(share_p / share_u) + (1 - share_p) * np.log((1 - share_p) / (1 - share_u)))
    score = np.where(share_p >= settings.least_lift * share_u, gain, 0)
    kept = np.sort(np.argsort(-score, kind="stable")[: settings.features])
    kept = kept[score[kept] >= settings.least_gain]
    place = np.full(len(keys), -1)
    place[kept] = np.arange(len(kept))
    used = place[cols] >= 0
    w, b = fit_nnpu(rows[used], place[cols][used], len(docs), len(kept), positive, prior, settings)
    return keys[kept], w, b


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id",
        label: str = "toxic") -> Model | None:
    """Train on ``docs`` (id and text) and the ids that ``labels`` marks with 1; the caller has removed held-out rows.
    The prior is the share of 1 among the labels. None if nothing is marked."""
    marked = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(
        F.max(label).alias("label"))
    seen = marked.agg(F.count("*").alias("n"), F.sum(F.expr("int(label = 1)")).alias("p")).first()
    if not seen["p"]:
        return None
    prior = min(0.9, max(1e-4, seen["p"] / seen["n"]))
    rows = docs.where(F.col(doc_id).isNotNull()).select(doc_id).count()
    ids = F.col(doc_id)
    bags = [
        marked.where("label = 1").where(hashed_share(ids, settings.seed + 2 * k, settings.positives, seen["p"]))
        .select(doc_id, F.lit(k).alias("member"))
        for k in range(settings.members)]
    positive_bags = bags[0]
    for bag in bags[1:]:
        positive_bags = positive_bags.union(bag)
    positive_bags = positive_bags.groupBy(doc_id).agg(F.collect_list("member").alias("as_p"))
    # At most about members * positives ids: a bound on what is broadcast, whatever the input.
    both = docs.select(doc_id, text).join(F.broadcast(positive_bags), doc_id, "left").withColumn(
        "as_u", F.array_compact(F.array(*[
            F.when(hashed_share(ids, settings.seed + 2 * k + 1, settings.unlabelled, rows), F.lit(k))
            for k in range(settings.members)])))
    both = both.where(ids.isNotNull() & (F.col("as_p").isNotNull() | (F.size("as_u") > 0)))
    gram = settings.gram

    def extract(batches):
        memo = {}
        for batch in batches:
            for x, p, u in zip(texts_of(batch, text), batch.column("as_p").to_pylist(), batch.column("as_u").to_pylist()):
                keys = document_keys(x, gram, memo)
                of = [(k, True) for k in p or ()] + [(k, False) for k in u or ()]
                if of:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _ in of], pa.int32()), pa.array([s for _, s in of], pa.bool_()),
                         pa.array([keys] * len(of), pa.list_(pa.int64()))], names=["member", "positive", "keys"])

    def train(docs: pd.DataFrame) -> pd.DataFrame:
        keys, w, b = fit_member(docs, prior, settings)
        return pd.DataFrame({"member": [int(docs["member"].iloc[0])], "keys": [keys.tolist()], "weights": [w.tolist()], "bias": [b]})

    members = (
        both.select(text, "as_p", "as_u").mapInArrow(extract, "member int, positive boolean, keys array<bigint>")
        .groupBy("member").applyInPandas(train, "member int, keys array<bigint>, weights array<double>, bias double")
        .orderBy("member").collect())  # members x features numbers
    keys = np.unique(np.concatenate([np.asarray(m["keys"], np.int64) for m in members]))
    weights = np.zeros((len(keys), len(members)))
    for k, m in enumerate(members):
        weights[np.searchsorted(keys, np.asarray(m["keys"], np.int64)), k] = m["weights"]
    return Model(keys, weights, np.array([m["bias"] for m in members]), gram)


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; an equally named column of the input is replaced."""
    docs = docs.drop(out)
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        place = {int(k): i for i, k in enumerate(m.keys)}
        memo, none = {}, ()
        for batch in batches:
            z = np.empty((batch.num_rows, len(m.bias)))
            for r, x in enumerate(texts_of(batch, text)):
                found = set()
                for word in set(x.lower().split()):
                    at = memo.get(word)
                    if at is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        at = tuple(place[k] for k in word_keys(word, m.gram) if k in place) or none
                        memo[word] = at
                    if at:
                        found.update(at)
                z[r] = m.bias + m.weights[sorted(found)].sum(axis=0)
            yield append(batch, {out: pa.array((1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean(axis=1), pa.float64())})

    return docs.mapInArrow(run, schema)
