"""Toxicity by a counterfactual-regularised classifier.

A document is the set of its words' features: each lower-cased word of letters and its prefixes of
4 to 6 characters. At most ``FEATURES`` features that tell toxic from other documents best, by
difference of document frequencies in the training sample (``MIN_Z`` standard deviations or more),
and the identity terms enter a logistic
model. Its loss has a second term: each sample sentence that names a group is written again with
the group's term swapped for every other, neutral sentences about each group are added, and the
mean squared difference of the two scores' logits, over all these pairs, is penalised. So a mention
alone moves no score. The pairs enter as the sum of their outer products, made where the texts are.

Training takes at most ``SAMPLE`` documents of each label, those of the smallest hashed ids; every
document is scored by its whole text. Labels, language, source and id are never features.

Defined results: null or empty text has no feature and scores as the intercept says; ids labelled
twice count as toxic if one label says so; null labels are none; without labels of both kinds every
score is the share of toxic labels (0 without labels); repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordTable, discard, ids_and_text, remainder, slices, stash, tidy

SAMPLE = 3000
FEATURES = 1500
MIN_DOCS = 4
#: A feature enters only this many standard deviations apart: of 100,000 random ones about none is.
MIN_Z = 5.0
THRESHOLD = 0.3
RIDGE = 2e-4
COUNTERFACTUAL = 1.0
WORD = re.compile(r"[^\W\d_]+")

#: Group terms that are swapped for one another within their row.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrants", "refugees", "locals", "foreigners"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("disabled", "deaf", "blind", "elderly"),
)
NEUTRAL = ("many {} live in this town", "the {} people spoke at the meeting", "our {} neighbours came to dinner")
_GROUP = {t: row for row in IDENTITY for t in row}


def word_features(word: str) -> tuple[str, ...]:
    return (word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n))


def text_words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def swapped(words: set[str]) -> list[tuple[set[str], set[str]]]:
    """(words, words with one group term swapped) for every term and each other of its row."""
    return [(words, words - {t} | {u}) for t in sorted(words & _GROUP.keys()) for u in _GROUP[t] if u != t]


def gap_counts(texts, at: dict[str, int]) -> tuple[dict[tuple[int, int], int], int]:
    """The sum, over every counterfactual pair of every sentence, of the outer product of the pair's
    difference in features with itself, by its entries; and the number of pairs."""
    out: dict[tuple[int, int], int] = {}
    n = 0

    def vector(words: set[str]) -> set[int]:
        return {at[f] for w in words for f in word_features(w) if f in at}

    for text in texts:
        if not _GROUP.keys() & text_words(text):
            continue
        for sentence in re.split(r"[.!?\n]+", text):
            for a, b in swapped(text_words(sentence)):
                n += 1
                va, vb = vector(a), vector(b)
                row = [(f, 1) for f in va - vb] + [(f, -1) for f in vb - va]
                for i, p in row:
                    for j, q in row:
                        out[i, j] = out.get((i, j), 0) + p * q
    return out, n


class Scorer:
    """weights by feature, and the intercept."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def table(self) -> WordTable:
        get = self.weights.get
        return WordTable(lambda w: tuple((f, v) for f in word_features(w) if (v := get(f))), limit=100_000)

    def logit(self, text: str, table) -> float:
        found: dict[str, float] = {}
        for w in text_words(text):
            if hits := table[w]:
                found.update(hits)
        return self.intercept + sum(sorted(found.values()))


def _fit(x, y, gap, ridge: float):
    """Newton's method on the logistic loss, the ridge and the quadratic form ``gap`` of the weights."""
    import numpy as np

    n, d = x.shape
    w, b = np.zeros(d), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    still = gap + ridge * np.eye(d)
    for _ in range(12):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        s = np.maximum(p * (1 - p), 1e-4) / n
        g = np.append(x.T @ (p - y) / n + still @ w, (p - y).mean())
        h = np.empty((d + 1, d + 1))
        xs = x * s[:, None]
        h[:d, :d] = xs.T @ x + still
        h[:d, d] = h[d, :d] = xs.sum(0)
        h[d, d] = s.sum() + 1e-9
        move = np.linalg.solve(h, g)
        w, b = w - move[:d], b - move[d]
        if np.abs(move).max() < 1e-4:
            break
    return w, b


def train(docs: DataFrame, labels: DataFrame, held_mod: int = 4, held_rest: int = 2, sample: int = SAMPLE, features: int = FEATURES, ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL) -> Scorer:
    """Fit on labelled documents outside the held-out part."""
    import numpy as np

    known = (
        labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
        .filter(remainder(F.col("doc_id"), held_mod) != held_rest)
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(sample).union(known.filter("toxic <> 1").orderBy(*order).limit(sample))
    chosen = stash(chosen, "chosen")  # at most 2 * sample rows
    rows = stash(ids_and_text(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", F.col("toxic").cast("int").alias("toxic")), "sample")

    def to_features(batches):
        import pyarrow as pa

        for batch in batches:
            f = [sorted({x for w in text_words(t) for x in word_features(w)}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(f, pa.list_(pa.string()))], names=["toxic", "f"])

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    if not n1 or not n0:
        discard(chosen, rows)
        p = min(max(n1 / max(1, n1 + n0), 1e-6), 1 - 1e-6)
        return Scorer({}, float(np.log(p / (1 - p))))
    counts = rows.mapInArrow(tidy(to_features), "toxic int, f array<string>").select("toxic", F.explode("f").alias("f")).groupBy("f").agg(
        F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") != 1).alias("o")
    )
    # Difference of frequencies against its standard deviation: features that any text has stand low.
    share = (F.col("t") + F.col("o") + 1) / (n1 + n0 + 1)
    z = F.abs(F.col("t") / n1 - F.col("o") / n0) / F.sqrt(share * (1 - share * 0.999) * (1 / n1 + 1 / n0))
    best = counts.filter((F.col("t") + F.col("o") >= MIN_DOCS) & (z >= MIN_Z)).orderBy(z.desc(), "f").limit(features).collect()
    names = sorted({r["f"] for r in best} | _GROUP.keys())
    at = {f: i for i, f in enumerate(names)}

    def vector(words: set[str]) -> set[int]:
        return {at[f] for w in words for f in word_features(w) if f in at}

    def to_vectors(batches):
        import pyarrow as pa

        for batch in batches:
            v = [sorted(vector(text_words(t))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(v, pa.list_(pa.int32()))], names=["toxic", "v"])

    def to_gaps(batches):
        import pyarrow as pa

        for batch in batches:
            entries, n = gap_counts(batch.column(0).to_pylist(), at)
            cells = [(-1, -1, n), *[(i, j, v) for (i, j), v in entries.items()]]
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "v"])

    got = rows.mapInArrow(tidy(to_vectors), "toxic int, v array<int>").toPandas()  # at most 2 * sample rows
    # Features of group terms alone differ in a pair: a few thousand entries, whatever the texts.
    gaps = rows.mapInArrow(tidy(to_gaps), "i int, j int, v long").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    discard(chosen, rows)
    docs_ = sorted((int(t), tuple(v)) for t, v in zip(got["toxic"], got["v"]))
    neutral = [s.format(t) for s in NEUTRAL for t in _GROUP]
    x = np.zeros((len(docs_) + len(neutral), len(names)), np.float64)
    y = np.zeros(len(x))
    for i, (t, v) in enumerate(docs_):
        x[i, list(v)] = 1
        y[i] = t == 1
    for i, text in enumerate(neutral):
        x[len(docs_) + i, list(vector(text_words(text)))] = 1
    own, pairs = gap_counts(neutral, at)
    gap = np.zeros((len(names), len(names)))
    for (i, j), v in own.items():
        gap[i, j] += v
    for r in gaps:
        if r["i"] < 0:
            pairs += r["v"]
        else:
            gap[r["i"], r["j"]] += r["v"]
    w, b = _fit(x, y, gap * (counterfactual / max(1, pairs)), ridge)
    return Scorer({f: float(v) for f, v in zip(names, w)}, float(b))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, held_mod: int = 4, held_rest: int = 2, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scorer = train(docs, labels, held_mod, held_rest, **options)
    rows = ids_and_text(docs).withColumn("held_out", remainder(F.col("doc_id"), held_mod) == held_rest)
    out = scored(rows, scorer, ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scored(rows: DataFrame, scorer: Scorer, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns of ``rows`` with the score of their ``text`` in ``name``."""
    shared = rows.sparkSession.sparkContext.broadcast((scorer.weights, scorer.intercept))  # FEATURES entries
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(name, T.DoubleType())])

    def run(batches):
        import math

        import pyarrow as pa

        s = Scorer(*shared.value)
        table = s.table()
        for batch in batches:
            out = []
            for texts in slices(batch.column(at)):
                for t in texts:
                    z = s.logit(t or "", table)
                    out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
                table.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.float64())], names=[*keep, name])

    at = keep.index("text") if "text" in keep else len(keep)  # the text moves once
    return rows.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(tidy(run), schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
