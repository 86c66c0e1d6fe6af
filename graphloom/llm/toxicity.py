"""Toxicity: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with word ends) and itself; a text's vector
is the weighted mean of its subwords' vectors, and two softmax rows turn it into a probability.
A subword weighs by the square of how far its toxic log-odds in the training rows are from those
of all rows, after ``prior`` rows of the usual mixture are added to its own: what both classes
hold alike weighs nothing (under ``least_odds``), what a few rows of one class hold weighs
little, and only what a single row holds (``least_rows``), which could only be memorised, is left
out. So the toxic words of a language with few rows count, however many rows the other languages
have. Rows of the rarer class are taken so many times that both classes weigh the same, which is
what makes a score of 0.7 mean the same whatever the share of toxic rows. Vectors and softmax are
learnt together, so a misspelling that training never saw shares most n-grams, and so most of its
vector, with the word it stands for. Since all is linear up to the softmax, the trained model
folds into two numbers for each bucket (share and weight), and scoring is a lookup.

Labels: a sample of at most about ``max_rows`` labelled rows and ``max_words`` words (the
smallest seeded hashes of their ids; every labelled row where there are fewer) is turned into
n-gram counts on the executors. They also sum up each bucket's rows; the driver turns the sums
into weights and gets the rows with what weighs something alone. Everything else covers every
text as a whole.

Edge cases: a text without words scores the model's bias alone; null labels and labelled ids
without a document are not trained on; without any label all scores are 0.5; repeated rows
each get a row, equal texts equal scores; very long texts are scored whole; a row with a null id is
scored and never trained on, and ``held_out`` of the query is null there; an empty table gives an
empty table; columns other than those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .workspace import discard, stash


@dataclass(frozen=True)
class Model:
    buckets: int = 1 << 20
    dim: int = 8
    least: int = 3
    most: int = 5
    max_rows: int = 5000
    max_words: int = 2_500_000
    epochs: int = 8
    least_steps: int = 400
    batch: int = 64
    rate: float = 0.05
    decay: float = 1e-2
    least_rows: int = 2
    prior: float = 50
    least_odds: float = 0.1
    seed: int = 5


def words_of(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Code points of lower-cased texts, and start, end and row of each word."""
    texts = [t or "" for t in pc.utf8_lower(column).to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    at = T.split_offsets(np.array([len(t) for t in texts], np.int64))
    word = np.zeros(len(points) + 2, bool)
    word[1:-1] = ~((points == 32) | ((points >= 9) & (points <= 13)))
    edge = np.zeros(len(points) + 2, bool)
    edge[at + 1] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[1:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | edge[2:])) + 1
    return points, start, end, np.searchsorted(at, start, "right") - 1


def subwords(column: pa.Array, model: Model) -> tuple[np.ndarray, ...]:
    """Distinct words' n-gram buckets: (row of each word, distinct word of each word, bucket of each n-gram, distinct word of each n-gram)."""
    points, start, end, row = words_of(column)
    data = points.view(np.uint8) if len(points) else np.zeros(0, np.uint8)
    _, first, which = np.unique(T.span_hashes(data, start * 4, end * 4), return_index=True, return_inverse=True)
    s, n = start[first], (end - start)[first]
    at = T.split_offsets(n + 2)
    flat = np.zeros(int(at[-1]), np.uint64)  # 60 and 62 stand for a word's two ends
    flat[at[:-1]], flat[at[1:] - 1] = 60, 62
    inside = np.ones(len(flat), bool)
    inside[at[:-1]] = inside[at[1:] - 1] = False
    flat[inside] = points[np.repeat(s - T.split_offsets(n)[:-1], n) + np.arange(n.sum())]
    owner = np.repeat(np.arange(len(s)), n + 2)
    bucket, of = [], []
    scrambled = T.mix(flat + np.uint64(1))
    for k in range(model.least, model.most + 1):
        g = T.grams(scrambled, k)
        ok = np.flatnonzero(T.within(owner, k))
        bucket.append((g[ok] & np.uint64(model.buckets - 1)).astype(np.int64))
        of.append(owner[ok])
    whole = np.add.reduceat(T.mix(scrambled + (np.arange(len(flat)) - at[owner]).astype(np.uint64) * T._M1), at[:-1]) if len(s) else np.zeros(0, np.uint64)
    bucket.append((T.mix(whole) & np.uint64(model.buckets - 1)).astype(np.int64))
    of.append(np.arange(len(s)))
    return row, which, np.concatenate(bucket), np.concatenate(of)


BAGS = "doc_id long, label long, rank long, n_words long, bag array<int>, weight array<float>"


def _listed(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    values = pa.array(np.concatenate(parts) if parts else [], kind)
    return pa.ListArray.from_arrays(pa.array(T.split_offsets(np.array([len(x) for x in parts], np.int64)).astype(np.int32)), values)


def _bags(model: Model):
    """Texts as sparse rows: bucket numbers and their weights, which add up to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.slices(batch["text"], 1 << 19):
                part = batch.slice(lo, hi - lo)
                row, which, bucket, of = subwords(part["text"], model)
                size = int(of.max()) + 1 if len(of) else 0
                share = 1 / np.maximum(np.bincount(of, minlength=size), 1)
                order = np.argsort(of, kind="stable")
                bounds = np.searchsorted(of[order], np.arange(size + 1))
                bags, weights = [], []
                for r in range(part.num_rows):
                    words, count = np.unique(which[np.searchsorted(row, r) : np.searchsorted(row, r + 1)], return_counts=True)
                    n = bounds[words + 1] - bounds[words] if len(words) else np.zeros(0, np.int64)
                    pick = order[np.repeat(bounds[words] - T.split_offsets(n)[:-1], n) + np.arange(n.sum())] if len(words) else np.zeros(0, np.int64)
                    b, back = np.unique(bucket[pick], return_inverse=True)
                    w = np.bincount(back, np.repeat(count, n) * share[of[pick]], minlength=len(b)) / max(1, count.sum())
                    bags.append(b.astype(np.int32))
                    weights.append(w.astype(np.float32))
                n_words = pa.array(np.bincount(row, minlength=part.num_rows))
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["label"], part["rank"], n_words, _listed(bags, pa.int32()), _listed(weights, pa.float32())], ["doc_id", "label", "rank", "n_words", "bag", "weight"])

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight of each entry of a batch's bags."""
    n = np.diff(batch["bag"].offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), n), batch["bag"].flatten().to_numpy(), batch["weight"].flatten().to_numpy()


def _tally(model: Model):
    """A task's sums: how many of its rows hold each bucket, and how many of those are toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, toxic = np.zeros(model.buckets, np.int64), np.zeros(model.buckets, np.int64)
        for batch in batches:
            row, bucket, _ = _flat(batch)
            np.add.at(held, bucket, 1)
            np.add.at(toxic, bucket, batch["label"].to_numpy()[row])
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some]), pa.array(toxic[some])], ["bucket", "held", "toxic"])

    return run


def _weighed(shared):
    """Bags without what weighs nothing; the weights of what is left add up to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            row, bucket, v = _flat(batch)
            v = v * weight[bucket]
            some = np.flatnonzero(v > 0)
            row, bucket, v = row[some], bucket[some], v[some]
            v = v / np.maximum(np.bincount(row, v, batch.num_rows), 1e-12)[row]
            at = T.split_offsets(np.bincount(row, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], T.binaries(bucket.astype(np.int32), at), T.binaries(v.astype(np.float32), at)], ["doc_id", "label", "bag", "weight"])

    return run


def evidence(held: np.ndarray, toxic: np.ndarray, rows: int, toxic_rows: int, model: Model) -> np.ndarray:
    """Each bucket's weight: its squared log-odds of being toxic, shrunk and relative to all rows'."""
    usual = (toxic_rows + 0.5) / (rows + 1)
    odds = np.log((toxic + model.prior * usual) / (held - toxic + model.prior * (1 - usual))) - np.log(usual / (1 - usual))
    return np.where((held >= model.least_rows) & (np.abs(odds) >= model.least_odds), odds**2, 0)


def train(bags: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Vectors and softmax by Adagrad on minibatches; returns each bucket's weight, its weighted log-odds, and the bias."""
    rng = np.random.default_rng(model.seed)
    e = rng.standard_normal((model.buckets, model.dim), np.float32)
    e *= np.float32(0.1)
    w = rng.normal(0, 0.5, (2, model.dim)).astype(np.float32)
    b = np.zeros(2, np.float32)
    ge, gw, gb = np.full(model.buckets, 1e-6, np.float32), np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    count = np.bincount(labels, minlength=2)
    times = np.where(count[labels] == count.max(), 1, max(1, round(count.max() / max(1, count.min()))))
    rows = np.repeat(np.arange(len(labels)), times)
    n = len(rows)
    scale = np.float32(np.mean([np.sqrt((x**2).sum()) for x in weights if len(x)] or [1]))
    for _ in range(max(model.epochs, -(-model.least_steps // max(1, -(-n // model.batch))))):
        order = rows[rng.permutation(n)]
        for lo in range(0, n, model.batch):
            pick = [i for i in order[lo : lo + model.batch] if len(bags[i])]
            if not pick:
                continue
            ids, at = np.concatenate([bags[i] for i in pick]), T.split_offsets(np.array([len(bags[i]) for i in pick]))
            x = np.concatenate([weights[i] for i in pick]) / scale
            text = np.add.reduceat(e[ids] * x[:, None], at[:-1])
            logits = text @ w.T + b
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = p.copy()
            d[np.arange(len(pick)), labels[pick]] -= 1
            back = np.repeat(d @ w, np.diff(at), 0) * x[:, None]
            uniq, place = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(place, back[:, k]) for k in range(model.dim)], 1).astype(np.float32) + model.decay * e[uniq]
            ge[uniq] += (grad**2).mean(1)
            e[uniq] -= model.rate * grad / np.sqrt(ge[uniq])[:, None]
            for value, g, dw in ((w, gw, d.T @ text), (b, gb, d.sum(0))):
                g += dw**2
                value -= model.rate * dw / np.sqrt(g)
    return weight, weight * (e @ (w[1] - w[0])) / scale, float(b[1] - b[0])


def _score(shared, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, odds, bias = shared.value
        for batch in batches:
            scores = []
            for lo, hi in T.slices(batch["text"], 1 << 20):
                n = hi - lo
                row, which, bucket, of = subwords(batch["text"].slice(lo, n), model)
                size = int(which.max()) + 1 if len(which) else 0
                parts = np.maximum(np.bincount(of, minlength=size), 1)
                up, down = (np.bincount(row, (np.bincount(of, x[bucket], minlength=size) / parts)[which], minlength=n) if size else np.zeros(n) for x in (odds, weight))
                scores.append(1 / (1 + np.exp(-np.clip(up / np.where(down > 0, down, 1) + bias, -60, 60))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, model: Model = Model(), doc_id="doc_id", text="text", label="toxic", usable=None) -> tuple[np.ndarray, np.ndarray, float]:
    """Train on a bounded sample of ``labels`` rows for which ``usable`` (a column of the id) holds."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("long")).alias("label"))
    if usable is not None:
        known = known.filter(usable(F.col("doc_id")))
    rank = F.pmod(F.xxhash64(F.lit(model.seed), "doc_id"), F.lit(1 << 30))
    known, count = known.withColumn("rank", rank), known.count()
    least = 1 << 30
    if count > model.max_rows:
        least = int(least * model.max_rows / count)
        known = known.filter(F.col("rank") < least)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(known, "doc_id").select("doc_id", "text", "label", "rank")
    whole = bags = stash(texts.mapInArrow(_bags(model), BAGS), "toxicity-bags")
    words = bags.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    if words > model.max_words:
        bags = bags.filter(F.col("rank") < int(least * model.max_words / words))
    n, n_toxic = bags.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return np.zeros(model.buckets), np.zeros(model.buckets), 0.0
    tally = bags.select("label", "bag", "weight").mapInArrow(_tally(model), "bucket long, held long, toxic long").groupBy("bucket").agg(F.sum("held").alias("held"), F.sum("toxic").alias("toxic")).filter(F.col("held") >= model.least_rows).toArrow()  # a row a bucket at most
    held, toxic = np.zeros(model.buckets), np.zeros(model.buckets)
    for sums, name in ((held, "held"), (toxic, "toxic")):
        sums[tally["bucket"].to_numpy()] = tally[name].to_numpy()
    weight = evidence(held, toxic, n, n_toxic, model)
    shared = docs.sparkSession.sparkContext.broadcast(weight)
    rows = bags.mapInArrow(_weighed(shared), "doc_id long, label long, bag binary, weight binary").toArrow()
    discard(whole)
    # views into what was collected, in an order that no partitioning changes
    views = []
    for name, kind in (("bag", np.int32), ("weight", np.float32)):
        data, at = T.raw(rows[name])
        rows = rows.drop_columns([name])
        views.append([data[a:b].view(kind) for a, b in zip(at[:-1], at[1:])])
    ids, labels = rows["doc_id"].to_numpy(), rows["label"].to_numpy().astype(int)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], len(views[0][i]), views[0][i].tobytes()[:64]))
    return train([views[0][i] for i in order], [views[1][i] for i in order], labels[order], weight, model)


def score(docs: DataFrame, fitted: tuple[np.ndarray, np.ndarray, float], model: Model = Model(), doc_id="doc_id", text="text") -> DataFrame:
    """``doc_id`` and ``score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((fitted[0].astype(np.float32), fitted[1].astype(np.float32), fitted[2]))  # 8 bytes a bucket, whatever the corpus
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_score(shared, model), "doc_id long, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score; labels of rows whose crc32(doc_id) mod 3 is 1 are never used."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = lambda d: F.crc32(d.cast("string").cast("binary")) % 3 == 1
    scored = score(docs, fit(docs, labels, usable=lambda d: ~held(d)))
    return scored.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
