"""Vectors: products, nearest neighbours, clusters and the impact of changed symbols."""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..index import Index
from ..plans.frames import numbered


def dot(a, b):
    return F.aggregate(F.zip_with(X.col(a), X.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v):
    return F.sqrt(F.aggregate(X.col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v):
    """A unit vector; a zero vector stays."""
    v, n = X.col(v), norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(X.col(a), X.col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def literal(vector: list[float]):
    return F.array(*[F.lit(float(x)) for x in vector])


def _scores(query: list[float]):
    wanted = np.array(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch["vector"].is_valid())
            flat = batch["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch["symbol_id"].cast(pa.int64()), pa.array(flat.reshape(-1, len(wanted)) @ wanted)], ["symbol_id", "score"])

    return run


def top_k(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """(symbol_id, score) of the k nearest by dot product; ties by id. Each task keeps k rows.

    Scores are one matrix product a batch: over wide vectors some three times as fast as folding
    arrays in the JVM, which runs outside generated code (see README)."""
    scored = vectors.select("symbol_id", "vector").mapInArrow(_scores(query), "symbol_id long, score double")
    return scored.orderBy(F.desc("score"), "symbol_id").limit(k)


def resolved(scored: DataFrame, ix: Index) -> DataFrame:
    """Scores with their symbols; ids without one are dropped."""
    own = ix.symbols.select(F.col("id").alias("symbol_id"), "name", "kind", "file", "line")
    return scored.join(own, "symbol_id").select("symbol_id", "name", "kind", "file", "line", "score").orderBy(F.desc("score"), "symbol_id")


def scoped(ix: Index, prefix: str) -> DataFrame:
    """Fresh vectors below a path prefix, upper and lower case apart."""
    return ix.embeddings.filter(F.col("file").startswith(prefix) & ~F.col("stale"))


def of_files(ix: Index, files: DataFrame) -> DataFrame:
    """Vectors of a set of files, stale ones too."""
    return ix.embeddings.join(files.select("file").distinct(), "file", "left_semi")


def ask(ix: Index, query: list[float], k: int = 50, files: DataFrame | None = None) -> DataFrame:
    """Nearest symbols, of ``files`` alone where given; stale vectors count here."""
    return resolved(top_k(ix.embeddings if files is None else of_files(ix, files), query, k), ix)


def without_structural(semantic: DataFrame, structural: DataFrame) -> DataFrame:
    return semantic.join(structural.select("file", "line").distinct(), ["file", "line"], "left_anti")


#: Vectors times changes that a task's products hold at a time: 8 MB of scores, and a few times that while they are ranked.
PRODUCTS = 1 << 20


def _merged(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each column the k rows of highest score, then least id, exactly: ties at the k-th score go by id."""
    order = np.argsort(ids, axis=0, kind="stable")
    score, ids = np.take_along_axis(score, order, 0), np.take_along_axis(ids, order, 0)
    best = np.argsort(-score, axis=0, kind="stable")[:k]
    return np.take_along_axis(score, best, 0), np.take_along_axis(ids, best, 0)


def _nearest(shared, k: int):
    """Of a task's vectors, the k nearest to each change; ties by id. What a task holds follows neither its rows nor ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.load(BytesIO(shared.value))  # a worker keeps the bytes only
        n = len(wanted)
        best, who = np.full((k, n), -np.inf), np.full((k, n), np.iinfo(np.int64).max)
        rows = max(1, PRODUCTS // n)
        for batch in batches:
            batch = batch.filter(batch["vector"].is_valid())
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part["symbol_id"].cast(pa.int64()).to_numpy(zero_copy_only=False)
                by_id = np.argsort(ids, kind="stable")
                ids = ids[by_id]
                flat = part["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                scores = np.round(flat.reshape(len(ids), -1)[by_id] @ wanted.T, 12)  # products of equal vectors are equal wherever they stand
                least = np.partition(scores, len(ids) - k, axis=0)[len(ids) - k] if len(ids) > k else np.full(n, -np.inf)
                above = scores > least
                equal = scores == least  # the first of them by id fill what is left of k
                equal &= np.cumsum(equal, axis=0, dtype=np.int32) <= k - above.sum(axis=0)
                change, row = np.nonzero((above | equal).T)
                nth = np.arange(len(change)) - np.searchsorted(change, change)
                found, own = np.full((k, n), -np.inf), np.full((k, n), np.iinfo(np.int64).max)
                found[nth, change], own[nth, change] = scores[row, change], ids[row]
                best, who = _merged(np.concatenate([best, found]), np.concatenate([who, own]), k)
        nth, change = np.nonzero(who != np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(change.astype(np.int32)), pa.array(who[nth, change]), pa.array(best[nth, change])], ["change", "symbol_id", "score"])

    return run


def impact(changed: DataFrame, ix: Index, k: int = 20, block: int = 1024) -> DataFrame:
    """Symbols near changed ones: ``changed`` has (name, vector), and kind, file and scope where names alone do not tell
    changes apart. Each change's k nearest other symbols, then the best change for each symbol. Changes go to every
    task ``block`` at a time, which is what bounds the broadcast; a task sends on k rows a change."""
    itself = [c for c in ("name", "kind", "file") if c in changed.columns]
    spark, session, number = ix.symbols.sparkSession.sparkContext, ix.symbols.sparkSession, 0
    near, held = None, []

    def scored(rows: list) -> DataFrame:
        np.save(packed := BytesIO(), np.array([r["vector"] for r in rows], np.float64))
        shared = spark.broadcast(packed.getvalue())
        names = session.createDataFrame([(n, number, *[r[c] for c in itself]) for n, r in enumerate(rows)], "change int, part int, " + ", ".join(f"own_{c} string" for c in itself))
        return ix.embeddings.select("symbol_id", "vector").mapInArrow(_nearest(shared, k), "change int, symbol_id long, score double").join(names, "change")

    for row in changed.select(*itself, "vector").toLocalIterator():
        held.append(row)
        if len(held) == block:
            near, held, number = scored(held) if near is None else near.unionByName(scored(held)), [], number + 1
    if held or near is None:
        last = scored(held) if held else None
        near = last if near is None else near.unionByName(last)
    if near is None:
        near = session.createDataFrame([], "change int, symbol_id long, score double, part int, " + ", ".join(f"own_{c} string" for c in itself))
    w = Window.partitionBy("part", "change").orderBy(F.desc("score"), "symbol_id")
    near = near.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)
    same = ix.symbols.select(F.col("id").alias("symbol_id"), *(F.col(c).alias(f"own_{c}") for c in itself))
    others = near.join(same, same.columns, "left_anti").select(F.col("own_name").alias("changed"), "symbol_id", "score")
    own = ix.symbols.select(F.col("id").alias("symbol_id"), "name", "kind", "file", "line")
    best = Window.partitionBy("name", "kind", "file", "line").orderBy(F.desc("score"), "changed", "symbol_id")
    out = others.join(own, "symbol_id").withColumn("r", F.row_number().over(best)).filter("r = 1")
    return out.select("changed", "name", "kind", "file", "line", "score").orderBy(F.desc("score"), "name", "file", "line")


def centroids(vectors: DataFrame, by: str = "cluster") -> DataFrame:
    """(cluster, dim, mean) of each dimension, summed before the exchange."""
    return vectors.select(by, F.posexplode("vector").alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def silhouette(points: DataFrame, most: int = 1000) -> DataFrame:
    """Mean silhouette of (id, cluster, vector) with plain distances; lone members count 0.

    The score is defined on at most about ``most`` points, every n-th by id, so its pairs are bounded."""
    sample = strided(points, "id", most)
    a = sample.select("id", "cluster", "vector")
    b = sample.select(F.col("id").alias("id2"), F.col("cluster").alias("cluster2"), F.col("vector").alias("v2"))
    to = a.crossJoin(b).filter("id <> id2").groupBy("id", "cluster", "cluster2").agg(F.avg(distance("vector", "v2")).alias("d"))
    each = to.groupBy("id", "cluster").agg(F.min(F.when(F.col("cluster") == F.col("cluster2"), F.col("d"))).alias("a"), F.min(F.when(F.col("cluster") != F.col("cluster2"), F.col("d"))).alias("b"))
    score = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.avg(score).alias("silhouette"), F.count("*").alias("points"))


def strided(points: DataFrame, by: str, most: int) -> DataFrame:
    """All points, or every n-th in the order of ``by`` so that at most ``most`` are left; only the ids are sorted."""
    n = points.count()
    if n <= most:
        return points
    ids = numbered(points.select(by), by).filter((F.col("position") - 1) % -(-n // most) == 0)
    return points.join(ids.select(by), by, "left_semi")


def _assigned(shared, sums: bool):
    """Each vector's nearest centre in every model: as partial sums of a task's vectors, or as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, heads = shared.value
        total, count, cost = np.zeros_like(centres), np.zeros(len(centres)), np.zeros(len(centres))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            far = np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)
            for lo, hi in zip(heads[:-1], heads[1:]):
                near = far[:, lo:hi].argmin(1)
                if not sums:
                    yield pa.RecordBatch.from_arrays([batch["symbol_id"].cast(pa.int64()), pa.array(near.astype(np.int32)), pa.array(np.sqrt(((x - centres[lo + near]) ** 2).sum(1)))], ["symbol_id", "cluster", "distance"])
                    continue
                one = np.zeros((hi - lo, n))
                one[near, np.arange(n)] = 1
                total[lo:hi] += one @ x
                count[lo:hi] += one.sum(1)
                cost[lo:hi] += one @ far[np.arange(n), lo + near]
        if sums:
            d = centres.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(centres)), d + 2)), pa.array(np.tile(np.arange(d + 2), len(centres))), pa.array(np.concatenate([total, count[:, None], cost[:, None]], 1).ravel())], ["centre", "dim", "value"])

    return run


def _seeded(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k starting centres, each drawn by its squared distance from those before it."""
    out = [points[rng.integers(len(points))]]
    far = ((points - out[0]) ** 2).sum(1)
    while len(out) < k:
        out.append(points[rng.choice(len(points), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(points))])
        far = np.minimum(far, ((points - out[-1]) ** 2).sum(1))
    return np.array(out)


def _mean_silhouette(points: np.ndarray, label: np.ndarray, far: np.ndarray) -> float:
    names, at = np.unique(label, return_inverse=True)
    if len(names) < 2:
        return 0.0
    member = np.eye(len(names))[at]
    size = member.sum(0)
    mean = far @ member
    own = mean[np.arange(len(at)), at] / np.maximum(size[at] - 1, 1)
    other = np.where(member > 0, np.inf, mean / size).min(1)
    top = np.maximum(own, other)
    return float(np.where((size[at] > 1) & (top > 0), (other - own) / np.where(top > 0, top, 1), 0).mean())


def cluster(vectors: DataFrame, most: int = 20, seed: int = 42, runs: int = 3, tol: float = 1e-4, iterations: int = 100, sample: int = 1000) -> DataFrame:
    """K-Means with 2 to ``most`` centres, ``runs`` starts each, the best by silhouette: (symbol_id, cluster, distance).

    All models advance together: an iteration is one pass over the vectors, one matrix product a batch with every
    model's centres, and sums that are added up before they reach the driver (at most 627 centres with the defaults).
    Starts and silhouettes use every n-th vector by id, ``sample`` at most. Of a model's starts the one of least
    squared distances counts. Under three vectors, or all equal, one cluster."""
    spark = vectors.sparkSession
    data = vectors.filter("vector IS NOT NULL").select("symbol_id", "vector").persist()
    n, different = data.agg(F.count("*"), F.countDistinct("vector")).first()
    if not n:
        return data.select("symbol_id", F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"))
    some = np.array([r[0] for r in strided(data, "symbol_id", sample).orderBy("symbol_id").select("vector").collect()], np.float64)
    upto = min(int(-(-(n**0.5) // 1)), most, 20) if n >= 3 and different > 1 else 1
    rng = np.random.default_rng(seed)
    models = [(k, _seeded(some, k, rng)) for k in range(2, upto + 1) for _ in range(runs)] or [(1, some[:1])]
    done, cost = [False] * len(models), [np.inf] * len(models)
    for _ in range(iterations):
        active = [m for m, d in enumerate(done) if not d]
        if not active:
            break
        centres = np.concatenate([models[m][1] for m in active])
        heads = np.cumsum([0, *(models[m][0] for m in active)])
        shared = spark.sparkContext.broadcast((centres, heads))
        sums = data.mapInArrow(_assigned(shared, True), "centre long, dim long, value double").groupBy("centre", "dim").agg(F.sum("value").alias("value")).toArrow()
        table = np.zeros((len(centres), centres.shape[1] + 2))
        table[sums["centre"].to_numpy(), sums["dim"].to_numpy()] = sums["value"].to_numpy()
        shared.destroy()
        for m, lo, hi in zip(active, heads[:-1], heads[1:]):
            count = table[lo:hi, -2]
            new = np.where(count[:, None] > 0, table[lo:hi, :-2] / np.maximum(count, 1)[:, None], models[m][1])
            done[m], cost[m] = bool(np.sqrt(((new - models[m][1]) ** 2).sum()) < tol), table[lo:hi, -1].sum()
            models[m] = (models[m][0], new)
    far = np.sqrt(np.maximum(((some**2).sum(1)[:, None] - 2 * some @ some.T + (some**2).sum(1)), 0))
    best = None
    for k in sorted({k for k, _ in models}):
        m = min((m for m in range(len(models)) if models[m][0] == k), key=lambda m: cost[m])
        label = ((some[:, None] - models[m][1][None]) ** 2).sum(2).argmin(1) if k > 1 else np.zeros(len(some), int)
        score = _mean_silhouette(some, label, far)
        if best is None or score > best[0]:
            best = (score, models[m][1])
    data.unpersist()
    return data.mapInArrow(_assigned(spark.sparkContext.broadcast((best[1], np.array([0, len(best[1])]))), False), "symbol_id long, cluster int, distance double")


def nearest_centres(vectors: DataFrame, centres: list[list[float]]) -> DataFrame:
    """(symbol_id, cluster, distance) by given centres; ties go to the first."""
    given = np.array(centres, np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((given, np.array([0, len(given)])))
    return vectors.filter("vector IS NOT NULL").select("symbol_id", "vector").mapInArrow(_assigned(shared, False), "symbol_id long, cluster int, distance double")


def representatives(clustered: DataFrame, ix: Index, n: int = 5) -> DataFrame:
    """Members with their rank by distance, the first n of each cluster marked; unknown symbols stay, blank."""
    w = Window.partitionBy("cluster").orderBy("distance", "symbol_id")
    own = ix.symbols.select(F.col("id").alias("symbol_id"), "name", "kind", "file", "line")
    out = clustered.withColumn("nth", F.row_number().over(w)).join(own, "symbol_id", "left")
    return out.select("cluster", "nth", "symbol_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("file", F.lit("")).alias("file"), "distance", (F.col("nth") <= n).alias("representative"))
