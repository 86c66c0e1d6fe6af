"""Mixing sources to target weights: a min-cost flow from membership patterns to source quotas.

Documents are summed by *membership pattern* (the set of sources that hold them). The flow
network is small: the tank of a pattern with S words has one edge of capacity S for each epoch,
dearer from epoch to epoch (convex repetition cost), an edge to each of its sources, and each
source drains at most its quota. Only the edges out of the start cost anything, and a path never
gives those back, so the cheapest maximal flow is a maximum flow over the first epoch's edges,
then carried on over the next epoch's, and so on. The routed words of a pattern then say how many
whole epochs all its documents get, and which seeded share of them gets one more.

Choosing that share never sorts a pattern as a whole: a seeded hash gives each document a bucket,
and the bucket where the share ends is found digit by digit, 64 sums a pattern and digit; there
are as many digits as leave about ``edge_rows`` documents in a bucket, and only those of the last
bucket are ordered. The gap that is left is closed with a few best-fitting documents.

The driver holds a row for each pattern (at most ``max_patterns``) and for each source. With 7
sources the flow takes about 1 s for 20,000 patterns, and its time grows in proportion.

Edge cases: null text has size 0; a null source is a source, last in order; a document whose
list of sources is empty is never taken; repeated rows are documents of their own; a very long
document can leave its source short by at most its size; an empty table gives an empty table; if
all sizes are 0, all targets are 0.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import discard, n_words, stash


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5, 2, 1)
    total: float = 1.5
    epochs: int = 2
    costs: tuple[int, ...] = (1, 3)
    seed: int = 17
    edge_rows: int = 1000
    fills: int = 4
    #: Most patterns that the driver takes (rows of pattern and size); more is an error.
    max_patterns: int = 100_000


def targets(sizes: list[int], weights: list[float], budget: float, epochs: int) -> list[float]:
    """Share ``budget`` by weight; a source stops at ``epochs`` times its size and the excess is shared anew."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while open_ and left > 0:
        w = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * weights[i] / w > epochs * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(epochs * sizes[i])
        left = budget - sum(out[i] for i in range(len(sizes)) if i not in open_ or i in over)
        open_ -= set(over)
    return out


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], costs: tuple[int, ...]) -> list[int]:
    """Words that the cheapest maximal flow takes from each pattern (sources, size); ``costs`` of the epochs ascend."""
    n, end = len(patterns), 1 + len(patterns) + len(quotas)
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to, cap, entry = [], [], []

    def edge(a: int, b: int, c: int) -> None:
        for x, y, z in ((a, b, c), (b, a, 0)):
            graph[x].append(len(to))
            to.append(y), cap.append(z)

    for p, (members, size) in enumerate(patterns):
        entry.append(len(to))
        edge(0, 1 + p, 0)
        for s in members:
            edge(1 + p, 1 + n + s, size * len(costs))
    for s, q in enumerate(quotas):
        edge(1 + n + s, end, q)
    for _ in sorted(costs):
        for e, (_, size) in zip(entry, patterns):
            cap[e] += size
        _augment(graph, to, cap, end)
    return [cap[e ^ 1] for e in entry]


def _augment(graph: list[list[int]], to: list[int], cap: list[int], end: int) -> None:
    """Carry a flow from node 0 on to a maximum: blocking flows over the layers of what is left."""
    while True:
        layer, queue = [-1] * len(graph), deque([0])
        layer[0] = 0
        while queue:
            x = queue.popleft()
            for e in graph[x]:
                if cap[e] > 0 and layer[to[e]] < 0:
                    layer[to[e]] = layer[x] + 1
                    queue.append(to[e])
        if layer[end] < 0:
            return
        at, path, x = [0] * len(graph), [], 0
        while True:
            if x == end:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                k = next(k for k, e in enumerate(path) if not cap[e])
                x = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[x] < len(graph[x]) and not (cap[e := graph[x][at[x]]] > 0 and layer[to[e]] == layer[x] + 1):
                at[x] += 1
            if at[x] < len(graph[x]):
                path.append(e)
                x = to[e]
            elif path:
                x = to[path.pop() ^ 1]
                at[x] += 1
            else:
                break


def decide(docs: DataFrame, text: str = "text", sources=None, plan: Mix = Mix(), keys: tuple[str, ...] = ("doc_id",), seeded: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each document: ``keys``, ``size``, ``source_size``, ``target``, ``taken`` words and ``copies``.

    ``sources`` is an array column of the sources that hold a document (default: its one
    ``source``); ``source_size`` and ``target`` are those of the first. ``seeded`` names the columns
    that, with the text, fix a document's place in the seeded order (default: ``keys``)."""
    spark = docs.sparkSession
    held = F.array(F.col("source").cast("string")) if sources is None else sources
    sized = docs.select(*keys, n_words(text).alias("size"), F.array_sort(F.array_distinct(held)).alias("pattern"), F.xxhash64(F.lit(plan.seed), *(seeded or keys), F.col(text)).alias("seeded"))
    # a pattern as text: an array with a null is not equal to itself in a join
    sizes_of = sized = stash(sized.select(*keys, "size", F.to_json(F.struct(F.col("pattern").alias("p"))).alias("pk"), "seeded", "pattern").withColumn("uid", F.monotonically_increasing_id()), "mix-sizes")

    sums = sized.groupBy("pk", "pattern").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(plan.max_patterns + 1).collect()
    if len(sums) > plan.max_patterns:
        raise ValueError(f"more than {plan.max_patterns} membership patterns")
    sums = [r for r in sums if r.pattern]
    names = sorted({s for r in sums for s in r.pattern}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in sums:
        for s in r.pattern:
            sizes[place[s]] += r["size"]
    weights = [plan.weights[i % len(plan.weights)] for i in range(len(names))]
    goal = targets(sizes, weights, plan.total * sum(r["size"] for r in sums), plan.epochs)
    order = sorted(sums, key=lambda r: [place[s] for s in r.pattern])
    routed = route([(tuple(place[s] for s in r.pattern), r["size"]) for r in order], [round(g) for g in goal], plan.costs[: plan.epochs])
    rows = [(r.pk, min(x // r["size"], plan.epochs) if r["size"] else 0, x % r["size"] if r["size"] else 0, sizes[place[r.pattern[0]]], goal[place[r.pattern[0]]]) for r, x in zip(order, routed)]
    # whole epochs for all, ``part`` words of one more epoch for a seeded share
    fate = F.broadcast(spark.createDataFrame(rows, "pk string, whole long, part long, source_size long, target double"))  # max_patterns rows at most, as all that is broadcast here
    sized = sized.drop("pattern")

    digits = 1
    while 64**digits * plan.edge_rows < sum(r.rows for r in sums):
        digits += 1
    sized = sized.withColumn("bucket", F.pmod("seeded", F.lit(64**digits)))
    cuts = []
    cut = fate.filter("part > 0").select("pk", "part", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("last"))
    for k in reversed(range(digits)):
        here = sized.join(F.broadcast(cut), "pk").filter(F.floor(F.col("bucket") / 64 ** (k + 1)) == F.col("last"))
        each = here.groupBy("pk", "part", "before", F.floor(F.col("bucket") / 64**k).alias("digit")).agg(F.sum("size").alias("words"))  # at most 64 a pattern
        upto = each.withColumn("begin", F.col("before") + F.sum("words").over(Window.partitionBy("pk").orderBy("digit")) - F.col("words"))
        cut = stash(upto.filter((F.col("begin") < F.col("part")) & (F.col("part") <= F.col("begin") + F.col("words"))).select("pk", "part", F.col("begin").alias("before"), F.col("digit").alias("last")), "mix-cut")
        cuts.append(cut)

    placed = sized.join(fate, "pk", "left").join(F.broadcast(cut.select("pk", "before", "last")), "pk", "left")
    edge = placed.filter(F.col("bucket") == F.col("last")).select("uid", "pk", "size", "part", "before", "seeded", *keys)
    run = F.col("before") + F.sum("size").over(Window.partitionBy("pk").orderBy("seeded", *keys, "uid"))
    inside = edge.withColumn("run", run).filter(F.col("run") <= F.col("part")).select("uid", F.lit(True).alias("in_edge"))
    chosen = stash(placed.join(inside, "uid", "left").withColumn("more", F.coalesce(F.col("bucket") < F.col("last"), F.lit(False)) | F.coalesce("in_edge", F.lit(False))).drop("in_edge", "before", "last", "bucket"), "mix-chosen")
    discard(sizes_of, *cuts)

    # a row for each pattern comes to the driver, as above
    gaps = {r.pk: r.gap for r in chosen.groupBy("pk").agg((F.max("part") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("gap")).filter("gap > 0").collect()}
    fits: list[tuple[int]] = []
    for _ in range(plan.fills):
        if not gaps:
            break
        off = F.abs(F.col("size") - F.col("gap"))
        spare = chosen.filter(~F.col("more") & (F.col("size") > 0)).join(F.broadcast(spark.createDataFrame(fits, "uid long")), "uid", "left_anti").join(F.broadcast(spark.createDataFrame(list(gaps.items()), "pk string, gap long")), "pk")
        best = spare.filter(off < F.col("gap")).groupBy("pk").agg(F.min(F.struct(off.alias("off"), "seeded", "uid", "size")).alias("b")).select("pk", "b.uid", "b.size").collect()
        fits += [(r.uid,) for r in best]
        gaps = {r.pk: gaps[r.pk] - r["size"] for r in best if gaps[r.pk] > r["size"]}
    extra = chosen.join(F.broadcast(spark.createDataFrame(fits, "uid long").withColumn("fits", F.lit(True))), "uid", "left")
    copies = F.coalesce("whole", F.lit(0)) + (F.col("more") | F.coalesce("fits", F.lit(False))).cast("long")
    return extra.select(*keys, "size", F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def repeat(docs: DataFrame, text: str = "text", plan: Mix = Mix()) -> DataFrame:
    """``docs`` as the mix takes them: a document that it takes twice stands twice, one that it leaves out is absent.

    Rows are matched by id and text. Rows equal in both share their copies evenly; what does not go
    round is given as further copies of one of them, so that their number is the mix's."""
    taken = decide(docs.withColumn("__text", F.xxhash64(F.col(text))), text, None, plan, ("doc_id", "__text"), ("doc_id",))
    taken = stash(taken.groupBy(F.col("doc_id").alias("__id"), F.col("__text").alias("__hash")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).filter("__copies > 0"), "mix-taken")
    rows = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__hash")))
    times = lambda n: F.explode(F.array_repeat(F.lit(1), n.cast("int")))
    out = rows.withColumn("__one", times(F.floor(F.col("__copies") / F.col("__rows")))).select(*docs.columns)
    rest = F.col("__copies") % F.col("__rows")
    if taken.filter(rest > 0).isEmpty():
        return out
    whole = F.struct(*docs.columns)
    one = rows.filter(rest > 0).groupBy("__id", "__hash").agg(F.min_by(whole, F.to_json(whole)).alias("__row"), F.max(rest).alias("__rest"))
    return out.unionByName(one.select("__row", times(F.col("__rest")).alias("__one")).select("__row.*"))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document's part in the mix."""
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")
