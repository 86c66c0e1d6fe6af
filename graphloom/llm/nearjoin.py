"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Two documents are linked when the Jaccard similarity of their sets of five-word shingles is at
least 0.8. Texts with equal words are one *class*; only a class's representative is compared.

Candidates share one of 24 bands of 4 MinHash values (a pair at exactly 0.8 is missed with
probability 4e-6, nearer pairs far less often). A pair's 96 values are then compared 16 at a
time; after n values with m agreements, with a uniform prior, the posterior probability that the
similarity reaches 0.8 is P(Bin(n+1, 0.8) <= m), and the pair is dropped once that is under
``tolerance``. The rest is verified exactly on the full shingle sets.

Where pairs meet. Every band bucket gives one edge from each member to its least member, and the
components of those edges are the *neighbourhoods* outside which no candidate exists. A
neighbourhood of up to ``block`` texts and ``block_words`` words is compared in one place.
A larger one is compared in the way that ships fewer rows: a dense one is cut into blocks, and
each pair of blocks is a group; a loose one goes bucket by bucket, each pair in the first band it
shares, and buckets beyond the bounds are cut into blocks likewise. So every candidate pair is
looked at exactly once, no pair is written out, and no group outgrows a task: groups return one
row a document, its number of links and the least document it connects to.

Groups meet twice. First with signatures alone, 384 bytes a text: a text that the pruning leaves
without a partner in a group goes no further. Only the others' texts are fetched and compared.

Edge cases: texts of one to four words have one shingle, all their words; texts without words
(null too) match nothing; repeated rows are copies of each other; rows that share an id are told
apart by their words; null ids count as ids, and a class of such rows alone has a null class id;
ties do not arise, classes being least ids; very long texts are taken whole; an empty table gives
an empty table; columns other than those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .graph import components
from .workspace import discard, partitions, stash


@dataclass(frozen=True)
class Join:
    words: int = 5
    least: float = 0.8
    bands: int = 24
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-6
    block: int = 1000
    block_words: int = 400_000
    chunk_bytes: int = 6 << 20
    group_rows: int = 500
    seed: int = 11

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def fewest(self) -> dict[int, int]:
        """Agreements that a pair needs after so many compared values."""
        out = {}
        for n in range(self.step, self.hashes + 1, self.step):
            total, m = 0.0, -1
            while total < self.tolerance:
                m += 1
                total += comb(n + 1, m) * self.least**m * (1 - self.least) ** (n + 1 - m)
            out[n] = m
        return out


_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingles(w: T.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, row), in row order; a row of fewer than n words has one shingle."""
    h = w.hashes()
    at = np.flatnonzero(T.within(w.row, n))
    g, row = T.grams(h, n)[at], w.row[at]
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        own = [T.grams(h[w.first[r] : w.first[r + 1]], int(size[r]))[0] ^ _B for r in short]
        g, row = np.concatenate([g, np.array(own, np.uint64)]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        g, row = g[order], row[order]
    return g, row


def text_hashes(w: T.Words, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of each row's word sequence, and its number of words."""
    h, place = w.hashes(), (np.arange(len(w)) - w.first[w.row]).astype(np.uint64)
    out = []
    for salt in (_A, _B):
        x = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(h * salt + place))])
        out.append(T.signed(T.mix(x[w.first[1:]] - x[w.first[:-1]] + salt)))
    return out[0], out[1], np.diff(w.first)


def minhash(g: np.ndarray, row: np.ndarray, n_rows: int, join: Join) -> np.ndarray:
    """A row of ``hashes`` MinHash values for each document; all ones where there is no shingle."""
    factor = T.mix(np.arange(1, join.hashes + 1, dtype=np.uint64) * np.uint64(join.seed)) | np.uint64(1)
    out = np.full((n_rows, join.hashes), np.iinfo(np.uint32).max, np.uint32)
    have = np.unique(row)
    if len(have):
        at = np.searchsorted(row, have)
        for k in range(join.hashes):
            out[have, k] = np.minimum.reduceat(((g * factor[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def band_keys(sig: np.ndarray, join: Join) -> np.ndarray:
    parts = sig.reshape(len(sig), join.bands, join.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(join.bands, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(join.rows):
        key = T.mix(key * T._M1 + parts[:, :, k] + np.uint64(1))
    return key


SIGNED = "doc_id long, w1 long, w2 long, n_words long, sig binary"


def _sign(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.slices(batch["text"], 1 << 20):
                part = batch.slice(lo, hi - lo)
                w = T.Words(part["text"])
                w1, w2, n = text_hashes(w, part.num_rows)
                sig = minhash(*shingles(w, join.words), part.num_rows, join)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(w1), pa.array(w2), pa.array(n), T.binaries(sig, np.arange(len(sig) + 1) * join.hashes)], ["doc_id", "w1", "w2", "n_words", "sig"])

    return run


def _explode_bands(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, _ = T.raw(batch["sig"])
            keys = band_keys(data.view(np.uint32).reshape(-1, join.hashes), join)
            rep = batch["rep"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep, join.bands)), pa.array(np.tile(np.arange(join.bands, dtype=np.int32), len(rep))), pa.array(T.signed(keys.ravel()))], ["rep", "band", "key"])

    return run


def candidate_pairs(group: np.ndarray, keys: np.ndarray, band: np.ndarray, block: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group that share a band, each in the first one it shares.

    ``band`` >= 0 restricts a group to one band (-1: a whole neighbourhood, -2: blocks of one); in a ``cross`` group only pairs of different blocks count."""
    for b in range(keys.shape[1]):
        use = np.flatnonzero((band < 0) | (band == b))
        if len(use) < 2:
            continue
        order = use[np.lexsort((keys[use, b], group[use]))]
        new = np.ones(len(order), bool)
        new[1:] = (group[order][1:] != group[order][:-1]) | (keys[order, b][1:] != keys[order, b][:-1])
        bounds = np.append(np.flatnonzero(new), len(order))
        size = np.diff(bounds)
        at = np.arange(len(order))
        rest = np.repeat(bounds[1:], size) - at - 1  # later members of the same run
        for lo, hi in _portions(rest, 1 << 20):
            n = rest[lo:hi]
            i = np.repeat(at[lo:hi], n)
            j = i + 1 + np.arange(n.sum()) - np.repeat(T.split_offsets(n)[:-1], n)
            i, j = order[i], order[j]
            ok = ~cross[i] | (block[i] != block[j])
            for e in range(b):
                i, j, ok = i[ok], j[ok], ok[ok]
                ok = keys[i, e] != keys[j, e]
            yield i[ok], j[ok]


def _portions(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    total, lo = np.concatenate([[0], np.cumsum(n)]), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """Compare values step by step; keep pairs that can still reach the threshold."""
    same = np.zeros(len(i), np.int32)
    for n, m in join.fewest().items():
        same += (sig[i, n - join.step : n] == sig[j, n - join.step : n]).sum(1, dtype=np.int32)
        ok = same >= m
        i, j, same = i[ok], j[ok], same[ok]
    return i, j


class Sets:
    """Shingle sets of a chunk's documents, for exact intersections."""

    def __init__(self, g: np.ndarray, row: np.ndarray, n_rows: int):
        uniq, ids = np.unique(g, return_inverse=True)
        self.width = len(uniq) + 1
        self.keys = np.unique(row * self.width + ids)
        self.row = self.keys // self.width
        self.ids = self.keys - self.row * self.width
        self.first = np.searchsorted(self.row, np.arange(n_rows + 1))
        self.size = np.diff(self.first)

    def linked(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        swap = self.size[i] > self.size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out = self.size[i] >= least * self.size[j]
        for lo, hi in _portions(np.where(out, self.size[i], 0), 1 << 21):
            a, b = i[lo:hi][out[lo:hi]], j[lo:hi][out[lo:hi]]
            n = self.size[a]
            take = np.repeat(self.first[a] - T.split_offsets(n)[:-1], n) + np.arange(n.sum())
            want = np.repeat(b * self.width, n) + self.ids[take]
            place = np.searchsorted(self.keys, want)
            hit = self.keys[np.minimum(place, len(self.keys) - 1)] == want
            both = np.bincount(np.repeat(np.arange(len(a)), n), hit, minlength=len(a))
            out[np.flatnonzero(out[lo:hi]) + lo] = both >= least * (self.size[a] + self.size[b] - both) - 1e-9
        return out


def _least_connected(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least label that each of n documents connects to by the pairs."""
    top = label.copy()
    while True:
        new = top.copy()
        np.minimum.at(new, i, top[j])
        np.minimum.at(new, j, top[i])
        if (new == top).all():
            return top
        top = new


def _by_group(batches: Iterator[pa.RecordBatch], full) -> Iterator[pa.Table]:
    """Rows in order of ``gid``, whole groups at a time, as soon as ``full`` (rows, bytes) says so."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows and full(rows, size):
            table = pa.Table.from_batches(held)
            gid = table["gid"].to_numpy()
            cut = int(np.searchsorted(gid, gid[-1]))  # the last group may go on in the next batch
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
                rows, size = sum(x.num_rows for x in held), sum(x.nbytes for x in held)
    if rows:
        yield pa.Table.from_batches(held)


def _signatures(table: pa.Table, join: Join) -> np.ndarray:
    return np.ascontiguousarray(T.raw(table["sig"])[0]).view(np.uint32).reshape(-1, join.hashes)


def _pairs(table: pa.Table, sig: np.ndarray, join: Join) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of some groups that the pruning leaves."""
    cross = table["bi"].to_numpy() != table["bj"].to_numpy()
    for i, j in candidate_pairs(table["gid"].to_numpy(), band_keys(sig, join), table["band"].to_numpy(), table["block"].to_numpy(), cross):
        yield prune(sig, i, j, join)


GROUPED = "gid long, band int, block int, bi int, bj int, rep long, n long, sig binary"


def _partnered(join: Join):
    """Rows that the pruning leaves with a partner in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, lambda rows, size: rows >= 4 * join.block):
            keep = np.zeros(table.num_rows, bool)
            for i, j in _pairs(table, _signatures(table, join), join):
                keep[i] = keep[j] = True
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _compare(join: Join):
    names = ("rep", "links", "root", "alone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (batch.slice(lo, hi - lo) for batch in batches for lo, hi in T.slices(batch["text"], join.chunk_bytes // 2))
        for table in _by_group(pieces, lambda rows, size: size > join.chunk_bytes):
            n, rep, copies = table.num_rows, table["rep"].to_numpy(), table["n"].to_numpy()
            sets, links, found = Sets(*shingles(T.Words(table["text"].combine_chunks()), join.words), n), np.zeros(n), []
            for i, j in _pairs(table, _signatures(table, join), join):
                ok = sets.linked(i, j, join.least)
                i, j = i[ok], j[ok]
                links += np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
                found.append((i, j))
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*found)) or [(), ()]))
            some = np.flatnonzero(links)
            root = _least_connected(n, i, j, rep)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some]), pa.array(table["band"].to_numpy()[some] == -1)], names)

    return run


def _verify_words(join: Join):
    """Keep rows whose text has the words that its representative was chosen for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                w1, w2, _ = text_hashes(T.Words(part["text"]), part.num_rows)
                yield part.filter(pa.array((w1 == part["w1"].to_numpy()) & (w2 == part["w2"].to_numpy())))

    return run


def resolve(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: ``uid``, ``doc_id``, ``w1``, ``w2`` (hashes of its words), ``root`` (least uid
    of its near-duplicate class), ``class_id`` (least doc_id of it) and ``n_links`` (documents it is linked to)."""
    spark = docs.sparkSession
    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stash(wanted.mapInArrow(T.tidy(_sign(join)), SIGNED).withColumn("uid", F.monotonically_increasing_id()), "near-signatures")
    worded = signed.filter("n_words > 0")
    classes = stash(worded.groupBy("w1", "w2").agg(F.min("uid").alias("rep"), F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("n_words").alias("words")), "near-classes")
    reps = worded.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("rep"), "sig")
    bands = reps.mapInArrow(_explode_bands(join), "rep long, band int, key long")
    shared = bands.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    members = stash(bands.join(shared, "key"), "near-bands")  # only buckets of two or more
    # a text and all its buckets' leaders meet at the least of them: a first round that needs no join
    star = members.groupBy("rep").agg(F.min("leader").alias("v"), F.collect_set("leader").alias("leaders"))
    edges = components(star.select(F.explode(F.array_union("leaders", F.array("rep"))).alias("u"), "v"))
    near = edges.unionByName(edges.select(F.col("root").alias("u"), "root").distinct()).withColumnRenamed("u", "rep").join(classes.select("rep", "n", "words"), "rep")
    cuts = F.greatest(F.ceil(F.count("*") / join.block), F.ceil(F.sum("words") / join.block_words)).cast("int").alias("blocks")
    sizes = near.groupBy("root").agg(F.count("*").alias("m"), cuts)
    active = stash(near.join(sizes, "root").select("rep", F.col("root").alias("hood"), "n", "words", "m", "blocks"), "near-active")

    none = F.lit(0)
    grouped = active.filter("blocks = 1").select(F.col("hood").alias("gid"), F.lit(-1).alias("band"), none.alias("block"), none.alias("bi"), none.alias("bj"), "rep", "n")
    if not active.filter("blocks > 1").isEmpty():
        large = stash(members.join(active.filter("blocks > 1").withColumnRenamed("blocks", "hood_blocks"), "rep"), "near-large")
        buckets = stash(large.groupBy("hood", "key", "m", "hood_blocks").agg(F.count("*").alias("members"), cuts), "near-buckets")
        dense = buckets.groupBy("hood").agg((F.max(F.col("m") * F.col("hood_blocks")) <= F.sum(F.col("members") * F.col("blocks"))).alias("dense"))
        dense = stash(dense, "near-dense")
        by_hood = large.join(dense.filter("dense"), "hood").select("rep", "n", F.col("hood").alias("key"), F.lit(-2).alias("band"), F.col("hood_blocks").alias("blocks")).distinct()
        by_bucket = large.join(dense.filter("NOT dense"), "hood").join(buckets.select("key", "blocks"), "key").select("rep", "n", "key", "band", "blocks")
        spread = by_hood.unionByName(by_bucket).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        lo, hi = F.least("block", "other"), F.greatest("block", "other")
        grouped = grouped.unionByName(spread.select(F.xxhash64("key", "band", lo, hi).alias("gid"), "band", "block", lo.alias("bi"), hi.alias("bj"), "rep", "n"))
    grouped = stash(grouped, "near-groups")
    discard(edges, members, active)
    # numbers of partitions follow the rows: these tasks take time by pairs, not by bytes
    met = grouped.join(reps, "rep").select("gid", "band", "block", "bi", "bj", "rep", "n", "sig").repartition(partitions(spark, grouped.count(), join.group_rows), "gid").sortWithinPartitions("gid")
    partnered = stash(met.mapInArrow(_partnered(join), GROUPED), "near-partnered")
    discard(grouped)

    fetch = partnered.select("rep").distinct().join(signed.select(F.col("uid").alias("rep"), F.col("doc_id").alias("own_id"), "w1", "w2"), "rep")
    texts = fetch.join(wanted, F.col("own_id").eqNullSafe(F.col("doc_id"))).select("rep", "w1", "w2", "text")
    if _repeats(signed):  # rows that repeat an id and its words would meet themselves
        texts = texts.mapInArrow(_verify_words(join), texts.schema).dropDuplicates(["rep"])
    met = partnered.join(texts.select("rep", "text"), "rep").repartition(partitions(spark, partnered.count(), join.group_rows), "gid").sortWithinPartitions("gid")
    met = stash(met.mapInArrow(T.tidy(_compare(join)), "rep long, links long, root long, alone boolean"), "near-links")
    discard(partnered)

    linked = met.groupBy("rep").agg(F.sum("links").alias("links"))
    settled = met.filter("alone").select("rep", "root")
    across = components(met.filter("NOT alone").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    roots = settled.unionByName(across.select(F.col("u").alias("rep"), "root"))
    full = classes.join(linked, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    lowest = full.groupBy("root").agg(F.min("first_id").alias("class_id"))
    full = full.join(lowest, "root").select("w1", "w2", "root", "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    some = worded.select("uid", "doc_id", "w1", "w2").join(full, ["w1", "w2"]).select("uid", "doc_id", "w1", "w2", "root", "class_id", "n_links")
    bare = signed.filter("n_words = 0").select("uid", "doc_id", "w1", "w2", F.col("uid").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(bare)


def _repeats(signed: DataFrame) -> bool:
    """Whether any id stands on two rows."""
    return bool(signed.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count())


def keep_one(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that of the least id."""
    found = resolve(docs, join, doc_id, text)
    keepers = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "w1", "w2")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.w1").alias("__w1"), F.col("k.w2").alias("__w2"), F.col("root").alias("__root"))
    keyed = docs.mapInArrow(T.tidy(_with_words(text)), docs.select("*", F.lit(0).cast("long").alias("__v1"), F.lit(0).cast("long").alias("__v2")).schema)
    joined = keyed.join(keepers, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__v1") == F.col("__w1")) & (F.col("__v2") == F.col("__w2")))
    return (joined.dropDuplicates(["__root"]) if _repeats(found) else joined).select(*docs.columns)


def _with_words(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.slices(batch[text]):
                part = batch.slice(lo, hi - lo)
                w1, w2, _ = text_hashes(T.Words(part[text]), part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(w1), pa.array(w2)], [*part.schema.names, "__v1", "__v2"])

    return run


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class and number of links."""
    return resolve(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")


def oracle() -> str:
    """The query's rows: sets, all pairs that share a shingle, exact similarity, components by closure."""
    return """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)
), size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM reach r JOIN edge e ON e.a = r.doc_id),
class AS (SELECT doc_id, min(c) AS class_id FROM reach GROUP BY doc_id),
deg AS (SELECT a AS doc_id, count(*) AS n_links FROM edge GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM class LEFT JOIN deg USING (doc_id)
"""
