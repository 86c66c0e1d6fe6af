"""Benchmark decontamination by spaced seeds.

Words are lower-cased and stripped of ASCII punctuation at their ends. Three fixed masks each
hash five words and ignore the words between; together they hit every window of 8 to 13 words
of which at least four fifths agree, wherever the substitutions fall (shown by enumeration in
the tests), so no such overlap is lost. Around each hit of a training hash in the test hashes
the two texts are compared word by word along the hit's diagonal: an *overlap* is a window of
``window`` words (all words of a shorter item) with at least ``share`` of them equal. Items of
fewer than ``shortest`` words tolerate no substitution: their seed is the whole sequence.

The test set is read in blocks of ``block_words`` words (and at most one item more). A block's
hashes, of known size, go to every task, and all documents are scanned once a block: nothing is
shuffled, and no passage, however common, gathers in one task. Hits are followed some hundred
thousand at a time, so a seed that very many items share takes time, not memory.

Edge cases: null texts have no words and overlap nothing; items without words match nothing; a
null item id stays null; ties and repeated rows each give their own rows; very long texts are
scanned whole; empty tables give an empty table; other columns are not looked at.
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

#: Fixed masks: 1 is compared, 0 is ignored.
MASKS = ("11111", "111011", "11010011")


@dataclass(frozen=True)
class Rule:
    window: int = 13
    share: float = 0.8
    shortest: int = 8
    block_words: int = 1 << 19


_PUNCT = np.zeros(256, bool)
_PUNCT[list(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""")] = True


class Tokens:
    """Normalised words: hash, row, and the first word of each row."""

    def __init__(self, column: pa.Array):
        w = T.Words(pc.utf8_lower(column))
        start, end = w.start.copy(), w.end.copy()
        for at, step, edge in ((start, 1, 0), (end, -1, -1)):
            todo = np.arange(len(start))
            while len(todo):
                todo = todo[(start[todo] < end[todo])]
                todo = todo[_PUNCT[w.bytes[at[todo] + edge]]]
                at[todo] += step
        some = np.flatnonzero(start < end)
        self.hash, self.row = T.span_hashes(w.bytes, start[some], end[some]), w.row[some]
        self.first = np.searchsorted(self.row, np.arange(len(w.offsets)))

    def seeds(self, mask: str, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of the mask laid at each word that has room for it; seeds of ``whole`` items are apart."""
        m = len(self.hash) - len(mask) + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        key = np.full(m, np.uint64(2 * int("1" + mask, 2) + whole))
        for k, c in enumerate(mask):
            if c == "1":
                key = (key + self.hash[k : k + m]) * T._M1
                key ^= key >> np.uint64(31)
        at = np.flatnonzero(T.within(self.row, len(mask)))
        return T.mix(key[at]), at


@dataclass
class Block:
    """A part of the test set, ready to be looked up. ``masks`` are those of all its items: (mask, whether it is a whole item)."""

    ids: list[int | None]
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray
    keys: np.ndarray
    places: np.ndarray
    filter: np.ndarray
    masks: list[tuple[str, bool]]
    rule: Rule

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str], rule: Rule) -> Block:
        t = Tokens(pa.array(texts, pa.string()))
        size = np.diff(t.first)
        masks = [*((m, False) for m in MASKS), *(("1" * n, True) for n in sorted(set(size[(size > 0) & (size < rule.shortest)].tolist())))]
        found = []
        for mask, whole in masks:
            keys, places = t.seeds(mask, whole)
            n = size[t.row[places]]
            keep = n == len(mask) if whole else n >= rule.shortest
            found.append((keys[keep], places[keep]))
        keys, places = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(keys, kind="stable")
        bits = np.zeros(1 << max(16, int(np.ceil(np.log2(len(keys) * 16 + 1)))), bool)
        bits[keys & np.uint64(len(bits) - 1)] = True
        return cls(ids, t.hash, t.row, t.first, keys[order], places[order], bits, masks, rule)

    def hits(self, t: Tokens, most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (word of the documents, word of the items) at which a seed begins in both, at most ``most`` at a time."""
        for mask, whole in self.masks:
            keys, at = t.seeds(mask, whole)
            some = np.flatnonzero(self.filter[keys & np.uint64(len(self.filter) - 1)])
            lo = np.searchsorted(self.keys, keys[some], "left")
            n = np.searchsorted(self.keys, keys[some], "right") - lo
            upto = T.split_offsets(n)
            for begin in range(0, int(upto[-1]), most):
                pair = np.arange(begin, min(begin + most, int(upto[-1])))
                which = np.searchsorted(upto, pair, "right") - 1
                yield at[some[which]], self.places[lo[which] + pair - upto[which]]

    def overlaps(self, t: Tokens) -> tuple[np.ndarray, ...]:
        """Different windows that agree enough: row, item row, first word in the row, first word in the item, words."""
        found, new, n_new = np.zeros(0, np.int64), [], 0  # a window is its first word in the texts and in the items
        w, reach = self.rule.window, 2 * self.rule.window
        rel = np.arange(-w + 1, reach)
        for a, b in self.hits(t):
            row, item = t.row[a], self.row[b]
            da, ib = a[:, None] + rel, b[:, None] + rel
            ok = (da >= t.first[row][:, None]) & (da < t.first[row + 1][:, None]) & (ib >= self.first[item][:, None]) & (ib < self.first[item + 1][:, None])
            same = ok & (t.hash[np.clip(da, 0, len(t.hash) - 1)] == self.hash[np.clip(ib, 0, len(self.hash) - 1)])
            total = np.concatenate([np.zeros((len(a), 1), np.int32), np.cumsum(same, 1, dtype=np.int32)], 1)
            size, need = self._sizes(item)
            each = np.arange(len(a))
            for k in range(w):
                x = np.flatnonzero(ok[:, k] & ok[each, k + size - 1] & (total[each, k + size] - total[:, k] >= need))
                new.append((da[x, k] << 32) + ib[x, k])
                n_new += len(x)
            if n_new > max(1 << 20, len(found)):
                found, new, n_new = np.unique(np.concatenate([found, *new])), [], 0
        found = np.unique(np.concatenate([found, *new]))
        here, there = found >> 32, found & 0xFFFFFFFF
        row, item = t.row[here], self.row[there]
        return row, item, here - t.first[row], there - self.first[item], self._sizes(item)[0]

    def _sizes(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of an item's windows, and how many of them must agree."""
        words = self.first[item + 1] - self.first[item]
        size = np.minimum(self.rule.window, words)
        return size, np.where(words < self.rule.shortest, words, np.ceil(size * self.rule.share - 1e-9)).astype(np.int32)

    def summary(self, t: Tokens) -> list[np.ndarray]:
        """A row for each pair that overlaps: row, item row, first word, end word, covered words of the item, words of the item."""
        found = self.overlaps(t)
        order = np.lexsort((found[3], found[1], found[0]))
        row, item, at, of, size = (x[order] for x in found)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        head = np.flatnonzero(new)
        if not len(head):
            return [row] * 6
        # windows of an item are of one size, so each adds what lies behind the one before it
        adds = np.where(new, size, np.minimum(size, np.diff(of, prepend=0)))
        return [row[head], item[head], np.minimum.reduceat(at, head), np.maximum.reduceat(at + size, head), np.add.reduceat(adds, head), (self.first[item + 1] - self.first[item])[head]]


def blocks(benchmark: DataFrame, rule: Rule, item_id: str = "item_id", text: str = "text") -> Iterator[Block]:
    """The test set, block by block; the driver holds one block at a time."""
    ids, texts, words = [], [], 0
    for r in benchmark.select(F.col(item_id).cast("long"), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        words += len(r[1].split()) + 1
        if words >= rule.block_words:
            yield Block.of(ids, texts, rule)
            ids, texts, words = [], [], 0
    if ids:
        yield Block.of(ids, texts, rule)


FOUND = "doc_id long, item_id long, first_word long, end_word long, n_covered long, n_item_words long"


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for lo, hi in T.slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                row, item, *numbers = block.summary(Tokens(part["text"]))
                columns = [part["doc_id"].take(pa.array(row)), pa.array([block.ids[k] for k in item], pa.int64()), *map(pa.array, numbers)]
                yield pa.RecordBatch.from_arrays(columns, FOUND.replace(" long", "").split(", "))

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and item that overlap: where in the document (normalised words), how many words of the item."""
    spark = docs.sparkSession
    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], FOUND)
    for block in blocks(benchmark, rule):
        out = out.unionByName(wanted.mapInArrow(_search(spark.sparkContext.broadcast(block)), FOUND))
    return out


def _clean(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for lo, hi in T.slices(batch[text]):
                part = batch.slice(lo, hi - lo)
                keep = np.ones(part.num_rows, bool)
                keep[block.overlaps(Tokens(part[text]))[0]] = False
                yield part if keep.all() else part.filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """``docs`` without those that overlap an item."""
    for block in blocks(benchmark, rule):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block), text), docs.schema)
    return docs


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle() -> str:
    """The query's rows: all pairs of equal words, summed over every window of every diagonal."""
    strip = r"regexp_replace(x, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')"
    tokens = lambda table, key, i: f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY k) - 1 AS {i}, w FROM (
  SELECT {key}, k, {strip} AS w FROM (SELECT {key}, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS x FROM (SELECT {key}, coalesce(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM {table}))
) WHERE w <> ''"""  # noqa: E731
    return f"""
WITH dw AS MATERIALIZED ({tokens("documents", "doc_id", "i")}), iw AS MATERIALIZED ({tokens("benchmark", "item_id", "j")}),
dn AS (SELECT doc_id, count(*) AS dn FROM dw GROUP BY doc_id),
item AS (SELECT item_id, n, least(n, 13) AS win, CASE WHEN n < 8 THEN n ELSE ceil(least(n, 13) * 0.8 - 1e-9) END AS need FROM (SELECT item_id, count(*) AS n FROM iw GROUP BY item_id)),
spot AS (SELECT doc_id, item_id, i - j AS d, unnest(range(greatest(0, j - win + 1), least(j, n - win) + 1)) AS s FROM dw JOIN iw USING (w) JOIN item USING (item_id)),
sums AS (SELECT doc_id, item_id, d, s, count(*) AS k FROM spot GROUP BY ALL HAVING count(*) >= (SELECT min(need) FROM item)),
good AS (SELECT doc_id, item_id, d, s, win, n FROM sums JOIN item USING (item_id) JOIN dn USING (doc_id) WHERE k >= need AND s + d >= 0 AND s + d + win <= dn),
cover AS (SELECT doc_id, item_id, count(DISTINCT s + k) AS n_covered FROM good, range(0, 13) t(k) WHERE k < win GROUP BY ALL)
SELECT doc_id, item_id, CAST(min(s + d) AS BIGINT) AS first_word, CAST(max(s + d + win) AS BIGINT) AS end_word, any_value(n_covered) AS n_covered, CAST(any_value(n) AS BIGINT) AS n_item_words
FROM good JOIN cover USING (doc_id, item_id) GROUP BY doc_id, item_id
"""
