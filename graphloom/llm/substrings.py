"""Substring dedup: repeated windows of words, found with compressed FM-indexes over content shards.

A window is ``window`` consecutive words of a document. A word goes when a window that covers it
also starts earlier in the corpus (smaller id, or the same document and an earlier word).

Sharding by content. Every window has an *anchor*, the least hash among its six-word runs;
consecutive windows with the same anchor position form a *segment* of at most 15 windows. Equal
windows have equal anchors, so a window can only recur in segments of its anchor, and a shard
that holds all segments of some anchors decides their windows alone.

1. Segments are emitted as hashes and places. Anchors that occur once are dropped: their windows
   are unique. Counts are aggregated before the exchange.
2. An anchor with more than ``hot`` different segments is split: each of its windows becomes a
   segment and an anchor of its own, so nothing but equal windows meets under it.
3. Of each different segment its words go to a shard once, as two pieces: that of the first place
   and, where the segment recurs, that of one later place, which stands for all the later ones.
   So a passage that a third of all documents hold reaches its shard once.
4. A shard's anchors hold their pieces in corpus order. They are halved again and again: the
   earlier half of a span of pieces becomes the index's text, the later half is streamed through
   the index, and the windows whose matching statistics reach ``window`` start earlier. All spans
   of a length share one index, each with symbols of its own, so a streamed piece meets nothing
   but the pieces of its own span; words that only one half of a span holds are left out, since
   no common window has them. Every two pieces of an anchor meet once; no piece is in the index
   that it is streamed through.
5. The intervals found go back to all places of their segment by its hash.

Shards are read anchor by anchor and indexed ``shard_segments`` pieces at a time, so neither
their number nor their size decides how much memory a task takes.

Edge cases: null texts have no words; a null id counts as one after all others; rows that share
an id are one document with words counted from each row's start; repeated rows of an id and a
text are the same windows and keep each other; texts shorter than a window lose nothing; an
empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .fmindex import FMIndex
from .workspace import discard, partitions, stash


@dataclass(frozen=True)
class Windows:
    window: int = 20
    anchor: int = 6
    hot: int = 32_000
    shard_segments: int = 16_000


_LAST = (1 << 63) - 1  # stands for a null id: after all others
_BASE = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))


def segments(w: T.Words, p: Windows) -> tuple[np.ndarray, ...]:
    """(first word, number of words, anchor, hash) of each segment; words counted over the batch."""
    h = w.hashes()
    g = T.grams(h, p.anchor)
    least = T.sliding_argmin(g, p.window - p.anchor + 1)  # for each window its anchor's place
    at = np.flatnonzero(T.within(w.row, p.window))
    if not len(at):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    anchor = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    start = at[first]
    size = np.diff(np.append(first, len(at))) + p.window - 1
    up = np.cumprod(np.full(len(h), _BASE))
    down = np.cumprod(np.full(len(h), _INVERSE))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up)])
    return start, size, g[anchor[first]], T.mix((total[start + size] - total[start]) * down[start] + size.astype(np.uint64))


EMITTED = "anchor long, seg long, doc long, start int, n int"


def _emit(p: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                w = T.Words(part["text"])
                start, size, anchor, seg = segments(w, p)
                row = w.row[start] if len(start) else start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(T.signed(anchor)), pa.array(T.signed(seg)), pa.array(part["doc"].to_numpy()[row]), pa.array((start - w.first[row]).astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["anchor", "seg", "doc", "start", "n"],
                )

    return run


def _wanted(part: pa.RecordBatch) -> tuple[T.Words, np.ndarray, list[np.ndarray]]:
    """Words of some texts, and of the segments wanted of them: row, and anchor, hash, first word and number of words."""
    w, wanted = T.Words(part["text"]), part["wanted"]
    row = np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
    fields = [wanted.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(wanted.type.value_type.num_fields)]
    # rows that share an id may be shorter than the one a place was taken from
    ok = w.first[row] + fields[2] + fields[3] <= w.first[row + 1]
    return w, row[ok], [x[ok] for x in fields]


def _split(p: Windows):
    """Each window of the wanted segments as a segment and an anchor of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                w, row, (_, _, start, n) = _wanted(part)
                windows = n.astype(np.int64) - p.window + 1
                every = np.repeat(np.arange(len(start)), windows)
                begin = start[every] + np.arange(windows.sum()) - np.repeat(T.split_offsets(windows)[:-1], windows)
                g = T.grams(w.hashes(), p.window)[w.first[row[every]] + begin] if len(every) else np.zeros(0, np.uint64)
                own = pa.array(T.signed(T.mix(g ^ _BASE)))
                yield pa.RecordBatch.from_arrays([own, own, pa.array(part["doc"].to_numpy()[row[every]]), pa.array(begin.astype(np.int32)), pa.array(np.full(len(every), p.window, np.int32))], ["anchor", "seg", "doc", "start", "n"])

    return run


SHIPPED = "anchor long, seg long, d0 long, s0 int, d1 long, s1 int, words binary"


def _ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (as hashes) of the wanted segments, taken from their first places."""
    for batch in batches:
        for lo, hi in T.slices(batch["text"]):
            part = batch.slice(lo, hi - lo)
            w, row, (anchor, seg, start, n, d1, s1) = _wanted(part)
            size, begin = n.astype(np.int64), w.first[row] + start
            offsets = T.split_offsets(size)
            words = w.hashes()[np.repeat(begin - offsets[:-1], size) + np.arange(size.sum())]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(seg), pa.array(part["doc"].to_numpy()[row]), pa.array(start), pa.array(d1), pa.array(s1), T.binaries(words, offsets)], ["anchor", "seg", "d0", "s0", "d1", "s1", "words"])


def _runs(alphabet: np.ndarray, code: np.ndarray, piece: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``least`` or more words of a piece that the alphabet has: their symbols one behind the other, first places and lengths."""
    place = np.minimum(np.searchsorted(alphabet, code), max(0, len(alphabet) - 1))
    known = alphabet[place] == code if len(alphabet) else np.zeros(len(code), bool)
    at = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (known[1:] != known[:-1]), [True]]))
    first, k = at[:-1], np.diff(at)
    long = known[first] & (k >= least) if len(code) else np.zeros(len(first), bool)
    first, k = first[long], k[long]
    return place[np.repeat(first - T.split_offsets(k)[:-1], k) + np.arange(k.sum())] + 1, first, k


def repeats(anchor: np.ndarray, place: np.ndarray, words: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of windows that an earlier piece of the same anchor holds.

    Pieces come anchor by anchor in the order of ``place``; those of an equal place do not count as earlier. Equal
    windows have equal anchors, so anchors need no symbols of their own."""
    n, size = len(anchor), np.diff(offsets)
    new, step = np.ones(n, bool), np.zeros(n, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    step[1:] = ~new[1:] & (place[1:] != place[:-1])
    head, group, seen = np.flatnonzero(new), np.cumsum(new) - 1, np.cumsum(step)
    rank = seen - seen[head][group]
    length = np.maximum.reduceat(rank, head) + 1 if n else rank
    most = length[group]
    symbols = np.unique(words, return_inverse=True)[1].astype(np.int64)

    def laid(pieces: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's symbol in its span, piece, and offset in the piece."""
        k = size[pieces]
        offset = np.arange(k.sum()) - np.repeat(T.split_offsets(k)[:-1], k)
        piece = np.repeat(pieces, k)
        return (span[piece] << 32) + symbols[offsets[piece] + offset], piece, offset

    out, half = [], 1
    while half < length.max(initial=0):
        part, late = rank // (2 * half), (rank // half) % 2 == 1
        early = ~late & ((2 * part + 1) * half < most)  # whose later half is not empty
        span = np.cumsum(new | np.concatenate([[False], part[1:] != part[:-1]]))  # apart from anchor to anchor, too
        (held, piece, _), (sent, of, offset) = (laid(np.flatnonzero(x), span) for x in (early, late))
        alphabet = np.intersect1d(held, sent)
        (text, _, k), (stream, begin, m) = (_runs(alphabet, *x, window) for x in ((held, piece), (sent, of)))
        if len(k) and len(m):
            index = FMIndex(np.insert(text, np.cumsum(k), 0), len(alphabet) + 1, window)
            who, shift, _ = index.statistics(stream, T.split_offsets(m)[:-1], m)
            at = begin[who] + shift
            out.append((of[at], offset[at]))
        half *= 2
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    piece, offset = (np.concatenate(x) for x in zip(*out))
    both = np.unique((piece << 32) + offset)
    return both >> 32, both & 0xFFFFFFFF


FOUND = "anchor long, seg long, d0 long, s0 int, later boolean, a int, b int"


def _search(p: Windows):
    """Repeated ranges [a, b) of the words of each shipped place, found some ``shard_segments`` segments at a time."""

    def chunk(table: pa.Table) -> pa.RecordBatch:
        anchor, seg, d0, s0, d1, s1 = (table[c].to_numpy() for c in ("anchor", "seg", "d0", "s0", "d1", "s1"))
        data, at = T.raw(table["words"])
        words, at = np.ascontiguousarray(data).view(np.uint64), at // 8
        again = np.flatnonzero((d0 != d1) | (s0 != s1))
        of = np.concatenate([np.arange(len(anchor)), again])
        doc, start = np.concatenate([d0, d1[again]]), np.concatenate([s0, s1[again]])
        order = np.lexsort((start, doc, anchor[of]))
        of, doc, start, later = of[order], doc[order], start[order], order >= len(anchor)
        place = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])]))
        size = np.diff(at)[of]
        offsets = T.split_offsets(size)
        piece, offset = repeats(anchor[of], place, words[np.repeat(at[of] - offsets[:-1], size) + np.arange(size.sum())], offsets, p.window)
        new = np.ones(len(piece), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (offset[1:] > offset[:-1] + p.window)
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(piece))[: len(head)] - 1
        k, a, b = piece[head], offset[head], offset[last] + p.window
        own = of[k]
        return pa.RecordBatch.from_arrays([pa.array(anchor[own]), pa.array(seg[own]), pa.array(d0[own]), pa.array(s0[own]), pa.array(later[k]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["anchor", "seg", "d0", "s0", "later", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= p.shard_segments:
                table = pa.Table.from_batches(held)
                anchor = table["anchor"].to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
                if cut:
                    yield chunk(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    rows -= cut
        if held:
            yield chunk(pa.Table.from_batches(held))

    return run


def spans(docs: DataFrame, p: Windows = Windows(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, s, e): ranges of words to remove; ranges of a document may overlap. Null ids are the largest long."""
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.col(text).alias("text"))

    def recurring(emitted: DataFrame, name: str) -> DataFrame:
        # written, so that a join of two plain exchanges follows, which Spark can split where an anchor is hot
        again = stash(emitted.groupBy("anchor").agg(F.count("*").alias("seen")).filter("seen > 1").select("anchor"), f"{name}-anchors")
        out = stash(emitted.join(again, "anchor"), f"{name}-places")
        discard(again)
        return out

    def different(places: DataFrame, name: str) -> DataFrame:
        place = F.struct("doc", "start")
        return stash(places.groupBy("anchor", "seg").agg(F.min(place).alias("first"), F.max(place).alias("later"), F.max("n").alias("n")), f"{name}-segments")

    places = recurring(keyed.mapInArrow(T.tidy(_emit(p)), EMITTED), "substring")
    segs = different(places, "substring")
    tables = [segs]
    hot = stash(segs.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > p.hot).select("anchor"), "substring-hot")
    if not hot.isEmpty():
        wide = places.join(hot, "anchor").groupBy("doc").agg(F.collect_list(F.struct("anchor", "seg", "start", "n")).alias("wanted"))
        windows = stash(keyed.join(wide, "doc").select("doc", "text", "wanted").mapInArrow(_split(p), EMITTED), "substring-windows")
        single = recurring(windows, "substring-windows")
        discard(windows)
        tables += [different(single, "substring-windows")]
        segs = segs.join(hot, "anchor", "left_anti").unionByName(tables[1])
        places = places.join(hot, "anchor", "left_anti").unionByName(single)

    wanted = segs.groupBy(F.col("first.doc").alias("doc")).agg(F.collect_list(F.struct("anchor", "seg", F.col("first.start").alias("start"), "n", F.col("later.doc").alias("d1"), F.col("later.start").alias("s1"))).alias("wanted"))
    shipped = keyed.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_ship, SHIPPED)
    shards = partitions(docs.sparkSession, segs.count(), p.shard_segments)
    found = stash(shipped.repartition(shards, "anchor").sortWithinPartitions("anchor").mapInArrow(T.tidy(_search(p)), FOUND), "substring-found")
    discard(*tables)
    whose = places.join(found, ["anchor", "seg"]).filter(((F.col("doc") != F.col("d0")) | (F.col("start") != F.col("s0"))) == F.col("later"))
    return whose.select("doc", (F.col("start") + F.col("a")).cast("int").alias("s"), (F.col("start") + F.col("b")).cast("int").alias("e"))


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, removed, sums, texts = [], [], [], [], []
            for doc_id, text, gone in zip(batch["doc_id"], batch["text"], batch["gone"]):
                words = (text.as_py() or "").encode().split()
                keep = None
                if gone.is_valid:
                    flat = gone.values
                    s, e = (flat.field(k).to_numpy() for k in range(2))
                    n = len(words)
                    depth = np.bincount(np.minimum(s, n), minlength=n + 1) - np.bincount(np.minimum(e, n), minlength=n + 1)
                    keep = np.cumsum(depth[:n]) == 0
                left = words if keep is None else [x for x, k in zip(words, keep.tolist()) if k]
                kept = b" ".join(left)
                ids.append(doc_id.as_py())
                counts.append(len(words))
                removed.append(len(words) - len(left))
                sums.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def dedup(docs: DataFrame, p: Windows = Windows(), doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """A row for each document: ``n_words``, ``n_removed``, ``kept_sha256`` and, unless told not to, the ``kept`` words."""
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.col(text).alias("text"))
    gone = spans(docs, p, doc_id, text).groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    joined = keyed.join(gone, "doc", "left").select(F.nullif("doc", F.lit(_LAST)).alias("doc_id"), "text", "gone")
    return joined.mapInArrow(_remove(with_text), RESULT)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated windows."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")


def oracle() -> str:
    """The query's rows, every window spelled out."""
    return """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM spot),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, range(0, 20) t(k)),
word AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
