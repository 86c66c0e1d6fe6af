"""Quality rules: counts of one document, then lines that too many documents of a host share.

A document's own counts come from one Arrow pass. For the cross-document rule each line is
normalised (lower case, words joined by one space) and hashed; a line is *frequent* on a host
when more documents of that host than a limit hold it: ``max_docs`` documents, however large the
host, or ``max_share`` of its documents but at least ``min_docs`` where the host is small.
Frequent lines are removed from all documents but the host's first (least id) that holds them,
and a document is rejected when what is left is under ``min_words`` words or under ``min_left``
of its words. So of a page copied a thousand times one copy stays.

Edge cases: a null text has no words and fails; null hosts form one host; repeated rows count as
documents of their own and each get a row; rows that share an id are first together; where all
ids are null any one row is first; ties do not arise, since counts are compared with limits; very
long texts are taken whole; an empty table gives an empty table; other columns are not looked at.
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
from .workspace import stash


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    repeat_window: int = 5
    min_docs: int = 5
    max_docs: int = 20
    max_share: float = 0.10
    min_left: float = 0.5


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80
_SPACED = np.zeros(256, bool)
_SPACED[[32, 9, 10, 11, 12, 13]] = True

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = f"doc_id long, host string, text_hash long, {COUNTS}, lines array<struct<hash:long,at:int,words:int>>"


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated_words(w: T.Words, h: np.ndarray, n: int) -> np.ndarray:
    """Words of each row in n-word windows that the row holds twice or more."""
    g, inside = T.grams(h, n), T.within(w.row, n)
    at = np.flatnonzero(inside)
    cover = np.zeros(len(w) + 1, np.int64)
    if len(at):
        key = T.mix(g[at] ^ T.mix(w.row[at].astype(np.uint64) + np.uint64(1)))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[back] > 1]
        cover[twice] += 1
        cover -= np.bincount(twice + n, minlength=len(cover))[: len(cover)]
    return _per_row(np.cumsum(cover[:-1]) > 0, w.first)


def _lines(w: T.Words, n_rows: int) -> tuple[np.ndarray, ...]:
    """First word, row and number (among the row's newline-split lines) of each line that has a word."""
    newline = np.flatnonzero(w.bytes == 10)
    number = np.searchsorted(newline, w.start) - np.searchsorted(newline, w.offsets[:-1])[w.row]
    new = np.ones(len(w), bool)
    new[1:] = (w.row[1:] != w.row[:-1]) | (number[1:] != number[:-1])
    at = np.flatnonzero(new)
    return at, w.row[at], number[at]


def _duplicate_lines(w: T.Words, at: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Lines with a word, byte for byte equal to an earlier line of the row."""
    if not len(at):
        return np.zeros(n_rows, np.int64)
    stops = np.unique(np.concatenate([np.flatnonzero(w.bytes == 10), w.offsets]))
    starts = np.unique(np.concatenate([np.flatnonzero(w.bytes == 10) + 1, w.offsets]))
    begin = starts[np.searchsorted(starts, w.start[at], "right") - 1]
    end = stops[np.searchsorted(stops, w.start[at], "right")]
    key = T.mix(T.span_hashes(w.bytes, begin, end) ^ T.mix(row.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(row, minlength=n_rows) - np.bincount(row[first], minlength=n_rows)


def _features(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in T.slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                n = part.num_rows
                w = T.Words(part["text"])
                h = w.hashes()
                at, row, number = _lines(w, n)
                low = T.Words(pc.utf8_lower(part["text"]))
                low_at, low_row, low_number = _lines(low, n)
                size = np.diff(np.append(low_at, len(low)))
                place = np.arange(len(low)) - np.repeat(low_at, size)
                line_hash = np.add.reduceat(T.mix(low.hashes() + place.astype(np.uint64) * T._M1), low_at) if len(low_at) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        part["host"],
                        pa.array(T.signed(T.span_hashes(w.bytes, w.offsets[:-1], w.offsets[1:]))),
                        pa.array(np.diff(w.first)),
                        pa.array(_per_row(_FIRST_BYTE[w.bytes] & ~_SPACED[w.bytes], w.offsets)),
                        pa.array(_per_row(_SYMBOL[w.bytes], w.offsets)),
                        pa.array(_duplicate_lines(w, at, row, n)),
                        pa.array(_repeated_words(w, h, rules.repeat_window)),
                        pa.ListArray.from_arrays(
                            pa.array(np.searchsorted(low_row, np.arange(n + 1)).astype(np.int32)),
                            pa.StructArray.from_arrays([pa.array(T.signed(line_hash)), pa.array(low_number.astype(np.int32)), pa.array(size.astype(np.int32))], ["hash", "at", "words"]),
                        ),
                    ],
                    ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
                )

    return run


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """A row for each document: ``doc_id``, ``text_hash``, its counts, ``n_line_words`` (in frequent
    lines), ``cut`` (numbers of those lines), ``base_failed`` and ``kept``."""
    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    found = stash(wanted.mapInArrow(T.tidy(_features(rules)), FEATURES).withColumn("uid", F.monotonically_increasing_id()), "quality")
    lines = found.select("uid", "doc_id", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), F.explode("lines").alias("line")).select("uid", "doc_id", "host", "no_host", F.col("line.hash").alias("line_hash"), "line.at", "line.words")
    hosts = found.groupBy(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host")).agg(F.count("*").alias("host_docs"))
    frequent = (
        lines.groupBy("host", "no_host", "line_hash")
        .agg(F.countDistinct("uid").alias("docs"), F.min("doc_id").alias("first_id"), F.min("uid").alias("first_uid"))
        .filter(F.col("docs") > rules.min_docs)
        .join(hosts, ["host", "no_host"])
        .filter((F.col("docs") > rules.max_docs) | (F.col("docs") > F.col("host_docs") * rules.max_share))
        .select("host", "no_host", "line_hash", "first_id", "first_uid")
    )
    frequent = stash(frequent, "quality-frequent")  # so that the join reads two plain exchanges, which Spark can split at a hot line
    first = F.when(F.col("first_id").isNull(), F.col("uid") == F.col("first_uid")).otherwise(F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(False)))
    cut = lines.join(frequent, ["host", "no_host", "line_hash"]).filter(~first).groupBy("uid").agg(F.sum("words").cast("long").alias("n_line_words"), F.sort_array(F.collect_set("at")).alias("cut"))
    judged = found.drop("lines").join(cut, "uid", "left")
    left = F.col("n_words") - F.coalesce("n_line_words", F.lit(0))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return judged.select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce("n_line_words", F.lit(0).cast("long")).alias("n_line_words"), "cut", failed.alias("base_failed"),
        (~failed & (left >= rules.min_words) & (left >= rules.min_left * F.col("n_words"))).alias("kept"),
    )


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """``docs`` without rejected documents and without frequent lines; the columns stay as they are.

    Rows are matched by id and text, so rows that share an id are judged each by its own text.
    ``n_chars``, where there is one, follows the text.
    """
    verdict = judge(docs, doc_id, text, host, rules).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("cut").alias("__cut")).dropDuplicates(["__id", "__hash"])
    keyed = docs.mapInArrow(_with_hash(text), docs.select("*", F.lit(0).cast("long").alias("__hash2")).schema)
    joined = keyed.join(verdict, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash2") == F.col("__hash")))
    left = F.when(F.col("__cut").isNull(), F.col(text)).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("__cut", i)), "\n"))
    out = joined.withColumn(text, left)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def _with_hash(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = T.raw(batch[text])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(T.signed(T.span_hashes(data, at[:-1], at[1:])))], [*batch.schema.names, "__hash2"])

    return run


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words")


def oracle() -> str:
    """The query's rows from words, lines and windows spelled out."""
    return """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, source IS NULL AS no_host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM spot),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 5) t(k) GROUP BY doc_id),
line AS (SELECT doc_id, host, no_host, text, unnest(string_split(text, chr(10))) AS x FROM d),
lw AS (SELECT *, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n, array_to_string(regexp_extract_all(lower(x), '[^\\x20\\x09-\\x0D]+'), ' ') AS norm FROM line),
l AS (SELECT * FROM lw WHERE n > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM l GROUP BY doc_id),
hosts AS (SELECT host, no_host, count(*) AS docs FROM d GROUP BY ALL),
freq AS (SELECT host, no_host, norm, first FROM (SELECT host, no_host, norm, count(DISTINCT doc_id) AS k, min(doc_id) AS first FROM l GROUP BY ALL) JOIN hosts USING (host, no_host) WHERE k > 20 OR (k > 5 AND k > docs * 0.1)),
cut AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_line_words FROM l JOIN freq USING (host, no_host, norm) WHERE doc_id <> first GROUP BY doc_id),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_line_words, 0) AS n_line_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN cut USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_line_words >= 10 AND n_words - n_line_words >= 0.5 * n_words AS kept, n_line_words FROM f
"""
