"""Secret scans: patterns propose, corpus-wide ownership decides what else is a live credential.

Three base kinds (``assign``, ``access``, ``hex``) are always reported. The ``token`` kind adds
opaque strings of other shapes (long mixed-case alphanumerics, well-known key prefixes, signed
web tokens, private-key blocks); such a string is reported where the whole corpus shows it with
one owner, in however many repositories, or with at most ``max_owners`` owners where they spread
it over at most ``max_repos`` repositories. A string that many owners carry is an example someone
copied. Base spans get the same verdict in ``n_live``/``n_example`` but stay.

A private key is its whole block, from the BEGIN line to the END line, or to the end of its
base64 where the END line is missing; what is compared is the block's body without its spaces,
so two keys are two secrets however alike their first lines are.

Owners and repositories are whatever columns the caller names. Where an owner is as coarse as a
crawl source (as in the registered query), two authors of one source look like one owner, and a
string that both copied looks live.

Candidates travel as hashes; no credential leaves the document it was found in. Counts of
owners and repositories are aggregated before any shuffle, so one string that a third of all
documents hold costs a few rows a task.

Edge cases: null text is empty; null owner or repository counts as one owner or repository, told
apart from an empty one; repeated rows each get a row; very long texts are scanned whole, in time
that grows with their length; columns other than those named are not looked at; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import stash

KINDS = ("assign", "access", "hex", "token")
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Shapes of the added kind: published prefixes of vendors' keys, signed web tokens, opaque strings.
_TOKEN = re.compile(
    r"gh[pousr]_[A-Za-z0-9]{36,}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|sk_live_[A-Za-z0-9]{16,}"
    r"|AIza[A-Za-z0-9_-]{35}"
    r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])"
)
_BEGIN, _END = (re.compile(rf"-----{x} (?:[A-Z0-9]+ )*PRIVATE KEY-----") for x in ("BEGIN", "END"))
_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s]|\\[nr])*")

FOUND = "doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind:int,start:int,end:int,digest:binary>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, secret) of the three base kinds, each leftmost and non-overlapping."""
    out = [(0, m.start(), m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return out


def _opaque(s: str) -> bool:
    """Long strings of one case or without digits are words, paths or numbers."""
    return not re.fullmatch(r"[A-Za-z_/-]*|[0-9_/+-]*|[a-z0-9]*|[A-Z0-9]*", s)


def key_blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, body) of private keys, each up to its END line if that comes before the next BEGIN line."""
    begins, ends = list(_BEGIN.finditer(text)), list(_END.finditer(text))
    starts, out = [m.start() for m in ends], []
    for k, m in enumerate(begins):
        upto = begins[k + 1].start() if k + 1 < len(begins) else len(text)
        n = bisect_left(starts, m.end())
        if n < len(ends) and starts[n] < upto:
            body, stop = text[m.end() : starts[n]], ends[n].end()
        else:
            body = _BODY.match(text, m.end(), upto)[0].rstrip()
            stop = m.end() + len(body)
        if body := re.sub(r"\s|\\[nr]", "", body):
            out.append((m.start(), stop, body))
    return out


def added_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates of the added kind that neither a base span nor, for other shapes, a private key overlaps."""
    keys = key_blocks(text)
    if taken := sorted([(s, e) for _, s, e, _ in base]):
        starts, reach = [s for s, _ in taken], []
        for _, e in taken:
            reach.append(max(e, reach[-1] if reach else e))
        free = lambda s, e: not (n := bisect_left(starts, e)) or reach[n - 1] <= s
    else:
        free = lambda s, e: True
    begins = [s for s, _, _ in keys]
    inside = lambda s: (n := bisect_right(begins, s)) and s < keys[n - 1][1]
    out = [(3, s, e, body) for s, e, body in keys if free(s, e)]
    for m in _TOKEN.finditer(text):
        if _opaque(m[0]) and free(m.start(), m.end()) and not inside(m.start()):
            out.append((3, m.start(), m.end(), m[0]))
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted((s, k, e) for k, s, e, *_ in spans))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        counts, sums, found = [], [], []
        for text in batch["text"]:
            text = text.as_py() or ""
            base = base_spans(text)
            base.sort(key=lambda x: (x[1], x[0]))
            counts.append([sum(k == kind for k, *_ in base) for kind in range(3)])
            sums.append(hashlib.sha256(written(base).encode()).hexdigest() if base else none)
            found.append([{"kind": k, "start": s, "end": e, "digest": hashlib.blake2b(secret.encode(), digest_size=16).digest()} for k, s, e, secret in [*base, *added_spans(text, base)]])
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["owner"], batch["repo"], *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(sums, pa.string()),
             pa.array(found, pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())])))],
            ["doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
        )


def scan(docs: DataFrame, doc_id="doc_id", text="text", owner="source", repo=None, max_owners: int = 1, max_repos: int = 3) -> DataFrame:
    """A row for each document: base counts and digest, ``spans``, and how many spans look live or copied.

    ``owner`` and ``repo`` are column names or Columns; without ``repo`` an owner is one repository."""
    named = lambda c: F.col(c) if isinstance(c, str) else c
    told = lambda c: F.coalesce(F.concat(F.lit("="), named(c).cast("string")), F.lit(""))
    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), told(owner).alias("owner"), told(owner if repo is None else repo).alias("repo"), F.col(text).alias("text"))
    found = stash(wanted.mapInArrow(_scan, FOUND).withColumn("uid", F.monotonically_increasing_id()), "secrets")
    spans = found.select("uid", "owner", "repo", F.explode("found").alias("x")).select("uid", "owner", "repo", "x.*")
    # one row a (string, owner, repository) leaves each task; then one a string
    spread = spans.groupBy("digest", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("owner", "repo").alias("repos"))
    spread = stash(spread, "secret-owners")  # so that the join reads two plain exchanges, which Spark can split at a hot string
    live = (F.col("owners") <= max_owners) & ((F.col("owners") == 1) | (F.col("repos") <= max_repos))
    judged = spans.join(spread, "digest").withColumn("live", live).filter((F.col("kind") < 3) | F.col("live"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    listed = judged.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("span")))).alias("all"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"), F.count_if(F.col("kind") == 3).alias("n_token"),
    )
    return found.join(listed, "uid", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(F.array_join(F.col("all.span"), ","), F.lit("")).alias("spans"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_token", "n_live", "n_example")),
    )


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's secrets, with sources as owners and source/language as repositories."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), repo=F.concat_ws("/", "source", "lang"))
