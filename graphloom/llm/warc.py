"""WARC archives: written record by record, read back by boundary-chain verification.

Writing. Pages with equal payloads of ``min_bytes`` or more share one *response*, that of the
largest page id; the others become *revisits* that refer to it. The digests' counts come from
one aggregation; only digests that occur twice are joined back. A task writes its records into
files of about ``roll_bytes``, each named by one rename when whole.

Reading. The files are cut into byte ranges. A task takes the record magics that begin in its
range as candidates, parses each header and emits (file, offset, successor offset): the record
ends where its declared length says. Payloads may hold the magic too, so candidates prove
nothing; pointer jumping along the successors from offset 0 keeps those that a file's first
record reaches, and drops the rest. What is reachable is then read record by record.

Edge cases: null html is an empty payload; null page ids are written as such, sort below all
others and read back null; rows that repeat a page are all responses where they hold the
largest id; a torn last record is dropped, its file's earlier records stay; an empty table
gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import new_folder, stash

MAGIC = b"WARC/1.1\r\n"
#: Fixed values of the format.
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", re.I)


@dataclass(frozen=True)
class Archive:
    min_bytes: int = 0
    roll_bytes: int = 64 << 20
    range_bytes: int = 8 << 20
    header_bytes: int = 64 << 10


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version line, named fields, blank line, block, two line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return MAGIC + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def _line(value: str | None) -> str:
    return re.sub(r"[\r\n]", " ", value or "")


def _write(folder: str, archive: Archive):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, k, out, size = TaskContext.get(), 0, None, 0
        done = []

        def close():
            out.close()
            fs.move(temp, path)
            done.append((f"{folder}/{name}", size))

        for batch in batches:
            for page_id, url, html, keeper, held in zip(*(batch[c] for c in ("page_id", "url", "payload", "keeper", "held"))):
                page_id, payload, keeper = page_id.as_py(), html.as_py(), keeper.as_py()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                revisit = held.as_py() and keeper != page_id
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", _line(url.as_py())), ("WARC-Payload-Digest", f"sha1:{digest}")]
                if revisit:
                    fields += [("WARC-Refers-To", _uri(keeper)), ("WARC-Profile", _REVISIT), ("X-Payload-Length", str(len(payload)))]
                fields += [("Content-Type", "application/octet-stream")]
                data = record(fields, b"" if revisit else payload)
                if out is not None and size + len(data) > archive.roll_bytes:
                    close()
                    out = None
                if out is None:
                    name = f"part-{context.partitionId():06d}-{k:05d}.warc"
                    fs, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    temp = path.replace("/part-", "/.part-") + f".{context.taskAttemptId()}"
                    out, size, k = fs.open_output_stream(temp), 0, k + 1
                out.write(data)
                size += len(data)
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"file": [f for f, _ in done], "size": [s for _, s in done]})

    return run


def write(pages: DataFrame, folder: str, archive: Archive = Archive()) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``folder``; returns ``file`` and ``size`` of what was written."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    sha = F.when(F.length("payload") >= archive.min_bytes, F.sha1("payload"))
    twice = stash(rows.select("page_id", sha.alias("sha")).filter("sha IS NOT NULL").groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc-copies")
    typed = rows.withColumn("sha", sha).join(twice.withColumn("held", F.lit(True)), "sha", "left").select("page_id", "url", "payload", "keeper", F.coalesce("held", F.lit(False)).alias("held"))
    return stash(typed.mapInArrow(_write(folder, archive), "file string, size long"), "warc-files")


def _open(file: str):
    fs, path = pafs.FileSystem.from_uri(file)
    return fs.open_input_file(path)


def candidates(data: bytes, upto: int) -> tuple[list[tuple[int, int]], int | None]:
    """(place, successor) of the record magics before ``upto``, and the place of the first whose header does not end
    in ``data``. One pass each for magics, blank lines and length fields, whatever the payloads hold."""
    ends = np.array([m.start() for m in re.finditer(b"\r\n\r\n", data)], np.int64)
    lengths = [(m.start(), int(m[1])) for m in _LENGTH.finditer(data)]
    at = np.array([a for a, _ in lengths], np.int64)
    out, torn = [], None
    for m in re.finditer(re.escape(MAGIC), data):
        if (place := m.start()) >= upto:
            break
        k = int(np.searchsorted(ends, place))
        if k == len(ends):
            torn = place
            break
        n = int(np.searchsorted(at, place))
        if n < len(at) and at[n] < ends[k]:
            out.append((place, int(ends[k]) + 4 + lengths[n][1] + 4))
    return out, torn


def _candidates(archive: Archive):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, lo in zip(*(batch[c].to_pylist() for c in ("file", "size", "lo"))):
                hi, extra = min(size, lo + archive.range_bytes), archive.header_bytes
                with _open(file) as source:
                    source.seek(lo)
                    data = source.read(min(size, hi + extra) - lo)
                    base, links = lo, []
                    while True:
                        found, torn = candidates(data, hi - base)
                        links += [(a + base, b + base) for a, b in found]
                        if torn is None or base + len(data) >= size:
                            break
                        extra *= 2  # a header longer than usual
                        base, data = base + torn, data[torn:] + source.read(extra)
                at, to = (np.array([x[k] for x in links], np.int64) for k in range(2))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(at), pa.string()), pa.array([size] * len(at), pa.int64()), pa.array(at), pa.array(to)], ["file", "size", "at", "next"])

    return run


def reachable(at: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """Which candidates the one at offset 0 reaches, by pointer jumping; ``at`` ascends.

    A successor that is neither a candidate nor the end of the file ends the chain before it:
    the record that claims it is torn or false."""
    n = len(at)
    place = np.searchsorted(at, to)
    hit = (place < n) & (at[np.minimum(place, n - 1)] == to)
    whole = hit | (to == size)
    jump = np.append(np.where(hit, place, n), n)
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and at[0] == 0
    while seen[0]:
        more = seen.copy()
        more[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
        if (more == seen).all():
            break
        seen = more
    return seen[:n] & whole


def _chain(key, table):
    table = table.sort_by("at")
    keep = reachable(table["at"].to_numpy(), table["next"].to_numpy(), table["size"][0].as_py())
    return table.filter(pa.array(keep)).select(["file", "at", "next"])


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (lower-case names) and block of one record."""
    end = data.index(b"\r\n\r\n")
    fields = {}
    for line in data[len(MAGIC) : end].decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, data[end + 4 : end + 4 + int(fields["content-length"])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened, source = None, None
    for batch in batches:
        rows = []
        for file, at, to in zip(*(batch[c].to_pylist() for c in ("file", "at", "next"))):
            if file != opened:
                opened, source = file, _open(file)
            source.seek(at)
            fields, block = parse(source.read(to - at))
            revisit = fields["warc-type"] == "revisit"
            digest = fields["warc-payload-digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(block).digest()).decode()
            if digest != fields["warc-payload-digest"].removeprefix("sha1:"):
                raise ValueError(f"{file} at {at}: the payload is not what its digest says")
            rows.append((_page(fields["warc-record-id"]), int(fields["x-payload-length"]) if revisit else len(block), digest, fields["warc-type"], _page(fields["warc-refers-to"]) if revisit else None))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(files: DataFrame, archive: Archive = Archive()) -> DataFrame:
    """The records of archives: ``files`` has ``file`` (a URI) and ``size``. A task for each range, however few bytes its offsets take."""
    total = files.agg(F.coalesce(F.sum(F.ceil(F.col("size") / archive.range_bytes)), F.lit(0))).first()[0]
    tasks = max(1, int(total))
    ranges = files.filter("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(archive.range_bytes).cast("long"))).alias("lo"))
    links = ranges.repartition(tasks, "file", "lo").mapInArrow(_candidates(archive), "file string, size long, at long, next long")
    kept = links.groupBy("file").applyInArrow(_chain, "file string, at long, next long")
    spot = F.floor(F.col("at") / archive.range_bytes)
    return kept.repartition(tasks, "file", spot).sortWithinPartitions("file", "at").mapInArrow(_read, RECORDS)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page as its archived record says."""
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc")))
