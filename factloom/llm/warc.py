"""WARC archives with a globally ordered capture index, made by external merging.

Each task writes its captures to archives in the shared folder and, per archive, an index run sorted by URL key, time and
page. Ranges of that order are then merged: a task takes its range from every run and merges the runs with a loser tree, so
that the ranges one after the other are the capture histories in order. Archives are read back through that index.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.url_rules import parts
from factloom.plans.session import ensure_checkpoint_dir, materialize

LEAST_SHARED = 100  # payloads of fewer bytes are always stored
ARCHIVE_BYTES = 64 << 20  # an archive is closed once it has taken so many bytes before compression
RANGE_ROWS = 8192  # index rows merged by one task
INDEX = "run string, seq long, url_key string, captured string, page_id long, place long, stored long"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the right, then path and query: `com,example,www)/path?query`."""
    host, _ = parts(url)
    rest = F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)
    return F.coalesce(F.when(url.contains("://"), F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), rest)).otherwise(url), F.lit(""))


def plan_captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None) -> DataFrame:
    """page_id, url, url_key, captured, payload, payload_digest, refers_to: what each record will hold.

    Payload: the html in UTF-8, empty for null. Of payloads equal by SHA-256 and of at least LEAST_SHARED bytes, the one with
    the smallest page_id is stored and the others refer to it; rows that repeat that page_id are stored too. Without a
    capture time, pages are a second apart in the order of their ids."""
    moment = captured if captured is not None else F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(F.col(page_id).cast("long"), F.lit(0)))
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), url_key(F.col(url)).alias("url_key"),
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    first = (
        rows.filter(F.octet_length("payload") >= LEAST_SHARED).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(first, "payload_digest", "left").select(
        "page_id", "url", "url_key", "captured", "payload", "payload_digest", refers.alias("refers_to"))


def _line(value: str | None) -> str:
    """A URL as a header value: control characters would end the line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value or "")


def _record(page, url, captured, digest, refers_to, payload: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Date: {captured}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(captures: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write captures as gzip members, a record each -> the stored index runs (run, seq, url_key, captured, page_id, place, stored).

    folder: shared by all executors; by default a new one in the checkpoint folder. File names are new in every attempt, and
    only those of the attempt whose index rows were stored are ever read, so lost executors and repeated tasks do no harm."""
    spark = captures.sparkSession
    ensure_checkpoint_dir(spark)
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        run, out, entries, size = "", None, [], 0

        def close() -> pa.RecordBatch:
            out.close()
            ordered = sorted(entries)
            return pa.RecordBatch.from_arrays([
                pa.array([run] * len(ordered)), pa.array(range(len(ordered)), pa.int64()), pa.array([e[0] for e in ordered], pa.string()),
                pa.array([e[1] for e in ordered], pa.string()), pa.array([e[5] for e in ordered], pa.int64()),
                pa.array([e[4] for e in ordered], pa.int64()), pa.array([e[6] for e in ordered], pa.int64())],
                names=["run", "seq", "url_key", "captured", "page_id", "place", "stored"])

        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "url_key", "captured", "payload", "payload_digest", "refers_to")]
            for row in zip(*columns):
                page, url, key, captured, payload, digest, refers_to = (v.as_py() for v in row)
                if out is None:
                    run = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, entries, size = system.open_output_stream(run, compression=None), [], 0
                    head = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % str(uuid.uuid4()).encode()
                    out.write(_gzip(head))
                record = _record(page, url, captured, digest, refers_to, payload)
                member, place = _gzip(record), out.tell()
                out.write(member)
                # sorted by what the runs are merged by, then by place
                entries.append((key, captured or "", page is not None, page or 0, place, page, len(member)))
                size += len(record)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialize(captures.mapInArrow(write, INDEX), "warc-index")


class LoserTree:
    """Merges sorted lists: every inner node keeps the loser of its match, so one new item replays one path to the root."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, n = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(n, 1)
        self.winner = -1
        for run in range(n):
            self._replay(run, building=True)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's next item goes before run b's; ended runs go last, ties to the earlier run."""
        left = self.runs[a][self.at[a]] if self.at[a] < len(self.runs[a]) else None
        right = self.runs[b][self.at[b]] if self.at[b] < len(self.runs[b]) else None
        if left is None or right is None:
            return right is None and (left is not None or a < b)
        return (left, a) < (right, b)

    def _replay(self, run: int, building: bool = False) -> None:
        node = (run + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if building and other < 0:  # the first to come waits for its opponent
                self.losers[node] = run
                return
            if self._before(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.winner = run

    def __iter__(self):
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self._replay(run)


def merge_runs(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Index runs -> the same rows in one order: by url_key, captured, page_id within and across partitions.

    Borders between ranges lie between whole keys, so a URL with very many captures is spread by time. A task holds the index
    rows of its range only. Runs of repeated rows are merged like any other; an empty index gives an empty result."""
    ranges = max(1, -(-index.count() // range_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: OrderedDict[str, list] = OrderedDict()
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("run", "seq", "url_key", "captured", "page_id", "place", "stored"))):
                page = row[4]
                runs.setdefault(row[0], []).append(((row[2], row[3], page is not None, page or 0), row))
        merged = [row for _, row in LoserTree(list(runs.values()))]
        for a in range(0, len(merged), 10_000):
            part = list(zip(*merged[a:a + 10_000]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(part, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                names=["run", "seq", "url_key", "captured", "page_id", "place", "stored"])

    dealt = index.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(merge, INDEX)


def parse_record(data: bytes) -> dict:
    """A record's named header fields in lower case, its HTTP length and its payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"http-length": length, "payload": payload if fields["warc-type"] == "response" else None}


def read_archives(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Read every indexed record -> page_id, url, captured, payload_bytes, payload_digest, record_type, refers_to
    (and payload, null for revisits), in index order. A batch of the index is read archive by archive from front to back, so each
    file is opened once a batch. Stored payloads are measured and digested anew; a digest that differs is an error."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(folder)
        number = lambda urn: int(urn[len("<urn:page:"):-1]) if urn and urn != "<urn:page:>" else None
        for batch in batches:
            wanted = list(zip(*(batch.column(n).to_pylist() for n in ("run", "place", "stored"))))
            rows: list[tuple] = [()] * len(wanted)
            opened, file = None, None
            for at in sorted(range(len(wanted)), key=wanted.__getitem__):
                run, place, stored = wanted[at]
                if run != opened:
                    if file is not None:
                        file.close()
                    opened, file = run, system.open_input_file(run)
                r = parse_record(zlib.decompress(file.read_at(stored, place), 31))
                payload, digest = r["payload"], r["warc-payload-digest"].removeprefix("sha256:")
                if payload is not None and (len(payload) != r["http-length"] or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{run} at {place}: the payload does not have its digest")
                rows[at] = (number(r["warc-record-id"]), r["warc-target-uri"], r["warc-date"], r["http-length"], digest, r["warc-type"],
                            number(r.get("warc-refers-to")), payload if with_payload else None)
            if file is not None:
                file.close()
            names = ["page_id", "url", "captured", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            keep = len(names) - (not with_payload)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(keep)], names=names[:keep])

    ddl = "page_id long, url string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return index.mapInArrow(read, ddl + ", payload binary" * with_payload)


def archive_pages(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Write pages to archives, merge their index and read everything back: one row per page, in capture order.

    Null ids stay null and come first; null urls are empty; other columns take no part; no pages, no rows."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    return read_archives(merge_runs(write_archives(plan_captures(pages), folder)), folder, with_payload)
