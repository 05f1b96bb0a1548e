"""WARC archives of pages and the global index of their captures.

Archives: gzip members, one record each, in files of about 16 MB that tasks write to the shared folder. Of pages with equal payloads the one
with the smallest page id is a ``response`` record, the others are ``revisit`` records without payload that refer to it; payload digest and
length are those of the full payload in both. A capture's time is ``EPOCH`` plus its page id in seconds, as pages have none.

Index: every archive gives a run of entries sorted by URL key (host reversed, then path) and time. The runs are dealt by ranges of (URL
key, time, page id) whose number grows with the entries, and within a range the slices of the runs are merged by a loser tree. The ranges follow each
other, so the captures of a URL stand in order of time, across ranges too if one URL has very many.

Null payloads are empty. A null page id makes a response of its own. Rows with the same page id and payload are each written, as
responses if the id is the smallest. Null URLs give records without a target and an empty key. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from datetime import datetime, timedelta, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch_dir
from .common import chunked, small_batches, stored
from .files import FILE_BYTES, make_folder, read_files, write_file

EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RANGE_ROWS, READ_BYTES = 20_000, 1 << 14
ENTRY = ("url_key string, captured long, page_id long, run string, seq long, payload_bytes long, payload_digest string, record_type string, "
         "refers_to long, warc_offset long")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """``com,example)/path?query``: scheme and fragment dropped, host reversed and in lower case."""
    m = re.match(r"(?s)(?:[^:/?#]*://)?([^/?#]*)([^#]*)", url or "")
    host = m[1].lower().rsplit("@", 1)[-1]
    return f"{','.join(reversed(host.split('.')))}){m[2]}" if host else m[2]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    date = (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 32))).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'-' if page_id is None else page_id}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + '!#$&()*+,/:;=?@[]~' + chr(39))}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def records(data: bytes):
    """(offset, headers, body) of the records of one archive; members are fed in small pieces, so time is linear in the file."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts, to = zlib.decompressobj(31), [], at
        while not member.eof:
            if to >= len(view):
                raise ValueError(f"record at {at} is cut off")
            parts.append(member.decompress(view[to: to + READ_BYTES]))
            to += READ_BYTES
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield at, fields, rest[: int(fields["Content-Length"])]
        at = min(to, len(view)) - len(member.unused_data)


def entry(fields: dict[str, str], body: bytes) -> tuple:
    """(url_key, captured, page_id, payload_bytes, payload_digest, record_type, refers_to) from a record as read."""
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    number = lambda name: None if fields.get(name, "<urn:page:->") == "<urn:page:->" else int(fields[name][10:-1])
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    when = datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
    return url_key(fields.get("WARC-Target-URI")), int(when.timestamp()), number("WARC-Record-ID"), size, digest, kind, number("WARC-Refers-To")


def loser_tree_merge(runs: list[list]) -> list:
    """The items of sorted runs in order; equal items in the order of their runs. Every step replays one path of the tree."""
    k = len(runs)
    at = [0] * k
    heads = [(0, run[0], i) if run else (1, None, i) for i, run in enumerate(runs)]  # (exhausted, item, run)
    less = lambda a, b: (heads[a][0], heads[a][2]) < (heads[b][0], heads[b][2]) if heads[a][0] or heads[b][0] else (heads[a][1], a) < (heads[b][1], b)
    losers = [-1] * k  # inner nodes 1 .. k-1; leaf i stands at k + i
    winner_of: list[int] = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner_of[2 * node], winner_of[2 * node + 1]
        winner_of[node], losers[node] = (a, b) if less(a, b) else (b, a)
    out = []
    best = winner_of[1] if k > 1 else 0
    while k and not heads[best][0]:
        out.append(heads[best][1])
        at[best] += 1
        heads[best] = (0, runs[best][at[best]], best) if at[best] < len(runs[best]) else (1, None, best)
        node = (k + best) // 2
        while node:
            if less(losers[node], best):
                best, losers[node] = losers[node], best
            node //= 2
    return out


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write ``capture-<partition>-<number>.warc.gz`` files."""
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("body")))
    # stored, so that its size decides how it is joined; one row for every payload met again
    first = stored(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"), "payloads")
    ruled = rows.join(first, "digest", "left").select("id", "url", "body", "digest", F.when(F.col("id") != F.col("first"), F.col("first")).alias("refers_to"))

    def run(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal number, held, size
            write_file(folder, f"capture-{part:07d}-{number:05d}.warc.gz", b"".join(held))
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["n"])

        for batch in chunked(batches, "body"):
            for row in batch.to_pylist():
                deflate = zlib.compressobj(6, wbits=31)
                member = deflate.compress(record(row["id"], row["url"], row["body"], base64.b32encode(row["digest"]).decode(), row["refers_to"])) + deflate.flush()
                if held and size + len(member) > FILE_BYTES:
                    yield flush()
                held.append(member)
                size += len(member)
        if held:
            yield flush()

    small_batches(ruled).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def runs(spark, folder: str) -> DataFrame:
    """The entries of the archives; those of one archive are a run, numbered in their order."""

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted(((*entry(fields, body), at) for at, fields, body in records(data)), key=lambda e: (e[0].encode(), e[1], -1 if e[2] is None else e[2]))
                name = path.rsplit("/", 1)[1]
                cols = list(zip(*found))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
                arrays[3:3] = [pa.array([name] * len(found)), pa.array(range(len(found)), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in ENTRY.split(", ")])

    return read_files(spark, folder, "*.warc.gz").mapInArrow(run, ENTRY)


def merged_index(entries: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The entries with their position in the global order of URL key, time and page id."""
    entries = stored(entries, "runs")
    ranges = max(1, -(-entries.count() // range_rows))
    order = ["url_key", "captured", "page_id"]
    dealt = entries.repartitionByRange(ranges, *order, "run", "seq").sortWithinPartitions("run", "seq")

    def run(batches):
        table = pa.Table.from_batches(list(batches))  # one range: about ``range_rows`` entries
        if not table.num_rows:
            return
        slices: dict[str, list] = {}
        for i, (key, when, page, name) in enumerate(zip(*(table.column(c).to_pylist() for c in (*order, "run")))):
            slices.setdefault(name, []).append((key.encode(), when, -1 if page is None else page, i))
        places = [item[3] for item in loser_tree_merge(list(slices.values()))]
        out = table.take(pa.array(places)).append_column("range", pa.array([TaskContext.get().partitionId()] * len(places), pa.int64()))
        yield from out.append_column("place", pa.array(range(len(places)), pa.int64())).to_batches()

    merged = stored(dealt.mapInArrow(run, ENTRY + ", range long, place long"), "index")
    sizes = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return merged.join(sizes.select("range", before.alias("before")), "range").withColumn("position", F.col("before") + F.col("place")).drop("range", "place", "before", "seq")


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Write the archives, read them back and merge their index: one row per page."""
    spark = pages.sparkSession
    folder = make_folder(folder or scratch_dir(spark, "warc"))
    write_archives(pages, folder, page_id, url, html)
    return merged_index(runs(spark, folder)).withColumnRenamed("run", "warc_file").withColumnRenamed("page_id", page_id)
