"""WARC archives with a merged capture index.

Each task writes its pages as gzip records into archives on the shared file system: full
responses, and revisit records for pages whose payload another page holds already. Reading
back, each archive gives a run of index entries, sorted by URL key, time and page. The runs
are merged externally: the key range is cut by splitters taken from regular samples of all
runs, and for each range one task streams the runs' matching rows through a loser tree, so
memory holds a batch per run. More runs than ``FAN_IN`` are first merged into fewer. The
ranges in order are the globally ordered capture history; a much captured URL is cut by time.

A task that is run again writes archives and runs of new names; only those listed by the
attempt that succeeded are read.

Defined cases: a null page has an empty payload. Of equal payloads the smallest page id is
the response, and rows that repeat that id are too; null ids come last. Pages without a URL
have an empty key. A digest that does not fit its payload fails the job.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import islice
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hookloom.llm.common import broadcast_if_small, whole_text
from hookloom.session import shared_dir, stage_table

ARCHIVE_BYTES = 256 << 20
FAN_IN = 512
# Entries sorted at once.
RUN_ROWS = 200_000
# Stands for a range's number in the names of runs that have a file per range.
PART = "{part}"
RANGE_ROWS = 250_000
# Keys of all runs together that splitters are chosen from.
SAMPLES = 8192
SAMPLE_FIELDS = ("url_key", "captured_at", "page_id", "archive", "offset")
SAMPLE_SQL = "url_key: string, captured_at: string, page_id: long, archive: string, offset: long"
BATCH = 4096
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
FIRST_CAPTURE = 1704067200

ENTRY = pa.schema([
    ("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
ENTRY_SQL = (
    "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, archive string, offset long, length long"
)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page}:{digest}')}>"


def warc_record(page: int | None, url: str | None, date: str, payload: bytes, refers_to: int | None,
                revisit: bool) -> bytes:
    """One WARC record, uncompressed."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")
    if page is not None:
        headers["WARC-Page-ID"] = str(page)
    if revisit:
        headers["WARC-Profile"] = REVISIT
        headers["WARC-Refers-To"] = record_id(refers_to, digest)
        headers["WARC-Refers-To-Page-ID"] = str(refers_to)
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in headers.items())
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member."""
    offset, rest = 0, b""
    while rest or (rest := stream.read(chunk)):
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise ValueError(f"archive ends inside the record at {offset}")
            parts.append(inflate.decompress(rest))
            used += len(rest) - len(inflate.unused_data)
            rest = inflate.unused_data
        yield offset, used, b"".join(parts)
        offset += used


def url_key(url: str) -> str:
    """The URL with its host's labels reversed, without scheme and fragment."""
    match = re.match(r"[^:/?#]*://([^/?#]*)([^#]*)", url)
    if not match:
        return url
    host = match.group(1).lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + match.group(2)


def index_entry(record: bytes, archive: str, offset: int, length: int) -> dict:
    """Index entry of a record, whose payload is checked against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http).group(1))
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    response = headers["WARC-Type"] == "response"
    if response and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} in {archive} does not fit its digest")

    def number(name: str) -> int | None:
        return int(headers[name]) if headers.get(name, "None") != "None" else None

    return {
        "url_key": url_key(headers.get("WARC-Target-URI", "")), "captured_at": headers["WARC-Date"],
        "page_id": number("WARC-Page-ID"), "payload_bytes": size, "payload_digest": digest,
        "record_type": headers["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID"),
        "archive": archive, "offset": offset, "length": length,
    }


def sort_key(entry: dict) -> tuple:
    page = entry["page_id"]
    return entry["url_key"], entry["captured_at"], page is None, page or 0, entry["archive"], entry["offset"]


class LoserTree:
    """Merges sorted sources; each step replays the matches on one path to the root."""

    def __init__(self, sources: list[Iterator], key: Callable):
        self.sources, self.key = sources, key
        self.heads: list = [None] * len(sources)
        self.keys: list = [None] * len(sources)  # None once a source has ended
        for source in range(len(sources)):
            self._advance(source)
        # losers[n] is the source that lost at inner node n; losers[0] is the winner of all.
        count = len(sources)
        self.losers = [-1] * max(count, 1)
        winners = [-1] * count + list(range(count))
        for node in range(count - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.losers[0] = winners[1] if count > 1 else (0 if count else -1)

    def _advance(self, source: int) -> None:
        self.heads[source] = head = next(self.sources[source], None)
        self.keys[source] = None if head is None else self.key(head)

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None
        return (self.keys[a], a) < (self.keys[b], b)

    def __iter__(self) -> Iterator:
        winner = self.losers[0]
        while winner >= 0 and self.keys[winner] is not None:
            yield self.heads[winner]
            self._advance(winner)
            node = (winner + len(self.sources)) // 2
            while node >= 1:
                if self._before(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2


def write_run(entries: Iterator[dict], path: str) -> int:
    """Write sorted entries as parquet, batch by batch; returns their number."""
    system, place = file_system(path)
    total, batch = 0, []
    with system.open_output_stream(place) as out, pq.ParquetWriter(out, ENTRY) as writer:
        for entry in entries:
            batch.append(entry)
            if len(batch) == BATCH:
                writer.write_table(pa.Table.from_pylist(batch, ENTRY))
                total, batch = total + len(batch), []
        writer.write_table(pa.Table.from_pylist(batch, ENTRY))
    return total + len(batch)


def read_run(path: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[dict]:
    """The entries of a run from ``low`` on and before ``high``, in order, batch by batch."""
    system, place = file_system(path)
    with system.open_input_file(place) as source:
        run = pq.ParquetFile(source)
        for group in range(run.num_row_groups):
            stats = run.metadata.row_group(group).column(0).statistics
            if stats is not None and stats.has_min_max:
                if (low and stats.max < low[0]) or (high and stats.min > high[0]):
                    continue
            for batch in run.iter_batches(BATCH, row_groups=[group]):
                for entry in batch.to_pylist():
                    key = sort_key(entry)
                    if high and key >= high:
                        return
                    if not low or key >= low:
                        yield entry


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
                   payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages into archives below ``folder``; returns the written ``archive`` paths."""
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page"), F.col(f"`{url}`").alias("url"),
        whole_text(F.col(f"`{payload}`")).alias("payload"),
    ).withColumn("digest", F.sha1(F.encode("payload", "utf-8")))
    firsts = rows.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = broadcast_if_small(stage_table(firsts.select("digest", "first"), "warc-firsts"))
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    date = F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page", F.lit(0)), F.lit(10 ** 9)))
    # Numbers travel as text, since a column of numbers and nulls would turn into floats.
    rows = rows.join(firsts, "digest", "left").select(
        F.col("page").cast("string").alias("page"), "url", "payload",
        F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.when(revisit, F.col("first").cast("string")).alias("refers"),
    )

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        out, name, size = None, "", 0
        written: list[str] = []
        try:
            for frame in frames:
                for page, address, content, day, refers in frame[["page", "url", "payload", "date", "refers"]] \
                        .itertuples(index=False):
                    if out is None or size >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                        written.append(f"{folder}/{name}")
                    record = gzip.compress(warc_record(
                        None if page is None else int(page), address, day, content.encode(),
                        None if refers is None else int(refers), refers is not None,
                    ), compresslevel=6, mtime=0)
                    out.write(record)
                    size += len(record)
        finally:
            if out is not None:
                out.close()
        yield pd.DataFrame({"archive": written}, dtype=object)

    return stage_table(rows.mapInPandas(write, "archive string"), "warc-archives")


def index_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Read archives back and write a sorted run for each; returns ``run``, ``rows`` and ``samples``."""
    count = archives.count()
    if not count:
        return archives.sparkSession.createDataFrame([], f"run string, rows long, samples array<struct<{SAMPLE_SQL}>>")
    keep = max(1, SAMPLES // count)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["archive"]:
                system, place = file_system(archive)
                with system.open_input_stream(place, compression=None) as stream:
                    found = (index_entry(record, archive, offset, length) for offset, length, record in gzip_members(stream))
                    first = True
                    # An archive of very many small records gives several runs.
                    while (entries := list(islice(found, RUN_ROWS))) or first:
                        first = False
                        entries.sort(key=sort_key)
                        run = f"{folder}/{uuid.uuid4().hex}.run.parquet"
                        step = max(1, -(-len(entries) // keep))
                        sample = [{name: entry[name] for name in SAMPLE_FIELDS} for entry in entries[step // 2::step]]
                        yield pd.DataFrame({
                            "run": [run], "rows": [write_run(iter(entries), run)], "samples": [sample],
                        }).astype({"run": object})

    # An archive is one row and much work, so archives are dealt out one to a task.
    dealt = archives.repartition(count, "archive")
    return stage_table(
        dealt.mapInPandas(read, f"run string, rows long, samples array<struct<{SAMPLE_SQL}>>"), "warc-runs"
    )


def _narrowed(spark: SparkSession, paths: list[str], bounds: list[tuple], prefix: str) -> list[str]:
    """Merge every ``FAN_IN`` runs into one of a file per key range; a task merges one range of one group.

    Files are named by group and range, so a task that is run again writes its own file again.
    """
    groups = [(number, paths[at:at + FAN_IN]) for number, at in enumerate(range(0, len(paths), FAN_IN))]
    parts = spark.createDataFrame(groups, "number int, runs array<string>").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(len(bounds) - 1)))
    )

    def narrow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, runs, part in zip(frame["number"], frame["runs"], frame["part"]):
                low, high = bounds[part]
                sources = [read_run(path.replace(PART, str(part)), low, high) for path in runs]
                rows = write_run(iter(LoserTree(sources, sort_key)), f"{prefix}-{number}-{part}.run.parquet")
                yield pd.DataFrame({"number": [number], "part": [part], "rows": [rows]})

    merged = parts.repartition(len(groups) * len(bounds), "number", "part").mapInPandas(narrow, "number int, part int, rows long")
    stage_table(merged, "warc-merged")
    return [f"{prefix}-{number}-{PART}.run.parquet" for number, _ in groups]


def merged_captures(runs: DataFrame, folder: str) -> DataFrame:
    """All index entries in global order: by ``index_range``, then ``index_place``."""
    spark = runs.sparkSession
    paths = [row["run"] for row in runs.select("run").orderBy("run").collect()]  # one per archive
    rows = runs.agg(F.sum("rows").alias("rows")).first()["rows"] or 0
    samples = sorted(
        (sort_key(row.asDict()) for row in runs.select(F.inline("samples")).collect())
    ) if rows else []
    ranges = max(1, -(-rows // RANGE_ROWS), min(spark.sparkContext.defaultParallelism, len(samples) // 64))
    cuts = sorted({samples[len(samples) * part // ranges] for part in range(1, ranges)})
    bounds = list(zip([None, *cuts], [*cuts, None]))
    rounds = 0
    while len(paths) > FAN_IN:
        paths = _narrowed(spark, paths, bounds, f"{folder}/merged-{rounds}")
        rounds += 1

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in frame["part"]:
                low, high = bounds[part]
                place, batch = 0, []
                for entry in LoserTree([read_run(path.replace(PART, str(part)), low, high) for path in paths], sort_key):
                    batch.append(entry)
                    if len(batch) == BATCH:
                        yield output(batch, part, place)
                        place, batch = place + len(batch), []
                if batch:
                    yield output(batch, part, place)

    def output(batch: list[dict], part: int, place: int) -> pd.DataFrame:
        frame = pd.DataFrame(batch)
        for name in ("page_id", "refers_to"):
            frame[name] = pd.array([entry[name] for entry in batch], dtype="Int64")
        frame = frame.astype({name: object for name in frame.columns if frame[name].dtype == "str"})
        return frame.assign(index_range=part, index_place=range(place, place + len(batch)))

    parts = spark.range(len(bounds), numPartitions=len(bounds)).select(F.col("id").cast("int").alias("part"))
    return parts.mapInPandas(merge, f"{ENTRY_SQL}, index_range int, index_place long")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages as archives, read them back, and return the merged capture index."""
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/hookloom/warc-{uuid.uuid4().hex}"
    runs = index_archives(write_archives(pages, folder), folder)
    return merged_captures(runs, folder)


def warc_report(pages: DataFrame) -> DataFrame:
    """Every page as the archives hold it."""
    return archive_pages(pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at",
        "index_range", "index_place",
    )
