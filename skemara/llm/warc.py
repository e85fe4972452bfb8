"""WARC files: writing with revisits, and reading by boundary-chain verification.

A reader's task takes a range of bytes. It cannot know which "WARC/1.1" in its
range begins a record and which lies in a payload, so it emits each candidate
with its successor, the offset that the candidate's own header leads to.
Candidates of a range are followed at once to the first offset beyond it; the
ranges are then chained by pointer jumping from the start of each file, and
only what is reached from there is read as records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.llm.shared import arrow_rows, checked_broadcast, scratch_dir, stage_table

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Payloads of fewer bytes are written again rather than referred to.
MIN_REVISIT = 100
#: Bytes of a reading task's range, and of a read within a payload or a long header.
RANGE, STEP = 8 << 20, 1 << 20
#: Ranges that a task reads at most.
RANGES = 64
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = re.compile(rb"[A-Za-z0-9-]+:")
FIELD = re.compile(rb"^([A-Za-z0-9-]+):[ \t]*(.*?)[ \t]*$", re.M)


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record: a response, or a revisit of page `first` without its payload."""
    body = payload if first is None else b""
    lines = [f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return MAGIC + "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + body + END


def header_fields(head: bytes) -> dict[str, str] | None:
    """The fields of a record's header block, None if it is none with a length."""
    fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in FIELD.findall(head.replace(b"\r\n", b"\n"))}
    return fields if fields.get("content-length", "").isascii() and fields.get("content-length", "").isdigit() else None


FILES = "file int, uri string, size long, records long"


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of `pages` into the files of `folder`; returns a row per file.

    Of rows whose payloads (UTF-8, null as empty) are equal and have MIN_REVISIT
    bytes, that with the smallest id is a response and the others refer to it.
    Rows without an id are always responses; rows that share the smallest id too. Equal
    payloads are found by digest over (id, digest) alone. Texts, URLs and so
    headers have any length; a null URL has no field; an empty table gives no
    file; other columns are ignored, whatever their names.

    A file's name has the task's attempt, so an attempt that runs again or
    beside another never meets its file. What counts is the returned table,
    which has the attempts that Spark committed. `folder` is shared by all executors.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    rows = rows.withColumn("_digest", F.sha2(F.col("_html").cast("binary"), 256))
    light = rows.filter((F.octet_length("_html") >= MIN_REVISIT) & F.col("_id").isNotNull()).select("_id", "_digest")
    firsts = light.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_digest", "_first")
    again = light.join(firsts, "_digest").filter("_id <> _first").distinct()
    # Where a count shows that few pages are repeats, the payloads are not shuffled at all.
    rows = rows.join(checked_broadcast(stage_table(again, "repeats")), ["_id", "_digest"], "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        uri = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc"
        fs, path = pafs.FileSystem.from_uri(uri)
        out, size, count = None, 0, 0
        for batch in batches:
            for page, url, html, digest, first in batch.itertuples(index=False, name=None):
                out = out or fs.open_output_stream(path)
                page, first = (None if x is None or pd.isna(x) else int(x) for x in (page, first))
                data = record(page, None if pd.isna(url) else url, html.encode(), digest, first)
                out.write(data)
                size, count = size + len(data), count + 1
        if out:
            out.close()
            yield pd.DataFrame({"file": [context.partitionId()], "uri": [uri], "size": [size], "records": [count]})

    with arrow_rows(pages.sparkSession, 256):
        ordered = rows.sortWithinPartitions("_id").select(F.col("_id").cast("string").alias("_id"), "_url", "_html", "_digest", F.col("_first").cast("string").alias("_first"))
        return stage_table(ordered.mapInPandas(write, FILES), "warc-files")


def header_end(f, size: int, at: int) -> int:
    """Offset of the first END from `at` on, -1 if there is none in the file."""
    for low in range(at, size, STEP):
        if (end := f.read_at(min(STEP + len(END) - 1, size - low), low).find(END)) >= 0:
            return low + end
    return -1


def candidates(uri: str, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in [low, high) where a header with a length begins, and their successors, within the file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    offsets, after = [], []
    with fs.open_input_file(path) as f:
        data = f.read_at(min(size, high + len(MAGIC)) - low, low)
        at, end = data.find(MAGIC), -1
        while 0 <= at < high - low:
            first = data[at + len(MAGIC) : at + len(MAGIC) + 64]
            if len(first) == 64 and not NAME.match(first):  # no field follows
                at = data.find(MAGIC, at + 1)
                continue
            if end < at and (end := data.find(END, at)) < 0:  # the header goes on beyond the range
                beyond = header_end(f, size, max(low + at, low + len(data) - len(END) + 1))
                if beyond < 0:
                    break
                if beyond > low + len(data):
                    data += f.read_at(beyond - low - len(data), low + len(data))
                end = beyond - low
            fields = header_fields(data[at:end])
            if fields and (follower := low + end + 8 + int(fields["content-length"])) <= size:
                offsets.append(low + at)
                after.append(follower)
            at = data.find(MAGIC, at + 1)
    return np.array(offsets, np.int64), np.array(after, np.int64)


def follow(offsets: np.ndarray, after: np.ndarray, high: int) -> np.ndarray:
    """For each candidate of a range, the first offset from `high` on that its chain reaches; -1 if the chain breaks off. By pointer jumping."""
    spot = np.searchsorted(offsets, after)
    inside = after < high
    known = inside & (spot < len(offsets)) & (offsets[np.minimum(spot, max(0, len(offsets) - 1))] == after)
    at = np.where(known, spot, np.arange(len(offsets)))
    while True:
        jumped = at[at]
        if (jumped == at).all():
            break
        at = jumped
    return np.where(inside[at], -1, after[at])


def spread(ranges: DataFrame, files: DataFrame, width: int) -> DataFrame:
    """`ranges` dealt to an explicit number of tasks, as rows this small would all go to one: a task per range up to the number of shuffle partitions, then RANGES of them to a task at most."""
    total = files.agg(F.sum(F.ceil(F.col("size") / width))).first()[0] or 1
    tasks = min(total, max(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGES)))
    return ranges.repartition(max(1, int(tasks)), "file", "low")


def boundaries(spark: SparkSession, files: DataFrame, width: int = RANGE) -> DataFrame:
    """(file, uri, size, low, high, entry): the ranges in which a true record begins, and the first one's offset."""
    ranges = files.select("file", "uri", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(width).cast("long"))).alias("low")).withColumn("high", F.least(F.col("low") + width, "size"))
    ranges = stage_table(ranges, "ranges")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, uri, size, low, high in batch.itertuples(index=False, name=None):
                at, after = candidates(uri, size, low, high)
                yield pd.DataFrame({"file": np.full(len(at), file, np.int32), "at": at, "next": follow(at, after, high), "size": size})

    jumps = stage_table(spread(ranges, files, width).mapInPandas(scan, "file int, at long, next long, size long").filter("next >= 0"), "candidates")
    reached = jumps.filter("at = 0").select("file", "at")
    # Only offsets that some chain leads to, or a file's start, can be entries.
    entries = jumps.select("file", F.col("next").alias("at")).unionByName(reached).distinct()
    jumps = stage_table(jumps.filter("next < size").select("file", "at", "next").join(entries, ["file", "at"], "left_semi"), "jumps")
    reached, known = stage_table(reached, "reached"), -1
    while (count := reached.count()) > known:
        known = count
        step = reached.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = stage_table(reached.unionByName(step).distinct(), "reached")
        onward = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        jumps = stage_table(jumps.join(onward, ["file", "next"]).select("file", "at", F.col("then").alias("next")), "jumps")
    entry = reached.withColumn("low", F.col("at") - F.pmod("at", F.lit(width))).select("file", "low", F.col("at").alias("entry"))
    return spread(ranges.join(entry, ["file", "low"]), files, width)


RECORDS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, intact boolean"


def read_warc(spark: SparkSession, files: DataFrame, width: int = RANGE) -> DataFrame:
    """The true records of the files: ids, payload size and digest, type, the page a revisit refers to, and whether a response's payload has its digest.

    Fails if a file yields another number of records than its row in `files` states; null states none.
    A task reads some ranges of RANGE bytes, payloads and long headers in steps of STEP bytes.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                fs, path = pafs.FileSystem.from_uri(r.uri)
                rows, at = [], int(r.entry)
                with fs.open_input_file(path) as f:
                    while at < r.high:
                        head = f.read_at(min(4096, r.size - at), at)
                        if (end := head.find(END)) < 0:
                            end = header_end(f, r.size, at) - at
                            head = f.read_at(end, at)
                        fields = header_fields(head[:end])
                        start, length = at + end + 4, int(fields["content-length"])
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                        page, first = (m[1] if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(k, ""))) else None for k in ("warc-record-id", "warc-refers-to"))
                        intact = True
                        if fields["warc-type"] == "response":
                            summed = hashlib.sha256()
                            for low in range(0, length, STEP):
                                summed.update(f.read_at(min(STEP, length - low), start + low))
                            intact = summed.hexdigest() == digest
                            digest, size = summed.hexdigest(), length
                        else:
                            size = int(fields["x-payload-length"])
                        rows.append((r.file, page, fields.get("warc-target-uri"), size, digest, fields["warc-type"], first, intact))
                        at = start + length + 4
                yield pd.DataFrame(rows, columns=["file", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])

    found = boundaries(spark, files, width).select("file", "uri", "size", "high", "entry").mapInPandas(parse, "file int, " + RECORDS)
    found = stage_table(found, "records")
    read = found.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    wrong = files.join(read, "file", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("records <> n").select("uri", "records", "n").take(5)
    if wrong:
        raise RuntimeError("records written and read differ: " + ", ".join(f"{r.uri}: {r.records}, {r.n}" for r in wrong))
    return found.drop("file").withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def warc_round_trip(pages: DataFrame, width: int = RANGE) -> DataFrame:
    """Write the archives of `pages` to a scratch folder and read them back."""
    return read_warc(pages.sparkSession, write_warc(pages, scratch_dir(pages.sparkSession, "warc")), width)
