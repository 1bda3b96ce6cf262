"""WARC archives with an index written first, read back by coalesced byte ranges.

``write_archives`` gives every page a record in a ``.warc.gz`` file (one member of gzip for each record, so a record can be
read alone): a response with the payload, or, if an equal payload belongs to a record with a smaller page_id, a
revisit that refers to it. Each task writes one file in the shared folder and returns an index row for each record:
file, offset, length, URL, digest. The index is stored as a table before anything reads an archive. Files of lost or
repeated attempts have names of their own, which no stored index row mentions.

``read_archives`` takes index rows (all, or any selection), sorts them by file and offset, coalesces neighbouring ranges to one
read of bounded size and parses the records.

Defined results: a null payload is empty, a null URL is the empty URL. Every row has a record, and of the records with equal
payloads exactly one is the response: that with the smallest page_id, then the smallest URL; rows that are equal in all three
count as one response and revisits of it. page_id may have any type with an order; it is written as text and read back by its
type. A null page_id is larger than any other. An empty table makes an empty index. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import n_partitions, prepare, scratch_path, stored

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 0
#: A coalesced read takes ranges with at most GAP bytes between them, up to READ bytes (or one record).
GAP, READ = 16 << 10, 4 << 20
LEVEL = 1
#: Ids are text here; ``typed`` gives them their type back.
INDEX = "file string, offset long, length long, page_id string, url string, payload_digest string, payload_bytes long, record_type string, refers_to string"
RECORDS = "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """Header values are one line: what would end it is percent-encoded, and so is the percent sign."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _page(page_id: str | None) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{_line(page_id)}>"


def _unpage(value: str | None) -> str | None:
    return None if value is None or value == "<urn:page>" else _unline(value[10:-1])


def record(page_id: str | None, url: str, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """One record in WARC/1.1; a revisit has no block, its headers tell the full payload's size and digest."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_page(page_id)}",
        f"WARC-Target-URI: {_line(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_page(refers_to)}"]
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one uncompressed record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return headers, rest[:size]


def _writer(root: str):
    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(root)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(5)]
            rows = []
            for page_id, url, html, refers_to, revisit in zip(*cols, strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                digest = base32_digest(payload)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, payload, digest, refers_to, revisit)) + packer.flush()
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(member)
                rows.append((name, offset, len(member), page_id, url, digest, len(payload), "revisit" if revisit else "response", refers_to))
                offset += len(member)
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if out is not None:
            out.close()

    return run


def with_references(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to, revisit): refers_to is the response's page_id for revisits, else null.

    Equal payloads meet by digest in a join, whose skewed partitions Spark splits; the smallest page_id comes from a
    pre-aggregated grouping.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Rows equal in all three are told apart by counting: one of each stays, its n - 1 repetitions are further revisits.
    same = ["page_id", "url", "digest"]
    repeats = stored(rows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1"), "warc-repeats")
    more = None
    if not repeats.isEmpty():
        rows = stored(rows.dropDuplicates(same), "warc-distinct")
        met = F.col("d.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("d.url") == F.col("r.url")) & (F.col("d.digest") == F.col("r.digest"))
        more = rows.alias("d").join(repeats.alias("r"), met).select("d.*", F.explode(F.sequence(F.lit(2), F.col("r.n"))).alias("k")).drop("k")
    # The response has the smallest page_id and, of the rows with it, the smallest URL.
    first = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count("*").alias("n")
    )
    shared = first if more is not None else first.where("n > 1")
    shared = shared.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("first_url"))

    def told(part: DataFrame, own) -> DataFrame:
        revisit = F.col("first_url").isNotNull() & ~own
        return part.join(shared, "digest", "left").select("page_id", "url", "html", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))

    out = told(rows, F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.col("url") == F.col("first_url")))
    return out if more is None else out.unionByName(told(more, F.lit(False)))


def typed(records: DataFrame, like: DataFrame) -> DataFrame:
    """Records or index rows with the ids in the type that ``like`` has."""
    kind = like.schema["page_id"].dataType
    return records.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def write_archives(pages: DataFrame, root: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> tuple[DataFrame, str]:
    """Write all pages; returns the stored index and the archives' folder."""
    spark = pages.sparkSession
    prepare(spark)
    root = root or scratch_path(spark, "warc")
    rows = with_references(pages, min_bytes)
    rows = rows.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"), "revisit")
    return typed(stored(rows.mapInArrow(_writer(_uri(root)), INDEX), "warc-index"), pages), root


def _uri(root: str) -> str:
    return root if "://" in root else f"file://{root}" if root.startswith("/") else root


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int, int]]:
    """Sorted (offset, length) ranges as reads (first, past the last range, start, end)."""
    out: list[list[int]] = []
    for k, (offset, length) in enumerate(ranges):
        if out and offset - out[-1][3] <= gap and max(offset + length, out[-1][3]) - out[-1][2] <= most:
            out[-1][1], out[-1][3] = k + 1, max(out[-1][3], offset + length)
        else:
            out.append([k, k + 1, offset, offset + length])
    return [tuple(x) for x in out]


def _reader(root: str):
    def rows_of(store, path, name, ranges):
        with store.open_input_file(f"{path}/{name}") as f:
            for first, past, start, end in coalesced(ranges):
                block = f.read_at(end - start, start)
                for offset, length in ranges[first:past]:
                    headers, body = parse(zlib.decompress(block[offset - start : offset - start + length], 31))
                    kind = headers["warc-type"]
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base32_digest(body) != digest:
                        raise ValueError(f"record at {offset} of {name} has another digest than its header")
                    yield (
                        _unpage(headers["warc-record-id"]), _unline(headers["warc-target-uri"]), kind, digest,
                        int(headers["warc-payload-length"]), _unpage(headers.get("warc-refers-to")), body if kind == "response" else None,
                    )

    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(root)
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for b in batches:
            files, offsets, lengths = (b.column(k).to_pylist() for k in range(3))
            start = 0
            while start < len(files):
                end = start
                while end < len(files) and files[end] == files[start]:
                    end += 1
                got, held = [], 0
                for row in rows_of(store, path, files[start], list(zip(offsets[start:end], lengths[start:end], strict=True))):
                    got.append(row)
                    held += len(row[-1] or b"")
                    if held > 8 * READ:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names)
                        got, held = [], 0
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names)
                start = end

    return run


def read_archives(index: DataFrame, root: str) -> DataFrame:
    """The records of all rows of ``index``, read by coalesced ranges, with payloads (null for revisits)."""
    spark = index.sparkSession
    prepare(spark)
    ranges = index.select("file", "offset", "length").repartitionByRange(n_partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")
    return typed(ranges.mapInArrow(_reader(_uri(root)), RECORDS), index)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, read every record back; the contract's columns as the archives tell them."""
    index, root = write_archives(pages)
    return read_archives(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
