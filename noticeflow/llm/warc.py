"""WARC archives: a writer, and a reader that gives a chunked record table.

The reader turns each archive into rows (record, chunk number): a record of any
size passes through in pieces, each with the digest of the payload so far, so no
task holds a whole record.  The last chunk of a record carries its full digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.shared import IdFilter, Scratch, give_back, shuffle_parts, spread_join

CHUNK = 256 * 1024
#: Record ids are UUIDs whose low half is the page id.
_SPACE = 0x6E6F7469636570672E7761726300 & (2**64 - 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int) -> str:
    import uuid

    return f"<urn:uuid:{uuid.UUID(int=(_SPACE << 64) | (page_id & (2**64 - 1)))}>"


def page_of(urn: str | None) -> int | None:
    import uuid

    if not urn:
        return None
    whole = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    low = whole & (2**64 - 1)
    return (low - 2**64 if low >= 2**63 else low) if whole >> 64 == _SPACE else None


def _head(fields) -> bytes:
    lines = [f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in fields if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def write_record(out, page_id, url, payload, refers_to, digest: str) -> None:
    """Append one record as a gzip member of its own; the payload is compressed piece by piece."""
    import uuid
    import zlib

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = memoryview(b"" if refers_to is not None else payload)
    own = record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}>"
    head = _head([
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", "2001-08-01T12:00:00Z"),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if refers_to is not None else None), ("WARC-Refers-To", record_id(refers_to) if refers_to is not None else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + len(body)),
    ])
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    out.write(squeeze.compress(head + http))
    for at in range(0, len(body), CHUNK):
        out.write(squeeze.compress(body[at : at + CHUNK]))
    out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())


def base32_sha1(payload) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_revisits(pages: DataFrame, scratch: Scratch, least: int, id_col: str, html_col: str) -> DataFrame:
    """(page_id, sha1, refers_to) of the records that revisit another's payload of at least `least` bytes."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    digests = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(payload).alias("sha1"), F.length(payload).cast("long").alias("bytes"))
    digests = scratch.save(digests.where(F.col("bytes") >= least), "digests")
    groups = digests.groupBy("sha1", "bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n", "bytes")
    again = spread_join(digests, groups, "sha1").where("page_id <> refers_to")
    return scratch.save(again.select("page_id", "sha1", "refers_to").distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one archive per partition below `folder`; returns (path, records, bytes).

    The payload is the html in UTF-8 (null: empty).  Of equal payloads of at
    least `least` bytes the smallest page_id is the response and the others are
    revisits of it; a null page_id is always a response; a page_id with several
    payloads is judged for each, and rows that repeat a page_id and its payload
    are written like that page each.  An archive gets its name only when it is
    complete, so that a task that runs again replaces what a lost one left.  An
    empty table gives no archives; other columns are not read.

    Payloads are written where they are read: a bounded filter tells the rows
    that are surely no revisits, and only the others meet the list of revisits.
    """
    import pyarrow.fs as pafs

    scratch = Scratch(pages.sparkSession, "warc-plan")
    revisits = plan_revisits(pages, scratch, least, id_col, html_col)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    rows = rows.withColumn("key", F.xxhash64("page_id", "sha1"))
    maybe, sure = IdFilter(revisits.select(F.xxhash64("page_id", "sha1").alias("key")), scratch, "revisit-filter").split(rows, "key")
    rows = sure.withColumn("refers_to", F.lit(None).cast("long")).unionByName(maybe.join(revisits, ["page_id", "sha1"], "left").select(*rows.columns, "refers_to"))
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)

    def work(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        part, n, out = f"{name}.{uuid.uuid4().hex}.part", 0, None
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns))):
                out = out or files.open_output_stream(part, compression=None)
                body = payload.as_buffer()
                write_record(out, page_id, url, body, refers_to, base32_sha1(body))
                n += 1
        if out:
            out.close()
            files.move(part, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [files.get_file_info(name).size]})
        give_back()

    done = scratch.save(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(work, "path string, records long, bytes long"), "archives")
    return done


def _records(stream):
    """(header fields, content length) of each record; the caller reads the content before it goes on."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[key.strip().lower()] = value.strip()
        yield fields, int(fields["content-length"])


def read_chunks(archives: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of archives (column path; gzip or plain).

    One row per chunk of a payload, and one with an empty chunk for a record
    without payload: record_id, chunk_no, record_type, url, refers_to, data,
    offset, payload_bytes and payload_digest so far, is_last, full_bytes and
    full_digest as the record states them.  `http` heads are taken off.
    """

    def work(batches):
        import base64
        import gzip
        import hashlib

        import pyarrow as pa
        import pyarrow.fs as pafs

        files, _ = pafs.FileSystem.from_uri(folder)
        names = ["record_id", "chunk_no", "record_type", "url", "refers_to", "data", "offset", "payload_bytes", "payload_digest", "is_last", "full_bytes", "full_digest"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                raw = files.open_input_stream(path, compression=None, buffer_size=1 << 20)
                stream = gzip.open(raw, "rb") if path.endswith(".gz") else raw
                for fields, length in _records(stream):
                    stated = None
                    if fields.get("content-type", "").startswith("application/http"):
                        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                            length -= len(line)
                            if line.lower().startswith(b"content-length:"):
                                stated = int(line.split(b":")[1])
                        length -= len(line)
                    sha, no, offset = hashlib.sha1(), 0, 0
                    while no == 0 or length > 0:
                        data = stream.read(min(chunk, length)) if length else b""
                        if length and not data:
                            raise ValueError(f"{path} ends inside a record")
                        length -= len(data)
                        sha.update(data)
                        rows.append((
                            fields.get("warc-record-id"), no, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), data, offset,
                            offset + len(data), base64.b32encode(sha.copy().digest()).decode(), length == 0, stated, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        ))
                        no, offset, held = no + 1, offset + len(data), held + len(data)
                        if held >= 4 << 20 or len(rows) >= 2000:
                            yield flush()
                            rows, held = [], 0
                stream.close()
        if rows:
            yield flush()
        give_back()

    schema = (
        "record_id string, chunk_no long, record_type string, url string, refers_to string, data binary, offset long, payload_bytes long, "
        "payload_digest string, is_last boolean, full_bytes long, full_digest string"
    )
    return archives.select("path").mapInArrow(work, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write archives of all pages, read them back and give one row per record.

    A response's bytes and digest are those of the chunks read back (a stated
    digest that differs is an error); a revisit's are those its record states.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.path("archives")
    archives = write_archives(pages, folder, least)
    spread = archives.repartition(shuffle_parts(pages.sparkSession), "path")
    last = read_chunks(spread, folder).where("is_last")
    revisit = F.col("record_type") == "revisit"
    sound = revisit | (F.col("payload_digest") == F.col("full_digest"))
    return last.select(
        _page("record_id").alias("page_id"),
        F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(~sound, F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))))
        .when(revisit, F.col("full_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        _page("refers_to").alias("refers_to"),
    )


def _page(column: str):
    """The page id in a record id's low half (null for other ids), without Python."""
    plain = F.regexp_replace(F.regexp_extract(column, r"urn:uuid:([0-9a-f-]{36})>", 1), "-", "")
    ours = F.left(plain, F.lit(16)) == F.lit(f"{_SPACE:016x}")
    low = F.expr(f"conv(right(regexp_replace(regexp_extract({column}, 'urn:uuid:([0-9a-f-]{{36}})>', 1), '-', ''), 16), 16, -10)")
    return F.when(ours, low.cast("long"))
