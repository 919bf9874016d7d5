"""WARC archives: one gzip member per record, written and read sequentially.

A record of a page holds an HTTP response whose body is the payload.  Of
records with equal payloads one is the response; the others are revisit
records, which hold the HTTP header alone and refer to it.  The reader
decompresses member by member as bytes arrive, frames blocks by their content
length, and verifies the block digest of every record and the payload digest
of every response.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.arrow import map_arrow
from siftline.llm.storage import Store, shared_folder, written

CHUNK = 1 << 18
#: An archive that has grown to so many bytes is closed and the next begun.
ROLL = 256 << 20
DATE = "2000-01-01T00:00:00Z"
#: Payloads with copies that are broadcast at most.
KEEPERS = 400_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id) -> str:
    return f"<urn:siftline:page:{'' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    """The page of an id that page_urn gives; null for any other id."""
    inner = urn.removeprefix("<urn:siftline:page:").removesuffix(">")
    return int(inner) if re.fullmatch(r"-?\d+", inner) else None


def record(page_id, url, payload: bytes, refers_to=None, *, revisit: bool = False, level: int = 6) -> bytes:
    """A whole record as one gzip member; a revisit leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(file) -> Iterator[bytes]:
    """The gzip members of a stream, each decompressed as its bytes arrive."""
    unpack, out, fresh = zlib.decompressobj(31), [], True
    raw = file.read(CHUNK)
    while raw:
        out.append(unpack.decompress(raw))
        fresh = False
        if unpack.eof:
            raw = unpack.unused_data
            yield b"".join(out)
            unpack, out, fresh = zlib.decompressobj(31), [], True
            raw = raw or file.read(CHUNK)
        else:
            raw = file.read(CHUNK)
    if not fresh:
        raise ValueError("the archive ends within a record")


def fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def checked(stated: str | None, *forms: bytes) -> None:
    """Raise unless a stated SHA-1 (base32 or hex) is that of one of the forms; other algorithms are not checked."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() in ("sha1", "sha-1") and value:
        sums = {x for form in forms for x in (digest(form), hashlib.sha1(form).hexdigest().upper())}
        if value.upper() not in sums:
            raise ValueError("a record doesn't have its digest")


def joined_chunks(body: bytes) -> bytes:
    """The body of a chunked transfer without its chunk headers; one that isn't framed as such comes back as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return body
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return body
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def read_records(file) -> Iterator[dict]:
    """The pages of an archive: record_id, page_id, url, type, payload (None in a revisit), payload_bytes, payload_digest, refers_to.

    Yields records of type response and revisit that hold an HTTP message;
    all others (warcinfo, request, metadata, resource, ...) are framed,
    checked and passed over.  A payload is the body, without the framing of a
    chunked transfer.  A missing block or payload digest is not checked, a
    missing payload digest or HTTP length is taken from the payload; a revisit
    without them has null there.  page_id and refers_to are null for ids that
    ``record`` did not give.  A frame, a length or a stated digest that doesn't
    hold raises ValueError.
    """
    for raw in members(file):
        end = raw.find(b"\r\n\r\n")
        if end < 0 or not raw.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = fields(raw[:end].decode("utf-8", "replace").split("\r\n")[1:])
        try:
            size = int(head["content-length"])
        except (KeyError, ValueError):
            raise ValueError("a record has no content length") from None
        block = raw[end + 4 : end + 4 + size]
        if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
            raise ValueError("a block doesn't have its content length")
        checked(head.get("warc-block-digest"), block)
        kind = head.get("warc-type", "").lower()
        if kind not in ("response", "revisit") or not (kind == "revisit" or block.startswith(b"HTTP/")):
            continue
        cut = block.find(b"\r\n\r\n")
        cut = len(block) if cut < 0 else cut
        http = fields(block[:cut].decode("utf-8", "replace").split("\r\n")[1:])
        length = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        stated, payload = head.get("warc-payload-digest"), None
        if kind == "response":
            body = block[cut + 4 :]
            payload = joined_chunks(body) if "chunked" in http.get("transfer-encoding", "").lower() else body
            checked(stated, payload, body)
            if payload is body and length not in (None, len(payload)):
                raise ValueError("a payload doesn't have its length")
            length = len(payload)
        sha1 = stated.partition(":")[2] if stated and stated.lower().startswith("sha1:") else digest(payload) if payload is not None else None
        yield {
            "record_id": head.get("warc-record-id"),
            "page_id": page_of(head.get("warc-record-id", "")),
            "url": head.get("warc-target-uri"),
            "type": kind,
            "payload": payload,
            "payload_bytes": length,
            "payload_digest": sha1,
            "refers_to": page_of(head.get("warc-refers-to", "")) if kind == "revisit" else None,
        }


def keepers(df: DataFrame, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, refers_to, revisit for every row.

    Of equal payloads of at least ``min_bytes`` bytes the row with the largest
    id stays (rows that repeat that id all do); others refer to it.  A null
    payload is empty; a null id is below all others; if all ids of equal
    payloads are null, all stay.  Payloads are matched by SHA-1 and length;
    what is gathered by them is one number each, combined before the shuffle.
    """
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"_sha": F.sha1("html"), "_size": F.octet_length("html")})
    keep = written(rows.groupBy("_sha", "_size").agg(F.max("page_id").alias("_keeper"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "keepers")
    copies = keep.count()
    if copies <= KEEPERS:  # some 60 bytes each
        joined = rows.join(F.broadcast(keep.drop("_n")), ["_sha", "_size"], "left")
    else:  # payloads that many rows have, of which there are few, never meet in one task
        large = keep.orderBy(F.desc("_n"), "_sha").limit(KEEPERS // 4).select("_sha", "_size", "_keeper")
        large = written(large, "keepers")
        rest = keep.drop("_n").join(large.select("_sha", "_size"), ["_sha", "_size"], "left_anti")
        few = rows.join(F.broadcast(large.drop("_keeper")), ["_sha", "_size"], "left_anti").join(rest, ["_sha", "_size"], "left")
        joined = rows.join(F.broadcast(large), ["_sha", "_size"]).unionByName(few)
    revisit = F.expr(f"_keeper IS NOT NULL AND _size >= {min_bytes} AND NOT (page_id <=> _keeper)")
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("_keeper")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(df: DataFrame, folder: str, **options) -> DataFrame:
    """Write a record for every row of ``df``; returns the archives' names and numbers of records.

    Each task writes archives of its own, under names that follow from its
    partition; a task that is run again replaces them by the same.  An empty
    table writes none.
    """

    def run(batches):
        store, part, k = Store(folder), TaskContext.get().partitionId(), 0
        batches = ((b, i) for b in batches for i in range(b.num_rows))
        row = next(batches, None)
        while row is not None:
            name, n, size = f"pages-{part:06d}-{k:04d}.warc.gz", 0, 0
            with store.create(name) as out:
                while row is not None and size < ROLL:
                    b, i = row
                    page, url, html, refers, revisit = (b.column(c)[i].as_py() for c in range(5))
                    raw = record(page, url, html.encode(), refers, revisit=revisit)
                    out.write(raw)
                    n, size = n + 1, size + len(raw)
                    row = next(batches, None)
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "n"])

    return map_arrow(keepers(df, **options), run, "name string, n long")


def read_archives(names: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def rows(store, name):
        with store.open(name) as file:
            block = []
            for r in read_records(file):
                block.append((r["page_id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"]))
                if len(block) == 5000:
                    yield block
                    block = []
            yield block

    def run(batches):
        store = Store(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                for block in rows(store, name):
                    columns = list(zip(*block, strict=True)) or [()] * 5
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(names.select("name").repartition(n, "name"), run, schema)


def archive_digests(df: DataFrame, **options) -> DataFrame:
    """Write the pages to archives in a new shared folder and read those back.

    page_id, payload_bytes, payload_digest, record_type, refers_to of every
    row of ``df``.  A null html is an empty payload; rows that repeat the id of
    a response are responses too; a null id is below all others; an empty table
    gives no rows.  Columns other than id, url and html are not read.
    """
    folder = shared_folder(df.sparkSession, "warc")
    return read_archives(written(write_archives(df, folder, **options), "warc-names"), folder)
