"""WARC archives: written one gzip member per record, read back as a stream.

The reader never seeks and never holds an archive: it inflates a member as bytes arrive,
frames the record by its ``Content-Length`` and checks the digests in its header.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import as_bytes, discard, fresh_path, mapped, split_by_keys, written

CHUNK = 1 << 16
#: A record's header is no longer than this.
HEADER_BYTES = 1 << 20
#: Equal payloads from this size on are stored once.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks its framing or a digest."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, uri: str, page_id, payload: bytes, refers_to=None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that only names it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>" if page_id is None else f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def members(stream) -> Iterator[Iterator[bytes]]:
    """The inflated bytes of each gzip member in turn; a member must be drained before the next."""
    rest = stream.read(CHUNK)
    while rest:
        inflate = zlib.decompressobj(31)
        left = [rest]

        def chunks(inflate=inflate, left=left):
            data = left[0]
            while True:
                out = inflate.decompress(data, CHUNK)
                if out:
                    yield out
                data = inflate.unconsumed_tail
                if inflate.eof:
                    left[0] = inflate.unused_data
                    return
                if not data:
                    data = stream.read(CHUNK)
                    if not data:
                        raise WarcError("an archive ends inside a member")

        yield chunks()
        if not inflate.eof:
            raise WarcError("a member was not read to its end")
        rest = left[0] or stream.read(CHUNK)


class _Framed:
    """A member's bytes, taken up to a mark or by their number; nothing beyond that is inflated but a chunk."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def until(self, mark: bytes) -> bytes:
        looked = 0
        while (at := self.held.find(mark, looked)) < 0:
            looked = max(0, len(self.held) - len(mark) + 1)
            part = next(self.chunks, None)
            if part is None or len(self.held) > HEADER_BYTES:
                raise WarcError("no WARC header")
            self.held += part
        top = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return top

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            part = next(self.chunks, None)
            if part is None:
                raise WarcError("a record's length and its bytes differ")
            self.held += part
        out = bytes(self.held[:size])
        del self.held[:size]
        return out

    def ended(self) -> bool:
        return not self.held and next(self.chunks, None) is None


def _headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return out


def records(stream) -> Iterator[dict]:
    """Headers, HTTP headers and payload of every record; raises ``WarcError`` on a broken one."""
    for chunks in members(stream):
        member = _Framed(chunks)
        top = member.until(b"\r\n\r\n")
        if not top.startswith(b"WARC/1."):
            raise WarcError("no WARC header")
        head = _headers(top)
        block = member.take(int(head["content-length"]))
        if member.take(4) != b"\r\n\r\n" or not member.ended():
            raise WarcError("a record's length and its bytes differ")
        if head.get("warc-block-digest", _digest(block)) != _digest(block):
            raise WarcError("a block's digest differs")
        http, mark, payload = block.partition(b"\r\n\r\n")
        if not mark:
            raise WarcError("no HTTP header")
        fields = _headers(http)
        if head["warc-type"] == "response" and head["warc-payload-digest"] != _digest(payload):
            raise WarcError("a payload's digest differs")
        yield {"head": head, "http": fields, "payload": payload}


def _open(uri: str):
    """A file system and a path in it; any store that pyarrow knows, local folders among them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def _write(folder: str):
    def run(batches):
        store, path = _open(folder)
        store.create_dir(path, recursive=True)
        out, name, n = None, f"{path}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            for row in batch.to_pylist():
                out = out or store.open_output_stream(name, compression=None)
                same = row["keeper"] is None or row["page_id"] == row["keeper"]
                kind = "response" if same else "revisit"
                out.write(record(kind, row["url"] or "", row["page_id"], row["html"], row["keeper"]))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([n], pa.int64())], names=["archive", "n"])

    return run


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def _page(urn: str | None):
    return None if urn is None or not urn.startswith("<urn:page:") else int(urn.removeprefix("<urn:page:").removesuffix(">"))


_ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_FULL = _ROWS + ", payload binary"


def _read(folder: str, payloads: bool):
    def run(batches):
        store, path = _open(folder)
        names = [x.strip() for x in _ROWS.split(",")]
        for batch in batches:
            for archive, expected in zip(batch.column("archive").to_pylist(), batch.column("n").to_pylist(), strict=True):
                rows, seen = [], 0

                def out(rows):
                    cols = [x.split()[0] for x in names]
                    arrays = [pa.array([r[k] for r in rows], pa.string() if " string" in t else pa.int64()) for k, t in zip(cols, names, strict=True)]
                    if payloads:
                        arrays.append(pa.array([r["payload"] for r in rows], pa.binary()))
                    return pa.RecordBatch.from_arrays(arrays, names=cols + ["payload"] * payloads)

                held = 0
                with store.open_input_stream(f"{path}/{archive}", compression=None) as stream:
                    for r in records(stream):
                        head = r["head"]
                        seen += 1
                        rows.append(
                            {
                                "page_id": _page(head["warc-record-id"]),
                                "url": head["warc-target-uri"],
                                "payload_bytes": int(r["http"]["content-length"]),
                                "payload_digest": _hex(head["warc-payload-digest"]),
                                "record_type": head["warc-type"],
                                "refers_to": _page(head.get("warc-refers-to")),
                                "payload": r["payload"] if payloads else None,
                            }
                        )
                        held += len(r["payload"]) if payloads else 0
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                if seen != expected:
                    raise WarcError(f"{archive} has {seen} records, not {expected}")
                if rows:
                    yield out(rows)

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page below ``folder`` and return the archives (``archive, n``), one per task.

    Among equal payloads of at least ``REVISIT_BYTES`` the page with the largest id is the response
    and the others revisit it. Null html is an empty payload. A row without an id gets a record with a name
    of its own: a revisit where a page with an id has its payload, else a response. Rows that repeat an id
    and a payload are each a record. A retried task writes an archive of another name, and only archives of
    tasks that ended are listed. Only pages whose payload comes again are shuffled.
    """
    page = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), as_bytes(html_col).alias("html")
    )
    page = page.withColumn("sum", F.when(F.length("html") >= REVISIT_BYTES, F.sha1("html")))
    keepers = page.where("sum is not null").groupBy("sum").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    keepers = written(keepers.where("n > 1 and keeper is not null").select("sum", "keeper"), "keepers")
    possible, clear = split_by_keys(page, "sum", keepers.select("sum"))
    named = possible.join(keepers, "sum", "left").unionByName(clear.withColumn("keeper", F.lit(None).cast("long")))
    out = written(named.select("page_id", "url", "html", "keeper").transform(mapped, _write(folder), "archive string, n long"), "archives")
    discard(keepers)
    return out


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the listed archives, each archive read once from front to back by one task."""
    return archives.repartition(max(1, archives.count())).transform(mapped, _read(folder, payloads), _FULL if payloads else _ROWS)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives in the shared folder, then read back."""
    folder = fresh_path(spark, "warc")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS keeper FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s AS payload_digest,
       CASE WHEN n >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND keeper <> page_id THEN keeper END AS refers_to FROM r
"""
