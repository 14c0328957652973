"""WARC archives in Zstandard: written by tasks to the shared folder, and read back record by record.

An archive starts with a skippable frame that holds the dictionary; then each record is a frame of its own. The reader
loads the dictionary, decodes one frame at a time and checks header fields, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch_path, skew_join, small_side

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

LEAST_PAYLOAD = 100
DICTIONARY_BYTES, SAMPLE_ROWS = 32_768, 256
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16


class ArchiveError(ValueError):
    """An archive or record that doesn't hold what its headers say."""


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if kind == "response" else http
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or f"urn:page:{page_id}")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Page-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Page-Refers-To: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def _agrees(digest: str, payload: bytes) -> bool:
    """Whether a labelled digest, in hex or base 32, is that of the payload; of an algorithm not known here, true."""
    label, colon, value = digest.partition(":")
    if not colon or label.lower() not in ("sha256", "sha1", "md5"):
        return True
    made = hashlib.new(label.lower(), payload).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def _number(fields: dict[str, str], name: str) -> int | None:
    try:
        return int(fields[name.lower()]) if name.lower() in fields else None
    except ValueError as e:
        raise ArchiveError(f"{name} isn't a number: {fields[name.lower()][:80]}") from e


def parse_record(raw: bytes) -> dict:
    """Fields of a record, its payload too; raises ArchiveError if the headers, lengths or digest don't agree.

    Names of fields are read in any case. A payload is what follows an HTTP head, or all of another kind of content. The
    writer's own fields may be absent: page_id and refers_to are then null, payload_bytes is the payload's length, of a
    revisit the one that its HTTP head states, and payload_digest, if none is given, is made from the payload.
    """
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"no field: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    if lacking := [x for x in REQUIRED if x.lower() not in fields]:
        raise ArchiveError(f"fields lacking: {', '.join(lacking)}")
    n = _number(fields, "Content-Length")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"Content-Length {n}, but {len(rest) - 4} bytes")
    payload, kind, stated = rest[:n], fields["warc-type"].lower(), None
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, sep, payload = payload.partition(b"\r\n\r\n")
        if not sep:
            raise ArchiveError("no HTTP head")
        heads = dict(x.lower().split(b":", 1) for x in http.split(b"\r\n")[1:] if b":" in x)
        if heads.get(b"content-length", b"").strip().isdigit():
            stated = int(heads[b"content-length"])
    length, digest = _number(fields, "Page-Payload-Length"), fields.get("warc-payload-digest")
    if kind == "revisit":
        if payload or not ("warc-refers-to" in fields or "warc-refers-to-target-uri" in fields):
            raise ArchiveError("a revisit with a payload or without its target")
        length = stated if length is None else length
    elif (length is not None and len(payload) != length) or (digest and not _agrees(digest, payload)):
        raise ArchiveError("payload isn't what its digest and length say")
    if length is None:
        length = len(payload)
    digest = digest.removeprefix("sha256:") if digest else hashlib.sha256(payload).hexdigest()
    return {"page_id": _number(fields, "Page-Id"), "url": fields.get("warc-target-uri"), "payload": payload, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": _number(fields, "Page-Refers-To")}


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def as_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def read_records(stream) -> Iterator[bytes]:
    """The decoded records of an archive, one frame each; memory holds one record and a chunk."""
    head = stream.read(8)
    if len(head) < 8:
        raise ArchiveError("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_FRAME:
        raise ArchiveError(f"leading frame has magic {magic:#x}")
    raw = stream.read(size)
    if len(raw) != size:
        raise ArchiveError("dictionary cut short")
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    decoder, rest = zstandard.ZstdDecompressor(dict_data=as_dictionary(raw)) if raw else zstandard.ZstdDecompressor(), b""
    while rest or (rest := stream.read(CHUNK)):
        frame, out = decoder.decompressobj(), []
        while True:
            try:
                out.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"bad frame: {e}") from e
            if frame.eof:
                rest = frame.unused_data
                break
            if not (rest := stream.read(CHUNK)):
                raise ArchiveError("last frame cut short")
        yield b"".join(out)


#: Spark's names of file systems, and those that the tasks' library knows them by.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def located(spark, path: str) -> str:
    """A folder's full address: one without a scheme is in Spark's default file system. Raises ArchiveError for a scheme that
    tasks can't write to, before any of them starts."""
    from pyspark.sql.utils import is_remote

    if "://" not in path and not is_remote():
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    scheme, _, rest = path.partition(":")
    if scheme not in SCHEMES:
        raise ArchiveError(f"archives can't be written to {path}: {', '.join(SCHEMES)} are known")
    return f"{SCHEMES[scheme]}://{rest.removeprefix('//')}"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


MANIFEST = "path string, n_records long, n_bytes long"


def _writer(root: str, dictionary: bytes, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _filesystem(root)
        files.create_dir(base, recursive=True)
        options = {"dict_data": as_dictionary(dictionary)} if dictionary else {}
        press = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, **options)
        task, out, done = TaskContext.get(), None, []

        def close():
            out.close()
            done.append((f"{root}/{name}", n_records, n_bytes))

        for rows in batches:
            for r in rows.itertuples(index=False):
                if out is None:
                    name, n_records, n_bytes = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done)}.warc.zst", 0, 0
                    out = files.open_output_stream(f"{base}/{name}")
                    out.write(dictionary_frame(dictionary))
                page, refers = (None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to))
                frame = press.compress(make_record(page, r.url, (r.html or "").encode(), r.digest, r.record_type, refers, date))
                out.write(frame)
                n_records, n_bytes = n_records + 1, n_bytes + len(frame)
                if n_bytes >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "n_records", "n_bytes"])

    return run


def trained_dictionary(pages: DataFrame, n_rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> bytes:
    """From about n_rows pages picked by a hash of page_id, never over twice as many; empty if they give none."""
    total = pages.count()
    if not total:
        return b""
    picked = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(total)) < n_rows).select("html").limit(2 * n_rows).collect()
    samples = [r.html.encode()[: 1 << 17] for r in picked if r.html]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def with_record_types(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with digest, record_type and refers_to.

    Of equal payloads of LEAST_PAYLOAD bytes or more the row with the smallest page_id is the response; repeated rows
    of that id are responses too. Smaller payloads are responses. A null html counts as empty. Only ids and digests are
    grouped; pages meet what was found of them by page_id, which no payload makes hot.
    """
    digested = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    keys = materialise(digested.filter(F.col("n") >= LEAST_PAYLOAD).select("page_id", "digest"), "payload-keys")
    groups = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("weight")).filter(F.col("weight") > 1)
    found = skew_join(keys, materialise(groups, "payload-groups"), "digest", "page_id", keys.count())
    revisits = found.filter(~F.col("page_id").eqNullSafe(F.col("first"))).distinct().withColumnsRenamed({"page_id": "__page", "digest": "__digest"})
    joined = digested.join(small_side(materialise(revisits, "revisits")), F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left")
    revisit = F.col("__digest").isNotNull()
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, root: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes pages to archives under root; the manifest (path, n_records, n_bytes) of what finished tasks wrote."""
    root = located(pages.sparkSession, root)
    dictionary = trained_dictionary(pages)
    return materialise(with_record_types(pages).mapInPandas(_writer(root, dictionary, date), MANIFEST), "warc-manifest")


RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that a manifest lists; raises ArchiveError on a bad one or a wrong record count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, expected in zip(rows["path"], rows["n_records"], strict=True):
                files, name = _filesystem(path)
                found, held, count = [], 0, 0
                with files.open_input_stream(name) as stream:
                    for raw in read_records(stream):
                        x = parse_record(raw)
                        if not payloads:
                            x["payload"] = None
                        found.append(x)
                        count, held = count + 1, held + (len(raw) if payloads else 0)
                        if len(found) >= 2_000 or held > 16 << 20:
                            yield _frame(found)
                            found, held = [], 0
                if count != expected:
                    raise ArchiveError(f"{path}: {count} records, the manifest says {expected}")
                if found:
                    yield _frame(found)

    def _frame(found: list[dict]) -> pd.DataFrame:
        df = pd.DataFrame(found)
        return df.assign(page_id=df["page_id"].astype("Int64"), refers_to=df["refers_to"].astype("Int64"))

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.repartition(n, "path").mapInPandas(run, RECORDS)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's record as read back; see with_record_types() for nulls, small payloads and repeated rows."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = write_archives(pages, scratch_path(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH t AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, min(page_id) AS first FROM t WHERE octet_length(body) >= 100 GROUP BY digest)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, t.digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN first END AS refers_to
FROM t LEFT JOIN g ON t.digest = g.digest
"""
