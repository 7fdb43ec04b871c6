"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a request, a response (or a revisit) and a metadata record that
point at each other through ``WARC-Concurrent-To``. Records end in two line
ends, which is what Spark's text writer puts after a row, so archives are
written by the ordinary committed writer to any Hadoop file system.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_arrow, materialise
from .minhash import connected_components

END = "\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are never revisits.
MIN_REVISIT_BYTES = 100
#: Captures to an archive.
FILE_CAPTURES = 4096
MAIN_TYPES = ("response", "revisit", "resource", "conversion")
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, concurrent_to array<string>, refers_to string, page_key string, payload_bytes long, payload_digest string, declared_digest string, content binary"


def _record(kind: str, rid: Column, uri: Column, fields: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A record without its closing line ends. A field whose value is null is left out."""
    lines = [F.lit(f"{VERSION}{END}WARC-Type: {kind}{END}WARC-Record-ID: <"), rid, F.lit(f">{END}WARC-Date: 2000-01-01T00:00:00Z{END}WARC-Target-URI: "), uri, F.lit(END)]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit("")) for name, value in fields]
    lines += [F.lit(f"Content-Type: {content_type}{END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END), block]
    return F.concat(*lines)


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", file_captures: int = FILE_CAPTURES) -> None:
    """Write three records per row of ``df`` below ``path`` as gzip-compressed WARC files of at most ``file_captures`` rows.

    Of rows with equal payloads of at least 100 bytes, the one with the
    smallest id becomes a response and the others revisit it; a null id is the
    largest. Null payloads are empty, null addresses become ``about:blank``,
    and control characters and blanks in addresses are percent-encoded. Rows
    that repeat id and payload are captures of their own. Payloads may be of
    any length; extra columns are not read. An empty table gives an archive
    without records.
    """
    base = df.select(F.col(id_col).cast("string").alias("key"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("k"), F.col(id_col).alias("id"), F.coalesce(F.col(uri_col), F.lit("about:blank")).alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    base = base.withColumn("sha", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("uri", F.regexp_replace("uri", r"[\x00-\x20\x7F]", "%20"))
    # Who is a response, and what is there several times, is settled on ids, addresses and digests alone.
    slim = materialise(base.select("k", "id", "uri", "sha", F.octet_length("payload").alias("size")), "page-digests")
    large = slim.filter(F.col("size") >= MIN_REVISIT_BYTES)
    first = large.groupBy("sha").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k", "uri")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    revisits = materialise(large.join(first.hint("merge"), "sha").filter(~F.col("id").eqNullSafe(F.col("first.id"))).select("k", "sha", "first", F.lit(True).alias("again")).distinct(), "page-revisits")
    rows = base.join(revisits.hint("merge"), ["k", "sha"], "left").withColumn("nth", F.lit(1))
    # Only rows that repeat in all of id, address and payload need numbers to have names of their own.
    same = materialise(slim.groupBy("k", "uri", "sha").agg(F.count("*").alias("n")).filter("n > 1").select("k", "uri", "sha"), "page-repeats")
    if not same.isEmpty():
        again = rows.join(same.hint("merge"), ["k", "uri", "sha"], "left_semi")
        again = again.withColumn("nth", F.row_number().over(W.partitionBy("k", "uri", "sha").orderBy("sha")))
        rows = rows.join(same.hint("merge"), ["k", "uri", "sha"], "left_anti").unionByName(again)
    name = lambda key, address, nth: F.concat(F.lit("urn:sha256:"), F.sha2(F.concat_ws("/", key, "sha", nth.cast("string"), address), 256))
    rows = rows.withColumn("rid", name(F.col("k"), F.col("uri"), F.col("nth"))).withColumn("first_rid", name(F.col("first.k"), F.col("first.uri"), F.lit(1)))
    rid, uri = F.col("rid"), F.col("uri")
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    digest = F.concat(F.lit("sha256:"), F.col("sha"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(END + END))
    response = _record("response", rid, uri, [("WARC-Payload-Digest", digest)], "application/http; msgtype=response", F.concat(head, F.col("payload")))
    revisit = _record("revisit", rid, uri, [("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", angle(F.col("first_rid")))], "application/http; msgtype=response", head)
    request = _record("request", F.concat(rid, F.lit(":request")), uri, [("WARC-Concurrent-To", angle(rid))], "application/http; msgtype=request", F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END}{END}")))
    metadata = _record("metadata", F.concat(rid, F.lit(":metadata")), uri, [("WARC-Concurrent-To", angle(rid))], "application/warc-fields", F.coalesce(F.concat(F.lit("page-key: "), F.col("key"), F.lit(END)), F.lit("")))
    main = F.when(F.col("again"), revisit).otherwise(response)
    # One row holds a capture's three records; the writer adds the last one's end.
    out = rows.select(F.concat(request, F.lit(END * 2), main, F.lit(END * 2), metadata).alias("value"))
    out.write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", file_captures).text(path)


def parse(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, from its decompressed bytes in pieces of any size. A field that repeats has its values joined by blanks."""
    held = bytearray()
    data = iter(data)
    ended = False

    def fill(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            piece = next(data, None)
            if piece is None:
                ended = True
            else:
                held.extend(piece)
        return len(held) >= n

    while True:
        while fill(2) and held[:2] == b"\r\n":
            del held[:2]
        if not held:
            return
        at, want = held.find(b"\r\n\r\n"), 4096
        while at < 0 and not ended:
            fill(len(held) + want)
            want *= 2
            at = held.find(b"\r\n\r\n")
        lines = bytes(held[: at if at >= 0 else len(held)]).decode("utf-8", "replace").split("\r\n")
        if at < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        fields: dict[str, str] = {}
        for line in lines[1:]:
            key, _, value = line.partition(":")
            key, value = key.strip().lower(), value.strip()
            fields[key] = f"{fields[key]} {value}" if key in fields else value
        n = int(fields.get("content-length", "0"))
        if not fill(at + 4 + n):
            raise ValueError("a WARC record is cut short")
        block = bytes(held[at + 4 : at + 4 + n])
        del held[: at + 4 + n]
        yield fields, block


def inflate(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """``content`` decompressed piece by piece if it is gzip (members may follow each other)."""
    if content[:2] != b"\x1f\x8b":
        view = memoryview(content)
        yield from (bytes(view[i : i + step]) for i in range(0, len(content), step))
        return
    while content[:2] == b"\x1f\x8b":
        machine = zlib.decompressobj(31)
        rest = content
        while not machine.eof:
            piece = machine.decompress(rest, step)
            rest = machine.unconsumed_tail
            if piece:
                yield piece
            elif not machine.eof and not rest:
                raise ValueError("a gzip member is cut short")
        content = machine.unused_data


def read_records(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """All records of the archives below ``path``, see ``RECORD_SCHEMA``.

    ``payload_*`` describe what follows the HTTP head of a response, as read
    (null for other types); ``declared_digest`` is the header's, ``page_key``
    what a metadata record says of it. A record without an id gets one from its
    place. With ``content=False`` blocks are dropped where they are parsed.
    """

    def run(batches):
        for batch in batches:
            for file, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                size = 0
                for nth, (f, block) in enumerate(parse(inflate(blob.as_buffer().to_pybytes()))):
                    ref = lambda k, f=f: f[k].strip("<>") if k in f else None
                    kind = f.get("warc-type")
                    n = digest = key = None
                    if kind == "response":
                        head, _, payload = block.partition(b"\r\n\r\n")
                        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    elif kind == "metadata":
                        key = next((x[9:].strip() for x in block.decode("utf-8", "replace").split("\r\n") if x.lower().startswith("page-key:")), None)
                    declared = f.get("warc-payload-digest", "").removeprefix("sha256:").lower() or None
                    rid = ref("warc-record-id") or f"urn:place:{file}:{nth}"
                    rows.append((rid, kind, f.get("warc-target-uri"), [x.strip("<>") for x in f.get("warc-concurrent-to", "").split()], ref("warc-refers-to"), key, n, digest, declared, block if content else None))
                    size += len(block) if content else 200
                    if size > 1 << 23:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = [pa.string()] * 3 + [pa.list_(pa.string())] + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return map_arrow(files.select("path", "content"), run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``(capture_id, main, requests, metadata)``.

    Records belong together that name each other by concurrent-to, whichever
    names which, directly or through others. A capture is called after its main
    record (response, revisit, resource, conversion); where several main
    records belong together, ``main`` is that of the least id and the others
    stand among ``metadata``. Records whose target is missing form a capture
    without a main record under the name they point at (their own, if they point
    nowhere; the least name, where several belong together). Of records that
    repeat an id, one stays. ``requests`` and ``metadata`` are arrays ordered by
    record id. ``records`` is read several times: give a written table.
    """
    columns = [c for c in records.columns if c != "concurrent_to"]
    whole = F.struct("record_id", *[c for c in columns if c != "record_id"])
    main = F.coalesce(F.col("record_type").isin(*MAIN_TYPES), F.lit(False))
    named = records.withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.coalesce(F.get("concurrent_to", F.lit(0)), F.col("record_id"))))
    # Most archives have request and metadata name the main record, and no other links.
    side = records.filter(~main)
    more = records.filter((F.size("concurrent_to") > 1) | (main & (F.size("concurrent_to") > 0))).isEmpty()
    if not more or not side.select(F.get("concurrent_to", F.lit(0)).alias("record_id")).join(side.select("record_id").hint("merge"), "record_id", "left_semi").isEmpty():
        links = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
        roots = connected_components(links, "warc-links")
        named = records.join(roots.withColumnsRenamed({"node": "record_id"}).hint("merge"), "record_id", "left").withColumn("root", F.coalesce("root", "record_id"))
        heads = named.filter(main).groupBy("root").agg(F.min("record_id").alias("head"))
        named = named.join(heads.hint("merge"), "root", "left").withColumn("capture_id", F.coalesce("head", "root")).drop("root", "head")
    head = main & (F.col("record_id") == F.col("capture_id"))
    pick = lambda test: F.array_distinct(F.array_sort(F.collect_list(F.when(test, whole))))
    request = F.coalesce(F.col("record_type") == "request", F.lit(False))
    return named.groupBy("capture_id").agg(
        F.min_by(F.when(head, whole), F.when(head, F.struct(*[c for c in columns if c != "content"]))).alias("main"),
        pick(request).alias("requests"),
        pick(~head & ~request).alias("metadata"),
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Captures with ``page_key``, ``payload_bytes``, ``payload_digest`` and ``refers_key`` of the full payload.

    ``page_key`` is what the capture's metadata says. A revisit takes payload
    and key from the capture it refers to; if that is missing, the declared
    digest stands and the length is null. ``captures`` is read twice.
    """
    key = F.get(F.filter("metadata", lambda m: m["page_key"].isNotNull()), F.lit(0))["page_key"]
    own = captures.filter("main is not null").select("capture_id", "requests", "metadata", "main", key.alias("page_key"))
    target = own.filter("main.record_type = 'response'").select(F.col("main.record_id").alias("t_id"), F.col("main.payload_bytes").alias("t_bytes"), F.col("main.payload_digest").alias("t_digest"), F.col("page_key").alias("t_key"))
    joined = own.join(target.hint("merge"), F.col("main.refers_to") == F.col("t_id"), "left")
    return joined.select(
        "capture_id", "main", "requests", "metadata", "page_key",
        F.coalesce("main.payload_bytes", "t_bytes").alias("payload_bytes"),
        F.coalesce("main.payload_digest", "t_digest", "main.declared_digest").alias("payload_digest"),
        F.col("t_key").alias("refers_key"),
    )
