"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing gives one gzip member per record and an index row (file, offset, length, url,
digest, type). Reading starts from the index: the selected rows are range-partitioned and
sorted by (file, offset), neighbouring ranges are merged and each merged span is one read, whose
records are unpacked one at a time. Bodies are written where they are scanned; only those whose digest is repeated
(and a few that a filter of fixed size takes for such) go through the join that finds their response.

Defined results: a null payload is the empty payload; a null id is archived without an id
and never chosen as a group's response unless the whole group has none (then all are
responses); rows that repeat the winning id are all responses; a null url leaves the
Target-URI out; an empty table gives an empty index and result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, saved, scratch, shuffle_width, table

INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_URN = "urn:evidentia:page:"
#: Bits of the filter of repeated digests: 16 MB.
FILTER_BITS = 1 << 27


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str) -> str:
    return "".join(c if " " < c else "%%%02X" % ord(c) for c in url)


def build_record(page_id, url, payload: bytes, refers_to, date: str) -> tuple[str, bytes]:
    """(digest, record bytes). A revisit's block keeps the HTTP header with the full length but no payload."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'none' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return digest, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises if lengths or a response's digest disagree with the header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("record length disagrees with its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != full or digest32(payload) != digest):
        raise ValueError("payload disagrees with its digest")
    number = lambda x: None if x is None or x.endswith(":none>") else int(x[len(_URN) + 1 : -1])
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": full, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if response else None}


def write_archives(pages: DataFrame, root: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, roll_bytes: int = 256 << 20, level: int = 6, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive every row under `root` and return the index, itself a table in the shared folder.

    Only ids and digests decide the responses; a hot digest's join rows are split by AQE's skew join.
    A task names its files afresh, so a repeated task never damages files an index row points to.
    """
    spark = pages.sparkSession
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("body")).withColumn("key", F.sha2("body", 256))
    first = keyed.filter(F.length("body") >= min_revisit_bytes).groupBy("key").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1")
    first = saved(first.select("key", "winner"), "warc-repeated")
    place = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    # FILTER_BITS / 8 bytes however many digests are repeated; a filter that fills up only sends more rows to the join
    marks = first.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("marks"))
    at = F.bitmap_bit_position("p")
    marked = F.substring("marks", (F.floor(at / 8) + 1).cast("int"), F.lit(1))
    bit = F.conv(F.hex(marked), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0
    met = keyed.withColumn("p", place).withColumn("bucket", F.bitmap_bucket_number("p")).join(F.broadcast(marks), "bucket", "left").withColumn("maybe", F.coalesce(bit, F.lit(False)))
    alone = met.filter("NOT maybe").select("page_id", "url", "body", F.lit(None).cast("long").alias("refers_to"))
    repeated = met.filter("maybe").join(first, "key", "left")
    repeated = repeated.select("page_id", "url", "body", F.when(F.col("winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("page_id")) & (F.length("body") >= min_revisit_bytes), F.col("winner")).alias("refers_to"))

    def write(batches):
        import pyarrow as pa

        fs, path = file_system(root)
        fs.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                ids, urls, bodies, refs = batch.columns
                for i in range(batch.num_rows):
                    page_id, url, body, refers = ids[i].as_py(), urls[i].as_py(), bodies[i].as_py(), refs[i].as_py()
                    if out is None or at >= roll_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    digest, record = build_record(page_id, url, body, refers, date)
                    member = gzip.compress(record, level, mtime=0)
                    out.write(member)
                    index.append((page_id, url, digest, "response" if refers is None else "revisit", name, at, len(member)))
                    at += len(member)
                if index:
                    cols = list(zip(*index))
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "url", "digest", "record_type", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return saved(alone.mapInArrow(write, INDEX).unionByName(repeated.mapInArrow(write, INDEX)), "warc-index")


def read_archives(index: DataFrame, root: str, *, payloads: bool = False, gap: int = 64 << 10, span: int = 4 << 20, held_bytes: int = 8 << 20) -> DataFrame:
    """Records of the selected index rows. Ranges at most `gap` bytes apart are read together, up to `span` bytes.

    A task holds one read's packed bytes, one record unpacked from it and, with `payloads`, `held_bytes` of payloads (or one).
    """
    wanted = index.select("file", "offset", "length").repartitionByRange(shuffle_width(index.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches):
        import pyarrow as pa

        fs, path = file_system(root)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]

        def fetch(handle, run):
            begin = run[0][0]
            handle.seek(begin)
            data = memoryview(handle.read(run[-1][0] + run[-1][1] - begin))
            found, held = [], 0
            for k, (o, n) in enumerate(run, 1):
                record = parse_record(zlib.decompress(data[o - begin : o - begin + n], 31))
                if payloads:
                    held += len(record["payload"] or b"")
                else:
                    record["payload"] = None
                found.append(record)
                if held >= held_bytes or k == len(run):
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], k) for c, k in zip(names, kinds)], names=names)
                    found, held = [], 0

        opened, handle, run = None, None, []
        for batch in batches:
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                far = run and (file != opened or offset - sum(run[-1]) > gap or offset + length - run[0][0] > span)
                if far:
                    yield from fetch(handle, run)
                    run = []
                if file != opened:
                    if handle is not None:
                        handle.close()
                    opened, handle = file, fs.open_input_file(f"{path}/{file}")
                run.append((offset, length))
        if run:
            yield from fetch(handle, run)
        if handle is not None:
            handle.close()

    return wanted.mapInArrow(read, RECORDS)


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read all of them back."""
    root = scratch(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), root)
    return saved(read_archives(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")


_B32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {s}) & 31)::INTEGER, 1)"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform([('0x' || substr(x, (1 + 5 * k)::INTEGER, 5))::BIGINT], lambda v: {" || ".join(_B32.format(s=s) for s in (15, 10, 5, 0))}), '')), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM g
"""
