"""Dictionary-compressed WARC archives.

Each archive is one file: a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from the
archive's own records, then one Zstandard frame for each record, compressed alone with that dictionary. Pages whose
payload (at least `least` bytes) repeats are written once, for the largest page_id, and as revisits elsewhere.

Plan: SHA-1 and sizes are computed in the JVM; repeated digests are found by a partially aggregated groupBy without the
payloads, and join the pages' digests in narrow rows (a join that Spark splits where a payload is common); the revisits this
gives, one row for each (page_id, digest), join the pages, so that payloads are not dealt by their digest. Writers roll a new archive at `roll` payload bytes, write under a name of
their own attempt and rename, and pass on only names; archives are read back by Spark's binaryFile reader.

Defined cases: a null html is an empty payload; a null url is written without a target; a null page_id is less than any other, so it
revisits the page that has its payload, and where only null ids have that payload all are responses; rows that repeat a page_id are
records of their own (all of them responses where that id is the largest, else revisits). An empty table gives a folder with an empty
manifest, from which no record is read. Very long payloads make an archive of their own. An archive with too little to learn from has
an empty dictionary frame. Other columns of the pages may have any name.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import forget_at_exit, shared_dir
from corpusloom.session import table

MAGIC = 0x184D2A5D
#: Dictionary bytes, payload bytes an archive rolls at, payload bytes that may be a revisit, compression level.
DICT_SIZE, ROLL, LEAST, LEVEL = 64 << 10, 8 << 20, 1000, 3
#: Bytes of an archive handed to the decompressor at once.
STEP = 1 << 14
DATE = "1970-01-01T00:00:00Z"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with its header; a revisit has no payload, and names the record and digest it repeats."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {' '.join(url.split())}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICT_SIZE) -> bytes:
    """Trained on all records of the archive; empty where there is too little to train on."""
    import zstandard

    total = sum(map(len, records))
    if len(records) < 8 or total < 4 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 16)), records, k=256, d=8, steps=1, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack(records: list[bytes]) -> bytes:
    """An archive of these records."""
    import zstandard

    trained = build_dictionary(records)
    comp = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_content_size=True)
    out = io.BytesIO()
    out.write(struct.pack("<II", MAGIC, len(trained)))
    out.write(trained)
    for r in records:
        out.write(comp.compress(r))
    return out.getvalue()


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    magic, n = struct.unpack_from("<II", archive)
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the start")
    trained = archive[8 : 8 + n]
    decomp = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    at = 8 + n
    view = memoryview(archive)
    while at < len(archive):
        one, out = decomp.decompressobj(), []
        while not one.eof:
            if at >= len(archive):
                raise ValueError("the last record is cut short")
            out.append(one.decompress(view[at : at + STEP]))
            at = min(at + STEP, len(archive))
        at -= len(one.unused_data)
        yield b"".join(out)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html, digest, refers_to): the records to write."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sized = pages.select("page_id", "url", "html", F.sha1(raw).alias("digest"), F.length(raw).cast("long").alias("size"))
    long_ = sized.filter(F.col("size") >= least).select("page_id", "digest")
    same = long_.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    again = long_.join(same, "digest").filter("page_id IS NULL OR page_id <> first")
    again = again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct()
    # by page_id, with the digest to tell rows apart that repeat an id
    return sized.drop("size").join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest")


def _write(folder: str, roll: int):
    def rows(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        waiting, size = [], 0

        def flush():
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{top}/.{name}.tmp", compression=None) as f:
                f.write(pack(waiting))
            store.move(f"{top}/.{name}.tmp", f"{top}/{name}")
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([len(waiting)], pa.int64())})

        for b in batches:
            cols = [b.column(i) for i in range(5)]
            for i in range(b.num_rows):
                page, url, html, digest, refers = (c[i].as_py() for c in cols)
                payload = (html or "").encode("utf-8", "surrogatepass")
                waiting.append(record_bytes(page, url, payload, digest, refers))
                size += len(waiting[-1])
                if size >= roll:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    return rows


def write_archives(records: DataFrame, folder: str, roll: int = ROLL) -> None:
    """Writes archives and their manifest under the folder; files that a repeated task left behind are not in it."""
    spark = records.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    made = records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_write(folder, roll), "archive string, records long")
    # one name for each 8 MB written; kept as a table beside the archives
    made.write.parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record: headers as columns, and the payload's own size and SHA-1 where it is there."""
    names = spark.read.schema("archive string, records long").parquet(f"{folder}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").join(names, "archive", "left_semi")

    def rows(batches):
        for b in batches:
            for x in b.column(0):
                got = []
                for record in unpack(x.as_buffer().to_pybytes()):
                    h, body = parse(record)
                    page, refers = (h.get(k, "")[len("<urn:page:") : -1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
                    told = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = h["WARC-Type"] == "response"
                    if response and hashlib.sha1(body).hexdigest() != told:
                        raise ValueError(f"record {page}: its payload does not have its digest")
                    got.append((int(page) if page else None, len(body) if response else int(h["X-Payload-Length"]), told, h["WARC-Type"], int(refers) if refers else None, h.get("WARC-Target-URI")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                cols = list(zip(*got)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return files.select("content").mapInArrow(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_archives(plan_records(table(spark, sf_dir, "pages")), folder)
    forget_at_exit(spark, folder)
    return read_archives(spark, folder).drop("url")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 1000"""
