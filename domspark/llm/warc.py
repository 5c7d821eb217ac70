"""WARC archives as seekable Zstandard bundles, written and read by Spark as a data source.

Records are grouped into frames that can be decompressed by themselves. Behind the frames stands the bundle's index in a
skippable frame (record id to frame, offset in the frame's records, length; sorted by id), and at the end the seek table
of the seekable format (compressed and decompressed size and checksum of each frame). Any Zstandard reader gives the
records as one stream; a reader of the table gets to a record by decompressing one frame.

    register(spark); df.write.format("warc_bundles").mode("append").save(path); spark.read.format("warc_bundles").load(path)

Tasks write bundles of their own names; the driver's commit writes the list of those that count, so a task that ran twice
leaves no record twice. Paths are those that pyarrow's filesystems open, alike on driver and executors.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import HOT, settle, shared_folder, small_batches

FRAME, BUNDLE, LEVEL = 256 << 10, 128 << 20, 3
MANIFEST = "_bundles.json"
#: Fixed values of the formats.
SEEK_MAGIC, SEEK_FRAME, INDEX_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A51
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = b"\r\n\r\n"
INDEX = np.dtype([("hi", ">u8"), ("lo", ">u8"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])
ROWS = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"
FOUND = "record_id string, page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def record_id(*parts: str | None) -> bytes:
    return hashlib.sha256("\x00".join("" if p is None else f"={p}" for p in parts).encode()).digest()[:16]


def _plain(s: str) -> str:
    """Without control characters, which would end a header line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in s)


def record(own_id: bytes, row: dict, date: str) -> bytes:
    """A response with its payload, or a revisit that names the response's id."""
    revisit = row["record_type"] == "revisit"
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=own_id)}>", f"WARC-Date: {date}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_plain(row['url'])}")
    for name, key in (("Page-ID", "page_id"), ("Refers-To-Page-ID", "refers_to")):
        if row[key] is not None:
            head.append(f"{name}: {_plain(row[key].replace('%', '%25'))}")
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
        if row["refers_to"] is not None:
            head.append(f"WARC-Refers-To: <urn:uuid:{uuid.UUID(bytes=record_id('response', row['payload_digest'], row['refers_to']))}>")
    block = HTTP if revisit else HTTP + row["payload"]
    head += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"Payload-Length: {row['payload_bytes']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record at a place, and where it ends."""
    stop = data.index(END, at)
    lines = data[at:stop].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    begin = stop + 4
    end = begin + int(head["Content-Length"])
    return head, data[data.index(END, begin, end) + 4 : end], end + 4


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Bundle:
    """Writes one bundle to a binary file."""

    def __init__(self, out, frame: int = FRAME, level: int = LEVEL):
        self.out, self.frame, self.compressor = out, frame, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.open, self.size, self.table, self.index, self.written = [], 0, [], [], 0

    def add(self, own_id: bytes, data: bytes) -> None:
        if self.open and self.size + len(data) > self.frame:
            self.flush()
        self.index.append((own_id, len(self.table), self.size, len(data)))
        self.open.append(data)
        self.size += len(data)

    def _put(self, packed: bytes, plain: bytes) -> None:
        self.out.write(packed)
        self.written += len(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.open:
            plain = b"".join(self.open)
            self._put(self.compressor.compress(plain), plain)
            self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = np.array([(*struct.unpack(">QQ", i), f, o, n) for i, f, o, n in self.index], INDEX)
        self._put(_skippable(INDEX_FRAME, np.sort(entries, order=["hi", "lo"]).tobytes()), b"")
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEK_MAGIC)
        self.out.write(_skippable(SEEK_FRAME, table))


class Seekable:
    """Reads a bundle by its seek table."""

    def __init__(self, file):
        self.file, self.decompressor = file, zstandard.ZstdDecompressor()
        size = file.seek(0, io.SEEK_END)
        file.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end")
        width = 12 if flags & 0x80 else 8
        file.seek(size - 9 - frames * width)
        self.table = np.frombuffer(file.read(frames * width), "<u4").reshape(frames, -1).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.table[:, 0])))

    def __len__(self) -> int:
        return len(self.table)

    def raw(self, k: int) -> bytes:
        self.file.seek(int(self.start[k]))
        return self.file.read(int(self.table[k, 0]))

    def frame(self, k: int) -> bytes:
        """The records of a frame; nothing for a skippable one."""
        if not self.table[k, 1]:
            return b""
        plain = self.decompressor.decompress(self.raw(k))
        if self.table.shape[1] == 3 and xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def index(self) -> np.ndarray:
        return np.frombuffer(self.raw(len(self) - 1)[8:], INDEX)

    def find(self, own_id: bytes) -> bytes | None:
        """One record, by a search of the index and one frame."""
        hi, lo = struct.unpack(">QQ", own_id)
        index = self.index()
        at = np.searchsorted(index["hi"], np.uint64(hi))
        while at < len(index) and index["hi"][at] == hi:
            if index["lo"][at] == lo:
                _, _, frame, offset, length = index[at].tolist()
                return self.frame(frame)[offset : offset + length]
            at += 1
        return None


def _folder(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


def _bundles(path: str) -> list[str]:
    fs, at = _folder(path)
    with fs.open_input_file(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class _Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


@dataclass
class _Part(InputPartition):
    name: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.frame, self.bundle = int(options.get("frame", FRAME)), int(options.get("bundle", BUNDLE))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, at = _folder(self.path)
        fs.create_dir(at, recursive=True)
        part, names, n, bundle, out = TaskContext.get().partitionId(), [], 0, None, None
        for batch in iterator:
            for row in batch.to_pylist():
                if bundle is None:
                    names.append(f"part-{part:05d}-{len(names):05d}-{uuid.uuid4().hex}.warc.zst")
                    out = fs.open_output_stream(f"{at}/{names[-1]}", compression=None)
                    bundle = Bundle(out, self.frame)
                # A response to which revisits refer is known by its digest and page; other records by their place too.
                known = (row["record_type"], row["payload_digest"], row["page_id"], *(() if row["record_type"] == "response" and row["refers_to"] is not None else (str(part), str(n))))
                data = dict(row, refers_to=row["refers_to"] if row["record_type"] == "revisit" else None)
                own_id = record_id(*known)
                bundle.add(own_id, record(own_id, data, self.date))
                n += 1
                if bundle.written >= self.bundle:
                    bundle.close()
                    out.close()
                    bundle = None
        if bundle is not None:
            bundle.close()
            out.close()
        return _Written(names)

    def commit(self, messages: list[_Written]) -> None:
        fs, at = _folder(self.path)
        fs.create_dir(at, recursive=True)
        every = [f"{self.path}/{x}" for m in messages if m is not None for x in m.names]
        try:
            every = _bundles(self.path) + every
        except FileNotFoundError:
            pass
        with fs.open_output_stream(f"{at}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(sorted(every)).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        fs, at = _folder(self.path)
        for name in (x for m in messages if m is not None for x in m.names):
            fs.delete_file(f"{at}/{name}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "false") == "true"

    def partitions(self) -> list[_Part]:
        return [_Part(name) for name in _bundles(self.path)] or [_Part(None)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.name is None:
            return
        fs, at = _folder(partition.name)
        with fs.open_input_file(at) as f:
            bundle = Seekable(f)
            for k in range(len(bundle)):
                data, at, rows = bundle.frame(k), 0, []
                while at < len(data):
                    head, payload, at = parsed(data, at)
                    rows.append(_row(head, payload, self.payload))
                if rows:
                    yield _batch(rows, self.payload)


def _row(head: dict[str, str], payload: bytes, whole: bool) -> tuple:
    """A response's digest and size are those of the bytes that were read; a revisit's are its headers'."""
    revisit = head["WARC-Type"] == "revisit"
    size, digest = (int(head["Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:")) if revisit else (len(payload), hashlib.sha256(payload).hexdigest())
    value = lambda name: unquote(head[name]) if name in head else None
    row = (head["WARC-Record-ID"][10:-1], value("Page-ID"), head.get("WARC-Target-URI"), head["WARC-Type"], size, digest, value("Refers-To-Page-ID"))
    return (*row, None if revisit else payload) if whole else row


def _batch(rows: list[tuple], whole: bool) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()] * whole
    names = [x.split()[0] for x in FOUND.split(", ")] + ["payload"] * whole
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class WarcBundles(DataSource):
    """Options: path; to write: date, frame and bundle (bytes); to read: payload ("true" adds that column)."""

    @classmethod
    def name(cls) -> str:
        return "warc_bundles"

    def schema(self) -> str:
        return FOUND + (", payload binary" if self.options.get("payload", "false") == "true" else "")

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("bundles are only added: take mode append")
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcBundles)


def archive_rows(pages: DataFrame, html: str = "html", url: str = "url", least: int = 100) -> DataFrame:
    """Rows to write: of equal payloads of at least least bytes the smallest page_id (nulls last) is the response.

    Its refers_to names itself, as revisits refer to it. Of repeated rows with that id one is the response. Hot payloads
    (see common.HOT) are told apart by a broadcast of digests, and their payloads are dropped before rows are shuffled.
    """
    rows = pages.select(F.col("page_id").alias("p"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload")).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    big = F.col("size") >= least
    each = rows.where(big).groupBy("digest", "p").agg(F.count("*").alias("c")).groupBy("digest")
    firsts = each.agg(F.min(F.struct(F.col("p").isNull().alias("none"), "p", "c")).alias("x"), F.sum("c").alias("rows"))
    firsts = settle(firsts.where("rows > 1").select("digest", F.col("x.p").alias("first"), F.col("x.c").alias("copies"), "rows"))
    total, twice = firsts.agg(F.sum("rows"), F.max("copies")).first()
    fact = F.struct("first", "copies")
    hot = firsts.where(F.col("rows") * HOT > (total or 0)).select("digest", fact.alias("hot"))
    cold = firsts.where(F.col("rows") * HOT <= (total or 0)).select(F.col("digest").alias("key"), fact.alias("cold"))
    first_of = lambda x: F.col("p").eqNullSafe(x["first"])
    rows = rows.join(F.broadcast(hot), "digest", "left")
    own = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))  # for rows that have nothing to look up
    rows = rows.withColumns({"key": F.when(big & F.col("hot").isNull(), F.col("digest")).otherwise(own), "payload": F.when(F.col("hot").isNull() | first_of(F.col("hot")), F.col("payload"))})
    rows = rows.join(cold, "key", "left").withColumn("x", F.when(big, F.coalesce("hot", "cold"))).drop("key", "hot", "cold")
    is_first = F.col("x").isNull() | first_of(F.col("x"))
    if (twice or 0) > 1:  # repeated rows of the first id: numbered in a written table, so that one of them is the first for good
        doubtful = first_of(F.col("x")) & (F.col("x.copies") > 1)
        some = settle(rows.where(F.coalesce(doubtful, F.lit(False))).withColumn("i", F.monotonically_increasing_id()))
        one = some.groupBy("digest").agg(F.min("i").alias("i")).select("i", F.lit(True).alias("one"))
        sure = rows.where(~F.coalesce(doubtful, F.lit(False))).withColumn("response", is_first)
        rows = sure.unionByName(some.join(one, "i", "left").withColumn("response", F.col("one").isNotNull()).drop("i", "one"))
    else:
        rows = rows.withColumn("response", is_first)
    kind = F.when(F.col("response"), "response").otherwise("revisit")
    return rows.select(F.col("p").cast("string").alias("page_id"), "url", F.when(F.col("response"), F.col("payload")).alias("payload"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), kind.alias("record_type"), F.col("x.first").cast("string").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, html: str = "html", url: str = "url", least: int = 100, **options) -> None:
    """The pages as bundles under path. A null html is an empty payload; page ids of any type are kept as text."""
    register(pages.sparkSession)
    small_batches(pages)
    archive_rows(pages, html, url, least).write.format("warc_bundles").options(**options).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """All records: record_id, page_id (as text), url, record_type, payload_bytes, payload_digest, refers_to, and payload of responses."""
    register(spark)
    return spark.read.format("warc_bundles").option("payload", str(payload).lower()).load(path)


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """record_id, bundle, frame, offset, length of all records, read from the bundles' index frames."""
    names = _bundles(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = _folder(name)
                with fs.open_input_file(at) as f:
                    index = Seekable(f).index()
                ids = [str(uuid.UUID(int=(int(h) << 64) + int(x))) for h, x in zip(index["hi"], index["lo"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([name] * len(ids)), *[pa.array(index[c].astype(np.int64)) for c in ("frame", "offset", "length")]], names=["record_id", "bundle", "frame", "offset", "length"])

    listed = spark.createDataFrame([(n,) for n in names], "bundle string").repartition(max(1, len(names)))
    return listed.mapInArrow(run, "record_id string, bundle string, frame long, offset long, length long")


def fetch(wanted: DataFrame, path: str) -> DataFrame:
    """The records of wanted (record_id) with their payloads; each frame that holds any is decompressed once."""
    places = wanted.select("record_id").distinct().join(record_index(wanted.sparkSession, path), "record_id")
    by_frame = places.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = _folder(row["bundle"])
                with fs.open_input_file(at) as f:
                    data = Seekable(f).frame(row["frame"])
                yield _batch([_row(*parsed(data, o)[:2], True) for o in row["offsets"]], True)

    return by_frame.mapInArrow(run, FOUND + ", payload binary")


def op11_warc(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as its record in the archives says.

    The archives are written first, by default into the shared folder. An empty table gives an empty archive and result.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    own: Column = F.col("page_id").cast(kind)
    return read_archives(spark, path).select(own.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
