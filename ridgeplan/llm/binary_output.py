"""Token-ID output: seekable files of independent zstandard frames.

File format (little endian), one file per shard of consecutive ``doc_id`` order:

* one zstandard frame per document: its token ids as unsigned 32-bit integers;
* a zstandard *skippable* frame (magic 0x184D2A5E) that holds the seek table: per frame
  ``doc_id int64, is_null uint8, n_tokens uint32, compressed uint32, crc32 uint32`` and the
  footer ``n_frames uint32, crc32 of the table uint32, magic "RPSEEK01"``.

Plain zstandard tools can still decompress a whole file.  A reader loads only the table
at the end, then the frames of the documents that it was asked for; each frame's
checksum is the crc32 of its decompressed bytes.

Writing: documents are range-partitioned on ``doc_id`` and sorted inside partitions
(spilling sorts of Spark), so that a shard is one partition's run of documents.  A task
writes under a name of its own attempt and renames the file when it is whole; the
manifest, which Spark commits, names only files of successful attempts, so a lost
executor or a speculative copy leaves at most an unused file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeplan.llm.common import id_and_text
from ridgeplan.llm.tokens import encoder
from ridgeplan.runtime import materialize, new_path

SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, b"RPSEEK01"
ENTRY = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("n_tokens", "<u4"), ("compressed", "<u4"), ("crc32", "<u4")])
FOOTER = struct.Struct("<II8s")
#: Tasks that read files back, at most.
MOST_TASKS = 20_000

MANIFEST = "path string, first_doc long, n_docs long, n_tokens long"
TOKENS = "path string, pos long, doc_id long, start long, n_tokens long, ids_crc32 long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a folder such as ``file:///shared`` or ``hdfs://host/x``."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class ShardWriter:
    """One file in the making."""

    def __init__(self, folder: str, level: int) -> None:
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"shard-{uuid.uuid4().hex}.zst"
        self.folder, self.base = folder, base
        self.out = self.fs.open_output_stream(f"{base}/.{self.name}.tmp")
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True).compress
        self.entries: list[tuple] = []
        self.tokens = self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.tobytes()
        frame = self.compress(raw)
        self.out.write(frame)
        self.entries.append((doc_id or 0, doc_id is None, len(ids), len(frame), zlib.crc32(raw)))
        self.tokens += len(ids)
        self.size += len(frame)

    def close(self) -> tuple[str, int, int, int]:
        table = np.array(self.entries, ENTRY).tobytes()
        tail = table + FOOTER.pack(len(self.entries), zlib.crc32(table), SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(tail)) + tail)
        self.out.close()
        self.fs.move(f"{self.base}/.{self.name}.tmp", f"{self.base}/{self.name}")
        return f"{self.folder}/{self.name}", self.entries[0][0], len(self.entries), self.tokens


class ShardReader:
    """Random access to one file; ``read`` decompresses the frames asked for only."""

    def __init__(self, path: str) -> None:
        fs, inner = file_system(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        n, crc, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{path}: no seek table")
        table = self._at(size - FOOTER.size - n * ENTRY.itemsize, n * ENTRY.itemsize)
        if zlib.crc32(table) != crc:
            raise ValueError(f"{path}: damaged seek table")
        self.table = np.frombuffer(table, ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.table["compressed"], dtype=np.int64)])
        self.decompress = zstandard.ZstdDecompressor().decompress
        self.path = path

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def read(self, k: int) -> np.ndarray:
        entry = self.table[k]
        raw = self.decompress(self._at(int(self.starts[k]), int(entry["compressed"])))
        if zlib.crc32(raw) != entry["crc32"]:
            raise ValueError(f"{self.path}: damaged frame {k}")
        return np.frombuffer(raw, "<u4")

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Encode every text, append ``end_id``, write the files; returns the manifest.

    The manifest (path, first_doc, n_docs, n_tokens, start) is one row per file in
    ascending order of documents; ``start`` counts the ids in all files before it.
    Null text: empty (its document is the end id alone).  A null id sorts first.
    Repeated ids stay as rows of their own, ordered by a hash of the text.  Empty input: no files.
    ``folder`` must be reachable from every executor.  A partition's files end at about
    ``shard_bytes`` of compressed frames.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    # the range keys are longs: Spark samples them to the driver, and equal ids still spread
    keyed = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("row_no", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(n, "doc_id", "text_hash", "row_no").sortWithinPartitions("doc_id", "text_hash", "row_no").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = encoder(tokenizer).ids, np.array([end_id], "<u4")
        done, shard = [], None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = shard or ShardWriter(folder, level)
                shard.add(doc_id, np.concatenate([ids_of(text or ""), end]))
                if shard.size >= shard_bytes:
                    done.append(shard.close())
                    shard = None
        if shard:
            done.append(shard.close())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else [[]] * 4, [pa.string(), *[pa.int64()] * 3], strict=True)], ["path", "first_doc", "n_docs", "n_tokens"])

    # which partition, and which file of it, gives the order of files even where ids repeat
    written = ordered.mapInArrow(write, MANIFEST).withColumn("ord", F.monotonically_increasing_id())
    manifest = materialize(written, "token-manifest")
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file of tens of MB: this window is over files, not over documents
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("ord")


def read_token_files(manifest: DataFrame, doc_ids: frozenset[int] | None = None) -> DataFrame:
    """Rows of the documents in the files, or of those in ``doc_ids`` only (then no other frame is read).

    path, pos (place in the file), doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids' bytes, checked against the frame's checksum).
    Files are dealt out to one task each (up to ``MOST_TASKS``), whatever the manifest's size.
    """
    tasks = min(MOST_TASKS, max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = ShardReader(path)
                table = reader.table
                starts = start + np.concatenate([[0], np.cumsum(table["n_tokens"], dtype=np.int64)])
                for low in range(0, len(table), 8192):
                    out = []
                    for k in range(low, min(low + 8192, len(table))):
                        doc_id = None if table["is_null"][k] else int(table["doc_id"][k])
                        if doc_ids is None or doc_id in doc_ids:
                            ids = reader.read(k)
                            out.append((path, k, doc_id, int(starts[k]), len(ids), zlib.crc32(ids.tobytes())))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, [pa.string(), *[pa.int64()] * 5], strict=True)], ["path", "pos", "doc_id", "start", "n_tokens", "ids_crc32"])
                reader.close()

    # a stated number, which adaptive execution does not lower: the manifest is tiny, its files are not
    spread = manifest.select("path", "start").repartition(tasks, "path")
    return spread.mapInArrow(read, TOKENS)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids from the written files: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, new_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
