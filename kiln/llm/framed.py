"""Token files of independent zstandard frames with a seek table.

File layout (all integers little-endian):

    frame 0 | frame 1 | ... | seek table | footer
    seek table: for each frame  n_docs u32, n_tokens u64, offset u64, length u32, crc32 u32,
                then for each document  n_tokens u32
    footer:     n_frames u32, n_docs u64, table offset u64, crc32 of the table u32, magic "KTF1"

A frame holds the uint32 ids of consecutive documents, compressed by itself; its
crc32 is that of the uncompressed ids. A reader fetches the footer and the table,
then only the frames that hold the documents asked for.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import query, read, saved, shared_path

MAGIC = b"KTF1"
FOOTER = struct.Struct("<IQQI4s")
ENTRY = np.dtype([("docs", "<u4"), ("tokens", "<u8"), ("offset", "<u8"), ("length", "<u4"), ("crc", "<u4")])
FRAME_TOKENS = 1 << 18
#: Chunks a worker remembers (beyond that it starts anew), and chunks encoded in one call.
MEMO_CHUNKS, LOT = 800_000, 200


class ChunkedTokenizer:
    """A byte-level tokenizer that remembers the ids of chunks.

    Where a single blank or newline stands between two other characters, the
    tokenizer always cuts before it (a blank joins what follows, a newline stands
    alone), so what lies between such places is encoded once and remembered.
    Texts with other white space or special strings go to the library whole.
    """

    def __init__(self, path: str):
        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        self.tok = tok
        self.special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.newline = int(np.frombuffer(self.raw(["\n"])[0], dtype="<u4")[0])
        self.memo: dict[str, bytes | None] = {}  # None: odd, its text goes whole

    def raw(self, texts: list[str]) -> list[bytes]:
        got = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    @staticmethod
    def odd(chunk: str) -> bool:
        """Is it empty, or does it hold white space beyond its leading newline?"""
        body = chunk.removeprefix("\n")
        return body.split() != [body]

    def learn(self, chunks: list[str], before: str, prefix: bytes) -> None:
        """Remember chunks, encoded in lots that a newline separates."""
        for i in range(0, len(chunks), LOT):
            lot = chunks[i : i + LOT]
            text = "\n".join([before + c.removeprefix("\n") for c in lot])
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            data = ids.tobytes()
            ends = np.flatnonzero(ids == self.newline).tolist()
            self.memo.update(
                (c, prefix + data[4 * x : 4 * y]) for c, x, y in zip(lot, [0, *[e + 1 for e in ends]], [*ends, len(ids)], strict=True)
            )

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.memo) > MEMO_CHUNKS:
            self.memo = {}
        # A chunk begins with a newline or, unwritten, with a blank; the first one gets a newline to be dropped.
        plain = [t and not any(s in t for s in self.special) for t in texts]
        cut = [("\n" + t).replace("\n", " \n").split(" ")[1:] if p else None for t, p in zip(texts, plain)]
        known = self.memo.__contains__  # asked chunk by chunk: a set less the memo's keys walks through the whole memo
        new = set(itertools.filterfalse(known, set().union(*[c for c in cut if c])))
        odd = [c for c in new if self.odd(c)]
        self.memo.update(dict.fromkeys(odd))
        new.difference_update(odd)
        self.learn([c for c in new if c[0] != "\n"], " ", b"")
        self.learn([c for c in new if c[0] == "\n"], "", self.newline.to_bytes(4, "little"))
        get, out = self.memo.__getitem__, []
        for t, c in zip(texts, cut):
            try:
                out.append(b"".join(map(get, c))[4:] if c else b"" if not t else None)
            except TypeError:
                out.append(None)
        whole = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(whole, self.raw([texts[i] for i in whole])):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkedTokenizer:
    return ChunkedTokenizer(path)


class FrameWriter:
    """Appends documents' ids; frames close at ``frame_tokens`` (a long document may fill more alone)."""

    def __init__(self, out, frame_tokens: int = FRAME_TOKENS):
        self.out, self.most = out, frame_tokens
        self.packer = zstandard.ZstdCompressor(level=1, write_checksum=False)
        self.frames: list[tuple] = []
        self.lengths: list[int] = []
        self.buffer: list[bytes] = []
        self.held = self.at = 0

    def add(self, ids: bytes) -> None:
        self.buffer.append(ids)
        self.lengths.append(len(ids) // 4)
        self.held += len(ids) // 4
        if self.held >= self.most:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            data = b"".join(self.buffer)
            packed = self.packer.compress(data)
            self.out.write(packed)
            self.frames.append((len(self.buffer), len(data) // 4, self.at, len(packed), zlib.crc32(data)))
            self.at += len(packed)
            self.buffer, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = np.array(self.frames, dtype=ENTRY).tobytes() + np.array(self.lengths, dtype="<u4").tobytes()
        self.out.write(table)
        self.out.write(FOOTER.pack(len(self.frames), len(self.lengths), self.at, zlib.crc32(table), MAGIC))


class FrameReader:
    """Reads single documents or frames of a file opened for random access."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n_frames, n_docs, at, crc, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        table = self._get(at, size - FOOTER.size - at)
        if magic != MAGIC or zlib.crc32(table) != crc:
            raise ValueError("not a whole token file")
        self.frames = np.frombuffer(table, dtype=ENTRY, count=n_frames)
        self.lengths = np.frombuffer(table, dtype="<u4", offset=n_frames * ENTRY.itemsize, count=n_docs)
        self.first_doc = np.r_[0, np.cumsum(self.frames["docs"], dtype=np.int64)]

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> list[np.ndarray]:
        """The documents of frame ``k``; a wrong checksum raises."""
        f = self.frames[k]
        data = zstandard.ZstdDecompressor().decompress(
            self._get(int(f["offset"]), int(f["length"])), max_output_size=int(f["tokens"]) * 4
        )
        if zlib.crc32(data) != f["crc"]:
            raise ValueError(f"frame {k} is damaged")
        ids = np.frombuffer(data, dtype="<u4")
        ends = np.cumsum(self.lengths[self.first_doc[k] : self.first_doc[k + 1]], dtype=np.int64)
        return np.split(ids, ends[:-1]) if len(ends) else []

    def document(self, i: int) -> np.ndarray:
        """Ids of document ``i``; only its frame is fetched and unpacked."""
        k = int(np.searchsorted(self.first_doc, i, side="right")) - 1
        return self.frame(k)[i - int(self.first_doc[k])]


def open_fs(path: str):
    """``(file system, path in it)`` for local folders and the stores that Arrow knows."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def write_token_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """Encode whole texts and write them in ascending id order, one file a partition.

    Documents are range-partitioned and sorted by id (nulls first; repeated rows
    are all written; a null text has no ids but the end id). Returns the manifest
    ``part, file, n_docs, n_tokens``, saved. A file is written under a name of the
    attempt and the manifest names only files that were finished, so a task that
    runs again leaves no half file behind a name in use.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    key = docs.schema[id_col].dataType
    base, root = open_fs(folder)
    base.create_dir(root, recursive=True)

    def run(batches):
        ctx = TaskContext.get()
        part, enc = ctx.partitionId(), _tokenizer(vocabulary)
        target, top = open_fs(folder)
        name = f"tokens-{part:06d}-{uuid.uuid4().hex}.ktf"
        writer = sink = ids_writer = None
        tokens = 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                if writer is None and s.num_rows:
                    sink = target.open_output_stream(f"{top}/{name}")
                    writer = FrameWriter(sink)
                    ids_sink = target.open_output_stream(f"{top}/{name}.ids")
                    ids_writer = pa.ipc.new_stream(ids_sink, pa.schema([s.schema.field(id_col)]))
                for ids in enc.encode(s.column(text_col).to_pylist()):
                    writer.add(ids + end)
                    tokens += (len(ids) + len(end)) // 4
                ids_writer.write_batch(pa.RecordBatch.from_arrays([s.column(id_col)], schema=pa.schema([s.schema.field(id_col)])))
        if writer is not None:
            writer.close()
            sink.close()
            ids_writer.close()
            ids_sink.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "file": [name],
                    "n_docs": pa.array([len(writer.lengths)], pa.int64()),
                    "n_tokens": pa.array([tokens], pa.int64()),
                }
            )

    assert key is not None
    ordered = docs.select(id_col, text_col).repartitionByRange(n, F.col(id_col)).sortWithinPartitions(id_col)
    return saved(ordered.mapInArrow(run, "part int, file string, n_docs long, n_tokens long"))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    The manifest has a row per file; their running token counts are the only
    thing that passes through the driver.
    """
    files = sorted(manifest.collect(), key=lambda r: r["part"])
    starts, total = [], 0
    for r in files:
        starts.append((r["file"], total))
        total += r["n_tokens"]
    listed = spark.createDataFrame(starts or [], "file string, start long").repartition(max(1, len(starts)), "file")

    def run(pdfs):
        source, top = open_fs(folder)
        for pdf in pdfs:
            for name, start in zip(pdf["file"], pdf["start"]):
                with source.open_input_file(f"{top}/{name}.ids") as f:
                    doc_ids = pa.ipc.open_stream(f).read_all().column(0).to_pylist()
                with source.open_input_file(f"{top}/{name}") as f:
                    reader, at, i = FrameReader(f), int(start), 0
                    for k in range(len(reader.frames)):
                        rows = []
                        for ids in reader.frame(k):
                            rows.append((doc_ids[i], at, len(ids), zlib.crc32(ids.tobytes())))
                            at += len(ids)
                            i += 1
                        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                        out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64") if id_type == "long" else out["doc_id"]
                        yield out

    return listed.mapInPandas(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


@query("op10_token_files")
def op10(spark, sf_dir):
    """All ``documents`` tokenized, written as token files in the shared folder, and read back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = shared_path(spark, "tokens")
    manifest = write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder, manifest)
