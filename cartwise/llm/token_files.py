"""Token ids as flat binary files with document offsets.

Documents are dealt by range of their id, so a partition's file follows the one
before it.  A task encodes its documents in order and writes three files: the
ids as flat little-endian unsigned integers, the 64-bit offsets of its
documents, and the documents' ids.  It reports one row; the prefix sums of those
rows are the partitions' bases, and the manifest that holds them is written last.
Readers follow the manifest and map the files into memory.

Layout below ``path``: ``<name>.tok`` (uint16, or uint32 for a vocabulary beyond
65,536), ``<name>.off`` (int64, n + 1 of them, relative to the file),
``<name>.ids`` (Arrow, column ``doc_id``) and ``manifest`` (Parquet: part, name,
width, n_docs, n_tokens, base).  A name carries the attempt that wrote it: a task
that runs twice leaves a file that no manifest names.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bound, ship_package
from .text_bytes import column_bytes
from .token_count import split_before_blanks, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
PART_BYTES = 1 << 20            # of a text, encoded at once
MEMO_BYTES = 1 << 25            # of chunks whose ids a worker remembers
CRC_TOKENS = 1 << 20
MANIFEST = "part int, name string, width int, n_docs long, n_tokens long, base long"


class Encoder:
    """A tokenizer of the ``tokenizers`` library, with a memo of chunks.

    Where the tokenizer drops white space, what stands between it is encoded
    independently of its neighbours; such chunks are sent to the library once
    and then looked up.  Other tokenizers get the text in parts that nothing
    merges across.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path(name))
        self.tok.no_truncation()
        self.tok.no_padding()
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        a, b, both = (self._ids([t])[0] for t in ("x", "y", " x \t\n y "))
        self.apart = both == a + b
        self._forget()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = self.held = 0

    def _learn(self, chunks: list[bytes]) -> None:
        for at in range(0, len(chunks), 4096):
            some = chunks[at:at + 4096]
            for c, ids in zip(some, self._ids([c.decode("utf-8", "replace") for c in some])):
                k, n = len(self.codes), len(ids)
                if k == len(self.starts):
                    self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)])
                                               for x in (self.starts, self.sizes))
                if self.used + n > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + n, np.uint32)])
                self.flat[self.used:self.used + n] = ids
                self.codes[c], self.starts[k], self.sizes[k] = k, self.used, n
                self.used += n
                self.held += len(c) + 8

    def _part(self, data: bytes) -> np.ndarray:
        """Ids of a part that starts and ends at white space or a text's end."""
        chunks = data.split()
        if not chunks:
            return np.zeros(0, np.uint32)
        if self.held > MEMO_BYTES:
            self._forget()
        which = np.fromiter(map(self.codes.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(which < 0)
        if len(new):
            missing = [chunks[i] for i in new]
            self._learn(list(set(missing)))
            which[new] = [self.codes[c] for c in missing]
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[which] - (ends - sizes), sizes)
        return self.flat[shift + np.arange(int(ends[-1]))]

    def parts(self, data: bytes):
        """Ids of one text as arrays, one a part."""
        if not self.apart:
            for p in split_before_blanks(data.decode("utf-8", "replace")):
                yield np.array(self._ids([p])[0], np.uint32)
            return
        start = 0
        while len(data) - start > PART_BYTES:
            # a blank or a line end that follows the part's least size
            cuts = [c for c in (data.find(x, start + PART_BYTES) for x in (b" ", b"\n")) if c >= 0]
            if not cuts:
                break
            yield self._part(data[start:min(cuts)])
            start = min(cuts)
        yield self._part(data[start:])


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def opened(path: str):
    """(file system, path in it); local files are mapped into memory when read."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(use_mmap=True), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(use_mmap=True), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id",
                      text_col: str = "text", tokenizer: str = TOKENIZER,
                      end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the files below
    ``path``, a folder that all machines see (a local or mounted path, or a
    store that Arrow opens).  Returns the manifest, one row a file.

    Documents stand in ascending order of ``id_col``, nulls last; rows of one id
    by a hash of their text, and rows equal in both in any order.  A null text
    is empty: its end id only.  An empty table gives a manifest without rows.
    Other columns are not read.  Rows of one id may lie in many partitions, so
    no id is too frequent; a task holds a part of one text at a time.  ``parts``
    is the number of files (the session's shuffle partitions by default).
    """
    spark = df.sparkSession
    ship_package(spark)
    arrow_bound(spark)
    root = path.rstrip("/")
    store, inside = opened(root)
    store.create_dir(inside, recursive=True)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("salt")]
    dealt = (df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
             .withColumns({"h": F.xxhash64("text"), "salt": F.rand(11)})
             .repartitionByRange(parts, *order).sortWithinPartitions(*order)
             .select("doc_id", "text"))

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs_, folder = opened(root)
        fs_.create_dir(folder, recursive=True)
        kind = f"<u{enc.width}"
        n_docs = n_tokens = 0
        with fs_.open_output_stream(f"{folder}/{name}.tok") as tok, \
                fs_.open_output_stream(f"{folder}/{name}.off") as off, \
                fs_.open_output_stream(f"{folder}/{name}.ids") as ids_file:
            off.write(np.zeros(1, "<i8").tobytes())
            ids_out = None
            for b in batches:
                if ids_out is None:
                    ids_out = pa.ipc.new_file(ids_file, pa.schema([("doc_id", b.schema[0].type)]))
                data, ends = column_bytes(b.column(1))
                offsets = np.zeros(b.num_rows, "<i8")
                for i in range(b.num_rows):
                    for x in enc.parts(data[ends[i]:ends[i + 1]].tobytes()):
                        tok.write(x.astype(kind).tobytes())
                        n_tokens += len(x)
                    tok.write(np.array([end_id], kind).tobytes())
                    n_tokens += 1
                    offsets[i] = n_tokens
                n_docs += b.num_rows
                off.write(offsets.tobytes())
                ids_out.write_batch(pa.RecordBatch.from_arrays([b.column(0)], names=["doc_id"]))
            if ids_out is not None:
                ids_out.close()
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "name": [name],
             "width": pa.array([enc.width], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()),
             "n_tokens": pa.array([n_tokens], pa.int64())})

    # one row a file comes to the driver
    done = dealt.mapInArrow(write, MANIFEST.rpartition(",")[0]).collect()
    rows, base = [], 0
    for r in sorted((r for r in done if r.n_docs), key=lambda r: r.part):
        rows.append((*r, base))
        base += r.n_tokens
    # what a failed attempt or an empty partition left
    from pyarrow import fs as arrow_fs
    names = {r[1] for r in rows}
    for info in store.get_file_info(arrow_fs.FileSelector(inside)):
        if info.is_file and info.base_name.rpartition(".")[0] not in names:
            store.delete_file(info.path)
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_token_files(spark: SparkSession, path: str, id_type: T.DataType | str = "long",
                     tokens: bool = False) -> DataFrame:
    """One row per document of the files below ``path``: doc_id, start (ids
    before it in all files), n_tokens (with the end id), ids_crc32 (of the ids
    as little-endian unsigned 32-bit integers) and, with ``tokens``, the ids as
    an array of long.  One task a file, which is mapped, not loaded."""
    ship_package(spark)
    root = path.rstrip("/")
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    n = max(1, manifest.count())
    kind = T._parse_datatype_string(id_type) if isinstance(id_type, str) else id_type
    fields = [T.StructField("doc_id", kind)] + [
        T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]
    if tokens:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def read(batches):
        import pyarrow as pa

        fs_, folder = opened(root)
        for b in batches:
            for r in b.to_pylist():
                at = f"{folder}/{r['name']}"
                with fs_.open_input_file(f"{at}.tok") as tok, \
                        fs_.open_input_file(f"{at}.off") as off, \
                        fs_.open_input_file(f"{at}.ids") as ids_file:
                    done = 0
                    names = pa.ipc.open_file(ids_file)
                    for k in range(names.num_record_batches):
                        yield from block(names.get_batch(k).column(0), done, tok, off, r)
                        done += names.get_batch(k).num_rows

    def block(ids, first, tok, off, r):
        import pyarrow as pa

        n_rows, width = len(ids), r["width"]
        ends = np.frombuffer(off.read_at(8 * (n_rows + 1), 8 * first), "<i8")
        crcs, lists = np.zeros(n_rows, np.int64), []
        for i in range(n_rows):
            crc = 0
            for s in range(int(ends[i]), int(ends[i + 1]), CRC_TOKENS):
                e = min(s + CRC_TOKENS, int(ends[i + 1]))
                x = np.frombuffer(tok.read_at(width * (e - s), width * s), f"<u{width}")
                crc = zlib.crc32(x.astype("<u4").tobytes(), crc)
            crcs[i] = crc
            if tokens:
                raw = tok.read_at(width * int(ends[i + 1] - ends[i]), width * int(ends[i]))
                lists.append(np.frombuffer(raw, f"<u{width}").astype(np.int64))
        cols = {"doc_id": ids, "start": pa.array(ends[:-1] + r["base"], pa.int64()),
                "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids_crc32": pa.array(crcs)}
        if tokens:
            cols["ids"] = pa.array(lists, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_pydict(cols)

    return manifest.repartition(n).mapInArrow(read, T.StructType(fields))
