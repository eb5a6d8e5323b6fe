"""Operator 6: token ids as a binary file of compressed bit planes.

Documents are dealt out by ranges of ``doc_id`` and sorted, encoded by the
tokenizers library (each distinct unit of text once per worker), closed with an
end id, and gathered into segments of whole documents.  The ids of a segment
are cut into blocks of a fixed number of ids.  A block is transposed: plane k
holds bit (or byte) k of all its ids, so that high planes are almost constant;
each plane is compressed with zstandard.

File format: a Parquet dataset, one row per segment.  Spark's writer commits
whole files, so lost executors leave nothing behind, and any store that Spark
reaches will do.

| column | meaning |
|---|---|
| part, segment | place in the order of doc_id |
| n_ids | ids in the segment |
| doc_ids, doc_lengths | documents in order, with their end ids |
| block_ids, plane_bytes | chunk index: ids per block, bytes per plane |
| planes | the compressed planes, block after block |

The index columns are read without the planes (column pruning), which is how
the first position of every segment is found: running sums within a part and
over the parts, whose number is that of the shuffle partitions.

Defined results: NULL or empty text: the end id alone.  NULL ``doc_id`` comes first; equal
ids stand next to each other, ordered by text.  A very long document makes one long segment.
An empty table gives an empty file and result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.bpe import slices, vocabulary_path
from tidepanel.llm.common import of_stage, partitions_for, shared_path
from tidepanel.llm.words import CODES, span_names

END_ID = 0
LIBRARY_UNITS = 200_000
JOINED = 64  # units that the library gets as one text
BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 19
LEVEL = 3
SCHEMA = (
    "part int, segment int, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, "
    "block_ids array<int>, plane_bytes array<int>, planes binary"
)
_ARROW = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())),
     ("block_ids", pa.list_(pa.int32())), ("plane_bytes", pa.list_(pa.int32())), ("planes", pa.binary())]
)


# Bytes after which a space may be cut off: no white space, nor the first byte of any beyond ASCII.
_VISIBLE = np.ones(256, bool)
_VISIBLE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False
_SHOWN = np.zeros(256, bool)
_SHOWN[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?)$%&*#")] = True


class LibraryEncoder:
    """The tokenizers library with a bounded cache of units: the same ids as whole texts would give.

    Texts are cut where the library's words always end: before a space that a visible byte
    follows, between a letter and a closing mark, and around single line feeds.  Units are named by 64 bits, and each distinct unit of a run of texts is looked up
    once; the ids are put together by index arithmetic.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # A mark that an added token holds is no place to cut.
        self.closing = _CLOSING.copy()
        self.closing[list("".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values()).encode())] = False
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = {i: len(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()} | added
        self.token_bytes = np.zeros(max(vocabulary) + 1, np.int64)  # in a byte-level vocabulary every character is a byte
        self.token_bytes[list(vocabulary)] = list(vocabulary.values())
        # Two generations: when the younger is full it becomes the older, and what is asked for again moves back.
        self.known: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}

    def _fresh(self, units: list[str], sizes: np.ndarray, joinable: np.ndarray) -> list[bytes]:
        """Ids of units; those that begin with a space and a visible byte are joined, as words end before such a space in any text.

        The tokens' byte lengths tell where the units of a joined text end.
        """
        found: list = [None] * len(units)
        alone, together = np.flatnonzero(~joinable).tolist(), np.flatnonzero(joinable)
        shares = [together[at : at + JOINED] for at in range(0, len(together), JOINED)]
        texts = ["".join([units[k] for k in share.tolist()]) for share in shares]
        for share, e in zip(shares, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids, ends = np.array(e.ids, "<u4"), np.cumsum(sizes[share])
            upto = np.cumsum(self.token_bytes[ids])
            last = np.searchsorted(upto, ends)
            if not len(upto) or last[-1] != len(upto) - 1 or (upto[last] != ends).any():  # not byte-level: one by one
                alone += share.tolist()
                continue
            raw, cuts = ids.tobytes(), ((last + 1) * 4).tolist()
            for k, a, b in zip(share.tolist(), [0, *cuts], cuts):
                found[k] = raw[a:b]
        for at in range(0, len(alone), 20_000):
            some = alone[at : at + 20_000]
            for k, e in zip(some, self.tokenizer.encode_batch_fast([units[k] for k in some], add_special_tokens=False)):
                found[k] = array("I", e.ids).tobytes()
        return found

    def _ids(self, names: list[int], raw: bytes, begins: np.ndarray, sizes: np.ndarray, joinable: np.ndarray) -> list[bytes]:
        """Ids of distinct units as little-endian 32-bit bytes; unit k stands in ``raw`` from ``begins[k]``."""
        if len(self.known) > LIBRARY_UNITS:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, names))
        missing = [k for k, f in enumerate(found) if f is None]
        fresh = []
        for k in missing:
            found[k] = self.older.get(names[k])
            if found[k] is None:
                fresh.append(k)
        at, n = begins[fresh], sizes[fresh]
        units = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(at.tolist(), (at + n).tolist())]
        for k, ids in zip(fresh, self._fresh(units, n, joinable[fresh])):
            found[k] = ids
        self.known.update([(names[k], found[k]) for k in missing])
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        blob = b"".join(encoded)
        raw = np.frombuffer(blob, np.uint8)
        sizes = np.array([len(e) for e in encoded], np.int64)
        bounds = np.cumsum(sizes)
        if not len(raw):
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        cut = np.zeros(len(raw), bool)
        cut[:-1] = (raw[:-1] == 0x20) & _VISIBLE[raw[1:]]
        cut[bounds[sizes > 0] - 1] = False
        before, here = raw[:-1], raw[1:]
        cut[1:] |= (_LETTER[before] & self.closing[here]) | (_SHOWN[before] & (here == 0x0A))
        cut[2:] |= _SHOWN[raw[:-2]] & (raw[1:-1] == 0x0A) & _VISIBLE[raw[2:]]
        cut[(bounds - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        distinct = pa.array(span_names(raw, starts, ends, CODES)).dictionary_encode()
        where = distinct.indices.to_numpy()
        first = np.empty(len(distinct.dictionary), np.int64)
        first[where[::-1]] = np.arange(len(where))[::-1]
        begins, sizes_of = starts[first], ends[first] - starts[first]
        spaced = (raw[begins] == 0x20) & (sizes_of > 1) & _VISIBLE[raw[np.minimum(begins + 1, len(raw) - 1)]]
        found = self._ids(distinct.dictionary.to_pylist(), blob, begins, sizes_of, spaced)
        flat = np.frombuffer(b"".join(found), "<u4")
        lengths = np.array([len(f) for f in found], np.int64) // 4
        begin = np.cumsum(lengths) - lengths
        each = lengths[where]
        upto = np.cumsum(each)
        ids = flat[np.arange(int(upto[-1])) + np.repeat(begin[where] - (upto - each), each)]
        totals = np.concatenate([[0], upto])[np.searchsorted(starts, bounds)]
        return ids, np.diff(totals, prepend=0)


def planes_of(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """Planes of one block, lowest first; planes above the highest bit in use are left out."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    used = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    found = []
    for k in range(used):
        found.append(np.packbits((raw[:, k // 8] >> (k % 8)) & 1).tobytes())
    return found


def ids_of(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if kind == "byte":
            raw[:, k] = np.frombuffer(plane, np.uint8)
        else:
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
    return raw.view("<u4").ravel()


def pack(ids: np.ndarray, kind: str = "bit") -> tuple[list[int], list[int], bytes]:
    """(ids per block, bytes per plane, all planes); every block has 32 (or 4) planes in the index."""
    import zstandard

    press, width = zstandard.ZstdCompressor(level=LEVEL), 32 if kind == "bit" else 4
    block_ids, plane_bytes, out = [], [], []
    for at in range(0, len(ids), BLOCK_IDS):
        block = ids[at : at + BLOCK_IDS]
        planes = [press.compress(p) for p in planes_of(block, kind)]
        block_ids.append(len(block))
        plane_bytes += [len(p) for p in planes] + [0] * (width - len(planes))
        out += planes
    return block_ids, plane_bytes, b"".join(out)


def unpack(block_ids: list[int], plane_bytes: list[int], planes: bytes, kind: str = "bit") -> np.ndarray:
    import zstandard

    press, width, at, out = zstandard.ZstdDecompressor(), 32 if kind == "bit" else 4, 0, []
    view = memoryview(planes)
    for b, n in enumerate(block_ids):
        mine = []
        for size in plane_bytes[b * width : (b + 1) * width]:
            if size:
                mine.append(press.decompress(view[at : at + size]))
                at += size
        out.append(ids_of(mine, n, kind))
    return np.concatenate(out) if out else np.empty(0, "<u4")


def _encode_batches(path: str, kind: str):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_stage(("library", path), lambda: LibraryEncoder(path))
        part, segment = TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        doc_ids, lengths, raw, size = [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(raw), "<u4")
            block_ids, plane_bytes, planes = pack(ids, kind)
            row = [part, segment, len(ids), doc_ids, lengths, block_ids, plane_bytes, planes]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)

        for batch in source:
            for first, run in slices(batch.column(1)):
                ids, sizes = encoder.encode(run)
                at = 0
                for i, n in enumerate(sizes.tolist()):
                    doc_ids.append(batch.column(0)[first + i].as_py())
                    lengths.append(n + 1)
                    raw += [ids[at : at + n].tobytes(), end]
                    at += n
                    size += n + 1
                    if size >= SEGMENT_IDS:
                        yield flush()
                        segment, doc_ids, lengths, raw, size = segment + 1, [], [], [], 0
        if raw:
            yield flush()

    return batches


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, kind: str = "bit") -> None:
    """Encode ``docs`` (doc_id, text) and write the file at ``path``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions_for(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_encode_batches(vocabulary or vocabulary_path(), kind), SCHEMA).write.option("compression", "none").parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, segment and the number of ids before the segment, from the index columns alone."""
    index = spark.read.schema(SCHEMA).parquet(path).select("part", "segment", "n_ids")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("part_ids")).withColumn("part_start", F.coalesce(F.sum("part_ids").over(order), F.lit(0)))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    index = index.withColumn("before", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return index.join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("before")).alias("segment_start"))


def _read_batches(kind: str):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                part, segment, _, doc_ids, lengths, block_ids, plane_bytes, planes = (batch.column(k)[i].as_py() for k in range(8))
                ids = unpack(block_ids, plane_bytes, planes, kind)
                ends = np.cumsum(np.array(lengths, np.int64))
                raw, begins = memoryview(ids.tobytes()), ends - np.array(lengths, np.int64)
                crc = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ends), pa.int32()), pa.array([segment] * len(ends), pa.int32()), pa.array(doc_ids, pa.int64()),
                     pa.array(begins), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "segment", "doc_id", "begin", "n_tokens", "ids_crc32"],
                )

    return batches


def read_documents(spark: SparkSession, path: str, kind: str = "bit") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the file."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    docs = segments.mapInArrow(_read_batches(kind), "part int, segment int, doc_id bigint, begin bigint, n_tokens bigint, ids_crc32 bigint")
    joined = docs.join(starts(spark, path), ["part", "segment"])
    return joined.select("doc_id", (F.col("segment_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, kind: str = "bit") -> DataFrame:
    """doc_id and ids (array of INT, end id included)."""

    def batches(source):
        for batch in source:
            for i in range(batch.num_rows):
                _, _, _, doc_ids, lengths, block_ids, plane_bytes, planes = (batch.column(k)[i].as_py() for k in range(8))
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(unpack(block_ids, plane_bytes, planes, kind).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), ids], names=["doc_id", "ids"])

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(batches, "doc_id bigint, ids array<int>")


def op6_token_file(spark: SparkSession, root: str) -> DataFrame:
    path = shared_path(spark, "token-file")
    write_ids(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text"), path)
    return read_documents(spark, path)
