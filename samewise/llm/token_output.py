"""Token ids of documents as Simple-8b segments in ascending order of document id, and their reader.

A table of segments is Parquet, so Spark's committers and any file system it knows serve it; the cell
``payload`` of a segment is self-contained (little-endian):

    magic "S8T1", n_docs u32, n_ids u64, n_blocks u32, n_words u32,
    document ids i64[n_docs], null marks u8[n_docs], id counts u32[n_docs],
    word offsets of the blocks u32[n_blocks + 1], words u64[n_words]
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm import simple8b
from samewise.operators.shared import arrow_rows, starts

MAGIC = b"S8T1"
_HEAD = struct.Struct("<4sIQII")
#: A segment is closed when it has this many ids, after a whole document.
SEGMENT_IDS = 1 << 19
SEGMENTS = "part int, segment int, start_in_part long, n_docs int, n_ids long, payload binary"


def pack_segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = simple8b.encode(ids)
    null = np.array([x is None for x in doc_ids], "u1")
    return b"".join(
        (
            _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(offsets) - 1, len(words)),
            np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
            null.tobytes(),
            counts.astype("<u4").tobytes(),
            offsets.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
        )
    )


def unpack_segment(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, id counts, all ids)."""
    magic, docs, n, blocks, n_words = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, null, counts = take("<i8", docs), take("u1", docs), take("<u4", docs)
    offsets, words = take("<u4", blocks + 1), take("<u8", n_words)
    ids = simple8b.decode(words, offsets, n)
    return [None if z else int(x) for x, z in zip(doc_ids, null, strict=True)], counts, ids


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes every whole text, adds ``end_id`` and writes segments to ``path`` in ascending ``id_col`` order.

    A null or empty text gives ``end_id`` alone; rows with a null id come first; rows that repeat an id are
    all written, in the order of a hash of their texts; an empty table writes no segment. Other columns
    are not read. Texts cross the network once, to range partitions; ids are made after that.
    """
    arrow_rows(docs.sparkSession, 2000)
    id_, text = docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")
    laid = docs.select(id_, text).repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from samewise.llm.tokens import encoder

        enc = encoder(tokenizer_path)
        part, segment, start, held, names, counts, arrays = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def close():
            payload = pack_segment(names, np.concatenate(counts), np.concatenate(arrays))
            cols = [[part], [segment], [start], [len(names)], [held], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SEGMENTS.split(", ")])

        for b in batches:
            ids, many = enc.batch(b.column(1), end_id)
            ends, own, i = np.concatenate([[0], np.cumsum(many)]), b.column(0).to_pylist(), 0
            while i < len(own):
                j = min(len(own), int(np.searchsorted(ends, ends[i] + segment_ids - held)))
                names += own[i:j]
                counts.append(many[i:j])
                arrays.append(ids[ends[i] : ends[j]])
                held += int(ends[j] - ends[i])
                if held >= segment_ids:
                    yield close()
                    segment, start, held, names, counts, arrays = segment + 1, start + held, 0, [], [], []
                i = j
        if names:
            yield close()

    laid.mapInArrow(run, SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids binary, little-endian unsigned 32-bit; start: ids of all documents before."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    before = starts(segments.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "n")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part, start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                names, counts, ids = unpack_segment(payload.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                data = pa.py_buffer(ids.astype("<u4").tobytes())
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype("<i8").tobytes()), data]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), part, "i4")), pa.array(names, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts.astype("i8")), cells], ["part", "doc_id", "start", "n_tokens", "ids"])

    arrow_rows(spark, 500)
    rows = segments.select("part", "start_in_part", "payload").mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids binary")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids")
