"""Token ids in a binary store: static range asymmetric numeral system (rANS).

One frequency table, counted over all tokens, is shared by all blocks.  A block
holds consecutive whole documents (at least ``BLOCK_TOKENS`` tokens, but for the
last of a part) and is coded by ``LANES`` interleaved 64-bit states with 32-bit
renormalisation, all lanes at once in numpy.  Each block decodes alone; inside it,
checkpoints (word offset and lane states) let a reader start every
``CHECKPOINT_TOKENS`` tokens; a crc32 of its ids guards it.

The store is a folder: ``blocks`` and ``table`` as Parquet, written by Spark's own
committers, so lost executors leave no torn files.  Parts are ranges of doc_id in
ascending order, and blocks within a part ascend too.

Edge cases: null and empty texts are documents of the end id alone; null ids come
first; repeated ids keep all their rows, ordered by content; an empty table gives an empty
store, which reads back as no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrand.llm.common import bounded_batches, discard, map_batches, materialize, new_path, share, table
from keystrand.llm.tokens import TextEncoder

LANES = 1024
BLOCK_TOKENS = 1 << 18
CHECKPOINT_TOKENS = 1 << 17
SCALE_BITS = 20
_LOW = np.uint64(1 << 31)
_SCALE = np.uint64(SCALE_BITS)
_WORD = np.uint64(32)

BLOCK = "part int, block int, first_token bigint, doc_ids array<{id}>, doc_tokens array<int>, n_tokens int, words binary, states binary, checkpoints array<struct<step:int,word:int,states:binary>>, crc32 bigint"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a total of 2 ** SCALE_BITS, at least 1 for every id that occurs."""
    total, target = counts.sum(), 1 << SCALE_BITS
    if not total:
        return np.zeros_like(counts)
    seen = counts > 0
    out = np.where(seen, np.maximum(1, counts * target // total), 0)
    order = np.argsort(-out, kind="stable")
    over = int(out.sum()) - target
    # rounding is made good on the most frequent ids
    while over:
        for k in order:
            step = min(over, int(out[k]) // 2) if over > 0 else over
            if step == 0 and over > 0:
                break
            out[k] -= step
            over -= step
            if not over:
                break
    return out


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - SCALE_BITS)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, list[dict]]:
        """Words, first states and checkpoints; the last symbol is coded first."""
        steps = -(-len(ids) // LANES)
        state = np.full(LANES, _LOW, np.uint64)
        words: list[np.ndarray] = [np.empty(0, np.uint32)] * steps
        marks: dict[int, bytes] = {}
        for t in range(steps - 1, -1, -1):
            s = ids[t * LANES : (t + 1) * LANES]
            x = state[: len(s)]
            full = x >= self.limit[s]
            words[t] = x[full].astype(np.uint32)
            x = np.where(full, x >> _WORD, x)
            f = self.freq[s]
            q = x // f
            state[: len(s)] = (q << _SCALE) + (x - q * f) + self.start[s]
            if t and t % (CHECKPOINT_TOKENS // LANES) == 0:
                marks[t] = state.tobytes()
        ends = np.cumsum([0, *map(len, words)])
        stream = np.concatenate(words).astype("<u4").tobytes() if words else b""
        return stream, state.tobytes(), [{"step": t, "word": int(ends[t]), "states": marks[t]} for t in sorted(marks)]

    def decode(self, n: int, words: bytes, states: bytes, step: int = 0, word: int = 0) -> np.ndarray:
        """The ids from ``step`` on; a checkpoint's step, word and states start in the middle."""
        stream = np.frombuffer(words, "<u4")
        state = np.frombuffer(states, "<u8").copy()
        steps = -(-n // LANES)
        out = np.empty(n - step * LANES, np.uint32)
        mask = np.uint64((1 << SCALE_BITS) - 1)
        for t in range(step, steps):
            x = state[: min(LANES, n - t * LANES)]
            slot = x & mask
            s = self.symbol[slot]
            x = self.freq[s] * (x >> _SCALE) + slot - self.start[s]
            low = np.flatnonzero(x < _LOW)
            x[low] = (x[low] << _WORD) | stream[word : word + len(low)]
            word += len(low)
            state[: len(x)] = x
            out[(t - step) * LANES : (t - step) * LANES + len(x)] = s
        return out


def token_table(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Every document's ids, written to the shared folder: id, ids (packed), n_tokens."""

    def make():
        encoder = TextEncoder(vocabulary, end_id)

        def fn(batch: pa.RecordBatch) -> dict[str, object]:
            ids = [encoder.encode(t) for t in batch.column(text_col).to_pylist()]
            return {"ids": ids, "n_tokens": [len(x) // encoder.dtype.itemsize for x in ids]}

        return fn

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias(text_col))
    fields = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.IntegerType())]
    return materialize(map_batches(rows, fields, make, drop=(text_col,)), "tokens")


def id_counts(tokens: DataFrame, dtype: str, size: int, once: bool = False) -> dict[int, int]:
    """How often each id occurs (``once``: in how many rows), over all rows; at most ``size`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        last = np.zeros(size, np.int64)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if not once:
                total += np.bincount(np.frombuffer(b"".join(rows), dtype), minlength=size)
                continue
            for row in rows:
                ids = np.frombuffer(row, dtype)
                at = np.arange(len(ids))
                # of the places of an id one is the last to be written
                last[ids] = at
                total[ids[last[ids] == at]] += 1
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k])], names=["id", "n"])

    bounded_batches(tokens.sparkSession)
    rows = tokens.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in rows.collect()}


def write_store(docs: DataFrame, vocabulary: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the store at ``path``."""
    spark = docs.sparkSession
    encoder = TextEncoder(vocabulary, end_id)
    size, dtype = max(encoder.library.get_vocab_size(), end_id + 1), encoder.dtype.str
    tokens = token_table(docs, vocabulary, end_id, id_col, text_col)
    counts = np.zeros(size, np.int64)
    for k, n in id_counts(tokens, dtype, size).items():
        counts[k] = n
    freq = frequencies(counts)
    spark.createDataFrame([(int(k), int(freq[k])) for k in np.flatnonzero(freq)], "id int, freq int").coalesce(1).write.parquet(f"{path}/table")
    shared = share(spark, freq)
    schema = BLOCK.format(id=tokens.schema["id"].dataType.simpleString())
    empty = spark.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty.schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(shared()), TaskContext.get().partitionId()
        names: list[object] = []
        packed: list[bytes] = []
        block = first = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held
            ids = np.frombuffer(b"".join(packed), dtype)
            words, states, marks = coder.encode(ids)
            width = np.dtype(dtype).itemsize
            row = [part, block, first, list(names), [len(x) // width for x in packed], len(ids), words, states, marks, zlib.crc32(ids.astype("<u4").tobytes())]
            block, first, held = block + 1, first + len(ids), 0
            names.clear()
            packed.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for name, ids, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names.append(name)
                packed.append(ids)
                held += n
                if held >= BLOCK_TOKENS:
                    yield flush()
        if names:
            yield flush()

    bounded_batches(spark)
    rows = tokens.repartitionByRange(F.col("id"), F.xxhash64("ids")).sortWithinPartitions("id", F.xxhash64("ids"))
    rows.select("id", "ids", "n_tokens").mapInArrow(encode, schema).write.parquet(f"{path}/blocks")
    discard(tokens)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    rows = spark.read.parquet(f"{path}/table").collect()
    freq = np.zeros(1 + max((r["id"] for r in rows), default=0), np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    shared = share(spark, freq)
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row for each part, as many as there were tasks that wrote
    sizes = dict(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    kind = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared())
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["n_tokens"], row["words"], row["states"])
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != row["crc32"]:
                    raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
                at = np.cumsum([0, *row["doc_tokens"]])
                base = before[row["part"]] + row["first_token"]
                columns = [row["doc_ids"], at[:-1] + base, row["doc_tokens"], [raw[4 * s : 4 * e] for s, e in zip(at[:-1], at[1:], strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    # a block is one row of a few hundred KB
    return blocks.select("part", "block", "first_token", "doc_ids", "doc_tokens", "n_tokens", "words", "states", "crc32").mapInArrow(decode, schema)


def op3_rans_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "rans-store")
    write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), "word_bpe_49k.json", 1, path)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
