"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Every document becomes token ids and an end id.  Its full windows are sequences of
their own; the rest is packed.  Documents are dealt to shards of about
``SHARD_DOCS`` by their text: ``LEADS`` MinHash values of its terms put them in one order, in which
documents with many terms in common lie together, and ranges of the order are shards.  A group of
copies, however large, is cut by a hash.  Each shard holds a BM25 inverted index of its documents, with document
frequencies and the mean length taken over all documents.  Documents are indexed by
their whole text, full windows too.  A seed asks the index of its own shard, and so
meets ``SHARD_DOCS`` documents, likely neighbours first of all, but not all (the README says
what that loses), for unused neighbours; they are added, best first, while they fit, and the best
one left is cut to fill the window.  What is cut off stays for later windows, so
only the last window of a shard is padded, and gaps of under ``LEAST_PIECE`` ids.

Terms are token ids, so the table of frequencies is bounded by the vocabulary.

Edge cases: null and empty texts are documents of the end id alone; very long
texts give many full windows; repeated rows are packed each; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keystrand.llm.common import BATCH_ROWS, bounded_batches, map_batches, materialize, share, table
from keystrand.llm.rans import id_counts
from keystrand.llm.tokens import TextEncoder, forget

WINDOW = 1024
SHARD_DOCS = 1000
#: MinHash values that order the documents.
LEADS = 2
LEAST_PIECE = 8
#: Fixed values of BM25.
K1, B = 1.2, 0.75
#: Terms of a seed that the index is asked for: those of highest weight.
QUERY_TERMS = 32


class Shard:
    """Inverted index of one shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        n = len(docs)
        self.n = n
        lengths = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(n), lengths)
        terms = np.concatenate(docs).astype(np.int64) if n else np.empty(0, np.int64)
        bits = n.bit_length()
        pairs, tf = np.unique(terms << bits | owner, return_counts=True) if len(terms) else (np.empty(0, np.int64), np.empty(0, np.int64))
        term, self.doc = pairs >> bits, pairs & ((1 << bits) - 1)
        norm = K1 * (1 - B + B * lengths[self.doc] / max(mean_length, 1.0))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm)
        bounds = np.flatnonzero(np.diff(term)) + 1
        starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(term)]])
        slot = np.zeros(len(term), np.int64)
        slot[bounds] = 1
        slot = np.cumsum(slot)
        # the terms of each document that other documents of the shard have too, best first
        useful = np.flatnonzero((ends - starts)[slot] > 1) if len(term) else np.empty(0, np.int64)
        order = useful[np.lexsort((-self.weight[useful], self.doc[useful]))]
        by_doc = self.doc[order]
        first = np.searchsorted(by_doc, np.arange(n + 1))
        self.query = [slot[order[first[d] : min(first[d + 1], first[d] + QUERY_TERMS)]] for d in range(n)]
        self.starts, self.ends = starts, ends

    def scores(self, seed: int) -> np.ndarray:
        """How well each document of the shard answers the seed's terms."""
        parts = self.query[seed]
        if not len(parts):
            return np.zeros(self.n)
        # the places of all postings of the terms
        sizes = self.ends[parts] - self.starts[parts]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[parts] - np.cumsum(sizes) + sizes, sizes)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack_rests(docs: list[np.ndarray], rests: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start within its rest, length); neighbours are found by the whole documents."""
    index = Shard(docs, idf, mean_length)
    at = np.zeros(len(rests), np.int64)
    left = np.array([len(r) for r in rests], np.int64)
    windows = []
    # long rests first: short ones are the better filling
    for seed in np.argsort(-left, kind="stable"):
        while left[seed]:
            room = min(window, int(left[seed]))
            pieces = [(int(seed), int(at[seed]), room)]
            at[seed] += room
            left[seed] -= room
            room = window - room
            if room >= LEAST_PIECE:
                score = index.scores(int(seed))
                # those that fit, best first
                fit = np.flatnonzero((left > 0) & (left <= room))
                fit = fit[np.argsort(-score[fit], kind="stable")]
                for d, size in zip(fit.tolist(), left[fit].tolist(), strict=True):
                    if size <= room:
                        pieces.append((d, int(at[d]), size))
                        room -= size
                        at[d] += size
                        left[d] = 0
                        if room < LEAST_PIECE:
                            break
                unused = np.flatnonzero(left) if room >= LEAST_PIECE else ()
                if len(unused):
                    d = int(unused[np.argmax(score[unused])])
                    pieces.append((d, int(at[d]), room))
                    at[d] += room
                    left[d] -= room
            windows.append(pieces)
    return windows


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    encoder = TextEncoder(vocabulary, end_id)
    size, dtype = max(encoder.library.get_vocab_size(), end_id + 1), encoder.dtype.str
    width = encoder.dtype.itemsize

    def make():
        encoder = TextEncoder(vocabulary, end_id)
        ranks = np.stack([np.random.default_rng(k).permutation(size) for k in range(LEADS)]).astype(np.int32)
        row = 0

        def fn(batch: pa.RecordBatch) -> dict[str, object]:
            nonlocal row
            ids = [encoder.encode(t) for t in batch.column(text_col).to_pylist()]
            starts = np.cumsum([0, *map(len, ids)])[:-1] // width
            leads = np.minimum.reduceat(ranks[:, np.frombuffer(b"".join(ids), dtype)], starts, axis=1)
            row += len(ids)
            rest = [x[len(x) // (width * window) * width * window :] for x in ids]
            full = [x[: len(x) - len(r)] for x, r in zip(ids, rest, strict=True)]
            return {"full": full, "ids": rest, "row": range(row - len(ids), row), "leads": [bytes(x) for x in np.ascontiguousarray(leads.T.astype(">i4"))]}

        return fn

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias(text_col))
    fields = [T.StructField("full", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("row", T.LongType()), T.StructField("leads", T.BinaryType())]
    tokens = materialize(map_batches(rows, fields, make, drop=(text_col,)), "packing")
    whole = tokens.select(F.concat("full", "ids").alias("ids"))
    n, total = tokens.agg(F.count("*"), F.sum(F.octet_length("full") + F.octet_length("ids"))).first()
    idf = np.zeros(size)
    for k, df in id_counts(whole, dtype, size, once=True).items():
        idf[k] = math.log(1 + (n - df + 0.5) / (df + 0.5))
    shared = share(spark, (idf, (total or 0) / width / max(n, 1)))
    kind = tokens.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind)]
        + [T.StructField(c, T.BinaryType() if c == "ids" else T.LongType()) for c in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")]
    )
    arrow = to_arrow_schema(schema)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard: all rows of a range."""
        forget()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        group = pa.Table.from_batches(held)
        idf, mean_length = shared()
        names = group.column("doc_id").to_pylist()
        full = [np.frombuffer(x, dtype) for x in group.column("full").to_pylist()]
        rests = [np.frombuffer(x, dtype) for x in group.column("ids").to_pylist()]
        out: list[list] = [[] for _ in arrow]
        sequence = TaskContext.get().partitionId() << 32

        def add(d: int, start: int, ids: np.ndarray, offset: int) -> None:
            for column, value in zip(out, (names[d], start, len(ids), ids.astype("<u4").tobytes(), len(full[d]) + len(rests[d]), sequence, offset), strict=True):
                column.append(value)

        for d, ids in enumerate(full):
            for start in range(0, len(ids), window):
                add(d, start, ids[start : start + window], 0)
                sequence += 1
        for pieces in pack_rests([np.concatenate(d) for d in zip(full, rests, strict=True)], rests, idf, mean_length, window):
            offset = 0
            for d, start, length in pieces:
                add(d, len(full[d]) + start, rests[d][start : start + length], offset)
                offset += length
            sequence += 1
        yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow).to_batches(max_chunksize=BATCH_ROWS)

    shards = max(1, math.ceil(n / shard_docs))
    # copies have equal leads, and are dealt by a hash of id and row number; the order makes a rerun alike
    tie = F.xxhash64("doc_id", "row", "ids")
    dealt = tokens.select("doc_id", "full", "ids", "row", "leads").repartitionByRange(shards, "leads", tie).sortWithinPartitions("leads", tie)
    bounded_batches(spark)
    return dealt.drop("row", "leads").mapInArrow(fill, schema)


def packed_documents(docs: DataFrame) -> DataFrame:
    pieces = pack(docs, "byte_bpe_50k.json", 0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_lexical_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left is packed whole; the rows are the pieces.

    Null and empty texts are the end id alone, repeated rows are packed each, other columns are not read; an empty table gives an empty result.
    """
    return packed_documents(docs.select("doc_id", "text"))
