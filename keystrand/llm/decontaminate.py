"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items (ASCII lower case, words of letters, digits and
non-ASCII characters) become one automaton over word ids.  Document words stream
through it; the longest matching length at each word tells every occurrence of a
13-word window, or of a whole item of fewer words.

The automaton is the only thing sent to the executors.  Its size is bounded: the
benchmark is cut into blocks of at most ``BLOCK_WORDS`` words, each block is one
automaton and one pass, and the hits of several blocks meet by text.  Cutting uses
the hits of all blocks, pass after pass, until no text changes.

Edge cases: null and empty texts have no words, no hits and are clean; null items
have no windows; repeated items and repeated rows are reported like any other; an
empty benchmark leaves every document clean; columns of the input that bear the name
of an output column are replaced, others come back as they were; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrand.llm.common import map_batches, materialize, shielded, table

WINDOW = 13
#: Words of benchmark text in one automaton (about 300 bytes of memory for each).
BLOCK_WORDS = 500_000

#: ASCII upper case becomes lower case; what is no word character becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Automaton of all word substrings of the items, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = array("i", [-1])
        self.length = array("i", [0])
        strings = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                strings.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self._label(strings)

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """Give the strings that reach q from p by c a state of their own."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _label(self, strings: list[tuple[str, list[int]]]) -> None:
        """windows: for a state of at least ``window`` words, the items of its last window; short: the whole short items that end there."""
        own: dict[int, set[str]] = {}
        whole: dict[int, set[tuple[int, str]]] = {}
        base = [0] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[v]
            base[v] = base[up] if up > 0 and self.length[up] >= self.window else v
        for name, ids in strings:
            v = 0
            for c in ids:
                v = self.next[v][c]
                if len(ids) >= self.window and self.length[v] >= self.window:
                    own.setdefault(base[v], set()).add(name)
            if len(ids) < self.window:
                whole.setdefault(v, set()).add((len(ids), name))
        self.windows = {v: frozenset(own.get(base[v], ())) for v in range(1, len(self.next)) if self.length[v] >= self.window}
        self.short: dict[int, tuple[tuple[int, str], ...]] = {}
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            ends = (*whole.get(v, ()), *self.short.get(self.link[v], ()))
            if ends:
                self.short[v] = ends

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of hit words, in order and merged, and the items hit."""
        follow, link, length, window = self.next, self.link, self.length, self.window
        short, windows = self.short, self.windows
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        v = size = 0
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                v = size = 0
                continue
            to = follow[v].get(c)
            while to is None and v:
                v = link[v]
                size = length[v]
                to = follow[v].get(c)
            if to is None:
                continue
            v = to
            size += 1
            if size >= window and windows[v]:
                spans.append((i + 1 - window, i + 1))
                found |= windows[v]
            if v in short:
                for n, name in short[v]:
                    if n <= size:
                        spans.append((i + 1 - n, i + 1))
                        found.add(name)
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Names and words of the items, block by block; the driver holds one block (and at its end one item more)."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string"))
    for name, text in rows.toLocalIterator():
        words = words_of(text)
        if size and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((str(name), words))
        size += len(words)
    yield block


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, a line feed in place of each."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    parts, last = [], 0
    for s, e in spans:
        parts.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    return b"\n".join([*parts, raw[last:]]).decode("utf-8", "surrogatepass")


def enough(spans: list[tuple[int, int]], n_words: int, limit: int) -> bool:
    """At least one word in ``limit`` is hit."""
    return bool(spans) and limit * sum(e - s for s, e in spans) >= n_words


def cut(text: str, automaton: SuffixAutomaton, limit: int) -> str:
    """The text without its hit spans, again until less than 1 / ``limit`` of its words are hit."""
    while True:
        words = words_of(text)
        spans, _ = automaton.hits(words)
        if not enough(spans, len(words), limit):
            return text
        text = without(text, spans)


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


def find_benchmark_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    clean_below: int = 0,
) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_hit, items (sorted as strings) and spans (word positions).

    With ``clean_below`` = k > 0 a column ``clean_text`` follows: where at least one
    word in k is hit, the text without its hit spans, else the text itself.
    """
    spark = docs.sparkSession

    def scan(rows: DataFrame, sent: Broadcast, source: str, clean_below: int) -> DataFrame:
        fields = FIELDS + [T.StructField("clean_text", T.StringType())] * bool(clean_below)

        def make():
            a = pickle.loads(sent.value)

            def fn(batch: pa.RecordBatch) -> dict[str, object]:
                out: dict[str, list] = {f.name: [] for f in fields}
                for text in batch.column(source).to_pylist():
                    words = words_of(text)
                    spans, items = a.hits(words)
                    out["n_words"].append(len(words))
                    out["n_hit"].append(sum(e - s for s, e in spans))
                    out["items"].append(sorted(items))
                    out["spans"].append([{"start": s, "end": e} for s, e in spans])
                    if clean_below:
                        out["clean_text"].append(cut(text, a, clean_below) if spans else text)
                return out

            return fn

        return map_batches(rows, fields, make)

    def blocks() -> Iterator[list[tuple[str, list[bytes]]]]:
        return item_blocks(benchmark, item_col, item_text_col, block_words)

    def sent(block: list[tuple[str, list[bytes]]]) -> Broadcast:
        return spark.sparkContext.broadcast(cloudpickle.dumps(SuffixAutomaton(block, window)))

    def parts_of(rows: DataFrame) -> DataFrame:
        """Hits of rows (_row, _text), block by block: one automaton is built, sent, used and dropped before the next."""
        parts = None
        for block in blocks():
            automaton = sent(block)
            part = materialize(scan(rows, automaton, "_text", 0).select("_row", "n_words", "items", "spans").distinct(), "block")
            automaton.destroy()
            parts = part if parts is None else parts.unionByName(part)
        return parts

    some = blocks()
    first = next(some)
    if next(some, None) is None:
        return scan(docs, sent(first), text_col, clean_below)
    del some, first
    found = _in_blocks(docs, parts_of, text_col)
    return _cut_in_blocks(found, parts_of, text_col, clean_below) if clean_below else found


def _in_blocks(docs: DataFrame, parts_of, text_col: str) -> DataFrame:
    """Several automata: each pass gives the hits of its block, and rows of equal text share them."""
    key = F.sha2(F.col(f"`{text_col}`").cast("string").cast("binary"), 256)
    rows = docs.withColumn("_row", F.coalesce(key, F.lit("")))
    parts = parts_of(rows.select("_row", F.col(f"`{text_col}`").cast("string").alias("_text")))
    out = rows.drop(*[f.name for f in FIELDS]).join(_joined(parts), "_row", "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {f.name for f in FIELDS}], *[f.name for f in FIELDS])


def _cut_in_blocks(found: DataFrame, parts_of, text_col: str, limit: int) -> DataFrame:
    """Adds clean_text: texts are cut by the hits of all blocks together, again until less than 1 / ``limit`` of their words are hit.

    A round takes only the texts that the round before has cut, and its results are written tables.
    """

    def make():
        def fn(batch: pa.RecordBatch) -> dict[str, object]:
            texts, again = [], []
            for text, n, spans in zip(*(batch.column(c).to_pylist() for c in ("_text", "n_words", "spans")), strict=True):
                at = [(s["start"], s["end"]) for s in spans or ()]
                again.append(enough(at, n or 0, limit))
                texts.append(without(text, at) if again[-1] else text)
            return {"_text": texts, "_again": again}

        return fn

    def cut_once(rows: DataFrame) -> DataFrame:
        fields = [T.StructField("_text", T.StringType()), T.StructField("_again", T.BooleanType())]
        return materialize(map_batches(rows, fields, make, drop=("n_words", "spans")), "cut")

    found = materialize(found.withColumn("_row", F.sha2(F.col(f"`{text_col}`").cast("string").cast("binary"), 256)), "found")
    rows = found.filter("n_hit > 0").select("_row", F.col(f"`{text_col}`").cast("string").alias("_text"), "n_words", "spans")
    state = cut_once(rows.dropDuplicates(["_row"]))
    done = None
    while True:
        over = state.filter("not _again").select("_row", "_text")
        done = over if done is None else done.unionByName(over)
        rest = state.filter("_again").select("_row", "_text")
        if not rest.take(1):
            break
        hits = _joined(parts_of(rest)).select("_row", "n_words", "spans")
        state = cut_once(rest.join(hits, "_row"))
    out = found.join(done.withColumnRenamed("_text", "_clean"), "_row", "left")
    clean = F.coalesce("_clean", F.col(f"`{text_col}`").cast("string")).alias("clean_text")
    return out.select(*[F.col(f"`{c}`") for c in found.columns if c not in ("_row", "clean_text")], clean)


def _joined(parts: DataFrame) -> DataFrame:
    """The hits of all blocks by _row: items and spans together, spans merged."""
    joined = parts.groupBy("_row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_all"),
    )
    merge = F.aggregate(
        "_all",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    joined = joined.withColumn("spans", merge).withColumn(
        "n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    )
    return joined.drop("_all")


def op9_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark_spans(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the benchmark spans out of documents with at least one hit word in twenty; a document with no word left goes.

    Null and empty texts are clean and stay; repeated rows are cut alike; an empty
    benchmark leaves every document as it is.  But for text (and n_chars, where there is one) of documents
    that are cut, all columns of the input come back as they were, whatever their names.
    """
    given, own = shielded(docs, [*(f.name for f in FIELDS), "clean_text", "_row", "_text", "_all", "_clean", "_again"])
    found = find_benchmark_spans(given, table(spark, sf_dir, "benchmark"), clean_below=20)
    changed = ~F.col("clean_text").eqNullSafe(F.col("text"))
    kept = found.filter(~changed | F.col("clean_text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    new = {"text": F.col("clean_text"), "n_chars": F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return kept.select(*[new[c].alias(c) if c in new else own(c) for c in docs.columns])
