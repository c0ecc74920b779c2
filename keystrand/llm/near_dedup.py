"""Near-duplicates by ProbMinHash, banding and verification.

A document is its weighted set of five-word shingles (weight: occurrences).
ProbMinHash gives each shingle a Poisson process of arrivals, seeded by the
shingle, with a rate equal to its weight; every arrival falls on one signature
component, which keeps its earliest.  A shingle stops as soon as its next arrival
is later than every component's, which ends nearly all of them after one step.
Two components agree with the probability Jaccard similarity of the documents.  A
document whose weights differ is signed a second time with all weights 1; there two
components agree with the plain Jaccard similarity of the shingle sets.

Exact copies of a word sequence are one text from the start.  Both signatures are cut
into bands; texts that share a band of either are candidates.  A pair is a link if its exact
probability Jaccard similarity, or the plain Jaccard similarity of the shingle sets,
is at least the threshold.  Classes are the connected components of the links.

Candidate pairs are never rows.  A bucket (texts of one band value) is dealt by hash
to slices of a bounded size, and one task holds a slice: it compares the signatures
of all its pairs, drops the texts without a good one, and later compares the shingles
of what is left, all pairs of a slice at once by a matrix product.  What it emits is a
spanning forest of the links it finds, fewer rows than texts.  A pair that shares several bands is
compared in the first of them alone.  Slices of one bucket meet in a second round,
where the texts of its largest class needn't meet each other: the others visit every
slice.  No bucket is capped, and every pair of different classes meets.

Edge cases: null and empty texts, and texts without words, have no shingles and
are classes of their own; texts of one to four words are one shingle; a repeated
row, and rows that share an id, belong to the classes of their texts; a row without
an id counts as a text, but names no class; other columns are not read, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrand.llm.common import bounded_batches, discard, map_batches, materialize, table
from keystrand.llm.decontaminate import words_of

SHINGLE = 5
THRESHOLD = 0.8
#: 24 bands of 5 components: a pair at the threshold is missed once in 14,000 times.
BANDS, ROWS = 24, 5
SIGNATURE = BANDS * ROWS
#: A candidate pair is verified if at least this share of its signature bytes agree: four standard deviations below the threshold.
LEAST_AGREEMENT = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / SIGNATURE) ** 0.5
#: Elements that ProbMinHash works off together.
CHUNK = 1 << 16
#: Texts, and shingles of them, that a slice of a bucket holds about (a single longer text is a slice of its own).
SLICE_TEXTS, SLICE_SHINGLES = 2048, 1 << 21
#: Pairs whose signatures are compared together, 240 bytes each.
PAIRS = 1 << 17
#: Cells of a block of the shingle matrix, 4 bytes each.
CELLS = 1 << 24
#: Shingles of texts that a verifying task remembers, 16 bytes each.
HELD = 1 << 21
#: A table of two numbers per row is broadcast up to this many rows (some 20 MB), and shuffled beyond.
BROADCAST_ROWS = 500_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S11 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(11)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words: a polynomial over the bytes, position by position, then mixed."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    values = (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[place % len(_POWERS)] + (place // len(_POWERS)).astype(np.uint64)
    return mix(np.add.reduceat(values, starts) + sizes.astype(np.uint64) * _GOLDEN)


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = word_hashes(words)
    n = max(1, len(h) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        total = mix(total * _M1 + h[k : k + n] + _GOLDEN)
    return np.unique(total, return_counts=True)


def prob_minhash(sets: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Signatures of weighted sets (elements, weights): for each set, the element of the earliest arrival on each component.

    All sets are worked off together, ``CHUNK`` elements at a time; an element stops
    when its next arrival is later than every component's earliest of its set.
    """
    earliest = np.full(len(sets) * size, np.inf)
    owner = np.zeros(len(sets) * size, np.uint64)
    every = np.concatenate([e for e, _ in sets]) if sets else np.empty(0, np.uint64)
    rates = np.concatenate([w for _, w in sets]).astype(np.float64) if sets else np.empty(0)
    owners = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    for at in range(0, len(every), CHUNK):
        live, rate, bag = every[at : at + CHUNK], rates[at : at + CHUNK], owners[at : at + CHUNK]
        low, high = int(bag[0]), int(bag[-1]) + 1
        time = np.zeros(len(live))
        done = 0
        while len(live):
            # few elements make several arrivals at once
            ahead = min(64, max(1, 4096 // len(live)))
            steps = np.array([(s * int(_GOLDEN)) & 0xFFFFFFFFFFFFFFFF for s in range(done + 1, done + ahead + 1)], np.uint64)
            done += ahead
            r = mix(live[:, None] + steps)
            gaps = -np.log(((r >> _S11).astype(np.float64) + 0.5) / 2.0**53) / rate[:, None]
            times = time[:, None] + np.cumsum(gaps, axis=1)
            place = bag[:, None] * size + (mix(r ^ _M2) % np.uint64(size)).astype(np.int64)
            np.minimum.at(earliest, place.ravel(), times.ravel())
            hit = times == earliest[place]
            owner[place[hit]] = np.broadcast_to(live[:, None], times.shape)[hit]
            time = times[:, -1]
            latest = earliest[low * size : high * size].reshape(-1, size).max(1)
            more = time < latest[bag - low]
            live, rate, time, bag = live[more], rate[more], time[more], bag[more]
    return owner.reshape(len(sets), size)


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard similarity by counts, and Jaccard similarity of the sets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    plain = len(i) / (len(a[0]) + len(b[0]) - len(i))
    if not len(i):
        return 0.0, 0.0
    x, y = a[1] / a[1].sum(), b[1] / b[1].sum()
    ratio = x[i] / y[j]
    order = np.argsort(ratio)
    xs, ys, rs = x[i][order], y[j][order], ratio[order]
    only_x = x.sum() - xs.sum()
    only_y = y.sum() - ys.sum()
    # for each common element at ratio r: sum over d of max(x(d) / x, y(d) / y)
    above = only_x + np.cumsum(xs[::-1])[::-1]
    below = only_y + np.cumsum(ys) - ys
    first = np.searchsorted(rs, rs, "left")
    total = above[first] + rs * below[first]
    return float((xs / total).sum()), plain


def small(df: DataFrame) -> DataFrame:
    """A written table of a few numbers per row: with a broadcast hint if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def signed(rows: DataFrame) -> DataFrame:
    """Rows without text, plus the digest of the words (null: none), a byte of each signature component, and the number of shingles.

    The bytes are those of the weighted signature, then those of the plain one (all
    weights 1) where that differs: in texts that repeat some shingles more than others.
    """

    def bytes_of(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
        return [bytes(x) for x in mix(prob_minhash(sets, SIGNATURE)).astype(np.uint8)]

    def make():
        def fn(batch: pa.RecordBatch) -> dict[str, object]:
            digests: list[bytes | None] = []
            new: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                d = hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None
                digests.append(d)
                if d and d not in new:
                    new[d] = shingles(words)
            held = dict(zip(new, bytes_of(list(new.values())), strict=True))
            uneven = [d for d, (_, w) in new.items() if w.min() != w.max()]
            for d, raw in zip(uneven, bytes_of([(new[d][0], np.ones(len(new[d][0]), np.int64)) for d in uneven]), strict=True):
                held[d] += raw
            return {"digest": digests, "sig": [held.get(d) for d in digests], "size": [len(new[d][0]) if d else 0 for d in digests]}

        return fn

    fields = [T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("size", T.LongType())]
    return map_batches(rows, fields, make, drop=("text",))


def banded(nodes: DataFrame) -> DataFrame:
    """A row for each text and distinct band value of either kind of signature: nodes with band and key."""
    values = F.transform(
        F.sequence(F.lit(0), (F.length("sig") / ROWS).cast("int") - 1),
        lambda i: F.struct((i % BANDS).alias("band"), F.xxhash64(i % BANDS, F.substring("sig", i * ROWS + 1, F.lit(ROWS))).alias("key")),
    )
    return nodes.select("*", F.explode(F.array_distinct(values)).alias("_v")).select(*nodes.columns, "_v.band", "_v.key")


def whole_units(batches: Iterator[pa.RecordBatch], by: list[str], most: int = 4096, most_bytes: int = 16 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come in order of ``by`` as tables of whole units, with the place where each unit begins and the end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < most and sum(b.nbytes for b in held) < most_bytes:
            continue
        rows = pa.Table.from_batches(held)
        starts = unit_starts(rows, by)
        if len(starts) > 2:
            yield rows.slice(0, starts[-2]), starts[:-1]
        held = rows.slice(starts[-2]).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, unit_starts(rows, by)


def unit_starts(rows: pa.Table, by: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for c in by:
        value = rows.column(c).to_numpy()
        new[1:] |= value[1:] != value[:-1]
    return np.append(np.flatnonzero(new), rows.num_rows)


def pairs_of(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows of one unit, some ``PAIRS`` at a time, units in order."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = 0
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        at = s
        while at < e - 1:
            # rows at, at + 1, ... each with all rows after it
            rows = np.arange(at, min(e - 1, at + max(1, (PAIRS - held) // (e - at))))
            after = e - 1 - rows
            left.append(np.repeat(rows, after))
            right.append(np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after) + left[-1] + 1)
            held += len(left[-1])
            at = int(rows[-1]) + 1
            if held >= PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def both_kinds(column: pa.ChunkedArray) -> np.ndarray:
    """Weighted and plain signature bytes of each row; a single signature is both."""
    return np.frombuffer(b"".join(x if len(x) > SIGNATURE else x + x for x in column.to_pylist()), np.uint8).reshape(-1, 2, SIGNATURE)


def promising(rows: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a unit that share no earlier band and agree in enough signature bytes, of either kind.

    In a unit of two sides only pairs across them count, and only those of different labels and slices.
    """
    sig = both_kinds(rows.column("sig"))
    kinds = 2 if any(len(x) > SIGNATURE for x in rows.column("sig").to_pylist()) else 1
    band = rows.column("band").to_numpy()
    sides = [rows.column(c).to_numpy() for c in ("side", "slice", "label_hash")] if "side" in rows.column_names else None
    for i, j in pairs_of(starts):
        if sides is not None:
            across = np.ones(len(i), bool)
            for v in sides:
                across &= v[i] != v[j]
            i, j = i[across], j[across]
        good = np.zeros(len(i), bool)
        first = np.full(len(i), BANDS)
        for k in range(kinds):
            same = sig[i, k] == sig[j, k]
            good |= same.sum(1, dtype=np.uint8) >= LEAST_AGREEMENT * SIGNATURE
            shared = same.reshape(-1, BANDS, ROWS).all(2)
            first = np.minimum(first, np.where(shared.any(1), shared.argmax(1), BANDS))
        good &= first == band[i]
        yield i[good], j[good]


def sorted_units(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows dealt by their unit and sorted; a unit is of bounded size."""
    return rows.repartition(*by).sortWithinPartitions(*by, "digest")


def screened(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of units that have a promising pair in their unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit_rows, starts in whole_units(batches, by):
            needed = np.zeros(unit_rows.num_rows, bool)
            for i, j in promising(unit_rows, starts):
                needed[i] = needed[j] = True
            if needed.any():
                yield from unit_rows.filter(pa.array(needed)).combine_chunks().to_batches()

    bounded_batches(rows.sparkSession)
    return sorted_units(rows, by).mapInArrow(run, rows.schema)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common.

    Frequent elements are columns of a matrix whose product with itself counts them;
    the others are counted by their pairs of sets, of which there are few.
    """
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    heads = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    count = np.diff(np.append(heads, len(every)))
    out = np.zeros((m, m), np.float32)
    often = count >= max(3, m // 32)
    rank = np.where(often, np.cumsum(often) - 1, -1)
    column = np.repeat(rank, count)
    width = max(1, CELLS // m)
    for at in range(0, int(often.sum()), width):
        inside = (column >= at) & (column < at + width)
        block = np.zeros((m, min(width, int(often.sum()) - at)), np.float32)
        block[owner[inside], column[inside] - at] = 1
        out += block @ block.T
    # k sets that have an element: its first, second, ... with the one d places after it
    rare = np.flatnonzero(~often & (count > 1))
    flat = out.reshape(-1)
    for d in range(1, int(count[rare].max(initial=1))):
        more = rare[count[rare] > d]
        n = count[more] - d
        a = np.repeat(heads[more], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        places, times = np.unique(np.concatenate([owner[a] * m + owner[a + d], owner[a + d] * m + owner[a]]), return_counts=True)
        flat[places] += times
    return out


def forest(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for links i - j between nodes 0 to m - 1."""
    label = np.arange(m)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def linked(sets: list[tuple[np.ndarray, np.ndarray]], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Component labels of the sets (elements, weights) by those of the pairs i - j that are links.

    Pairs that earlier links have put into one component are not compared again.
    """
    m = len(sets)
    label = np.arange(m)
    if len(i) > 4 * m and m > 16:
        sizes = np.array([len(e) for e, _ in sets])
        common = common_counts([e for e, _ in sets])[i, j].astype(np.float64)
        good = common / (sizes[i] + sizes[j] - common) >= threshold
        label = forest(m, i[good], j[good])
        # where both texts have each shingle equally often, the two similarities are one
        uneven = np.array([w.min() != w.max() for _, w in sets])
        rest = ~good & (uneven[i] | uneven[j])
        i, j = i[rest], j[rest]
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if label[a] != label[b] and max(similarities(sets[a], sets[b])) >= threshold:
            low, high = sorted((label[a], label[b]))
            label[label == high] = low
    return label


def verified(rows: DataFrame, by: list[str], nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of digests: in each unit a spanning forest of the pairs whose exact similarity reaches the threshold."""
    # the texts of the units' rows only, one for each digest
    wanted = materialize(nodes.join(rows.select("digest").distinct(), "digest", "left_semi").select("digest", "place"), "wanted")
    held = materialize(texts.join(small(wanted), "place").select("digest", "text").dropDuplicates(["digest"]), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        room = HELD

        def of(digest: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal room
            if digest not in memo:
                found = shingles(words_of(text))
                if len(found[0]) > room:
                    memo.clear()
                    room = HELD
                room -= len(found[0])
                memo[digest] = found
            return memo[digest]

        for unit_rows, starts in whole_units(batches, by):
            pairs = list(promising(unit_rows, starts))
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
            digests = unit_rows.column("digest").to_pylist()
            text = unit_rows.column("text")
            out: tuple[list[bytes], list[bytes]] = ([], [])
            bounds = np.searchsorted(i, starts)
            for k, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                mine = slice(bounds[k], bounds[k + 1])
                if mine.start == mine.stop:
                    continue
                sets = [of(digests[x], text[x].as_py()) for x in range(s, e)]
                label = linked(sets, i[mine] - s, j[mine] - s, threshold)
                for x in np.flatnonzero(label != np.arange(e - s)).tolist():
                    out[0].append(digests[s + x])
                    out[1].append(digests[s + int(label[x])])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], names=["a", "b"])

    bounded_batches(rows.sparkSession)
    found = sorted_units(rows.join(held, "digest"), by).mapInArrow(run, "a binary, b binary")
    links = materialize(found, "links")
    discard(wanted, held)
    return links


def connected(links: DataFrame) -> DataFrame:
    """Components of an undirected graph: node, label (the least node), by large-star and small-star steps.

    Each step takes the minimum of a node's neighbours (a minimum Spark makes before
    it shuffles) and joins it to the links; a step's result is a written table.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    before = None
    while True:
        # large star: neighbours above u go to the least of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "large-star")
        # small star: u and its lower neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = materialize(star.filter("u > v").distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(edges, large)
        edges = new
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = state


def link_rounds(nodes: DataFrame, texts: DataFrame, threshold: float, slice_texts: int, slice_shingles: int) -> DataFrame:
    """Links (a, b) of digests, from nodes (digest, place, sig, size) and texts (place, text)."""
    bands = banded(nodes)
    # buckets of one text are of no interest
    parts = F.greatest(F.ceil(F.count("*") / slice_texts), F.ceil(F.sum("size") / slice_shingles))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), parts.cast("int").alias("slices")).filter("n > 1").drop("n")
    buckets = materialize(buckets, "buckets")
    dealt = bands.join(small(buckets), "key").withColumn("slice", F.pmod(F.xxhash64("digest"), F.col("slices")).cast("int"))
    by = ["key", "slice"]
    rows = materialize(screened(dealt.select("key", "slice", "band", "digest", "sig"), by), "screened")
    links = verified(rows, by, nodes, texts, threshold)
    discard(rows)
    if not buckets.filter("slices > 1").take(1):
        discard(buckets)
        return links
    # second round: slices of one bucket meet, but for the texts of the bucket's largest class
    labels = connected(links)
    rows = bands.join(buckets.filter("slices > 1"), "key").withColumn("slice", F.pmod(F.xxhash64("digest"), F.col("slices")).cast("int"))
    rows = rows.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    large = materialize(rows, "large-buckets")
    classes = large.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    every = classes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    spare = every.join(classes.withColumnsRenamed({"label": "_l", "size": "_s"}).drop("n"), "key").filter("_l = most.label")
    others = F.greatest(F.ceil((F.col("n") - F.col("most.n")) / slice_texts), F.ceil((F.col("size") - F.col("_s")) / slice_shingles)).cast("int")
    mixed = materialize(spare.select("key", F.col("most.label").alias("spare"), others.alias("chunks")).filter("chunks > 0"), "mixed")
    rows = large.join(mixed, "key").select("key", "slice", "slices", "chunks", "spare", "label", "band", "digest", "sig", F.xxhash64("label").alias("label_hash"))
    up_to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    common = ["key", "band", "digest", "sig", "slice", "label_hash"]
    hosts = rows.select(*common, F.col("slice").alias("unit"), up_to(F.col("chunks")).alias("chunk"), F.lit(0).alias("side"))
    guests = rows.filter("label <> spare").select(*common, up_to(F.col("slices")).alias("unit"), F.pmod(F.xxhash64("digest", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"))
    by = ["key", "unit", "chunk"]
    met = materialize(screened(hosts.unionByName(guests.select(*hosts.columns)), by), "screened")
    more = materialize(verified(met, by, nodes, texts, threshold).unionByName(links), "links")
    discard(buckets, labels, large, mixed, met, links)
    return more


def place_of(text: Column) -> Column:
    """128 bits that name a text, computed the same way wherever the text is read."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text, F.length(text)).alias("b"))


def text_classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, slice_texts: int, slice_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs``: id, place and digest (written); and the classes with links: digest, class (the least digest)."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), place_of(text).alias("place"), text.alias("text"))
    members = materialize(signed(rows), "members")
    # one node for each digest; sig and size are the same for all its rows
    nodes = members.filter("digest is not null").groupBy("digest").agg(*[F.first(c).alias(c) for c in ("place", "sig", "size")])
    nodes = materialize(nodes, "nodes")
    links = link_rounds(nodes, rows.select("place", "text"), threshold, slice_texts, slice_shingles)
    labels = connected(links).withColumnsRenamed({"node": "digest", "label": "class"})
    discard(nodes, links)
    return members.select("id", "place", "digest"), labels


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, slice_texts: int = SLICE_TEXTS, slice_shingles: int = SLICE_SHINGLES
) -> DataFrame:
    """Columns ``id_col`` and class_id (the least id of the class), one row per row of ``docs``; text is not returned.

    A row of a class without any id has a null class_id.
    """
    members, labels = text_classes(docs, id_col, text_col, threshold, slice_texts, slice_shingles)
    rows = members.filter("digest is not null").join(labels, "digest", "left").select("id", F.coalesce("class", "digest").alias("class"))
    # a written table, so that the join can split a class of many rows
    least = materialize(rows.groupBy("class").agg(F.min("id").alias("class_id")), "classes")
    # texts without words are of no digest, and a class each
    alone = members.filter("digest is null").select("id", F.col("id").alias("class_id"))
    out = rows.join(least, "class").select("id", "class_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "class_id")


def op1_prob_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: that of the least id (a row without an id only where no row of the class has one), of repeated rows one.

    Rows without words (null and empty texts among them) are classes of their own and stay.
    Of rows that share an id each goes or stays with the class of its own text.  All columns
    come back as they were, whatever their names.
    """
    members, labels = text_classes(docs, "doc_id", "text", THRESHOLD, SLICE_TEXTS, SLICE_SHINGLES)
    rows = members.filter("digest is not null").join(labels, "digest", "left").select("id", "place", F.coalesce("class", "digest").alias("class"))
    kinds = materialize(rows.groupBy("class", "id", "place").agg(F.count("*").alias("n")), "kinds")
    least = kinds.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place")).alias("kept"), F.sum("n").alias("all"))
    # rows of which nothing goes are most, and need no decision; a written table, so that the join can split a class of many rows
    least = materialize(least.filter("all > 1"), "least")
    kept = (F.col("id").eqNullSafe(F.col("kept.id"))) & (F.col("place") == F.col("kept.place"))
    judged = kinds.join(least, "class").select("id", "place", kept.alias("stays"), F.col("n") > 1)
    judged = materialize(judged.toDF("_id", "_place", "_stays", "_repeated").filter("not _stays or _repeated"), "judged")
    discard(kinds, least)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = given.join(small(judged), (F.col("row.doc_id").eqNullSafe(F.col("_id"))) & (place_of(F.col("row.text").cast("string")) == F.col("_place")), "left")
    out = found.filter("_stays is null").select("row.*")
    if judged.filter("_stays").take(1):
        out = out.unionByName(found.filter("_stays").dropDuplicates(["_id", "_place"]).select("row.*"))
    return out
