"""Personal data by a semi-Markov conditional random field.

Fixed patterns give the base spans.  Around every digit and every at-sign the text
is cut into tokens, and a semi-Markov CRF over these tokens scores whole candidate
segments (their shape, digits, checksum, separators and left context).  Viterbi
over segments of at most ``MAX_TOKENS`` tokens chooses boundaries and types
together; base spans are segments that the path must contain, so the model adds
spans and never takes one away.

The weights are learned by the driver from ``TRAIN_WINDOWS`` generated windows
(values of each kind in several spellings, and things that only look like them:
versions, years, hashes, amounts, long numbers), by gradient ascent on the
conditional likelihood with forward and backward sums over segmentations.

Edge cases: null and empty texts have no spans; positions are code points; very
long texts are scanned whole, window by window; the model marks no segment of over ``MAX_CHARS``
characters (base spans have no bound); repeated rows are reported alike; columns of the input that bear
the name of an output column are replaced, others come back as they were; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keystrand.llm.common import map_batches, share, shielded, table

#: The kinds in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can't begin inside a run of digits but after an earlier match, which ends the run; so looking behind changes nothing.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Bounds of a segment; a token has one character at least, so characters decide.
MAX_CHARS = 64
MAX_TOKENS = MAX_CHARS
TRAIN_WINDOWS = 1500
EPOCHS = 4
SEED = 7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns, by start, then kind."""
    out: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


# --- the model ---------------------------------------------------------------

#: Tokens: runs of letters, runs of digits, single other characters.
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\sA-Za-z0-9]|\s")
#: What the window needs for a segment to be scored: a digit or an at-sign, or one spelled out.
_TRIGGER = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]")
#: Characters around a trigger that belong to its window.
REACH = 48


def windows_of(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers, merged, cut at white space."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        s, e = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


_CUES = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "payment", "iban", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
}


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str] | None:
    """Whole-span features of tokens i to j - 1; None where no entity can have this span."""
    start, end = tokens[i][0], tokens[j - 1][1]
    if end - start > MAX_CHARS:
        return None
    first, last = text[start], text[end - 1]
    if not (first.isalnum() or first in "+(") or not last.isalnum():
        return None
    span = text[start:end]
    if "\n" in span:
        return None
    digits = sum(c in "0123456789" for c in span)
    marked = "@" in span or (" at " in span or "(at)" in span or "[at]" in span)
    if not marked and digits < 4:
        return None
    letters = sum(c.isalpha() for c in span)
    shape = re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", span))
    before, after = text[start - 1 : start], text[end : end + 1]
    out = [
        "bias",
        f"digits={min(digits, 20)}",
        f"letters={min(letters, 12) if letters < 4 else 'many'}",
        f"dots={min(span.count('.'), 4)}",
        f"dashes={min(span.count('-'), 3)}",
        f"spaces={min(span.count(' '), 4)}",
        f"at={'@' in span},{'(at)' in span or '[at]' in span}",
        f"plus={first == '+'}",
        f"left={'w' if before.isalnum() else before if before in '.-+@_=' else ' '}",
        f"right={'w' if after.isalnum() else after if after in '-+@_=' else ' '}",
        f"shape={shape if len(shape) <= 15 else 'long'}",
    ]
    if digits and not letters:
        parts = [p for p in re.split(r"[^0-9]+", span) if p]
        out.append(f"parts={min(len(parts), 6)},{max(map(len, parts)) if len(parts) < 6 else '-'}")
        out.append(f"octets={len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
        whole = "".join(parts)
        out.append(f"luhn={12 <= len(whole) <= 19 and luhn(whole)}")
    near = text[max(0, start - 24) : start].lower()
    out += [f"cue={k}" for k, cues in _CUES.items() if any(c in near for c in cues)]
    return out


def candidates(text: str, tokens: list[tuple[int, int]]) -> dict[int, list[tuple[int, list[str]]]]:
    """For each token that may end a segment (exclusive index): starts and features."""
    out: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
    hot = [any(c in "0123456789@" for c in text[s:e]) or text[s:e] == "at" for s, e in tokens]
    for i in range(len(tokens)):
        seen = False
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            seen = seen or hot[j - 1]
            if seen and (f := features(text, tokens, i, j)):
                out[j].append((i, f))
    return out


def viterbi(n: int, cands: dict[int, list[tuple[int, list[str]]]], weights: dict[str, dict[str, float]], forced: dict[int, tuple[int, str]], blocked: list[bool]) -> list[tuple[int, int, str]]:
    """Best segmentation of n tokens: outside tokens score 0; ``forced`` segments (end -> start, kind) are on every path."""
    best: list[float] = [0.0] * (n + 1)
    back: list[tuple[int, str] | None] = [None] * (n + 1)
    for j in range(1, n + 1):
        if j in forced:
            i, kind = forced[j]
            best[j], back[j] = best[i], (i, kind)
            continue
        best[j] = best[j - 1]
        for i, f in cands.get(j, ()):
            if any(blocked[i:j]):
                continue
            for kind in KINDS:
                w = weights[kind]
                score = best[i] + sum(w.get(x, 0.0) for x in f)
                if score > best[j]:
                    best[j], back[j] = score, (i, kind)
    out, j = [], n
    while j:
        if back[j]:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i
        else:
            j -= 1
    return out[::-1]


def expectation(n: int, cands: dict[int, list[tuple[int, list[str]]]], weights: dict[str, dict[str, float]]) -> dict[tuple[int, int, str], float]:
    """Marginal probability of each segment, by forward and backward sums over all segmentations."""
    scored = {(i, j, k): sum(weights[k].get(x, 0.0) for x in f) for j, rows in cands.items() for i, f in rows for k in KINDS}
    ends, starts = defaultdict(list), defaultdict(list)
    for (i, j, k), s in scored.items():
        ends[j].append((i, s))
        starts[i].append((j, s))
    add = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward[j] = add([forward[j - 1], *(forward[i] + s for i, s in ends[j])])
    for i in range(n - 1, -1, -1):
        backward[i] = add([backward[i + 1], *(backward[j] + s for j, s in starts[i])])
    return {(i, j, k): math.exp(forward[i] + s + backward[j] - forward[n]) for (i, j, k), s in scored.items()}


def generated(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A window of made-up words with one value in it: personal data in some spelling, or something that only looks like it."""
    syllables = "ta re mi no lu est ver con dor al in ka shu bel ou tra".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    octet = lambda: str(rng.randint(0, 255))

    def card() -> str:
        body = rng.choice("3456") + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    group = lambda x, sep: sep.join(x[k : k + 4] for k in range(0, len(x), 4))
    kind = rng.choice([*KINDS, *KINDS, "", "", ""])
    if kind == "email":
        at, dot = rng.choice([("@", "."), ("@", "."), (" (at) ", "."), ("[at]", ".")])
        value = f"{word()}{rng.choice(['', '.' + word(), d(2), '.' + d(2)])}{at}{word()}{rng.choice(['', d(1)])}{dot}{rng.choice(['com', 'example.org', 'net', 'de'])}"
    elif kind == "ip":
        value = ".".join(octet() for _ in range(4))
    elif kind == "card":
        value = rng.choice([card(), group(card(), " "), group(card(), "-")])
    elif kind == "phone":
        area, a, b = d(3), d(3), d(4)
        value = rng.choice([f"+{rng.choice('123469')} ({area}) {a}-{b}", f"({area}) {a}-{b}", f"+{d(2)} {area} {a} {b}", f"{area}-{a}-{b}", f"+{d(11)}", f"00{d(2)} {area} {a} {b}"])
    else:
        value = rng.choice(
            [
                f"{rng.randint(1, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 30)}", f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}", str(rng.randint(1900, 2030)), f"{d(2)}-{d(2)}-{rng.randint(1990, 2030)}",
                f"{rng.randint(1, 999)}.{d(3)}.{d(3)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), d(rng.randint(4, 7)), f"{rng.randint(300, 999)}.{rng.randint(300, 999)}.{d(3)}.{d(3)}",
                f"{d(4)} - {d(4)}", f"@{word()}", f"{word()} at {word()}", d(rng.randint(20, 30)), f"{rng.randint(1990, 2030)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", f"{d(6)}.{d(6)}", d(16) if rng.random() < 0.3 else d(13),
            ]
        )
    cue = rng.choice(["", "", "", "", rng.choice(_CUES[kind or rng.choice(KINDS)]) + rng.choice([" ", ": "])])
    left = " ".join(word() for _ in range(rng.randint(0, 4)))
    left += (" " if left else "") + cue
    text = left + value + rng.choice(["", ".", ",", " "]) + " " + " ".join(word() for _ in range(rng.randint(0, 4)))
    return text, [(len(left), len(left) + len(value), kind)] if kind else []


@functools.cache
def trained(windows: int = TRAIN_WINDOWS, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, dict[str, float]]:
    """Weights by kind and feature: AdaGrad on the conditional log-likelihood."""
    rng = random.Random(seed)
    data = []
    for _ in range(windows):
        text, gold = generated(rng)
        tokens = tokens_of(text, 0, len(text))
        cands = candidates(text, tokens)
        place = {(tokens[i][0], tokens[j - 1][1]): (i, j) for j, rows in cands.items() for i, _ in rows}
        if missing := [text[s:e] for s, e, _ in gold if (s, e) not in place]:
            raise ValueError(f"no candidate segment covers {missing}")
        data.append((len(tokens), cands, {(*place[s, e], k) for s, e, k in gold}))
    weights: dict[str, dict[str, float]] = {k: defaultdict(float) for k in KINDS}
    squares: dict[str, dict[str, float]] = {k: defaultdict(float) for k in KINDS}
    for _ in range(epochs):
        rng.shuffle(data)
        for n, cands, gold in data:
            p = expectation(n, cands, weights)
            step: dict[tuple[str, str], float] = defaultdict(float)
            for j, rows in cands.items():
                for i, f in rows:
                    for k in KINDS:
                        g = ((i, j, k) in gold) - p[i, j, k]
                        if abs(g) > 1e-4:
                            for x in f:
                                step[k, x] += g
            for (k, x), g in step.items():
                squares[k][x] += g * g
                weights[k][x] += 0.5 * g / (1e-6 + math.sqrt(squares[k][x]))
    return {k: dict(w) for k, w in weights.items()}


def find(text: str, weights: dict[str, dict[str, float]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and the spans that the model adds; added ones overlap no base span."""
    base = base_spans(text)
    added: list[tuple[int, int, str]] = []
    at = 0
    for start, end in windows_of(text):
        tokens = tokens_of(text, start, end)
        blocked = [False] * len(tokens)
        while at < len(base) and base[at][1] <= start:
            at += 1
        near = at
        for x, (a, b) in enumerate(tokens):
            while near < len(base) and base[near][1] <= a:
                near += 1
            # base spans of different kinds may overlap, so look a few ahead
            blocked[x] = any(s < b and e > a for s, e, _ in base[near : near + 4])
        if all(blocked[x] or not _TRIGGER.search(text, *tokens[x]) for x in range(len(tokens))) and "at" not in text[start:end]:
            continue
        # each run of blocked tokens is one segment that every path contains
        forced: dict[int, tuple[int, str]] = {}
        x = 0
        while x < len(tokens):
            if blocked[x]:
                y = x
                while y < len(tokens) and blocked[y]:
                    y += 1
                forced[y] = (x, "")
                x = y
            else:
                x += 1
        for i, j, kind in viterbi(len(tokens), candidates(text, tokens), weights, forced, blocked):
            if kind:
                added.append((tokens[i][0], tokens[j - 1][1], kind))
    return base, added


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, last = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= last:
            out += [text[last:s], f"<{k}>"]
        last = max(last, e)
    return "".join([*out, text[last:]])


FIELDS = [
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
    T.StructField("base_spans", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def find_personal_data(docs: DataFrame, text_col: str = "text", mask: bool = False) -> DataFrame:
    """All columns of ``docs`` plus counts of base spans by kind, base_spans and spans (``kind:start:end``, comma-joined); with ``mask`` also masked_text."""
    weights = share(docs.sparkSession, trained())
    fields = FIELDS + [T.StructField("masked_text", T.StringType())] * mask

    def make():
        w = weights()

        def fn(batch: pa.RecordBatch) -> dict[str, object]:
            out: dict[str, list] = {f.name: [] for f in fields}
            for text in batch.column(text_col).to_pylist():
                base, added = find(text or "", w)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(x[2] == k for x in base))
                spans = in_order(base + added) if added else base
                out["base_spans"].append(listed(base))
                out["spans"].append(listed(spans))
                if mask:
                    out["masked_text"].append(masked(text, spans) if spans else text)
            return out

        return fn

    return map_batches(docs, fields, make)


def op5_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span, base or added, is replaced by its kind in angle brackets; no document goes.

    Null and empty texts come back as they were, repeated rows are masked alike.  But for
    text (and n_chars, where there is one) of documents with spans, all columns of the input come back as they were, whatever
    their names; an empty table gives an empty result.
    """
    given, own = shielded(docs, [*(f.name for f in FIELDS), "masked_text"])
    found = find_personal_data(given, mask=True)
    changed = ~F.col("masked_text").eqNullSafe(F.col("text"))
    new = {"text": F.col("masked_text"), "n_chars": F.when(changed, F.length("masked_text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[new[c].alias(c) if c in new else own(c) for c in docs.columns])


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
