"""The ten training-data operators: brute force, round trips, held-out accuracy and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrand.llm import decontaminate, html_extract, near_dedup, packing, pii, quality_classifier, quality_rules, queries, rans, sharding, tokens, toxicity

DOCS = "doc_id bigint, text string, shard string, label int, ids string, row int, key string"
ODD = [None, "", " ", "\n\n", "a", "a b c", "word " * 3000, "\U0001f600 é\u0085x᠎ y", "x" * 5000]


def odd_docs(spark):
    """Null, empty and long texts, a null id, repeated rows and columns whose names clash with the operators' own."""
    rows = [(i, t, "s", 1, "i", 2, "k") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[6], (None, "no id", "s", 1, "i", 2, "k")], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


# --- 1


def brute_classes(docs, threshold=0.8):
    sets = {}
    for i, text in docs:
        w = words(text)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                parent[b] = a
    return {i: top(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs = []
    for base in range(12):
        text = rng.choices(vocabulary, k=rng.randint(4, 300))
        for _ in range(rng.randint(1, 14)):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(copy)))
    rng.shuffle(docs)
    want, table = brute_classes(docs), spark.createDataFrame(docs, "doc_id bigint, text string")
    assert dict(near_dedup.near_duplicate_classes(table).collect()) == want
    # buckets in many slices, by texts and by shingles, which meet in a second round
    assert dict(near_dedup.near_duplicate_classes(table, slice_texts=2).collect()) == want
    assert dict(near_dedup.near_duplicate_classes(table, slice_shingles=700).collect()) == want


def test_large_groups_are_compared_as_matrices():
    rng = np.random.default_rng(7)
    base = rng.choice(10**6, 150, replace=False).astype(np.uint64)
    sets = []
    for k in range(300):
        new = base.copy()
        new[rng.choice(150, rng.integers(0, 60), replace=False)] = 10**6 + rng.integers(500)
        sets.append(np.unique(new))
    counts = near_dedup.common_counts(sets)
    assert all(counts[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(0, 300, 7) for b in range(300) if a != b)
    i, j = np.triu_indices(300, 1)
    weighted = [(s, np.ones(len(s), np.int64)) for s in sets]
    label = near_dedup.linked(weighted, i, j, 0.8)
    parent = list(range(300))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if near_dedup.similarities(weighted[a], weighted[b])[1] >= 0.8:
            low, high = sorted((parent[a], parent[b]))
            parent = [low if p == high else p for p in parent]
    assert label.tolist() == parent and 1 < len(set(parent)) < 300
    starts = np.array([0, 3, 4, 700, 703])
    got = [(a, b) for x, y in near_dedup.pairs_of(starts) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert got == [(a, b) for s, e in zip(starts[:-1], starts[1:], strict=True) for a in range(s, e) for b in range(a + 1, e)]


def test_near_duplicates_with_repeated_passages_equal_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    docs = []
    for _ in range(20):
        text = rng.choices(vocabulary, k=304)
        at = rng.randrange(280)
        # as sets of shingles the two are nearly alike, by counts they are not
        docs += [(len(docs), " ".join(text)), (len(docs) + 1, " ".join(text[: at + 19] + text[at : at + 19] * 20 + text[at + 19 :]))]
    found = {r[0]: r[1] for r in near_dedup.near_duplicate_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert found == brute_classes(docs) and len(set(found.values())) == 20


def test_near_duplicates_of_odd_rows(spark):
    out = near_dedup.near_duplicate_classes(odd_docs(spark)).collect()
    assert len(out) == len(ODD) + 2
    classes = {r["doc_id"]: r["class_id"] for r in out}
    assert all(c == i for i, c in classes.items())
    assert near_dedup.near_duplicate_classes(empty_docs(spark)).count() == 0


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "c"), (None, "no id", "d"), (None, "no id", "d"), (3, "same id, other text", "e"), (8, None, "f"), (9, "", "g"), (10, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
    kept = near_dedup.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter([rows[1], rows[4], *rows[6:]])
    assert near_dedup.dedup_stage(spark, docs.limit(0), "").count() == 0


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    elements = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    a, b = (elements[:300], rng.integers(1, 5, 300)), (elements[60:360], rng.integers(1, 5, 300))
    sig = near_dedup.prob_minhash([a, b], 6000)
    exact = near_dedup.similarities(a, b)[0]
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03
    alone = near_dedup.prob_minhash([b], 6000)
    assert (alone[0] == sig[1]).all()


# --- 2


def test_main_text_only(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><a>Home</a></nav><header>Site</header><article><h1>Head &amp; tail</h1>"
        "<p>First   <b>bold</b>\nline.</p><p>Second &eacute;.</p></article><div class='sidebar'>Buy</div><form>Name</form><footer>Foot</footer><script>x()</script></body></html>"
    )
    pages = spark.createDataFrame([(1, "http://a/1", page), (2, None, None), (3, "http://a/2", "")], "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()}
    assert found == {1: "Head & tail\nFirst bold line.\nSecond é.", 2: "", 3: ""}
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


def test_buttons_inline_adverts_and_hidden_text_are_left_out():
    page = (
        "<article><p>One <span class='advert'>Buy</span>two <button>Subscribe now</button><a href='/x' title='hidden'>three</a>.</p>"
        "<div style='display: none'>Four</div><p hidden>Five</p><span class=ad><div>Six</div></span><p>Seven</p></article>"
    )
    assert html_extract.main_text(page, set()) == "One two three.\nSeven"
    assert html_extract.main_text("<div>" * 3000 + "deep", set()) == "deep"


def test_the_tree_cuts_without_names(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = html_extract.extract_main_text(pages, by_name=False).collect()
    noise = cut = 0
    for r in found:
        names, everything, left = (Counter(x.split("\n")) for x in (html_extract.main_text(r["html"], set()), html_extract.main_text(r["html"], set(), False), r["text"]))
        assert not names - left
        noise, cut = noise + (everything - names).total(), cut + (everything - left).total()
    assert cut > 0.85 * noise


def test_importance_equals_brute_force(spark):
    rng = random.Random(5)
    pages = []
    for i in range(60):
        strip = f"<div><p>Latest</p><p>{rng.choice(['a', 'b', 'c'])}</p></div>"
        text = "".join(f"<p>{rng.random()}</p>" for _ in range(rng.randint(1, 3)))
        pages.append((i, f"http://{rng.choice('xyz')}/{i}", f"<body><section>{text}</section>{strip * rng.randint(0, 1)}</body>"))
    table = spark.createDataFrame([*pages, (60, pages[0][1], pages[0][2])], "page_id bigint, url string, html string")
    rows = table.select(F.regexp_extract("url", html_extract.HOST, 1).alias("host"), "html")
    tree = html_extract.style_tree(rows)
    found = {(r["host"], r["node"]): (r["m"], r["importance"], r["most"]) for r in html_extract.composite_importance(tree, ["host"]).collect()}

    def entropy(counts, m):
        total = sum(counts.values())
        return min(1.0, -sum(n / total * np.log(n / total) for n in counts.values()) / np.log(m)) if m > 1 else 1.0

    for host in "xyz":
        mine = [html_extract.Page(h) for _, u, h in pages if f"//{host}/" in u]
        have, held, shown = Counter(), defaultdict(Counter), defaultdict(Counter)
        for page in mine:
            branches = {b[:k] for b in [*(x[0] for x in page.blocks), *(x[0] for x in page.shown)] for k in range(1, len(b) + 1)}
            have.update(branches)
            for b, t in {(x[0], x[3]) for x in page.blocks}:
                held[b][t] += 1
            for b, c in {(x[0], x[2]) for x in page.shown}:
                shown[b][c] += 1
        want = {}
        for b, m in have.items():
            under = [c for c in held if c[: len(b)] == b]
            total = sum(held[c].total() for c in under)
            inside = sum(entropy(held[c], have[c]) * held[c].total() for c in under) / total if total else 1.0
            want[b] = 0.9 * inside + 0.1 * entropy(shown[b], m) if b in shown else inside
        for b, m in have.items():
            got = found[host, b[-1]]
            assert got[0] == m and abs(got[1] - want[b]) < 1e-9 and abs(got[2] - max(v for c, v in want.items() if c[: len(b)] == b)) < 1e-9
    # the strip that repeats is cut as a whole branch, and the texts are whole
    for r in html_extract.extract_main_text(table, by_name=False).collect():
        assert r["text"] == "\n".join(re.findall(r"<p>(0[^<]*)</p>", r["html"]))


def test_main_text_of_odd_pages(spark):
    rows = [(1, "http://a/1", "<p>x</p>", "keep", "me", "too"), (None, None, None, "keep", None, None), (3, "", "<div", "l", "h", "t"), (3, "no url", "&lt;b&gt; <p", "l", "h", "t"), (1, "http://a/1", "<p>x</p>", "keep", "me", "too"), (4, "http://a/1", "<p>" + "word " * 300_000, "", "", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, low string, host string, row string")
    out = html_extract.extract_main_text(pages)
    assert out.columns == [*pages.columns, "text"]
    assert Counter(tuple(r)[:6] for r in out.collect()) == Counter(rows)
    assert Counter(r["text"] for r in out.filter("page_id < 4 or page_id is null").collect()) == Counter({"x": 2, "": 2, "<b>": 1})
    assert out.filter("page_id = 4").first()["text"] == ("word " * 300_000).strip()


# --- 3


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunked_ids_are_the_library_ids(spark, sf, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path(vocabulary))
    encoder = tokens.TextEncoder(vocabulary, 1)
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += [*ODD, "a  b", "a \n b", "don't  stop.\n\n\tNow", "<|endoftext|> x", "a<|endoftext|>b\n", "<|ENDOFTEXT|> <|startoftext|>", "< |endoftext|", "İstanbul ﬁ", "1,234.56 -- [x](y)"]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == library.encode(text or "", add_special_tokens=False).ids + [1]


def test_full_memo_keeps_the_words_met_first(monkeypatch):
    """Rare words beyond the memo's size don't make the common ones be encoded again; the ids stay those of the library."""
    monkeypatch.setattr(tokens, "MEMO", 60)
    encoder = tokens.TextEncoder("byte_bpe_50k.json", 3)
    model, seen = encoder.model, []

    class Counting:
        def tokenize(self, text):
            seen.append(text)
            return model.tokenize(text)

    encoder.model = Counting()
    common = "the quick brown fox jumps over\na lazy dog"
    for k in range(200):
        rare = "".join(chr(97 + int(d)) for d in str(k * 7919))
        seen.clear()
        text = f"{common} {rare}, {rare}."
        assert encoder.encode(text) == encoder.direct(text) + encoder.end
        assert not k or len(seen) <= 2 and set(seen) <= {"\u0120" + rare}


def test_rans_round_trip_and_checkpoints():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1023, 1024, 300_000):
        ids = np.minimum(rng.geometric(0.01, n), 5000).astype(np.uint32)
        coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=5001)))
        stream, states, marks = coder.encode(ids)
        assert (coder.decode(n, stream, states) == ids).all()
        for m in marks:
            assert (coder.decode(n, stream, m["states"], m["step"], m["word"]) == ids[m["step"] * rans.LANES :]).all()


def test_token_store(spark, tmp_path):
    docs = odd_docs(spark)
    rans.write_store(docs, "word_bpe_49k.json", 1, str(tmp_path / "store"))
    rows = sorted(rans.read_store(spark, str(tmp_path / "store")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in docs.collect()), key=lambda i: (i is not None, i))
    at = 0
    encoder = tokens.TextEncoder("word_bpe_49k.json", 1)
    texts = {i: t for i, t in enumerate(ODD)} | {None: "no id"}
    for r in rows:
        assert r["start"] == at
        assert np.frombuffer(r["ids"], "<u4").tolist() == np.frombuffer(encoder.encode(texts[r["doc_id"]]), encoder.dtype).tolist()
        at += r["n_tokens"]
    rans.write_store(empty_docs(spark), "word_bpe_49k.json", 1, str(tmp_path / "none"))
    assert rans.read_store(spark, str(tmp_path / "none")).count() == 0


# --- 4


def check_packing(rows, docs, window=1024):
    encoder = tokens.TextEncoder("byte_bpe_50k.json", 0)
    want = Counter(encoder.encode(t) for _, t in docs)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    assert sum(r["length"] for r in rows) == sum(len(x) // encoder.dtype.itemsize * n for x, n in want.items())
    return by_doc, encoder


def test_packing(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.packed_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    by_doc, encoder = check_packing(rows, docs)
    for i, text in docs:
        ids = np.frombuffer(encoder.encode(text), encoder.dtype).astype("<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    total = sum(r["length"] for r in rows)
    assert total / (1024 * len({r["sequence_id"] for r in rows})) > 0.98


def test_packing_of_odd_rows(spark):
    docs = odd_docs(spark)
    check_packing(packing.packed_documents(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert packing.packed_documents(empty_docs(spark)).count() == 0


def test_neighbours_are_found_by_whole_documents(spark):
    encoder = tokens.TextEncoder("byte_bpe_50k.json", 0)

    def text(filler, rest):
        """A topic of some windows, then filler, of which ``rest`` ids (with the end id) are left after the full windows."""
        out = "zebra quartz violin harbour walnut glacier" * 20 + filler * 64
        while len(encoder.encode(out)) // encoder.dtype.itemsize % 64 != rest:
            out += filler
        return out

    # the rest of the seed shares nothing with that of document 1, and "the" with all others
    texts = [text(" the", 50), text(" of", 10), *(" the" * 6 for _ in range(8))]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "byte_bpe_50k.json", 0, window=64).collect()
    seed = next(r for r in rows if r["doc_id"] == 0 and r["length"] == 50)
    assert seed["offset"] == 0
    assert next(r for r in rows if r["sequence_id"] == seed["sequence_id"] and r["offset"] == 50)["doc_id"] == 1


# --- 5

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_base_spans_equal_the_patterns(spark, sf):
    rng = random.Random(4)
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["".join(rng.choices("a1290.@+-() \n", k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["1.2.3.4.5.6.7.8", "a@b.c.d@e.f", "@@a@b.c", "0001.2.3.4", "4111 1111 1111 1111", "+1 (212) 555-0000"]
    for text in texts:
        assert pii.listed(pii.base_spans(text or "")) == brute_spans(text)


def test_added_spans_and_masks(spark):
    docs = spark.createDataFrame([(1, "write to ann.lee (at) mail.example.org or call 212-555-0142 now"), (2, None), (3, "version 1.2.3 of 2021")], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs, mask=True).collect()}
    assert {s.split(":")[0] for s in found[1]["spans"].split(",")} == {"email", "phone"}
    assert "555" not in found[1]["masked_text"] and "example" not in found[1]["masked_text"]
    assert found[2]["spans"] == "" and found[3]["spans"] == ""
    out = pii.find_personal_data(odd_docs(spark))
    assert out.count() == len(ODD) + 2 and set(DOCS.replace(",", "").split()[::2]) <= set(out.columns)


def test_long_spelled_out_addresses_are_marked_whole(spark):
    docs = spark.createDataFrame([(1, "write to ann.lee (at) mail.example.org or call 212-555-0142 now")], "doc_id bigint, text string")
    found = pii.find_personal_data(docs, mask=True).first()
    assert found["spans"] == "email:9:38,phone:47:59" and "ann" not in found["masked_text"]


def test_every_generated_value_is_a_candidate():
    rng = random.Random(14)
    for _ in range(3000):
        text, gold = pii.generated(rng)
        tokens = pii.tokens_of(text, 0, len(text))
        have = {(tokens[i][0], tokens[j - 1][1]) for j, rows in pii.candidates(text, tokens).items() for i, _ in rows}
        assert {(s, e) for s, e, _ in gold} <= have


def segmentations(n, segments):
    """All sets of segments (start, end, kind) without overlap, in order, over n tokens."""
    if n == 0:
        return [()]
    out = segmentations(n - 1, segments)
    for s in segments:
        if s[1] == n:
            out = out + [(*before, s) for before in segmentations(s[0], segments)]
    return out


def test_viterbi_and_marginals_equal_enumeration():
    rng = random.Random(15)
    for _ in range(60):
        n = rng.randint(1, 5)
        places = [(i, j) for i in range(n) for j in range(i + 1, n + 1)]
        cands = defaultdict(list)
        for i, j in rng.sample(places, min(len(places), 4)):
            cands[j].append((i, [f"f{i}.{j}", "bias"]))
        weights = {k: {x: rng.gauss(0, 2) for rows in cands.values() for _, f in rows for x in f} for k in pii.KINDS}
        score = {(i, j, k): sum(weights[k][x] for x in f) for j, rows in cands.items() for i, f in rows for k in pii.KINDS}
        every = segmentations(n, list(score))
        total = [sum(score[s] for s in segments) for segments in every]
        found = pii.viterbi(n, cands, weights, {}, [False] * n)
        assert sum(score[s] for s in found) == pytest.approx(max(total)) and tuple(found) in every
        mass = sum(np.exp(total))
        for s, p in pii.expectation(n, cands, weights).items():
            assert p == pytest.approx(sum(np.exp(t) for t, segments in zip(total, every, strict=True) if s in segments) / mass)
        # a segment of the fixed patterns is on the path, and no other overlaps it
        i, j = rng.choice(places)
        held = pii.viterbi(n, cands, weights, {j: (i, "ip")}, [i <= t < j for t in range(n)])
        free = [sum(score[s] for s in segments) for segments in every if all(s[1] <= i or s[0] >= j for s in segments)]
        assert (i, j, "ip") in held and sum(score[s] for s in held if s != (i, j, "ip")) == pytest.approx(max(free))


# --- 6 and 8


def test_attention_gradient_equals_differences():
    rng = np.random.default_rng(16)
    model = quality_classifier.AttentionModel()
    for name in ("b", "d"):
        model.weights[name] += rng.normal(0, 0.3, model.weights[name].shape)
    x, starts, labels = rng.normal(0, 1, (9, quality_classifier.N_FEATURES)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, starts)["p"]
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).sum()

    f = model.forward(x, starts)
    assert np.allclose(np.add.reduceat(f["attention"], starts), 1)
    grads = model.gradient(f, starts, f["p"] - labels)
    for name, value in model.weights.items():
        flat = value.reshape(-1)
        for k in rng.choice(flat.size, min(flat.size, 12), replace=False):
            held = flat[k]
            flat[k] = held + 1e-5
            up = loss()
            flat[k] = held - 1e-5
            down = loss()
            flat[k] = held
            assert grads[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-7)


def auc(rows, label):
    good, bad = [s for s, y in rows if y == label], [s for s, y in rows if y != label]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("name", "label", "least"), [("op6_attention_quality", "quality", 0.9), ("op8_compression_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    data = "/root/testdata/sf0.1"
    out = queries.QUERIES[name](spark, data)
    assert out.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    rows = out.filter("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").select("score", label, "predicted").collect()
    print(name, data, auc([r[:2] for r in rows], 1), [sum(r[2] for r in rows if r[1] == y) / sum(r[1] == y for r in rows) for y in (1, 0)])
    assert auc([r[:2] for r in rows], 1) > least


@pytest.mark.parametrize("score", [quality_classifier.score_quality, toxicity.score_toxicity])
def test_scores_of_odd_rows(spark, score):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(ODD))], "doc_id bigint, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        rows = score(odd_docs(spark), given).collect()
        assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert score(empty_docs(spark), labels).count() == 0


def test_long_words_are_learned_and_scored_in_pieces():
    rng = random.Random(10)
    word = "".join(rng.choices("abcdef", k=500))
    assert {word[i : i + 9] for i in range(492)} <= {p[i : i + 9] for p in toxicity.pieces_of(word) for i in range(len(p) - 8)}
    # a script without spaces: each document is one word
    letters = [chr(0x4E00 + k) for k in range(900)]
    draw = lambda n: "".join(rng.choices(letters, k=n))
    toxic = [toxicity.windows_of(draw(200) + "\u9f98\u9f99\u9f9a" + draw(200)) for _ in range(30)]
    ordinary = [toxicity.windows_of(draw(400)) for _ in range(60)]
    count = lambda docs: Counter(s for d in docs for s in toxicity.segments_of(d))
    typical = toxicity.typical_segments({s: n for s, n in count(toxic).items() if n >= 4}, 30, count(ordinary), 60)
    assert any("\u9f98\u9f99\u9f9a".encode() in s for s in typical)
    assert max(len(w) for doc in toxic for w in doc) < 10 * 4 * 64 + 12


# --- 7


def test_shards(spark):
    n = 1000
    df = spark.range(n).select("id", F.lit("x").alias("shard"), F.lit(None).cast("string").alias("t"))
    rows = sharding.uniform_shards(df, shards=7, block_rows=50).collect()
    assert sorted(r["id"] for r in rows) == list(range(n))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert rows == sharding.uniform_shards(df, shards=7, block_rows=50).collect() or sorted(rows) == sorted(sharding.uniform_shards(df, shards=7, block_rows=50).collect())
    assert sharding.uniform_shards(odd_docs(spark)).count() == len(ODD) + 2
    assert sharding.uniform_shards(empty_docs(spark)).count() == 0


def test_copies_of_one_row_are_dealt_uniformly(spark):
    """Slots and shards of equal rows spread like those of any rows (chi-square over 7 shards and 10 tenths of the slots)."""
    df = spark.range(7000).select(F.lit("same").alias("text"), (F.col("id") < 3500).alias("first"))
    rows = sharding.uniform_shards(df, shards=7, block_rows=100).collect()
    cells = Counter((r["shard"], r["slot"] // 100) for r in rows if r["first"])
    assert sum((cells[s, t] - 50) ** 2 / 50 for s in range(7) for t in range(10)) < 110


def test_shards_of_the_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op7_hypergeometric_shuffle"](spark, sf).collect():
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_communication_matrix_margins_and_law():
    counts, sizes = [10, 0, 25, 5], [14, 13, 13]
    for seed in range(50):
        m = sharding.communication_matrix(counts, sizes, seed)
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes
    rng = random.Random(1)
    mean = sum(sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)) / 4000
    assert abs(mean - 6) < 0.15


# --- 9


def brute_hits(text, items, window=13):
    w, hit, found = words(text), set(), []
    for name, item in items:
        iw = words(item)
        grams = [iw[k : k + window] for k in range(len(iw) - window + 1)] if len(iw) >= window else [iw] * bool(iw)
        seen = False
        for g in grams:
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit |= set(range(k, k + len(g)))
                    seen = True
        if seen:
            found.append(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [10**6, 60])
def test_benchmark_hits_equal_brute_force(spark, block_words):
    rng = random.Random(6)
    draw = lambda n: " ".join(rng.choices("a B c d é".split(), k=n))
    items = [(i, draw(rng.choice([0, 2, 5, 12, 13, 14, 40]))) for i in range(30)] + [(98, None), (99, "A b, a B")]
    docs = []
    for i in range(120):
        parts = [draw(rng.randint(0, 40)), (items[rng.randrange(30)][1] or "").replace(" ", rng.choice([" ", ", ", "\n"]))[: rng.choice([20, 400])], draw(rng.randint(0, 20))]
        docs.append((i, " ".join(parts)))
    docs += [(500, None), (501, "")]
    found = decontaminate.find_benchmark_spans(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_words=block_words)
    for r in found.collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(dict(docs)[r["doc_id"]], items)


def test_benchmark_hits_equal_sql(spark):
    data, name = "/root/testdata/sf0.01", "op9_suffix_automaton_decontamination"
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
        want = db.sql(queries.ORACLES[name])
        columns, rows = want.columns, want.fetchall()
    assert Counter(map(tuple, queries.QUERIES[name](spark, data).select(*columns).collect())) == Counter(rows)


def test_cutting_in_blocks_equals_cutting_in_one(spark):
    rng = random.Random(9)
    draw = lambda n: " ".join(rng.choices("a B c d é".split(), k=n))
    items = [(i, draw(rng.choice([5, 13, 14, 40]))) for i in range(12)]
    # x y z lies round another item, so that a first cut makes a second hit, of another block
    items += [(50, "p q r s t u v w"), (51, "x y z x y z")] + [(60 + i, draw(40)) for i in range(3)]
    docs = [(i, draw(rng.randint(0, 30)) + " " + items[i % 12][1] + " " + draw(rng.randint(0, 200))) for i in range(60)]
    docs += [(500, None), (501, ""), (502, "k x y z p q r s t u v w x y z m"), (503, "k x y z p q r s t u v w x y z m"), (504, "n " * 500 + items[50 - 38][1])]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    one, many = (sorted(decontaminate.find_benchmark_spans(docs, items, clean_below=20, block_words=n).collect()) for n in (10**6, 60))
    assert many == one
    assert {r["clean_text"] for r in many if r["doc_id"] in (502, 503)} == {"k \n m"}


def test_decontamination_of_odd_rows(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_benchmark_spans(odd_docs(spark), none).filter("n_hit > 0").count() == 0
    assert decontaminate.find_benchmark_spans(empty_docs(spark), none).count() == 0


# --- 10


def brute_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(spark, sf):
    rng = random.Random(8)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10**6 + i, t) for i, t in enumerate([*ODD, *("".join(rng.choices("ab \n\t#é\x0b ", k=80)) for _ in range(200))])]
    out = quality_rules.weakly_supervised_quality(spark.createDataFrame(docs, "doc_id bigint, text string"))
    texts = dict(docs)
    for r in out.collect():
        want = brute_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.weakly_supervised_quality(empty_docs(spark)).count() == 0


def test_expectation_maximisation_equals_row_by_row():
    """The estimate from counts of vote patterns is that of a plain loop over rows."""
    rng = random.Random(13)
    names = ["a", "b", "c"]
    rows = []
    for _ in range(600):
        good = rng.random() < 0.7
        rows.append([rng.choice([0, 1 if good == (rng.random() < p) else -1, 1 if good == (rng.random() < p) else -1]) for p in (0.9, 0.8, 0.7)])
    found = quality_rules.estimate([(list(v), n) for v, n in Counter(map(tuple, rows)).items()], names)
    balance, accuracy = 0.8, {k: quality_rules.START for k in names}
    for _ in range(quality_rules.ITERATIONS):
        yes = {k: [8.0, 8.0] for k in names}
        every = {k: [10.0, 10.0] for k in names}
        total = 0.0
        for r in rows:
            g, b = balance, 1 - balance
            for k, v in zip(names, r, strict=True):
                if v:
                    g *= accuracy[k][0] if v == 1 else 1 - accuracy[k][0]
                    b *= 1 - accuracy[k][1] if v == 1 else accuracy[k][1]
            p = g / (g + b)
            total += p
            for k, v in zip(names, r, strict=True):
                if v:
                    yes[k][0] += p * (v == 1)
                    yes[k][1] += (1 - p) * (v == -1)
                    every[k][0] += p
                    every[k][1] += 1 - p
        bound = lambda x, low, high: min(high, max(low, x))
        new = {k: (bound(yes[k][0] / every[k][0], *quality_rules.GOOD_BOUNDS), bound(yes[k][1] / every[k][1], *quality_rules.BAD_BOUNDS)) for k in names}
        moved = max([abs(total / len(rows) - balance), *(abs(a - b) for k in names for a, b in zip(new[k], accuracy[k], strict=True))])
        balance, accuracy = total / len(rows), new
        if moved < quality_rules.TOLERANCE:
            break
    assert abs(found["balance"] - balance) < 1e-9
    assert all(abs(a - b) < 1e-9 for k in names for a, b in zip(found["accuracy"][k], accuracy[k], strict=True))


def test_quality_of_rows_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c " * 40, "x", "y"), (2, None, "x", "y")], "doc_id bigint, text string, votes string, n_words string")
    out = {r["doc_id"]: r for r in quality_rules.weakly_supervised_quality(docs).collect()}
    assert out[1]["n_words"] == 120 and out[1]["base_failed"] and out[2]["n_words"] == 0 and not out[2]["kept"]


# --- the pipeline


def test_stages_give_back_the_columns_of_their_input(spark, sf):
    """Null, empty and long texts, repeated rows, and columns that bear the names of the stages' own."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = "score spans n_ip items n_words n_hit clean_text masked_text base_spans digest class place id keys slot _row _text row host low".split()
    rows = [(i, t, *(f"{n} {i}" for n in names)) for i, t in enumerate([*ODD, "write to ann@example.org " * 30])]
    docs = spark.createDataFrame([*rows, rows[6], (None, None, *names)], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert {tuple(r)[2:] for r in out.collect()} <= {tuple(r)[2:] for r in docs.collect()}
        assert stage(spark, docs.limit(0), sf).count() == 0
    corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
    rows = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len({r["doc_id"] for r in rows}) <= n
    assert hashlib.sha256(repr(sorted(r["sequence_id"] for r in rows)).encode()).hexdigest()
