"""N-gram Jaccard join, decontamination, winnowing: against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from headwater.llm import decontaminate as D
from headwater.llm import ngram_jaccard as J
from headwater.llm import winnowing as W
from headwater.llm.components import connected_components
from tests.llm.fixtures import ODD, WORDS, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(max(len(w) - width, 0) + 1)) if w else frozenset()


def brute(texts, width, num, den):
    sets = [shingles(t, width) for t in texts]
    links = {k: set() for k in range(len(texts))}
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(texts)))
    for i in root:
        stack, seen = [i], {i}
        while stack:
            new = links[stack.pop()] - seen
            seen |= new
            stack += new
        root[i] = min(seen)
    return [(k, len(sets[k]), root[k], len(links[k])) for k in range(len(texts))]


def edited(text, rng, rate):
    return " ".join(w if rng.random() > rate else rng.choice(WORDS) for w in text.split())


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_join_matches_brute_force(spark, width, num):
    rng = random.Random(3)
    texts = list(ODD) + [t and t.upper() for t in ODD[3:6]]
    for k in range(12):
        base = prose(k, rng.choice([3, 9, 12, 40, 200]))
        texts += [base] + [edited(base, rng, rng.choice([0, 0.005, 0.02, 0.05])) for _ in range(5)]
    chain = prose(99, 300).split()
    texts += [" ".join(chain[k : k + 250]) for k in range(0, 50, 4)]
    hot = prose(100, 60)
    texts += [hot] * 20 + [f"{hot} tail{k}" for k in range(40)]
    got = J.ngram_jaccard(documents(spark, texts), width, num, 100).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(texts, width, num, 100)


def test_join_of_no_rows_and_repeated_rows(spark):
    assert J.ngram_jaccard(documents(spark, ["a"]).limit(0)).count() == 0
    one = documents(spark, [prose(1, 20)])
    rows = J.ngram_jaccard(one.union(one)).collect()
    assert [(r["doc_id"], r["component_id"], r["n_links"]) for r in rows] == [(0, 0, 1), (0, 0, 1)]


def test_join_with_null_and_repeated_ids(spark):
    a, b, c = prose(1, 40), prose(2, 40), prose(3, 40)
    rows = [(None, a), (None, a + " end"), (5, b), (5, c), (4, c), (7, c + " end"), (None, None), (None, ""), (None, b), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("k1", F.lit("x"))
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["n_links"]) for r in J.ngram_jaccard(docs).collect()))
    assert got == sorted([(0, 36, 0, 1), (0, 37, 0, 1), (5, 36, 5, 1), (5, 36, 4, 2), (4, 36, 4, 2), (7, 37, 4, 2), (0, 0, 0, 0), (0, 0, 0, 0), (0, 36, 5, 1), (2, 0, 2, 0)])
    kept = J.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(texts) == 6 and {(5, b), (4, c), (None, None), (None, ""), (2, "")} <= set(texts) and ((None, a) in texts) != ((None, a + " end") in texts)
    assert J.drop_near_duplicates(docs.limit(0)).count() == 0
    again = J.drop_near_duplicates(docs.union(docs).filter("text <> ''"))
    assert again.count() == 3


def test_marks_dealt_over_ranges_tie_all_rows():
    rng = np.random.default_rng(5)
    mark = np.sort(np.r_[np.full(100, 7), np.full(40, 9), np.full(3, 11), rng.integers(20, 60, 80)])
    rep = np.arange(len(mark))
    for parts in (1, 2, 7, 50):
        edges, ends = [], {}
        for some in np.array_split(np.arange(len(mark)), parts):
            batches = [pa.RecordBatch.from_pydict({"mark": pa.array(mark[x]), "rep": pa.array(rep[x])}) for x in np.array_split(some, 3)]
            for table in J.marked_edges(iter(batches)):
                for r in table.to_pylist():
                    ends.setdefault(r["mark"], []).append(r["rep"]) if r["kind"] == J.END else edges.append((r["mark"], r["head"], r["rep"]))
        edges += [(m, x[0], y) for m, x in ends.items() for y in x[1:]]
        for m in set(mark.tolist()):
            near = {r: {r} for r in rep[mark == m].tolist()}
            for k, a, b in edges:
                if k == m:
                    whole = near[a] | near[b]
                    for r in whole:
                        near[r] = whole
            assert all(len(x) == (mark == m).sum() for x in near.values())
        assert len(edges) < 17 * len(mark)


def test_hot_blocks_are_cut_into_panels(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE_DOCS", 5)
    monkeypatch.setattr(J, "PANEL_TILES", 2)
    base = prose(50, 80)
    texts = [f"{base} {prose(60 + k, 1 + k % 3)}" for k in range(45)] + [prose(51, 30)]
    got = J.ngram_jaccard(documents(spark, texts), 3, 90, 100).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(texts, 3, 90, 100)


def test_sparse_and_dense_products_agree(monkeypatch):
    rng = np.random.default_rng(7)
    rows = [np.unique(rng.integers(0, 3000, 200)) for _ in range(20)] + [np.unique(np.r_[np.arange(190), rng.integers(0, 3000, 3)]) for _ in range(9)]
    found = []
    for factor in (0, 1 << 40):
        monkeypatch.setattr(J, "SPARSE", factor)
        found.append((J.linked_pairs(rows, None, 80, 100), J.linked_pairs(rows[:12], rows[12:], 80, 100)))
    assert all((x == y).all() for x, y in zip(*found, strict=True)) and found[0][0].sum() == 72


#: A word and its complement, whose polynomials modulo 2**64 are equal.
MORSE = "a"
for _ in range(11):
    MORSE += MORSE.translate(str.maketrans("ab", "ba"))
COMPLEMENT = MORSE.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    from headwater.llm import sentencepiece as S
    from headwater.llm import token_counts as T

    got = J.ngram_jaccard(documents(spark, [f"one {MORSE} two", f"one {COMPLEMENT} two"]), 3, 90, 100).collect()
    assert sorted(r["component_id"] for r in got) == [0, 1]
    bench = spark.createDataFrame([(1, f"one {MORSE} two")], "item_id long, text string")
    assert [r["n_hit"] for r in D.find_contamination(documents(spark, [f"one {COMPLEMENT} two", f"one {MORSE} two"]), bench).orderBy("doc_id").collect()] == [0, 3]
    texts = [MORSE, COMPLEMENT, f"{MORSE} {COMPLEMENT}"]
    assert all(r["round_trip"] for r in S.encode_sentencepiece(documents(spark, texts), digest=True).collect())
    one, two, both = [r["n_tokens"] for r in T.count_tokens(documents(spark, texts)).orderBy("doc_id").collect()]
    assert both == one + two


def test_tile_products_count_links_across_tiles():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 2**62, 400)
    rows = [np.unique(np.r_[rng.choice(base, 380, replace=False), rng.integers(1, 2**62, 5)]) for _ in range(30)]
    exact = np.array([[100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)) for b in rows] for a in rows])
    np.fill_diagonal(exact, False)
    assert (J.linked_pairs(rows, None, 90, 100) == exact).all()
    assert (J.linked_pairs(rows[:11], rows[11:], 90, 100) == exact[:11, 11:]).all()
    near = {frozenset(e) for e in J.spanning_forest(exact)}
    assert all(exact[a, b] for a, b in map(tuple, (e for e in near if len(e) == 2)))


def test_outlines_never_overstate():
    rng = np.random.default_rng(2)
    for n in (1, 5, 60, 900):
        a = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        b = np.unique(np.r_[a[: n // 2], rng.integers(0, 2**62, n // 3).astype(np.uint64)])
        assert J.least_difference(J.outline(a), J.outline(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 7), (200, 201), (300, 300)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in rows} == {**{k: 0 for k in range(41)}, 100: 0, 200: 200, 201: 200}


def windows_of(text, width):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    n = min(width, len(w))
    return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if n else []


@pytest.mark.parametrize("blocks", [1, 3])
def test_decontamination_matches_brute_force(spark, monkeypatch, blocks):
    items = [(1, prose(1, 30)), (2, prose(2, 12)), (10, "Short one here"), (11, ""), (12, None), (13, "été"), (2, prose(2, 12))]
    rng = random.Random(4)
    texts = list(ODD) + [f"x {prose(1, 30)} y", prose(1, 30)[:90], f"{prose(9, 50)} SHORT, one...here {prose(2, 12)}", "un Été; été", prose(1, 30) + " " + prose(1, 30)]
    texts += [" ".join(rng.choice(prose(1, 30).split()) for _ in range(200)) for _ in range(5)]
    if blocks > 1:
        monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in D.find_contamination(docs, bench, cut=True, keep=["lang", "spans"][:1]).collect()}
    owners = {}
    for i, t in items:
        for w in windows_of(t, 10):
            owners.setdefault(w, set()).add(i)
    for k, t in enumerate(texts):
        w = [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))]
        words, hit, found = [m[0] for m in w], [False] * len(w), set()
        for n in {len(x) for x in owners}:
            for a in range(len(w) - n + 1):
                if tuple(words[a : a + n]) in owners:
                    found |= owners[tuple(words[a : a + n])]
                    hit[a : a + n] = [True] * n
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["items"], r["lang"]) == (len(w), sum(hit), sorted(map(str, found)), "en")
        spans, a = [], 0
        while a < len(w):
            b = a
            while b < len(w) and hit[b]:
                b += 1
            if b > a:
                spans.append((w[a].start(), w[b - 1].end()))
            a = max(b, a + 1)
        assert [tuple(s) for s in r["spans"]] == spans
        rest, at = "", 0
        for s, e in spans:
            rest, at = rest + t[at:s], e
        assert r["clean_text"] == (None if t is None else rest + t[at:])


def test_decontamination_with_odd_ids_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 60)
    monkeypatch.setattr(D, "CHAIN", 2)
    texts = {"b": prose(1, 12), "a10": prose(2, 12), "a9": prose(2, 12), None: prose(3, 12)}
    bench = spark.createDataFrame([*texts.items(), *texts.items()], "item_id string, text string")
    docs = spark.createDataFrame([(None, texts["b"]), (1, f"{texts['a9']} and {texts['b']}"), (1, texts[None]), (1, texts[None])], "doc_id long, text string").withColumn("items", F.lit(7)).withColumn("hits", F.lit(8))
    rows = D.find_contamination(docs, bench, cut=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_hit"], r["items"], r["clean_text"]) for r in rows) == [(0, 12, ["b"], ""), (1, 12, [], ""), (1, 12, [], ""), (1, 24, ["a10", "a9", "b"], " and ")]


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in D.find_contamination(documents(spark, ["a b", None]), bench).collect()] == [0, 0]
    assert D.find_contamination(documents(spark, ["a"]).limit(0), bench).count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 4, 300)
    text[-1] = 0
    index = D.FMIndex(text, 3)
    for n in (1, 2, 4):
        patterns = rng.integers(1, 4, (20, n))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]


def test_fingerprints(spark):
    texts = list(ODD) + [prose(k, 80) for k in range(4)] + [prose(3, 80), prose(5, 40) + " " + prose(0, 80)]
    texts = [t if t is None else t.replace("\x00", "") for t in texts]
    rows = {r["doc_id"]: r for r in W.fingerprint_edits(documents(spark, texts, first=-3)).withColumn("shown", W.shown("fingerprint")).collect()}
    ids = sorted(rows, reverse=True)
    by = {k - 3: t or "" for k, t in enumerate(texts)}
    sets = {i: {x.split("@")[0] for x in rows[i]["shown"].split(",") if x} for i in ids}
    for place, i in enumerate(ids):
        t, after = by[i], by[ids[(place + 1) % len(ids)]]
        assert rows[i]["edited"] == t[: len(t) - len(t) // 2] + after[: len(t) // 2] and rows[i]["n_chars"] == len(t)
        b = sets[ids[(place + 1) % len(ids)]]
        assert rows[i]["near_next"] == pytest.approx(len(sets[i] & b) / len(sets[i] | b) if sets[i] | b else 1.0)
    assert rows[ids[0]]["fingerprint"] != rows[ids[1]]["fingerprint"] and sets[8 + 0] <= sets[len(texts) - 4] | sets[8 + 0]
    shared = sets[len(ODD) - 3] & sets[len(texts) - 4]
    assert len(shared) >= 0.8 * len(sets[len(ODD) - 3])  # a shared run of 80 words keeps its fingerprints
    assert rows[len(ODD) + 3 - 3]["shown"] == rows[len(ODD) + 4 - 3]["shown"]


def test_fingerprints_are_those_of_byte_windows(spark, monkeypatch):
    monkeypatch.setattr(W, "_BLOCK", 50)
    texts = ["short", "\u3000A  b\n", "日本語" * 40, prose(1, 100), prose(2, 9), "x" * 200, "y" * 47, "z" * 48, None]
    rows = {r["doc_id"]: r["f"] for r in documents(spark, texts).select("doc_id", W.winnow("text").alias("f")).collect()}
    raws = [re.sub(r"\s+", " ", (t or "").lower()).strip().encode() for t in texts]
    cut = [(k, i, bytearray(b[i : i + W.K])) for k, b in enumerate(raws) if b for i in range(max(len(b) - W.K, 0) + 1)]
    known = spark.createDataFrame(cut, "k int, i int, b binary").selectExpr("k", "i", "xxhash64(b) & 2147483647 AS h").collect()
    for k, b in enumerate(raws):
        h = [r["h"] << 32 | (0xFFFFFFFF - r["i"]) for r in sorted((r for r in known if r["k"] == k), key=lambda r: r["i"])]
        assert rows[k] == list(dict.fromkeys(min(h[i : i + W.WINDOW]) for i in range(max(len(h) - W.WINDOW, 0) + 1))) if b else rows[k] == []


@pytest.mark.parametrize("block", [50, 4096])
def test_only_the_seam_of_an_edited_text_is_hashed(spark, monkeypatch, block):
    monkeypatch.setattr(W, "_BLOCK", block)
    texts = ["a" * 300, "a" * 301, prose(1, 90), "ΑΣ" * 200, "ΑΣΣ" * 70 + "  ", "  Σα " + prose(4, 50), *[prose(k, 20)[: 90 + k] for k in range(20)], prose(3, 400), "tiny", prose(9, 700), "", None, "q " * 90, "İ\u0307 " * 60]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("more "), "text", "text")))
    rows = W.fingerprint_edits(docs).select("doc_id", "edited_fingerprint", W.winnow("edited").alias("anew")).collect()
    assert len(rows) == docs.count() and all(r["edited_fingerprint"] == r["anew"] for r in rows)

    left, right = prose(1, 500), prose(2, 300)
    one = spark.createDataFrame([(left + " and more", left + right, right)], "b string, e string, tail string").select(*[F.col(c).cast("binary").alias(c) for c in ("b", "e", "tail")])
    (r,) = one.select(W.fresh_windows(F.col("e"), F.col("b"), F.col("tail")).alias("x"), W.shared_start(F.col("e"), F.col("b")).alias("n")).collect()
    reach = W.K + W.WINDOW - 1
    assert r["n"] == len(left) and tuple(r["x"]) == (len(left) - reach, len(left), True, True)


def test_short_and_unspaced_texts_are_like_their_edits(spark):
    rng = random.Random(8)
    texts = [prose(1, 14), "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400)), "".join(rng.choice("abcdefghijklmnop") for _ in range(2000))]
    rows = W.fingerprint_edits(documents(spark, texts)).collect()
    assert len(rows) == 3 and all(0.1 < r["near_edited"] < 0.9 for r in rows)


def test_next_ids_of_ranges_and_outliers(spark, monkeypatch):
    monkeypatch.setattr(W, "IDS_PER_RANGE", 7)
    ids = [*range(60), 2**62, -(2**62), 5, 5, None]
    got = {r["doc_id"]: r["next_id"] for r in W.next_ids(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()}
    order = sorted({i for i in ids if i is not None}, reverse=True)
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_fingerprint_edges(spark):
    assert W.fingerprint_edits(documents(spark, ["a"]).limit(0)).count() == 0
    one = documents(spark, ["alpha beta gamma delta"])
    (r,) = W.fingerprint_edits(one).collect()
    assert r["edited"] == "alpha beta " + "alpha beta " and r["near_next"] == 1.0
    twice = W.fingerprint_edits(one.union(one)).collect()
    assert len(twice) == 2 and twice[0]["fingerprint"] == twice[1]["fingerprint"]
    assert W.fingerprint_edits(one.selectExpr("cast(null as long) as doc_id", "text")).count() == 1


def test_set_hashes_tell_words_apart():
    from headwater.llm.bytewords import NON_SPACE, text_buffers, words_of

    raw, offsets = text_buffers(pa.array(["ab c", "a bc", None, "AB\tc"]))
    start, end, hashed, bounds = words_of(raw, offsets, NON_SPACE)
    assert bounds.tolist() == [0, 2, 4, 4, 6] and hashed[0] == hashed[4] and hashed[0] != hashed[3] and len(set(hashed.tolist())) == 4
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
