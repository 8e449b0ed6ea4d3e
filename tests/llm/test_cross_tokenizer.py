"""Cross-tokenizer alignment against a plain walk over both tokenizers' whole results."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from headwater.llm import cross_tokenizer as X
from headwater.llm.queries import QUERIES
from tests.llm.fixtures import ODD, documents, prose

TEXTS = [
    *ODD, "<|endoftext|> is plain text", "<s> </s> <unk> <0x41>", "don't stop  two  spaces\n\nnew\tline ", "naïve café — 東京 Москва العربية ñ́", "x" * 500, "end ", " ", "😀" * 20,
    prose(1, 60), prose(2, 60), prose(1, 60), "tail nbsp　wide", "a b \u0085c",
]


def whole(text):
    """(ids of A, ids of B) with their bytes, from the libraries alone; None where a text has no tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not text:
        return None
    if not hasattr(whole, "tools"):
        a = Tokenizer.from_file(X.BYTE_LEVEL)
        a.encode_special_tokens = True
        whole.tools = a, SentencePieceProcessor(model_file=X.PIECES), {i: t for t, i in a.get_vocab().items()}
    a, b, names = whole.tools
    letters = X.byte_letters()
    left = [(i, bytes(letters[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    given = b" " + text.encode()
    return (left, right) if b"".join(x for _, x in left) == given == b"".join(x for _, x in right) else None


def brute(texts):
    rows, pairs = [], []
    for text in texts:
        found = whole(text)
        if not found:
            rows.append((0, 0, 0, ""))
            pairs.append([])
            continue
        ends = [{} for _ in range(2)]
        for side, tokens in enumerate(found):
            at = 0
            for k, (_, piece) in enumerate(tokens):
                at += len(piece)
                ends[side][at] = k
        groups, links, i, j = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            m, n = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(str(t) for t, _ in found[0][i:m]) + "|" + ",".join(str(t) for t, _ in found[1][j:n]))
            links.append((found[0][m - 1][0], found[1][n - 1][0]))
            i, j = m, n
        rows.append((len(found[0]), len(found[1]), len(groups), ";".join(groups)))
        pairs.append(links)
    counts, best = Counter(p for own in pairs for p in own), defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(k, *r[:3], len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), hashlib.sha256(r[3].encode()).hexdigest() if r[3] else "") for k, (r, own) in enumerate(zip(rows, pairs, strict=True))]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("known", "segment"), [(1 << 20, 1 << 18), (40, 50), (0, 1 << 18)])
def test_alignment_matches_brute_force(spark, monkeypatch, known, segment):
    monkeypatch.setattr(X, "KNOWN", known)
    want = brute(TEXTS)
    assert sum(w[1] == 0 for w in want) == 3  # null, empty, and a mark of B's own
    monkeypatch.setattr(X, "SEGMENT", segment)
    got = X.align_and_count(documents(spark, TEXTS), digest=True).select(*COLUMNS).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_the_registered_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = [(docs[w[0]]["doc_id"], *w[1:]) for w in brute([r["text"] for r in docs])]
    df = QUERIES["op12_cross_tokenizer"](spark, "/root/testdata/sf0.001")
    assert df.columns == COLUMNS and sorted(map(tuple, df.collect())) == sorted(want)


def test_runs_give_the_ids_of_the_whole():
    text = " ".join(t for t in TEXTS if t) * 3
    a, b, _ = X._tools(X.BYTE_LEVEL, X.PIECES)
    for limit in (10, 37, 400):
        parts = X.runs(text, limit)
        assert len(parts) > 3 and " ".join(parts) == text
        for tokenizer in (a, b):
            assert [i for ids in tokenizer.encode(parts) for i in ids.tolist()] == tokenizer.encode([text])[0].tolist()


def test_words_give_the_ids_of_the_whole():
    every = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    texts = [t for t in TEXTS if t] + [f"{x} {y}" for x in every[:0x80] for y in every[:0x80]] + [f"a{c} {c}b {c} {c}c  {c}" for c in every[0x80::7]]
    a, b, _ = X._tools(X.BYTE_LEVEL, X.PIECES)
    cut = [X._BETWEEN.split(t) for t in texts]
    assert all(" ".join(words) == t for words, t in zip(cut, texts, strict=True)) and sum(len(words) > 1 for words in cut) > 8000
    for tokenizer in (a, b):
        whole, ids = tokenizer.encode(texts), iter(tokenizer.encode([w for words in cut for w in words]))
        parts = [[i for _ in words for i in next(ids).tolist()] for words in cut]
        changed = [b" " + t.encode() != joined for t, joined in zip(texts, tokenizer.tokens.joined(whole), strict=True)]
        odd = [k for k, x in enumerate(whole) if x.tolist() != parts[k]]
        assert all(changed[k] for k in odd)
        # what is changed as a whole is changed in one of its words
        words = [w for k in odd for w in cut[k]]
        raw = iter(tokenizer.tokens.joined(tokenizer.encode(words)) if words else [])
        assert all([any([b" " + w.encode() != next(raw) for w in cut[k]]) for k in odd])


def test_words_are_tokenised_once_and_forgotten_when_not_met(monkeypatch):
    X._words.cache_clear()
    words = X._words(X.BYTE_LEVEL, X.PIECES)
    asked = []
    encode = words.a.encode
    monkeypatch.setattr(words.a, "encode", lambda texts: asked.extend(texts) or encode(texts))
    text = "river stone, (water) river ▁ river river stone, end" + " river (water)" * 500
    (bad, good) = X.aligned_texts([text, text.replace(" ▁", "")], X.BYTE_LEVEL, X.PIECES)
    assert sorted(asked) == ["(water)", "end", "river", "river ▁ river", "stone,"] and bad[0] == 0 and good[0] > 1000 and len(good[4]) == good[2]
    monkeypatch.setattr(X, "MEMORY", 6)
    for k in range(40):
        assert X.aligned_texts([f"river w{k} stone,"], X.BYTE_LEVEL, X.PIECES)[0][0] > 3
    assert asked.count("river") == 1 and asked.count("stone,") == 1 and len(words.recent) + len(words.older) <= 8


def test_the_faster_encoder_gives_the_same_ids():
    a, _, _ = X._tools(X.BYTE_LEVEL, X.PIECES)
    assert a.fast
    every = [chr(c) for c in range(0x20, 0x11000) if not 0xD800 <= c < 0xE000]
    texts = [t for t in TEXTS if t] + [f"a{c}b 1{c}2 {c} {c}{c}'s" for c in every[::7]]
    want = a.encode(texts)
    a.fast, fast = None, a.fast
    try:
        assert [x.tolist() for x in a.encode(texts)] == [x.tolist() for x in want]
    finally:
        a.fast = fast


def test_windows_are_remembered_and_forgotten(monkeypatch):
    a, b, _ = X._tools(X.BYTE_LEVEL, X.PIECES)
    text = "the river stone and the river stone and the cloud"
    ids = a.encode([text])[0], b.encode([text])[0]
    aligner = X.Aligner(a.tokens, b.tokens)
    windows = aligner.windows(*ids)
    (found,) = aligner.aligned([windows])
    assert len(windows) == 10 and len(aligner.memory) == 5 and aligner.aligned([windows[3:], []]) == [found[3:], []]
    monkeypatch.setattr(X, "MEMORY", 2)
    again = X.Aligner(a.tokens, b.tokens)
    assert again.aligned([windows]) == [found] and again.aligned([windows[:1], windows]) == [found[:1], found] and len(again.memory) <= 2
    whole_run = aligner.align([(ids[0].tobytes(), ids[1].tobytes())])
    assert whole_run[0] == (";".join(w[0] for w in found), b"".join(w[1] for w in found), sum(w[2] for w in found))


def test_odd_tables(spark):
    assert X.align_and_count(documents(spark, ["a"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "one two"), (None, "one two"), (4, None), (4, "one")], "doc_id long, text string").withColumn("pair", F.lit(1)).withColumn("n", F.lit("x"))
    got = sorted((r["doc_id"] or 0, r["n_links"], r["n_best"], r["count_sum"], r["groups"].count("|")) for r in X.align_and_count(rows).collect())
    assert [g[:2] for g in got] == [(0, got[0][1]), (0, got[0][1]), (4, 0), (4, got[3][1])] and got[0][1] == got[0][4] > 0 and got[0][3] == sum((3, 2)[: got[0][1]])


def test_a_very_long_text(spark):
    text = prose(7, 150_000)
    r = X.align_and_count(documents(spark, [text, "z" * 300_000])).orderBy("doc_id").collect()
    assert len(text) > 4 * X.SEGMENT and r[0]["n_links"] > 150_000 and r[0]["n_links"] == r[0]["n_groups"] and r[1]["n_a"] > 0
