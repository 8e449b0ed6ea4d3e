"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from headwater.llm import simhash as S
from headwater.llm.keyed import looked_up
from headwater.llm.queries import QUERIES
from tests.llm.fixtures import ODD, WORDS, documents, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[k : k + width]) for k in range(max(len(w) - width, 0) + 1)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(values, budget=3):
    """The least position that each value reaches."""
    v = np.array(values, np.uint64)
    root = list(range(len(v)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[:i] ^ v[i]) <= budget).tolist():
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(v))]


def near_values(rng, n, centres, spread):
    out = []
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(n // centres):
            v = centre
            for _ in range(rng.randrange(spread + 1)):
                v ^= 1 << rng.randrange(64)
            out.append(v)
    return out


def test_query_matches_brute_force(spark):
    rng = random.Random(5)
    texts = list(ODD) + ["".join(t.upper()) for t in ODD[3:5]] + [None, ""]
    for k in range(12):
        base = prose(k, rng.choice([2, 3, 9, 60, 400])).split()
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(rng.choice([" ", "\n", "\t\r "]).join(copy))
    texts += [prose(100, 80)] * 30
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.simhash_components(documents(spark, texts)).collect()}
    prints = [fingerprint(t) for t in texts]
    assert [rows[k][0] % (1 << 64) for k in range(len(texts))] == prints
    assert [rows[k][1] for k in range(len(texts))] == components(prints)


def test_the_registered_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [fingerprint(r["text"]) for r in docs]
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op11_simhash_dedup"](spark, "/root/testdata/sf0.001").collect()}
    assert [rows[r["doc_id"]] for r in docs] == [(f"{p:016x}", docs[c]["doc_id"]) for p, c in zip(prints, components(prints), strict=True)]


@pytest.mark.parametrize(("unit", "spread", "centres"), [(1024, 6, 40), (8, 6, 40), (8, 3, 2), (4, 64, 1), (16, 1, 300)])
def test_trie_join_finds_every_link(spark, monkeypatch, unit, spread, centres):
    monkeypatch.setattr(S, "UNIT", unit)
    rng = random.Random(unit * 100 + spread)
    values = sorted(set(near_values(rng, 900, centres, spread) + [0, (1 << 64) - 1, 1 << 63, (1 << 63) | 7]))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(v,) for v in signed], "fingerprint long").withColumn("least", F.lit(1))
    place, root = {v: k for k, v in enumerate(signed)}, list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    edges = S.fingerprint_links(classes).collect()
    for r in edges:
        assert (signed[place[r["left"]]], signed[place[r["right"]]]) == (r["left"], r["right"])
        a, b = sorted((top(place[r["left"]]), top(place[r["right"]])))
        root[b] = a
    assert [top(k) for k in range(len(values))] == components(values)


def test_leaves_of_two_nodes():
    rng = random.Random(2)
    values = np.array(sorted(set(near_values(rng, 400, 3, 5))), np.uint64)
    i, j = S.linked_leaves(values, None, 0, 0, 3)
    near = np.bitwise_count(values[:, None] ^ values[None, :])
    half = np.minimum(np.bitwise_count((values[:, None] ^ values[None, :]) >> np.uint64(32)), 9)
    want = {(a, b) for a, b in zip(*np.nonzero((near <= 3) & (half <= 1)), strict=True) if a < b}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) >= want and (near[i, j] <= 3).all() and len(set(zip(i, j, strict=True))) == len(i)


def test_odd_rows(spark):
    assert S.simhash_components(documents(spark, ["a"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (7, "q r s t u"), (7, None), (3, "  "), (None, "")], "doc_id long, text string").withColumn("root", F.lit(1)).withColumn("fingerprint", F.lit("x"))
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in S.simhash_components(rows).collect())
    assert got == [(0, 0), (0, 0), (0, 3), (3, 3), (7, 3), (7, 7)]


def test_very_long_text(spark):
    long = " ".join(f"w{k % 977}" for k in range(400_000))
    r = S.simhash_components(documents(spark, [long, long + " end", "other words here"])).orderBy("doc_id").collect()
    assert r[0]["component_id"] == r[1]["component_id"] == 0 and r[2]["component_id"] == 2


def test_lookup_with_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"))
    values = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = looked_up(rows, values, "k")
    assert got.count() == 5000 and got.filter("k < 2000 AND (v is null OR v <> 2 * k)").isEmpty() and got.filter("k >= 2000 AND v is not null").isEmpty()
