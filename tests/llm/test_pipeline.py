"""The pipeline's stages on odd rows, each against brute force."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from headwater.llm import quality, secrets, sentencepiece
from tests.llm.fixtures import ODD, prose
from tests.llm.test_pairs import LOWER, shingles

KEY = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with null, empty, repeated and missing ids, near copies, a benchmark passage and a secret."""
    texts = [t if t is None else t.replace("\x00", "") for t in ODD]
    rows = list(enumerate(texts)) + [(None, None), (None, ""), (3, prose(70, 30)), (3, prose(71, 30)), (3, prose(71, 30)), (None, prose(71, 30) + " end")]
    rows += [(50, prose(72, 60)), (51, prose(72, 60) + " more"), (None, prose(73, 60)), (60, f"before {prose(74, 14)} after"), (61, f"token={KEY} {prose(75, 20)}"), (61, f"token={KEY} {prose(75, 20)}")]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("b1", prose(74, 14)), (None, None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def documents(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def test_quality_stage(spark, tables):
    docs = documents(spark, tables)
    kept = P.quality(spark, docs, tables)  # labels of one kind: nothing is rejected
    assert kept.columns == P.COLUMNS and pairs(kept) == pairs(docs)
    good = spark.createDataFrame([(k, int(k % 2), 0) for k in range(400)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(k, prose(k, 30) if k % 2 else "$$$ ### " * 9) for k in range(400)], "doc_id long, text string")
    model = quality.train_quality(texts, good)
    scores = {(r["doc_id"], r["text"]): r["s"] for r in docs.select("doc_id", "text", quality.quality_score(model).alias("s")).collect()}
    wordless = [s for (_, t), s in scores.items() if not (t or "").split()]
    assert len(wordless) == 5 and len(set(wordless)) == 1


def test_near_duplicate_stage(spark, tables):
    docs = documents(spark, tables)
    left = P.near_duplicates(spark, docs, tables)
    assert left.columns == P.COLUMNS
    rows, kept = pairs(docs), pairs(left)
    sets = [shingles(t, 5) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    expected = []
    for g in set(group):
        members = [rows[k] for k in range(len(rows)) if group[k] == g]
        ids = [i for i, _ in members if i is not None]
        expected.append((min(ids) if ids else None, {t for i, t in members if not ids or i == min(ids)}))
    assert len(kept) == len(expected) and all(any(i == a and t in options for a, options in expected) for i, t in kept)
    assert sum(t is None or not t.strip() for _, t in kept) == sum(t is None or not t.strip() for _, t in rows)


def test_decontamination_and_secret_stages(spark, tables):
    docs = documents(spark, tables)
    cut = P.decontaminate(spark, docs, tables)
    words = prose(74, 14).translate(LOWER)
    assert cut.columns == P.COLUMNS and pairs(cut) == sorted(((i, t.replace(words, "") if t else t) for i, t in pairs(docs)), key=repr)
    assert cut.filter("n_chars <> coalesce(length(text), 0)").count() == 0
    hidden = P.secrets(spark, docs, tables)
    assert pairs(hidden) == sorted(((i, re.sub(f"token={KEY}|[a]{{32,}}", "[SECRET]", t) if t else t) for i, t in pairs(docs)), key=repr)


def test_encoding_stage_and_the_whole_run(spark, tables):
    from sentencepiece import SentencePieceProcessor

    docs = documents(spark, tables)
    model = SentencePieceProcessor(model_file=sentencepiece.MODEL)
    got = sorted(((r["doc_id"], r["ids"]) for r in P.sentencepiece(spark, docs, tables).collect()), key=repr)
    assert got == sorted(((i, model.encode(t or "")) for i, t in pairs(docs)), key=repr)
    once = docs
    for _, stage in P.STAGES[:-1]:
        once = stage(spark, once, tables).checkpoint()
    assert P.run(spark, tables).count() == once.count() > 0


def test_stages_of_empty_tables(spark, tables):
    none = documents(spark, tables).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, tables).count() == 0


def test_markov_spans_match_python(spark):
    import random

    rng = random.Random(4)
    flat = [rng.uniform(-1, 1.5) for _ in range(67 * 67)]
    token = lambda: "".join(rng.choice(secrets.ALPHABET) for _ in range(rng.randrange(15, 40)))
    texts = [" ".join(rng.choice([token(), "word", "😀", f"token={token()}", "0a" * 17, "."]) for _ in range(40)) for _ in range(12)] + [None, "", "x" * 50_000]
    frame = spark.createDataFrame([(k % 5 or None, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    seen = 0
    for r in secrets.scan_secrets(frame, flat).collect():
        base = [(b["start"], b["end"]) for b in r["base"]]
        expected = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", r["text"] or ""):
            place = [secrets.ALPHABET.index(c) for c in m[0]]
            ratio = sum(float(f"{flat[a * 67 + b]:.6f}") for a, b in zip(place, place[1:], strict=False))
            if ratio >= secrets.THRESHOLD and not any(a < m.end() and m.start() < b for a, b in base):
                expected.append(m.span())
        found = [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "random"]
        assert found == expected
        seen += len(found)
    assert seen > 5


def test_models_of_nothing_find_nothing(spark):
    assert set(secrets.ratios({})) == {0.0} and set(secrets.ratios({(1, "ab"): 5})) == {0.0}
    odd = spark.createDataFrame([(1, "internationalization_of_the_number_garden"), (2, "get_customer_account_identifier")], "doc_id long, text string")
    assert [r["spans"] for r in secrets.scan_secrets(odd).collect()] == [[], []]
    assert secrets.train_models(odd.limit(0)) == [0.0] * 67 * 67


def test_samples_of_huge_tables_are_not_empty(spark):
    from headwater.llm.labelled import picked

    rows = spark.range(200_000).withColumnRenamed("id", "doc_id")
    share = rows.filter(picked(20_000, 200_000, "doc_id")).count() / 200_000
    assert 0.09 < share < 0.11
    text = picked(20_000, 10**13, "doc_id")._jc.toString()
    assert str((1 << 60) * 20_000 // 10**13) in text and rows.filter(picked(5, 5, "doc_id")).count() == 200_000
