import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.llm import langid, quality, sample
from tests.llm.helpers import DOCS, awkward, clashing, empty, prose


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def labelled(spark):
    """Good documents are prose; bad ones have one passage of symbols somewhere."""
    rows, labels = [], []
    for i in range(400):
        text, good = prose(i, 300), i % 3 != 0
        if not good:
            cut = (i * 37) % len(text)
            text = text[:cut] + " ".join(w + "%%%" for w in prose(i, 90).split()) + text[cut:]
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_documents(spark, labelled):
    docs, labels = labelled
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    held = got[got.held_out]
    assert auc(held.score.values, held.quality.values) > 0.97
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_quality_never_reads_held_out_labels(spark, labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.classify(docs.withColumn("lang", F.lit(None).cast("string")), turned).collect()}
    assert a == pytest.approx(b)


def test_quality_awkward_rows(spark, labelled):
    docs = awkward(spark)
    model = quality.train(*labelled)
    got = quality.score(clashing(docs, "label"), model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (1, 2)}
    assert len(blank) == 1  # null scores as empty
    labels = spark.createDataFrame([(None, 1), (4, None), (4, 7), (5, 0), (5, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, labels).collect()} == {0.5}
    assert {r["score"] for r in quality.classify(docs, spark.createDataFrame([(4, 1), (5, 1), (6, 1), (7, 1)], "doc_id long, quality int")).collect()} == {1.0}
    assert quality.classify(empty(spark), labelled[1]).count() == 0


def test_long_texts_score_the_same_in_blocks(spark, labelled):
    model = quality.train(*labelled)
    text = prose(8, 60_000)
    data = np.frombuffer(text.encode(), np.uint8)
    x, owner = quality.passages(data, np.array([0, len(data)]))
    want = model.scores(model.encode(x), owner)[0]
    got = quality.score(spark.createDataFrame([(1, text, "", "", 0)], DOCS), model).first()["score"]
    assert got == pytest.approx(want, abs=1e-3)


def test_passages_ignore_neighbouring_texts():
    data = np.frombuffer(b"abcd" * 200 + b"%%%%" * 50, np.uint8)
    x, owner = quality.passages(data, np.array([0, 800, 800, 1000]))
    alone, _ = quality.passages(data[:800], np.array([0, 800]))
    assert owner.tolist() == [0, 0, 1, 2] and np.allclose(x[:2], alone) and not x[2].any()


def test_gradients_of_attention():
    rng = np.random.default_rng(0)
    bags = [rng.random((n, quality.FEATURES)).astype(np.float32) for n in (1, 4, 2, 6) * 8]
    y = np.array([int(b[:, 0].max() > 0.8) for b in bags])
    model = quality.GatedAttention().fit(bags, y, epochs=60)
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    s = model.scores(model.encode(np.concatenate(bags)), owner)
    assert auc(s, y) > 0.95


LANGS = {"en": "the of and to ing tion ", "de": "der die und ein sch ung ", "fr": "le la de que eau é "}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        lang = list(LANGS)[i % 3]
        words = LANGS[lang].split()
        rows.append((i, " ".join("".join(rng.choice(words, 2)) for _ in range(120)), lang, "a", 0))
    return spark.createDataFrame(rows, DOCS)


def test_language_on_held_out_documents(spark, spoken):
    got = langid.identify(spoken).join(spoken, "doc_id").toPandas()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_awkward_rows(spark, spoken):
    model = langid.train(spoken)
    docs = awkward(spark).union(spark.createDataFrame([(20, "123 456 !!", "en", "a", 1)], DOCS))
    got = langid.predict(clashing(docs, "pair"), model).collect()
    assert len(got) == docs.count()
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1, 2, 3, 20)} == {("und", 0.0)}
    assert all(r["lang_pred"] in LANGS for r in got if r["doc_id"] in (4, 5, 6, 7))
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    one = langid.identify(docs.withColumn("lang", F.lit("xx"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in one if r["doc_id"] in (4, 5, 7)} == {("xx", 1.0)}
    assert langid.identify(empty(spark)).count() == 0


def test_windows_cover_whole_texts(spark, spoken):
    model = langid.train(spoken)
    long = "the of and to ing tion " * 40_000 + "der die und ein sch ung " * 60_000
    got = langid.predict(spark.createDataFrame([(1, long, "", "", 0)], DOCS), model).first()
    assert got["lang_pred"] == "de" and 0.5 < got["score"] < 0.75
    x, owner = langid.windows(np.frombuffer(b"abc" + b"d" * 300, np.uint8), np.array([0, 3, 3, 303]), langid.WINDOW - 3)
    assert owner.tolist() == [0, 2, 2] and (x[0, 3:] == 0).all() and (x[2, :47] == x[2, 0]).all()


def test_pair_tables_equal_the_plain_convolution():
    rng = np.random.default_rng(3)
    model = langid.ByteNetwork(["a", "b"])
    x = rng.integers(0, langid.SYMBOLS, (5, langid.WINDOW)).astype(np.uint16)
    pooled = []
    for w in langid.WIDTHS:
        n = langid.WINDOW - w + 1
        pooled.append(sum(model.p[f"t{w}"][j][x[:, j : j + n]] for j in range(w)).max(axis=1))
    logits = np.tanh(np.concatenate(pooled, axis=1) / 4) @ model.p["s"]
    e = np.exp(logits)
    assert np.allclose(model.probabilities(x), e / e.sum(axis=1, keepdims=True), atol=1e-5)


def test_sample_is_bounded_and_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"))
    a, b = (sorted(r[0] for r in sample.hashed_sample(d, 50).collect()) for d in (df, df.repartition(7)))
    assert len(a) == 50 and a == b and sample.hashed_sample(df.limit(0), 5).count() == 0


def test_labels_without_a_document_take_no_places(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "x#x#x# ") * 20, "en", "s", 1) for i in range(60)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(i, 1, 0) for i in range(1000, 6000)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels, sample_docs=60)
    assert model.constant is None
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all((scores[i] > 0.5) == (i % 2 == 1) for i in range(60))


def test_rare_languages_get_a_class_and_equal_shares(spark):
    rows = [(i, f"common text {i} of many", "en", "s", 1) for i in range(3000)] + [(5000 + i, f"seltener Satz {i}", "de", "s", 1) for i in range(5)] + [(7, "one id", "fr", "s", 1)] * 400
    sampled = sample.stratified_sample(spark.createDataFrame(rows, DOCS), 90, stratum="lang", text_col="text").collect()
    assert {lang: sum(r["lang"] == lang for r in sampled) for lang in ("en", "de", "fr")} == {"en": 30, "de": 5, "fr": 1}
    assert sample.stratified_sample(spark.createDataFrame([], DOCS), 5, stratum="lang", text_col="text").count() == 0


def test_scores_equal_a_plain_pass_per_document(spark):
    """Features, attention and score of one document at a time, in loops over its passages."""
    rng = np.random.default_rng(8)
    model = quality.GatedAttention()
    model.p["c"][:] = 0.3
    texts = ["".join(rng.choice(list("ab etn.,AE9\n#é"), int(k))) for k in (0, 1, 4, 300, 511, 1700, 5000)]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS), model).collect()}
    for i, text in enumerate(texts):
        raw, hidden = text.encode(), []
        for at in range(0, max(1, len(raw)), quality.PASSAGE):
            part = raw[at : at + quality.PASSAGE]
            after = raw[at + quality.PASSAGE : at + quality.PASSAGE + 3]
            pairs, grams = np.zeros(quality.PAIRS), {}
            for j, byte in enumerate(part):
                near = (part + after)[j : j + 4]
                if len(near) > 1:
                    pairs[int(quality.BYTE_CLASS[byte]) * quality.CLASSES + int(quality.BYTE_CLASS[near[1]])] += 1
                if len(near) == 4:
                    cell = (sum(b * m for b, m in zip(near, (2654435761, 2246822519, 3266489917, 668265263))) % 2**32) >> 22
                    grams[cell] = grams.get(cell, 0) + 1
            total = max(1, sum(grams.values()))
            repeats = [len(grams) / total, np.sqrt(sum(v * v for v in grams.values())) / total, max(grams.values(), default=0) / total]
            x = np.r_[np.sqrt(pairs / max(1, pairs.sum())), repeats]
            hidden.append(np.tanh(x @ model.p["W"] + model.p["b"]))
        e = [float(np.exp(((np.tanh(h @ model.p["V"]) / (1 + np.exp(-(h @ model.p["U"])))) @ model.p["w"])[0])) for h in hidden]
        z = sum(w * h for w, h in zip(e, hidden)) / sum(e)
        want = 1 / (1 + np.exp(-(z @ model.p["o"] + model.p["c"])[0]))
        assert abs(got[i] - want) < 1e-5
