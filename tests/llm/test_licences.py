import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchlake.llm import licences as L
from tests.llm.helpers import awkward, clashing, empty, prose

APACHE = "Licensed under the Apache License, Version 2.0."
MIT = "Released under the MIT License."


def files(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, path string, text string")


def test_frequencies_and_cosine_match_brute_force(spark):
    texts = [prose(i, 20) + "\n" + (APACHE if i % 3 == 0 else "the version of this") for i in range(30)]
    df = files(spark, [(i, f"p/{i}", t) for i, t in enumerate(texts)]).repartition(3)
    vocabulary = frozenset(t for g in L.TEMPLATES.values() for x in g for t in L.terms(x))
    n, got = L.document_frequencies(df, vocabulary)
    assert n == 30 and got == {t: c for t in vocabulary if (c := sum(t in L.terms(x) for x in texts))}
    m = L.Matcher(L.TEMPLATES, n, got)
    idf = lambda t: math.log(31 / (1 + got.get(t, 0))) + 1 if t in vocabulary else math.log(31) + 1
    line = L.terms("licensed under some Apache License version 2.0 terms")
    a = {t: c * idf(t) for t, c in Counter(line).items()}
    best = max((sum(a.get(t, 0) * c * idf(t) for t, c in Counter(L.terms(x)).items()) / math.sqrt(sum(v * v for v in a.values()) * sum((c * idf(t)) ** 2 for t, c in Counter(L.terms(x)).items())), name) for name, g in L.TEMPLATES.items() for x in g)
    assert m.best(line, 0.0)[1] == best[1] and m.best(line, 0.0)[0] == pytest.approx(best[0])
    assert m.best(line, best[0] + 0.01) is None


def test_nearest_ancestor_wins(spark):
    rows = [(1, "LICENSE", MIT), (2, "a/b/COPYING", APACHE), (3, "a/x.py", "code"), (4, "a/b/y.py", "code"), (5, "a/b/c/d/z.py", "code"), (6, "a/bb/w.py", "code"),
            (7, "a/b/own.py", "head\n" + MIT + "\ncode"), (8, "top.py", None), (9, None, "code"), (10, None, MIT), (11, "a/b/LICENSE-2", MIT), (12, "q/notes", APACHE), (13, "q/r.py", "")]
    got = {r["key"]: (r["licence"], r["origin"], r["origin_path"]) for r in L.inherit(L.own_licences(files(spark, rows))).collect()}
    near = ("Apache-2.0", "inherited", "a/b/COPYING")
    root = ("MIT", "inherited", "LICENSE")
    assert got[2] == ("Apache-2.0", "own", "a/b/COPYING") and got[7] == ("MIT", "own", "a/b/own.py")
    assert got[4] == got[5] == near and got[3] == got[6] == got[8] == root
    assert got[9] == (None, None, None) and got[10] == ("MIT", "own", None)
    assert got[13] == root  # q/notes is no licence file


def test_blocks_of_lines_and_whole_texts(spark):
    notice = L.TEMPLATES["GPL-3.0"][1]
    words = notice.split()
    wrapped = "\n".join("# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    rows = [(1, "a/x", "import os\n" + wrapped + "\n" + prose(1, 50)), (2, "b/y", prose(2, 20_000) + "\n" + APACHE), (3, "c/z", prose(3, 500))]
    got = {r["key"]: r["own"] for r in L.own_licences(files(spark, rows)).collect()}
    assert got == {1: "GPL-3.0", 2: "Apache-2.0", 3: None}


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("path", F.when(F.col("doc_id") != 5, F.concat(F.lit("d/"), F.col("doc_id"))))
    got = L.inherit(L.own_licences(clashing(docs, "key", "own", "folder")))
    assert got.count() == docs.count() and got.where("licence is not null").count() == 0
    assert L.inherit(L.own_licences(empty(spark).withColumn("path", F.lit("x")))).count() == 0
