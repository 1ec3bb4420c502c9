import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.llm import winnowing
from tests.llm.helpers import DOCS, awkward, clashing, empty, prose

ITEMS = "item_id long, text string"
PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        t = min(len(w), span)
        for s in range(len(w) - t + 1 if t else 0):
            windows.setdefault(tuple(w[s : s + t]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for t in {len(k) for k in windows}:
            for s in range(len(w) - t + 1):
                if tuple(w[s : s + t]) in windows:
                    hit |= set(range(s, s + t))
                    found |= windows[tuple(w[s : s + t])]
        out.append((doc_id, len(w), len(hit), len(found - {None}), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


def run(docs, items, **kw):
    return sorted(map(tuple, winnowing.contamination(docs, items, **kw).select("doc_id", "n_words", "n_hit", "n_items", "items").collect()), key=str)


def planted(seed, n=60):
    """Documents of few different words, with whole and cut passages of items, changed in case and punctuation."""
    rng = random.Random(seed)
    pool = [prose(s, 1) for s in range(30)]

    def text(k):
        return [rng.choice(pool) for _ in range(k)]

    items = [(i, " ".join(text(rng.choice([0, 1, 2, 5, 9, 10, 11, 30, 45])))) for i in range(20)]
    docs = []
    for d in range(n):
        body = text(rng.choice([0, 3, 9, 10, 80, 200]))
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, len(w))
            at = rng.randint(0, len(body))
            body[at:at] = [x.upper() if rng.random() < 0.3 else x for x in w[a : a + rng.choice([8, 9, 10, 14, 50])]]
        docs.append((d, rng.choice([" ", ", ", "\n", " - "]).join(body)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_hits_equal_brute_force(spark, seed):
    docs, items = planted(seed)
    items += [(3, items[5][1]), (None, prose(77, 12)), (40, None), (41, "?!"), (42, items[18][1])]
    docs += [(900, prose(77, 12)), (901, None), (901, ""), (None, items[18][1]), (902, items[18][1]), (902, items[18][1])]
    frame = spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], DOCS).repartition(3)
    got = run(clashing(frame, "row", "hits", "n_words", "words", "fp"), clashing(spark.createDataFrame(items, ITEMS), "fp", "length", "window"), salts=3)
    assert got == brute(docs, items)


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    items = [(i, r["text"]) for i, r in enumerate(docs.collect()) if r["text"] and len(r["text"]) < 500]
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    bench = spark.createDataFrame(items, ITEMS)
    assert run(docs, bench) == want
    assert run(empty(spark), bench) == []
    assert all(r[2:] == (0, 0, []) for r in run(docs, bench.limit(0)))


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "BLOCK", 300)
    rng = random.Random(3)
    body = [rng.choice(["ab", "cde", "été", "f", "ghijkl"]) for _ in range(3000)]
    items = [(1, " ".join(body[100:130])), (2, " ".join(body[2000:2010])), (3, " ".join(body[2990:])), (4, "zzz ab zzz"), (5, "y" * 1000)]
    docs = [(1, " ".join(body)), (2, "y" * 1000 + "  " + " ".join(body[:50])), (3, "q" * 2000)]
    texts = [t.encode() for _, t in docs]
    for t in texts:
        counted = 0
        for block, _, before in winnowing.blocks([t]):
            counted = before + len(block)
        assert counted == len(words(t.decode()))
    # a block of the worker is as small: compare the kept k-grams of the cut and the whole text
    whole = winnowing.Words(texts[0].translate(winnowing.FOLD), np.zeros(1, np.int64))
    first, gram, fp = whole.winnowed(10)
    cut = {(int(a) + before, int(g) + before, int(h)) for block, _, before in winnowing.blocks([texts[0]]) for a, g, h in zip(*block.winnowed(10))}
    assert cut == set(zip(first.tolist(), gram.tolist(), fp.tolist()))
    monkeypatch.undo()
    frame = spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], DOCS)
    assert run(frame, spark.createDataFrame(items, ITEMS)) == brute(docs, items)


def test_shared_spans_always_meet():
    rng = np.random.default_rng(4)
    for length in range(1, 11):
        shared = [f"w{i}" for i in rng.integers(0, 5, length)]
        kept = []
        for pad in (0, 7):
            text = " ".join([f"p{i}" for i in rng.integers(0, 5, pad)] + shared + [f"s{i}" for i in rng.integers(0, 5, pad)])
            w = winnowing.Words(text.encode().translate(winnowing.FOLD), np.zeros(1, np.int64))
            first, gram, fp = w.winnowed(length)
            at = first.tolist().index(pad)
            kept.append((int(gram[at]) - pad, int(fp[at])))
        assert kept[0] == kept[1]
