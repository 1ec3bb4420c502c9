import random

import numpy as np

import corpus_pipeline as C
from matchlake.llm import jaccard, simhash
from tests.llm.helpers import DOCS, prose


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """Smallest index of each component of pairs at 0.8 or more."""
    sets, label = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return set(label)


def edited(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "w" + str(rng.randrange(10**6))
    return " ".join(words)


def kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    return {r["doc_id"] for r in C.near_duplicate_stage(spark, docs, "").collect()}


def test_edited_copies_as_by_brute_force(spark):
    rng, texts = random.Random(4), [None, "", " ", "a b", "A  b", "a a a a a a", "a a a a a"]
    for seed, words in enumerate((40, 64, 64, 90, 150, 400, 1200)):
        texts.append(prose(seed, words))
        texts += [edited(texts[-1], rng, e) for e in (1, 1, 1, 2, 2, 3, 4, 6, 9, 20)]
    # chains of edits: neighbours link, the ends do not
    texts.append(prose(50, 80))
    for _ in range(15):
        texts.append(edited(texts[-1], rng, 1))
    # a passage that makes up 70 percent of many unrelated texts
    shared = prose(60, 70)
    texts += [shared + " " + prose(100 + i, 30) for i in range(40)]
    rng.shuffle(texts)
    want = brute(texts)
    assert kept(spark, texts) == want
    assert len(want) < len(texts) - 40


def test_second_round_finds_links_that_the_forest_passed_over(spark):
    # long texts that share four fifths (similarity 0.67): their parity maps are full and exclude nothing, so all links of the forest are false
    rng, shared = random.Random(5), prose(60, 1600)
    texts = [shared + " " + prose(200 + i, 400) for i in range(16)]
    texts += [edited(t, rng, 1) for t in texts[::3]]
    want = brute(texts)
    assert len(want) == 16 and kept(spark, texts) == want


def test_parity_map_never_excludes_a_pair_at_the_limit():
    rng = np.random.default_rng(1)
    for n in (1, 5, 9, 40, 300, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for cut in range(len(x) // 5 + 1):
            y = x[cut:]
            if jaccard.similar(x, y):
                maps = np.array([np.frombuffer(jaccard.parity_map(v), np.uint64) for v in (x, y)])
                assert jaccard.possible(np.array([len(x), len(y)]), maps, 0, np.array([1]))[0]


def test_near_copies_are_candidates_by_their_fingerprints(spark):
    rng = random.Random(5)
    base = prose(1, 900)
    texts = [base, edited(base, rng, 1), base.upper(), prose(2, 300), "", "two words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "rank long, text string")
    signed = docs.mapInArrow(jaccard._signed, "rank long, digest binary, n long, map binary, keys array<long>, fp long")
    got = {r["rank"]: r["fp"] % 2**64 for r in signed.collect()}
    assert got == {i: simhash.fingerprint(t.encode(), 5) for i, t in enumerate(texts)}
    fps = {3: 0b111, 9: 0b111, 4: 0, 5: 1 << 40 | 0b11, 6: -1, 8: (1 << 63) - 1}
    nodes = spark.createDataFrame(list(fps.items()), "node long, fp long")
    pairs = {tuple(r) for r in jaccard.fingerprint_pairs(nodes).collect()}
    far = lambda a, b: bin((fps[a] ^ fps[b]) % 2**64).count("1")
    assert (3, 9) in pairs and all(a < b and far(a, b) <= 3 for a, b in pairs)
    label = {n: n for n in fps}
    for a, b in pairs:
        label = {n: min(label[a], label[b]) if v in (label[a], label[b]) else v for n, v in label.items()}
    assert label == {3: 3, 9: 3, 4: 3, 5: 3, 6: 6, 8: 6}
