"""Registered queries of the dealt operators, with their production parameters."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from . import ann, bpe, hamming, langid, licences, lines, orchard, packing, periods, quality, repeats, simhash, winnowing
from .registry import llm_query, table


def _ranks() -> tuple[str, str]:
    import public_tokenizers as P

    return str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN


@llm_query("op1_bpe")
def op1_bpe(spark, sf_dir):
    """Encode every whole text, decode the ids, and digest both."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), *_ranks())
    both = bpe.decode(coded, *_ranks())
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@llm_query("op2_packing")
def op2_packing(spark, sf_dir):
    """Pack all documents into sequences of power-of-two length up to 1024."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), *_ranks(), max_tokens=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


USABLE_SQL = """(SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))"""


@llm_query("op7_nearest", f"""
WITH v AS {USABLE_SQL},
pairs AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v ON len(q.e) = len(v.e) AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""")
def op7_nearest(spark, sf_dir):
    """The 10 nearest of every vector whose id is divisible by 100, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


@llm_query("op10_hamming", f"""
WITH v AS {USABLE_SQL},
pairs AS (SELECT q.vec_id AS query_id, v.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: CAST((z[1] > 0) <> (z[2] > 0) AS INTEGER))) AS INTEGER) AS distance
  FROM v q JOIN v ON len(q.e) = len(v.e) AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10""")
def op10_hamming(spark, sf_dir):
    """The 10 nearest sign codes of every vector whose id is divisible by 50, among all others."""
    codes = hamming.sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming.nearest_codes(codes, codes.where(F.col("id") % 50 == 0), 10)


@llm_query("op3_quality")
def op3_quality(spark, sf_dir):
    """Quality of every whole text, learned from the labels outside the held-out fifth."""
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.select("doc_id", "held_out", "score", "predicted")


@llm_query("op9_language")
def op9_language(spark, sf_dir):
    """Language of every whole text, learned outside the held-out quarter."""
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@llm_query("op8_simhash")
def op8_simhash(spark, sf_dir):
    """Components of documents whose fingerprints of 3-word shingles link at 3 or fewer bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@llm_query("op4_repeats")
def op4_repeats(spark, sf_dir):
    """Bytes of every whole text without those in 50-byte strings of earlier documents."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@llm_query("op5_lines", r"""
WITH u AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS unit, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
n AS (SELECT *, trim(regexp_replace(lower(unit), '[ \t\r\f\v]+', ' ', 'g'), ' ') AS plain FROM u),
m AS (SELECT *, plain <> ''
    AND row_number() OVER (PARTITION BY plain ORDER BY doc_id, place) > 1 AS gone FROM n)
SELECT doc_id, count(*) AS n_units, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
  CAST(coalesce(sum(length(unit)) FILTER (WHERE gone), 0) AS BIGINT) AS removed_chars,
  coalesce(string_agg(unit, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
FROM m GROUP BY doc_id""")
def op5_lines(spark, sf_dir):
    """Whole texts without lines that an earlier place has; blank lines stay."""
    found = lines.remove_repeated_units(table(spark, sf_dir, "documents"), unit="line")
    return found.select("doc_id", "n_units", "n_removed", "removed_chars", "text")


@llm_query("op6_licences")
def op6_licences(spark, sf_dir):
    """Licence of every document. The table has no paths: a document lies in a folder of its source, language and hundred,
    and one of under 400 characters is a licence file of one of the levels above."""
    docs = table(spark, sf_dir, "documents")
    levels = [F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 100).cast("string")]
    deep = F.concat_ws("/", *levels)
    above = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", *levels[:1])).when(F.col("doc_id") % 3 == 1, F.concat_ws("/", *levels[:2])).otherwise(deep)
    short = F.coalesce(F.length("text"), F.lit(0)) < 400
    path = F.when(short, F.concat(above, F.lit("/LICENSE-"), "doc_id")).otherwise(F.concat(deep, F.lit("/"), "doc_id", F.lit(".txt")))
    found = licences.inherit(licences.own_licences(docs.withColumn("path", path)))
    return found.select(F.col("key").alias("doc_id"), "path", "licence", "score", "origin", "origin_path")


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round as one more step: parts against all entries, the nearest by (distance, index), floors of the means."""
    steps = f"""
k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
part AS (SELECT vec_id, label, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x FROM k, range({parts}) r(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM part
  QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}),"""
    for r in range(rounds + 1):
        steps += f"""
d{r} AS (SELECT vec_id, label, p, x, e, c, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM part JOIN b{r} USING (p)),
a{r} AS (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1),"""
        if r < rounds:
            steps += f"""
u{r} AS (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY p, e, i),
m{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM u{r} GROUP BY p, e),
b{r + 1} AS (SELECT b{r}.p, b{r}.e, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} ON b{r}.p = m{r}.p AND b{r}.e = m{r}.e),"""
    return f"""
WITH {steps}
coded AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, book"""


@llm_query("op11_codes", _codes_sql())
def op11_codes(spark, sf_dir):
    """Product codes of all vectors: 8 parts, 16 entries each, 6 rounds."""
    coded = orchard.with_label_error(orchard.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6))
    return coded.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", "codebooks_sha256")


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@llm_query("op12_winnowing", f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
il AS (SELECT item_id, w, least(len(w), 10) AS t FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, t, list_slice(w, s, s + t - 1) AS g FROM (SELECT item_id, t, w, unnest(range(1, len(w) - t + 2)) AS s FROM il)),
dl AS (SELECT doc_id, w, t FROM d, (SELECT DISTINCT t FROM il)),
dw AS (SELECT doc_id, t, s, list_slice(w, s, s + t - 1) AS g FROM (SELECT doc_id, t, w, unnest(range(1, len(w) - t + 2)) AS s FROM dl WHERE len(w) >= t)),
m AS (SELECT doc_id, t, s, item_id FROM dw JOIN iw USING (t, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + t)) AS p FROM m) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)""")
def op12_winnowing(spark, sf_dir):
    """Words of every whole document inside windows of ten words of a benchmark item."""
    found = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _periodic_tail(doc_id, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by crc32 of its id, goes on periodically from some word; a null id changes nothing."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


@llm_query("op13_periods")
def op13_periods(spark, sf_dir):
    """Periodic runs of words of every whole text, and the text without the repeats."""
    found = periods.periodic_runs(table(spark, sf_dir, "documents"), prepare=_periodic_tail)
    # the longest; of equals the first, then the shortest period
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("top", top).select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
                                               F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
                                               F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
