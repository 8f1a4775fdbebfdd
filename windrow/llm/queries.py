"""One query per operator over its whole table, and the same results as SQL where SQL can express them.

`public_tokenizers` tells where the vocabulary files are; every operator takes the path as a parameter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from windrow.llm import (bpe, collocation, fertility, fingerprint, mixing, near_join, quality, spelling, substring,
                         token_count, topk, toxicity, url_filter)
from windrow.llm.common import held_out, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
TOKEN_LIMIT = 4096


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each passage: where it is in a document (words) and where in an earlier one."""
    found = substring.passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "start", "stop", F.col("ref").alias("ref_id"), "ref_start",
                        "ref_stop", F.col("equal").alias("n_equal"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.decode(bpe.encode(docs, path), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its tokens (words), posteriors of the domains, rate and copies in the mixture."""
    found = mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.col("tokens").cast("long").alias("n_tokens"),
                        *[F.col(d).alias(f"p_{d}") for d in mixing.DOMAINS], "rate", "copies")


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                          "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_join.near_classes(table(spark, sf_dir, "documents"), shingle=4, num=85, den=100)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return judged(scored, 0.5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts, how two vocabularies cut the text, and the band that it leaves, if any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = public_tokenizers.path
    found = fertility.measure(docs, path("piece_bpe_32k.model"), path("byte_bpe_multi_50k.tiktoken"),
                              public_tokenizers.PATTERN)
    return found.select("doc_id", "measures.*", fertility.kept().alias("kept"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def judged(scored: DataFrame, least: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_bpe_round_trip, op3_mixing, op4_token_count, op5_top_k, op6_url_filter, op7_fingerprint,
                                   op8_near_join, op9_toxicity, op10_quality, op11_quality_rules,
                                   op12_collocations, op13_spelling_variants)}

ORACLE = {
    "op5_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                     ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
     fits AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
              FROM (SELECT p.page_id, rules.h, rules.p, rules.verdict FROM p JOIN rules
                    ON (p.host = rules.h OR ends_with(p.host, '.' || rules.h)) AND starts_with(p.path, rules.p))
              GROUP BY page_id)
SELECT p.page_id, p.host, p.path, fits.rule, coalesce(fits.verdict, 'allow') AS verdict
FROM p LEFT JOIN fits ON p.page_id = fits.page_id""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text,
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
     g AS (SELECT lang, k AS width, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS ws
           FROM w, (VALUES (1), (2), (3), (4)) AS t(k) WHERE len(ws) >= k),
     f AS (SELECT lang, width, ws, count(*) AS a FROM g GROUP BY ALL),
     c AS (SELECT * FROM f WHERE width >= 2 AND a >= 30),
     n AS (SELECT lang, sum(a) AS n FROM f WHERE width = 1 GROUP BY lang),
     cuts AS (SELECT c.*, unnest(range(1, width)) AS k FROM c),
     s AS (SELECT cuts.lang, cuts.ws, cuts.width, cuts.a, k, x.a AS l, y.a AS r,
                  CAST(2000000 AS HUGEINT) * cuts.a // (CAST(x.a AS HUGEINT) + y.a) AS score
           FROM cuts JOIN f x ON x.lang = cuts.lang AND x.ws = cuts.ws[1:k]
                     JOIN f y ON y.lang = cuts.lang AND y.ws = cuts.ws[k + 1:cuts.width]),
     low AS (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS place FROM s),
     spans AS (SELECT c.*, m, unnest(range(1, width - m + 2)) AS i FROM c, (VALUES (2), (3)) AS t(m) WHERE m < width),
     inner_ AS (SELECT lang, ws[i:i + m - 1] AS ws, max(a) AS longer FROM spans GROUP BY ALL),
     free AS (SELECT low.*, array_to_string(low.ws, ' ') AS phrase FROM low LEFT JOIN inner_ USING (lang, ws)
              WHERE place = 1 AND (longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(low.a AS HUGEINT))),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
                FROM free)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op13_spelling_variants": r"""
WITH RECURSIVE
     t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
               lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
     r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text,
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]{7,}')) AS run
           FROM documents),
     d AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM r GROUP BY ALL),
     h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2),
                      lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
                  lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1])), 4294967295) AS h FROM d, t),
     w AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
     v AS (SELECT word, sum(n) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
     o AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
     gap AS (SELECT word, n, i, word[:i] || '*' || word[i + 2:] AS pattern FROM o),
     less AS (SELECT DISTINCT word, n, word[:i] || word[i + 2:] AS other FROM o),
     near AS (SELECT a.word, b.word AS other, b.n AS n_other FROM gap a JOIN gap b ON a.pattern = b.pattern AND a.word <> b.word
              UNION ALL SELECT less.word, v.word, v.n FROM less JOIN v ON v.word = less.other
              UNION ALL SELECT v.word, less.word, less.n FROM less JOIN v ON v.word = less.other),
     best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n_other DESC, encode(other)) AS place,
                     count(*) OVER (PARTITION BY word) AS n_near FROM near),
     f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_other >= 10 * v.n THEN other END AS form,
                  CASE WHEN n_other >= 10 * v.n THEN n_other END AS form_n
           FROM v LEFT JOIN best ON best.word = v.word AND place = 1),
     walk AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL
              UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
     ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near,
       CAST(form_n AS BIGINT) AS form_n FROM f LEFT JOIN ends ON ends.word = f.word""",
}
