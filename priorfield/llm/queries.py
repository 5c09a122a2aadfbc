"""The queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build

    return add


@query("op4_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS content FROM documents),
g AS (SELECT content, count(*) AS group_size, max(points) AS most FROM d GROUP BY content),
k AS (SELECT d.content, min(doc_id) AS keep_id FROM d JOIN g ON d.content = g.content AND d.points = g.most GROUP BY d.content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.content) AS text_sha256
FROM d JOIN g ON d.content = g.content JOIN k ON d.content = k.content""")
def op4(spark, sf_dir):
    from .exact import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_url_rules", r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM p),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
             ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
             row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
      FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1""")
def op10(spark, sf_dir):
    from .urlrules import judge_urls, rule_frame

    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_frame(spark)).select(
        "page_id", "host", "path", "rule", "verdict")


@query("op6_license_scan")
def op6(spark, sf_dir):
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op5_token_files")
def op5(spark, sf_dir):
    import public_tokenizers
    from pyspark.sql import functions as F

    from .idfiles import new_folder, read_ids, write_ids

    path = new_folder(spark)
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_curve_packing")
def op2(spark, sf_dir):
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_ngram_jaccard", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 3], ' ')) AS shingle
                   FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
          GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM (SELECT doc_id FROM documents) d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)""")
def op1(spark, sf_dir):
    from .jaccard import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"))


@query("op3_kneser_ney")
def op3(spark, sf_dir):
    from pyspark.sql import functions as F

    from .kneser_ney import fit, in_training, score_texts

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(in_training(F.col("doc_id"))))
    return score_texts(docs, model).select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                                           "base_score", "score", "perplexity")


@query("op7_toxicity")
def op7(spark, sf_dir):
    from pyspark.sql import functions as F

    from .toxicity import fit_toxicity, in_training, score_toxicity

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted", "rejected")


@query("op8_raked_mixture")
def op8(spark, sf_dir):
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).select(
        "doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


@query("op9_exact_top_k", r"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.ints, c.ints), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op9(spark, sf_dir):
    from .topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op13_fill_in_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
k AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
             CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""")
def op13(spark, sf_dir):
    from .fim import digests, fill_in_middle

    return digests(fill_in_middle(table(spark, sf_dir, "documents")))


@query("op12_pu_quality")
def op12(spark, sf_dir):
    from pyspark.sql import functions as F

    from .quality import fit_quality, in_training, score_quality

    docs = table(spark, sf_dir, "documents")
    net, _ = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, net, keep=["doc_id"]).select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")


@query("op11_hard_negatives", r"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_sum(list_transform(list_zip(a.ints, c.ints), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""")
def op11(spark, sf_dir):
    from .mining import mine_hard_negatives

    return mine_hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
