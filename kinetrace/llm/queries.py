"""Queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, embedding_dedup, exact_dedup, hard_negatives, licenses, lm_score, media, near_dedup, packing, reshard, token_counts, toxicity, whitening
from .common import documents, materialize, scratch_path
from .vectors import embeddings

#: Vocabulary files; a deployment passes its own paths to the operators.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.score_documents(documents(spark, sf_dir), modulus=7, held_out=2)
    # Sums in any order agree to far more than six decimals.
    return scores.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=2, percent=80).drop("n_links")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through an index of its own, which is dropped once the verdicts are written."""
    index = exact_dedup.scratch_index(spark)
    verdicts = exact_dedup.deduplicate(documents(spark, sf_dir), index)
    verdicts = materialize(verdicts.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")), "verdicts")
    index.drop()
    return verdicts


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(documents(spark, sf_dir), RANKS, PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), TOKENIZER, PATTERN, length=1024, separator=0).drop("token_ids")


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards by source, of very unequal size, to 40 near equal in bytes; affected shards are written and read back."""
    by_source = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(32))
    return reshard.rewrite_affected(documents(spark, sf_dir), by_source, 40, scratch_path(spark, "shards"))[0]


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_documents(spark, documents(spark, sf_dir), labels, modulus=4, held_out=2, threshold=0.3)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), TOKENIZER, PATTERN, limit=1024)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "digest", "shard", "offset", "length")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(embeddings(spark, sf_dir), cosine=0.98)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir), keep=8)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are a hundredth of the rows; a seventh of the labels is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0, label, positives=5, negatives=10)


def _license_sql() -> str:
    """The trained weights and the notices as values, joined with the lines' n-grams."""
    model = licenses.train()
    classes = range(len(licenses.CLASSES))
    text = lambda x: "'" + x.replace("'", "''") + "'"
    weights = ", ".join(f"({text(f)}, {', '.join(f'{w!r}::DOUBLE' for w in map(float, row))})" for f, row in zip(model.features, model.weights, strict=True))
    own = licenses.own_grams()
    notices = ", ".join(f"({text(family)}, {n}, {len(licenses.grams(t))}, {text(g)}, {(family, g) in own})" for family, texts in licenses.TEMPLATES.items() for n, t in enumerate(texts) for g in licenses.grams(t))
    powers = ", ".join(f"(sum(w{k}) + {float(model.bias[k])!r}::DOUBLE) / {model.temperature!r}::DOUBLE" for k in classes)
    names = ", ".join(map(text, licenses.TEMPLATES))
    speaking = model.speaking_words()
    return f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        l AS (SELECT doc_id, row_no, unnest(l) AS line, unnest(range(len(l))) AS paragraph FROM d),
        w AS (SELECT doc_id, row_no, paragraph, list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM l WHERE regexp_matches(lower(line), '(^|[^a-z0-9])({"|".join(speaking)})([^a-z0-9]|$)')),
        g AS (SELECT doc_id, row_no, paragraph, list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w WHERE list_has_any(w, [{", ".join(map(text, speaking))}])),
        e AS (SELECT doc_id, row_no, paragraph, len(g) AS n, unnest(g) AS gram FROM g),
        z AS (SELECT doc_id, row_no, paragraph, [{powers}] AS z FROM e JOIN (VALUES {weights}) t(gram, {", ".join(f"w{k}" for k in classes)}) USING (gram) GROUP BY ALL),
        x AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS x FROM z),
        b AS (SELECT doc_id, row_no, paragraph, list_max(list_slice(x, 1, {len(licenses.TEMPLATES)})) AS best, x[{len(licenses.CLASSES)}] AS none, list_sum(x) AS total, [{names}][list_position(x, list_max(list_slice(x, 1, {len(licenses.TEMPLATES)})))] AS likely FROM x),
        j AS (SELECT *, best / total AS p, best / total >= {model.least!r}::DOUBLE AND best > none AS sure FROM b WHERE best / total >= {licenses.REPORTS}),
        c AS (SELECT doc_id, row_no, paragraph, family, greatest(count(*) / any_value(size), count(*) / any_value(n)) AS share, bool_or(own) AS own FROM e JOIN (VALUES {notices}) t(family, notice, size, gram, own) USING (gram) GROUP BY doc_id, row_no, paragraph, family, notice),
        s AS (SELECT doc_id, row_no, paragraph, family, max(share) AS similarity, max(share) FILTER (WHERE own) AS own_similarity FROM c GROUP BY ALL)
        SELECT j.doc_id, j.paragraph, CASE WHEN sure THEN likely ELSE 'unknown' END AS family, round(p, 6) AS probability, round(coalesce(similarity, 0.0), 6) AS similarity, sure AND coalesce(own_similarity, 0.0) >= {licenses.CONFIRMS} AS confirmed
        FROM j LEFT JOIN s ON s.row_no = j.row_no AND s.paragraph = j.paragraph AND s.family = j.likely
    """


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_near_dedup": op2_near_dedup,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_bpe_codec": op4_bpe_codec,
        "op5_packing": op5_packing,
        "op6_resharding": op6_resharding,
        "op7_toxicity": op7_toxicity,
        "op8_token_counts": op8_token_counts,
        "op9_license_scan": op9_license_scan,
        "op10_media_columns": op10_media_columns,
        "op11_embedding_dedup": op11_embedding_dedup,
        "op12_whitening": op12_whitening,
        "op13_hard_negatives": op13_hard_negatives,
    }


#: SQL for the documents' words: lower-cased A-Z, parted by ASCII white space.
_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"""
#: SQL for crc32 of an id as text, by the polynomial.
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b:
        xor(c >> 8, list_reduce(list_concat([xor(c, b) & 255], [0, 0, 0, 0, 0, 0, 0, 0]), lambda t, k: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END)), 4294967295), 4294967295)"""


def _lm_sql() -> str:
    """The smoothed trigram model as joins with its counts; the end is a blank, the start an empty word."""
    k2, k3 = lm_score.STRENGTHS
    return f"""
        WITH docs AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append({_WORDS}, ' ') AS w FROM documents),
        t AS (SELECT doc_id, held_out, unnest(w) AS tok, unnest(list_concat([''], list_slice(w, 1, len(w) - 1))) AS prev,
                     unnest(list_concat([NULL, ''], list_slice(w, 1, len(w) - 2))[1:len(w)]) AS first FROM docs),
        c1 AS (SELECT tok, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
        c2 AS (SELECT prev, tok, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1, 2),
        c3 AS (SELECT first, prev, tok, count(*) AS c FROM t WHERE NOT held_out AND first IS NOT NULL GROUP BY 1, 2, 3),
        n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c1),
        p AS (SELECT doc_id, held_out, t.first, c1.c IS NOT NULL AS known, (coalesce(c1.c, 0) + 1) / (n + 1 * (v + 1))::DOUBLE AS p1, coalesce(c2.c, 0) AS seen2, coalesce(c3.c, 0) AS seen3,
                     CASE WHEN t.prev = '' THEN coalesce((SELECT c FROM c1 WHERE tok = ' '), 0) ELSE coalesce(h.c, 0) END AS context2, coalesce(g.c, 0) AS context3
              FROM t CROSS JOIN n LEFT JOIN c1 ON c1.tok = t.tok LEFT JOIN c1 h ON h.tok = t.prev LEFT JOIN c2 ON c2.prev = t.prev AND c2.tok = t.tok
              LEFT JOIN c2 g ON g.prev = t.first AND g.tok = t.prev LEFT JOIN c3 ON c3.first = t.first AND c3.prev = t.prev AND c3.tok = t.tok),
        q AS (SELECT *, (seen2 + {k2} * p1) / (context2 + {k2}) AS p2 FROM p)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE known) AS n_known, (SELECT n FROM n) AS train_tokens, round(sum(log10(p1)), 6) AS base_score,
               round(sum(log10(CASE WHEN first IS NULL THEN p2 ELSE (seen3 + {k3} * p2) / (context3 + {k3}) END)), 6) AS score
        FROM q GROUP BY doc_id, held_out
    """


#: Candidates share one of the rarest fifth of their shingles, as any linked pair must; links are counted in full.
_NEAR_SQL = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (SELECT doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
    n AS (SELECT doc_id, len(s) AS n FROM s),
    e AS (SELECT doc_id, unnest(s) AS g FROM s),
    f AS (SELECT g, count(*) AS c FROM e GROUP BY 1),
    k AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS r FROM e JOIN f USING (g)),
    p AS (SELECT k.doc_id, g, n FROM k JOIN n USING (doc_id) WHERE r <= n - ceil(0.8 * n) + 1),
    c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
    i AS (SELECT a, b, na, nb, count(*) AS shared FROM c JOIN e x ON x.doc_id = a JOIN e y ON y.doc_id = b AND y.g = x.g GROUP BY ALL),
    l AS (SELECT a, b FROM i WHERE 100 * shared >= 80 * (na + nb - shared)),
    u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reach)
    SELECT n.doc_id, n.n AS n_shingles, min(reach) AS component_id, n.doc_id = min(reach) AS kept FROM r JOIN n USING (doc_id) GROUP BY n.doc_id, n.n
"""


#: Vectors whose components all are finite numbers.
_VECTORS = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v,
        coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding), false) AS fits FROM embeddings)"""
#: All pairs of a label.
_COSINE_SQL = f"""
    WITH RECURSIVE {_VECTORS},
    x AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS n FROM u WHERE fits AND label IS NOT NULL AND list_inner_product(v, v) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / a.n / b.n >= 0.98),
    r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach)
    SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = r.vec_id) AS n_links, min(reach) AS component_id, vec_id = min(reach) AS kept FROM r GROUP BY vec_id
"""
_NEGATIVES_SQL = f"""
    WITH {_VECTORS},
    x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(v, lambda c: floor(256 * c)) AS v FROM u WHERE fits AND label IS NOT NULL),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM x a JOIN x b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS nth FROM s WHERE same),
    n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS r
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE nth <= 5)
    SELECT anchor_id, positive_id, r::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_embedding_dedup": _COSINE_SQL,
        "op13_hard_negatives": _NEGATIVES_SQL,
        "op1_lm_score": _lm_sql(),
        "op2_near_dedup": _NEAR_SQL,
        "op9_license_scan": _license_sql(),
        "op3_exact_dedup": """
            SELECT doc_id,
                   max(doc_id) OVER same AS keep_id,
                   count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents
            WINDOW same AS (PARTITION BY coalesce(text, ''))
        """,
    }
