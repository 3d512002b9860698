"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, caps, codes, decontam, katz, licenses, phrases, pieces, secrets, sharding, simhash, toxicity, webtext


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary package keeps a file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(_table(spark, sf_dir, "documents"))


def op2_winnow_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op3_html_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_bpe_speculative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), 0.9)


def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_shards(_table(spark, sf_dir, "documents"), 40)


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_sentencepiece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the licence scan that SQL can say: places and labels of the base phrases."""
    return op9_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the shuffle that SQL can say: how many rows each shard has, and that its slots have no gap."""
    rows = op7_hypergeometric_shards(spark, sf_dir)
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_katz_backoff,
        op2_winnow_decontam,
        op3_html_template_removal,
        op4_bpe_speculative,
        op5_toxicity_ordinal,
        op6_spherical_caps,
        op7_hypergeometric_shards,
        op8_simhash_golay,
        op9_license_scan,
        op10_secret_forest,
        op11_vector_codes,
        op12_collocations,
        op13_sentencepiece_agenda,
        license_phrases,
        shard_counts,
    )
}

def _codes_sql(rounds: int = 2) -> str:
    """Assignments and floors of means, a pair of tables for each round."""
    near = "SELECT vec_id, p, x, d % 64 AS e, d // 64 AS d FROM (SELECT vec_id, p, any_value(x) AS x, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) * 64 + e)::BIGINT AS d FROM s JOIN c{i} USING (p) GROUP BY ALL)"
    mean = "SELECT p, e, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT p, e, list(floor_mean ORDER BY j) AS m FROM (SELECT p, e, j, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_mean FROM (SELECT p, e, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS j FROM a{i}) GROUP BY ALL) GROUP BY ALL) USING (p, e)"
    steps = ", ".join(f"a{i} AS ({near.format(i=i).replace('GROUP BY ALL', 'GROUP BY vec_id, p')}), c{i + 1} AS ({mean.format(i=i)})" for i in range(rounds))
    return f"""
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM (SELECT vec_id, v, unnest(range(0, 16)) AS p FROM k)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM s QUALIFY e < 64), {steps}, a{rounds} AS ({near.format(i=rounds).replace('GROUP BY ALL', 'GROUP BY vec_id, p')}),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id), h"""


#: Word hits are joins of windows, vector links a self-join with a recursive closure. The others hold
#: hashes, models, parsers or random draws that SQL has no functions for; tests compare with brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    "op12_collocations": r"""
WITH p AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
g AS (SELECT lang, w[s : s + k - 1] AS g, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM p, (SELECT unnest(range(1, 4)) AS k))),
f AS (SELECT lang, g, k, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, g, k, f AS a FROM f WHERE k > 1 AND f >= 10),
t AS (SELECT c.lang, c.g, c.k, c.a, i, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : i] JOIN f r ON r.lang = c.lang AND r.g = c.g[i + 1 :]),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
o AS (SELECT lang, s AS g, max(a) AS m FROM (SELECT lang, a, unnest([g[1 : 2], g[2 : 3]]) AS s FROM c WHERE k = 3) GROUP BY ALL),
q AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN o USING (lang, g) WHERE m IS NULL OR 100 * m < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) QUALIFY rank <= 2000""",
    "license_phrases": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS m, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS a,
list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g FROM d)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(m) + len(a) + len(g))::BIGINT AS n_base, list_min(list_concat(list_concat(m, a), g)) - 1 AS first_word, list_max(list_concat(list_concat(m, a), g)) - 1 AS last_word,
coalesce(array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ','), '') AS base_labels FROM p""",
    "shard_counts": """
WITH t AS (SELECT count(*) AS c FROM documents), s AS (SELECT unnest(range(0, 40))::INT AS shard), n AS (SELECT shard, (c // 40 + (shard < c % 40)::INT)::BIGINT AS n FROM s, t)
SELECT shard, n, n AS slots, 0::BIGINT AS first_slot, n - 1 AS last_slot FROM n WHERE n > 0""",
    "op2_winnow_decontam": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
a AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS g FROM a),
b AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
h AS (SELECT DISTINCT doc_id, s, k, item_id FROM (SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS g FROM b) JOIN win USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM h)) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op6_spherical_caps": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a),
c AS (SELECT a AS vec_id, min(root) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
}
