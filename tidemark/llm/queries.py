"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.codes import compressed
from tidemark.llm.exact import exact_duplicates
from tidemark.llm.lines import remove_boilerplate
from tidemark.llm.merkle import folded, hexed, leaf_of, merkle_manifest, siblings
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix
from tidemark.llm.packing import best_fit
from tidemark.llm.perplexity import quality_rules
from tidemark.llm.quality import with_quality
from tidemark.llm.substring import remove_repeats
from tidemark.llm.tokens import read_ranks, with_token_counts
from tidemark.llm.toxicity import with_toxicity
from tidemark.llm.vectors import near_vectors
from tidemark.llm.work import written

#: A public vocabulary of 50,256 pieces; a parameter, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Target weights of domains and of languages within each; all others are 1.
DOMAINS = ["web", "books", "news", "code"]
WEIGHTS = {("web",): 3, ("books",): 5, ("news",): 1, ("code",): 1} | {(d, "en"): 4 for d in DOMAINS} | {("web", "en", "src0"): 2}


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_documents(spark, folder), shingle=4)


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"), cosine=0.98)


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeats(_documents(spark, folder), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def with_domain(docs: DataFrame, name: str = "domain") -> DataFrame:
    """docs with a domain, in the column `name`, by the number that ends the source's name."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int)")
    return docs.withColumn(name, F.coalesce(F.get(F.array(*map(F.lit, DOMAINS)), number % len(DOMAINS)), F.lit("other")))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = written(with_domain(_documents(spark, folder)).select("doc_id", "domain", "lang", "source", words.alias("n_tokens")), "mix-input")
    return mix(rows, WEIGHTS, share=1.0, max_epochs=2)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return with_token_counts(_documents(spark, folder), read_ranks(VOCABULARY)).select("doc_id", "n_words", "n_tokens")


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit(op6_token_counts(spark, folder))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_boilerplate(_documents(spark, folder), min_sites=10)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = with_toxicity(_documents(spark, folder), labels, train_where=_fold(5) != 0)
    return out.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = with_quality(_documents(spark, folder), labels, train_where=_fold(3) != 1)
    return out.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_documents(spark, folder))


def op11_code_compression(spark: SparkSession, folder: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{folder}/embeddings.parquet"), parts=16, entries=64, rounds=2)


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(_documents(spark, folder))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    names = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = leaf_of(*(F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in names))
    out = merkle_manifest(_documents(spark, folder), names, also={"tampered": F.when(_fold(7) == 0, tampered)})
    back, root = folded(F.coalesce("tampered", "leaf"), F.col("proof")), hexed("root")
    return out.select(
        "doc_id", hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), root.alias("root"),
        F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), back.alias("folded_root"), (back == root).alias("verified"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_quality_rules": op10_quality_rules,
    "op11_code_compression": op11_code_compression,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _fill_sql(k: int) -> str:
    """Budgets of level k (1 to 3) from those of the level above, as for Spark."""
    path, parent = ["domain", "lang", "source"][:k], ["domain", "lang"][: k - 1]
    name, cols, part = path[-1], ", ".join(path), f"PARTITION BY {', '.join(parent)}" if parent else ""
    link = "CROSS JOIN f0" if k == 1 else f"JOIN f{k - 1} USING ({', '.join(parent)})"
    weight = "CASE concat_ws('/', " + cols + ") " + " ".join(f"WHEN '{'/'.join(p)}' THEN {w}" for p, w in WEIGHTS.items()) + " ELSE 1 END"
    return f"""
        n{k} AS (SELECT {cols}, sum(2 * avail)::HUGEINT AS cap, ({weight})::HUGEINT AS weight FROM leaves GROUP BY {cols}),
        o{k} AS (SELECT *, row_number() OVER ({part} ORDER BY cap::DOUBLE / weight, {name}) AS r FROM n{k} {link}),
        g{k} AS (SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
                        sum(weight) OVER ({part} ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o{k}),
        h{k} AS (SELECT *, cap * rest <= weight * (B - gone) AS is_full FROM g{k}),
        f{k} AS (SELECT {cols}, CASE WHEN is_full THEN cap ELSE (weight * (B - coalesce(sum(cap) FILTER (WHERE is_full) OVER ({part}), 0)))
                        // greatest(coalesce(sum(weight) FILTER (WHERE NOT is_full) OVER ({part}), 0), 1) END AS B FROM h{k})"""


MIX_SQL = rf"""
        WITH d AS (
          SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens,
                 coalesce(([{', '.join(f"'{x}'" for x in DOMAINS)}])[try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % {len(DOMAINS)} + 1], 'other') AS domain
          FROM documents),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS avail FROM d GROUP BY ALL),
        f0 AS (SELECT sum(avail)::HUGEINT AS B FROM leaves), {_fill_sql(1)}, {_fill_sql(2)}, {_fill_sql(3)},
        b AS (SELECT *, CASE WHEN avail > 0 THEN B // avail ELSE 0 END AS fulls, CASE WHEN avail > 0 THEN B % avail ELSE 0 END AS rest
              FROM leaves JOIN f3 USING (domain, lang, source)),
        e AS (SELECT d.*, fulls, rest, md5(concat_ws(':', 1, fulls + 1, doc_id)) AS h FROM d JOIN b USING (domain, lang, source)),
        p AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM e)
        SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, fulls::BIGINT + 1))::INT AS epoch, n_tokens AS n_taken FROM e
        UNION ALL
        SELECT doc_id, domain, lang, source, n_tokens, (fulls + 1)::INT, least(n_tokens, rest - used)::BIGINT FROM p WHERE used < rest"""



def _round_sql(k: int) -> str:
    """Assignment of all parts to the codebooks of round k, and the codebooks after it."""
    return f"""
        d{k} AS (SELECT vec_id, label, t.p, t.v, e, list_sum(list_transform(list_zip(t.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
                 FROM t JOIN c{k} c USING (p)),
        a{k} AS MATERIALIZED (SELECT vec_id, label, p, any_value(v) AS v, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM d{k} GROUP BY vec_id, label, p),
        s{k} AS (SELECT p, e, i, floor(sum(v[i]) / count(*))::BIGINT AS x FROM a{k}, unnest(range(1, len(v) + 1)) u(i) GROUP BY p, e, i),
        m{k} AS (SELECT p, e, list(x ORDER BY i) AS v FROM s{k} GROUP BY p, e),
        c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (p, e))"""


CODES_SQL = f"""
        WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
                      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        t AS MATERIALIZED (SELECT vec_id, label, r, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS v FROM kept, range(16) x(p)),
        c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM t WHERE r <= 64), {_round_sql(0)}, {_round_sql(1)}, {_round_sql(2)},
        o AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id, label),
        h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS digest FROM c2)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM o, h"""


def _leaf_sql(n_chars: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
    return "sha256(concat(" + ", ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(strlen({v}), ':', {v}) END" for v in values) + "))"


def _tree_sql(name: str, nodes: str) -> str:
    """All levels k of the trees over nodes (tree, pos, n, h)."""
    return f"""
        {name} AS (
          SELECT 0 AS k, tree, pos, n, h FROM {nodes}
          UNION ALL
          SELECT any_value(k) + 1, tree, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, pos // 2, (n + 1) // 2)"""


#: crc32 by eight shifts a byte over the number's digits.
MERKLE_SQL = f"""
        WITH RECURSIVE b AS (SELECT doc_id, unnest([ascii(c) for c in string_split(doc_id::VARCHAR, '')]) AS byte, generate_subscripts(string_split(doc_id::VARCHAR, ''), 1) AS i FROM documents),
        w AS (SELECT doc_id, list(byte::BIGINT ORDER BY i) AS bytes FROM b GROUP BY doc_id),
        crc AS (SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, byte:
                  list_reduce(list_prepend(xor(a, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS v FROM w),
        leaves AS (SELECT d.doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
                          count(*) OVER (PARTITION BY lang) AS n, {_leaf_sql("n_chars")} AS h,
                          CASE WHEN v % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS tampered
                   FROM documents d LEFT JOIN crc USING (doc_id)),
        {_tree_sql("lower", "leaves")},
        subs AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h, k AS depth FROM lower WHERE n = 1),
        {_tree_sql("upper", "subs")},
        steps AS (
          SELECT doc_id, lower.k AS k, lower.h AS s, lower.pos < leaves.pos >> lower.k AS before
          FROM leaves JOIN lower ON lower.tree = leaves.tree AND lower.pos = xor(leaves.pos >> lower.k, 1)
          UNION ALL
          SELECT doc_id, depth + upper.k, upper.h, upper.pos < leaves.tree >> upper.k
          FROM leaves JOIN subs ON subs.pos = leaves.tree JOIN upper ON upper.pos = xor(leaves.tree >> upper.k, 1)),
        root AS (SELECT h AS root, k AS height FROM upper WHERE n = 1),
        fold AS (
          SELECT doc_id, 0 AS k, depth + height AS last, coalesce(tampered, leaves.h) AS h FROM leaves JOIN subs ON subs.pos = leaves.tree, root
          UNION ALL
          SELECT f.doc_id, f.k + 1, last, sha256(CASE WHEN s IS NULL THEN h WHEN before THEN concat(s, h) ELSE concat(h, s) END)
          FROM fold f LEFT JOIN steps ON steps.doc_id = f.doc_id AND steps.k = f.k WHERE f.k < last)
        SELECT l.doc_id, l.h AS leaf, subs.h AS subroot, root, sha256(coalesce(p.all_s, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
        FROM leaves l JOIN subs ON subs.pos = l.tree JOIN fold f ON f.doc_id = l.doc_id AND f.k = f.last
        LEFT JOIN (SELECT doc_id, string_agg(s, '' ORDER BY k) AS all_s FROM steps GROUP BY doc_id) p ON p.doc_id = l.doc_id, root"""

ORACLE_SQL: dict[str, str] = {
    "op11_code_compression": CODES_SQL,
    "op12_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op13_merkle_manifest": MERKLE_SQL,
    "op4_mixing": MIX_SQL,
    "op8_line_dedup": r"""
        WITH lines AS (
          SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
        ), keyed AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM lines),
        common AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10),
        kept AS (
          SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM common)) AS n_removed,
                 coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM common)), '') AS t
          FROM keyed GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
               CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(t, '')) END AS kept_sha256
        FROM documents d LEFT JOIN kept USING (doc_id)""",
}
