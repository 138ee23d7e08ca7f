"""The operators over their whole tables with production parameters, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import (
    exact_dedup,
    fill_in_middle,
    language_id,
    mixing,
    order_minhash,
    packing,
    periodic_runs,
    rotated_codes,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    toxicity,
    url_filters,
)
from leadloom.llm.common import read_documents

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "copy", F.round("rate", 6).alias("rate"), "shuffle_key", F.sha2("text", 256).alias("text_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity_scores(read_documents(spark, sf_dir), labels)


LISTS = ("adult", "gambling", "malware")


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of ``pages``: each host has up to eight, on lists, days and actions that its hash picks."""
    hosts = pages.select(url_filters.url_host().alias("domain")).where("domain <> ''").distinct()
    entries = hosts.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(7))))
    code = F.crc32(F.concat_ws("|", "domain", "n"))
    names = F.array(*[F.lit(x) for x in LISTS])
    return entries.select(
        F.element_at(names, (code % 3 + 1).cast("int")).alias("list_name"),
        "domain",
        F.timestamp_seconds(F.lit(1704067200) + (code % 366) * 86400).alias("effective_at"),
        F.when(F.floor(code / 366) % 2 == 0, "block").otherwise("release").alias("action"),
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no fetch time; a capture's is a minute of 2024 that follows from its id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("page_id") * 7919, F.lit(527040)) * 60)
    found = url_filters.filter_urls(pages.withColumn("fetched_at", fetched), list_entries(pages))
    return found.select("page_id", "url", F.unix_timestamp("fetched_at").alias("fetched_s"), "host", "n_lists", "lists", "blocked")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read_documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read_documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(read_documents(spark, sf_dir))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rotated_codes.nearest(vectors, F.col("vec_id") % 100 == 0)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir), tokenizer_path())


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.fill_in_middle(read_documents(spark, sf_dir))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"),
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in one of ten documents, picked by its id's hash, the words from a place on repeat a first part."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    code = F.crc32(F.col("doc_id").cast("string"))
    picked = F.col("w").isNotNull() & (F.size("w") > 0)
    n, g = F.size("w").cast("bigint"), F.floor(F.col("h") / 10)
    repeated = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1),
        lambda i: F.get(F.col("w"), F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")),
    )
    rows = docs.select("doc_id", "text", code.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumns({"n": n, "g": g}).withColumn("a", F.when(picked, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    return rows.select("doc_id", F.when(picked, F.concat_ws(" ", repeated)).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_periods(read_documents(spark, sf_dir)))
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = found.withColumn("top", F.array_max(ranked))
    return top.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(F.col("top.length") * 1000 / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.predicted_languages(read_documents(spark, sf_dir))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_toxicity": op3_toxicity,
    "op4_url_filters": op4_url_filters,
    "op5_near_dedup": op5_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_secrets": op7_secrets,
    "op8_nearest": op8_nearest,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_language_id": op13_language_id,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op2_mix_sources": r"""
        WITH sizes AS (
            SELECT source, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY source),
        rates AS (
            SELECT source, CASE WHEN chars > 0 THEN
                sqrt(chars::DOUBLE) / (SELECT sum(sqrt(chars::DOUBLE)) FROM sizes)
                * (SELECT sum(chars)::DOUBLE FROM sizes) / chars ELSE 0.0 END AS rate
            FROM sizes),
        terms AS (
            SELECT source, rate, k, sum(CASE WHEN k = 0 THEN 0.0 ELSE ln(rate) - ln(k::DOUBLE) END)
                OVER (PARTITION BY source ORDER BY k) - rate AS log_term
            FROM rates, LATERAL (SELECT unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 24)::INT)) AS k)
            WHERE rate > 0),
        steps AS (
            SELECT source, rate, k, sum(exp(log_term)) OVER (PARTITION BY source ORDER BY k) AS step FROM terms),
        drawn AS (
            SELECT d.doc_id, d.source, d.text,
                (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
            FROM documents d),
        counted AS (
            SELECT d.doc_id, d.source, d.text, s.rate, count(*) FILTER (WHERE s.step < d.u) AS n
            FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source
            GROUP BY d.doc_id, d.source, d.text, d.u, s.rate),
        copies AS (
            SELECT *, unnest(generate_series(1, n)) AS copy FROM counted WHERE n > 0)
        SELECT doc_id, source, copy::INT AS copy, round(rate, 6) AS rate,
               substr(md5('mix-1-order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy), 1, 16) AS shuffle_key,
               sha256(text) AS text_sha256
        FROM copies""",
    "op4_url_filters": r"""
        WITH captures AS (
            SELECT page_id, url, 1704067200 + (page_id * 7919 % 527040) * 60 AS fetched_s,
                   lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host
            FROM pages),
        hosts AS (SELECT DISTINCT host AS domain FROM captures WHERE host <> ''),
        bits AS (
            SELECT n::BIGINT AS n, list_reduce(list_prepend(n::BIGINT, range(8)),
                   lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS entry
            FROM range(256) t(n)),
        crc_table AS (SELECT list(entry ORDER BY n) AS e FROM bits),
        coded AS (
            SELECT domain, k, xor(list_reduce(list_prepend(4294967295::BIGINT,
                       list_transform(string_split(domain || '|' || k, ''), lambda c: ascii(c)::BIGINT)),
                       lambda a, b: xor(a >> 8, e[(xor(a, b) & 255) + 1])), 4294967295) AS code
            FROM hosts, range(8) r(k), crc_table),
        entries AS (
            SELECT ['adult', 'gambling', 'malware'][(code % 3 + 1)::INT] AS list_name, domain,
                   1704067200 + (code % 366) * 86400 AS effective_s, (code // 366) % 2 = 0 AS blocks
            FROM coded),
        moments AS (
            SELECT list_name, domain, effective_s, bool_or(blocks) AS blocks FROM entries GROUP BY ALL),
        intervals AS (
            SELECT list_name, domain, blocks, effective_s AS valid_from,
                   lead(effective_s) OVER (PARTITION BY list_name, domain ORDER BY effective_s) AS valid_to
            FROM moments),
        hits AS (
            SELECT DISTINCT c.page_id, c.url, c.fetched_s, i.list_name
            FROM captures c JOIN intervals i
              ON (c.host = i.domain OR ends_with(c.host, '.' || i.domain)) AND i.blocks
             AND c.fetched_s >= i.valid_from AND (i.valid_to IS NULL OR c.fetched_s < i.valid_to))
        SELECT c.page_id, c.url, c.fetched_s, c.host, count(h.list_name) AS n_lists,
               coalesce(string_agg(h.list_name, ',' ORDER BY h.list_name), '') AS lists, count(h.list_name) > 0 AS blocked
        FROM (SELECT DISTINCT * FROM captures) c
        LEFT JOIN hits h ON c.page_id IS NOT DISTINCT FROM h.page_id AND c.url IS NOT DISTINCT FROM h.url
              AND c.fetched_s IS NOT DISTINCT FROM h.fetched_s
        GROUP BY c.page_id, c.url, c.fetched_s, c.host""",
    "op11_fill_in_middle": r"""
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
                   sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d
            FROM documents),
        drawn AS (
            SELECT doc_id, t, units, len(units) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
                   ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4
            FROM cut),
        placed AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100
                        THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn),
        parts AS (
            SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
                   array_to_string(units[b + 1:n], '') AS s
            FROM placed)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(p || m || s) AS restored_sha256
        FROM parts""",
}
