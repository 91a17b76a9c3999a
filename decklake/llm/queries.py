"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decklake.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decklake.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decklake.llm.secret_scan import with_secrets

    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decklake.llm.license_scan import licenses

    return licenses(table(spark, sf_dir, "documents")).drop("spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decklake.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decklake.llm.url_filter import judged

    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decklake.llm.quality import quality

    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_keep").alias("keep"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from decklake.llm.bpe import decode, encode, ids_digest, read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    ids = F.col("token_ids")
    return found.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), ids_digest(ids).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decklake.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decklake.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def media_page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser of operator 9 over real pages: texts and media in order."""
    from decklake.llm.media import page_items

    return page_items(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decklake.llm.simhash import hex_digits, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decklake.llm.fill_middle import fill_middle, restored

    found = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    output, form = F.col("output"), F.col("form")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(output).alias("output_sha256"), digest(restored(output, form)).alias("restored_sha256"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decklake.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from decklake.llm.filter_audit import audited

    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_secrets, op3_licenses, op4_toxicity, op5_urls, op6_quality, op7_bpe, op8_warc, op9_media, op10_simhash, op11_fill_middle, op12_minhash, op13_filter_audit, media_page_items)}
#: The other queries fit models, hash with XXH64, or write formats that SQL lacks; tests/llm compares them with brute force.
ORACLE: dict[str, str] = {
    "op8_warc": """WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS s FROM pages),
    m AS (SELECT s, max(page_id) AS last_id FROM d WHERE n >= 1000 GROUP BY s)
    SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> last_id THEN last_id END AS refers_to
    FROM d LEFT JOIN m USING (s)""",
    "op11_fill_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS x FROM documents),
    h AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS k, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT doc_id, t, k, len(k) AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS a, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(k[:a], ''), '') AS p, coalesce(array_to_string(k[a + 1:b], ''), '') AS m, coalesce(array_to_string(k[b + 1:], ''), '') AS s FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_filter_audit": """WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS w FROM t),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, concat(CASE WHEN len(w) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END,
      CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 'C' END, CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' END, CASE WHEN least < doc_id THEN 'E' END) AS fails FROM w LEFT JOIN l USING (doc_id)),
    m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, fails),
    c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    o AS (SELECT concat(a.c, b.c, d.c, e.c, g.c) AS o FROM c a, c b, c d, c e, c g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
    s AS (SELECT o, i AS step, o[i] AS c, o[1:i - 1] AS earlier FROM o, range(1, 6) r(i)),
    r AS (SELECT part, o, step, c, sum(CASE WHEN translate(fails, earlier || c, '') = fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN contains(fails, c) AND translate(fails, earlier, '') = fails THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN contains(fails, c) AND translate(fails, earlier, '') <> fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = c THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN contains(fails, c) AND translate(fails, earlier, '') = fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN contains(fails, c) AND translate(fails, earlier, '') = fails THEN bad ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY part, o, step, c)
    SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
      (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM r""",
}
