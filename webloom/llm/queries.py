"""The registered query of each operator, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import align, chatformat, decontaminate, embed_dedup, htmltext, langid, minhash, packing, resample, tokencount, toxicity, urlfilter, warc
from webloom.llm.common import remainder, settled, shared_dir, table


def tokenizer_path() -> str:
    """The byte-level vocabulary of the production queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    """The sentence-piece vocabulary of the production queries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(remainder("doc_id", 4) != 2))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")


# The rules of the URL query.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.format_chats(table(spark, sf_dir, "conversations"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=1024, end_id=0)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(remainder("doc_id", 5) != 0)
    lexicon = toxicity.fit(docs, labels)
    out = toxicity.score(docs, lexicon).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), "toxic_matches")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_lines(table(spark, sf_dir, "documents"), tokenizer_path(), rule="most")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.main_text(pages, htmltext.fit(pages))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample.resample(docs, target, percent=10, least_words=20, seed="2024", longest=1, buckets=10_000)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.link_counts(table(spark, sf_dir, "documents"), tokenizer_path(), piece_path())


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    out = settled(lambda: warc.round_trip(table(spark, sf_dir, "pages"), folder, least_bytes=0), "records")
    warc.delete(spark, folder)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("error").isNull().alias("verified"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_chat_format": op4_chat_format,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_packing": op6_packing,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_html_text": op10_html_text,
    "op11_resample": op11_resample,
    "op12_token_alignment": op12_token_alignment,
    "op13_warc": op13_warc,
}


def _url_sql() -> str:
    near = lambda t: f"regexp_matches(low, '(^|[^a-z0-9])({t})([^a-z0-9]|$)')"
    soft = [f"CASE WHEN {near(t)} THEN {w} ELSE 0 END" for t, w in urlfilter.SOFT.items()]
    count = [f"CASE WHEN {near(t)} THEN 1 ELSE 0 END" for t in urlfilter.SOFT]
    rules = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1]))

    def fits(rule: str) -> str:
        domain, slash, rest = rule.partition("/")
        return f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{rest}')"

    upper, lower = urlfilter.UPPER, urlfilter.LOWER
    return f"""
WITH u AS (
    SELECT page_id, coalesce(translate(url, '{upper}', '{lower}'), '') AS low,
           coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{upper}', '{lower}'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages),
r AS (SELECT *, CASE {" ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in rules)} END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{t}' THEN '{v}'" for v, t in rules)}
            WHEN {near("|".join(urlfilter.STRICT))} THEN 'block'
            WHEN {" + ".join(count)} >= 2 AND {" + ".join(soft)} >= 1.5 THEN 'block'
            ELSE 'allow' END AS verdict
FROM r"""


def _resample_sql() -> str:
    """CRC-32 byte by byte over the distinct words; its table is eight shifts of each number under 256."""
    upper, lower = urlfilter.UPPER, urlfilter.LOWER
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH t AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i)),
d AS (SELECT doc_id, unnest({words}) AS w FROM documents),
b AS (SELECT unnest({words}) AS w FROM benchmark),
distinct_words AS (SELECT DISTINCT w FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
crc AS (SELECT w, xor(list_reduce(list_transform(range(1, length(hex(w)), 2), lambda p: ('0x' || substr(hex(w), p, 2))::BIGINT),
                      lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM distinct_words, t),
dw AS (SELECT doc_id, bucket FROM d JOIN crc USING (w)),
s AS (SELECT bucket, count(*) AS n FROM dw GROUP BY 1),
u AS (SELECT bucket, count(*) AS n FROM b JOIN crc USING (w) GROUP BY 1),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(u.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000) / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000))))::BIGINT AS gain
      FROM s LEFT JOIN u USING (bucket)),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dw JOIN g USING (bucket) GROUP BY 1),
o AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
             + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM documents LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 10 // 100 FROM r) THEN rank END AS rank FROM o LEFT JOIN r USING (doc_id)"""


def _warc_sql() -> str:
    """Base 32 of a SHA-1: every five hexadecimal digits are four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    four = " || ".join(f"substr('{letters}', ((v >> {k}) & 31) + 1, 1)" for k in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(list_transform(range(8), lambda k: ('0x' || substr(h, 5 * k + 1, 5))::BIGINT), lambda v: {four}), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to, TRUE AS verified
FROM f"""


SQL: dict[str, str] = {
    "op11_resample": _resample_sql(),
    "op13_warc": _warc_sql(),
    "op3_url_filter": _url_sql(),
    "op4_chat_format": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
      FROM t GROUP BY conv_id),
m AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns),
k AS (SELECT * FROM m WHERE NOT EXISTS (
      SELECT 1 FROM m d WHERE len(d.turns) > len(m.turns) AND d.turns[1:len(m.turns)] = m.turns))
SELECT conv_id, len(turns) AS n_turns, n_copies,
       array_to_string(['<|im_start|>' || replace(coalesce(x.r, 'unknown'), '<|', '< |') || chr(10)
           || replace(coalesce(x.t, ''), '<|', '< |') || '<|im_end|>' || chr(10) for x in turns], '') AS rendered
FROM k""",
}
