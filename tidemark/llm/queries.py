"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, licenses, pii, quality, secrets, warc
from tidemark.llm._spark import table
from tidemark.llm.conversations import repair
from tidemark.llm.cross_polytope import near_vectors
from tidemark.llm.decontaminate import leaks
from tidemark.llm.divergence import divergence
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.url_filter import url_filter

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
PREDICT_AT = 0.3


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.fit(docs)), pii.KINDS)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), RULES)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(secrets.find(docs, secrets.fit(docs)), secrets.KINDS[:3])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.round_trip(table(spark, sf_dir, "pages"))
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), word_bpe())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f) and k[2].isdigit()}


WORDS = r"[^\x20\x09-\x0D]+"
ORACLES = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM d WHERE len(w) >= 35),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, unnest(range(p, p + 35)) AS p FROM win JOIN rep USING (h)),
gone AS (SELECT doc_id, list_distinct(list(p)) AS ps FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op3_url_filter": """
WITH u AS (SELECT page_id, CASE WHEN coalesce(position('://' IN url), 0) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, '.' || host AS dotted FROM h),
j AS (SELECT page_id, host, path, CASE
  WHEN dotted LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN dotted LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN dotted LIKE '%.com' AND path LIKE '/%' THEN 'com/'
  WHEN dotted LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
  WHEN dotted LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/' END AS rule FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM j""",
    "op5_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
top AS (SELECT h, max(page_id) AS newest FROM p GROUP BY h),
u AS (SELECT *, CASE WHEN coalesce(position('://' IN url), 0) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM p JOIN top USING (h)),
k AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((strpos('0123456789abcdef', substr(h, 1 + 5 * i // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 + 5 * i // 4, 1)) - 1) >> (3 - (5 * i) % 4)) & 31), 1)), '') AS payload_digest,
  CASE WHEN newest = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(newest, page_id) AS refers_to,
  array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path || coalesce(regexp_extract(url, '[?][^#]*'), '') AS urlkey,
  strftime(to_timestamp(1704067200 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM k""",
    "op6_decontaminate": rf"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS w FROM benchmark),
bs AS (SELECT item_id, len(w) AS n, array_to_string(w[i:i + 4], ' ') AS s FROM b, unnest(range(1, len(w) - 3)) AS r(i) WHERE len(w) >= 5),
item AS (SELECT item_id, n, s, count(*) AS c FROM bs GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS w FROM documents),
ds AS (SELECT doc_id, len(w) AS m, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS r(i) WHERE len(w) >= 5),
hit AS (SELECT doc_id, item_id, m, n, c, s, p FROM ds JOIN item USING (s)),
win AS (SELECT doc_id, item_id, m, n, c, s, start FROM hit, unnest(CASE WHEN m < n THEN [0] ELSE range(greatest(0, p - n + 5), least(p, m - n) + 1) END) AS r(start)),
per AS (SELECT doc_id, item_id, least(m, n) AS m, n, start, s, least(count(*), any_value(c)) AS k FROM win GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, sum(k)::DOUBLE / (m + n - 8 - sum(k)) AS similarity FROM per GROUP BY doc_id, item_id, m, n, start)
SELECT doc_id, item_id, count(*)::BIGINT AS n_windows, min_by(start, (-similarity, start))::BIGINT AS start, round(max(similarity), 6) AS similarity FROM sim WHERE similarity >= 0.8 - 1e-12 GROUP BY doc_id, item_id""",
}


#: Components by labels that spread along links until they stay.
SPREAD = """
reach AS (SELECT DISTINCT a AS id, a AS low FROM link UNION SELECT link.b, reach.low FROM reach JOIN link ON link.a = reach.id WHERE reach.low < link.b),
low AS (SELECT id, min(low) AS low FROM reach GROUP BY id)"""
ORACLES["op7_cross_polytope"] = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT *, sqrt(list_dot_product(x, x)) AS size, len(x) AS d FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
  AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
link AS (SELECT a.id AS a, b.id AS b FROM good a JOIN good b ON a.label = b.label AND a.d = b.d AND a.id <> b.id WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.93),
{SPREAD},
n AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, least(id, coalesce(low, id)) AS component_id, id = least(id, coalesce(low, id)) AS kept FROM v LEFT JOIN n USING (id) LEFT JOIN low USING (id)"""
ORACLES["op8_minhash"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
met AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
{SPREAD}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(id, coalesce(low, id)) AS component_id, id = least(id, coalesce(low, id)) AS kept FROM w LEFT JOIN n USING (id) LEFT JOIN low USING (id)"""


def _add(weight: str, cost: str, label: str) -> str:
    """A weight is nine digits of cost and the edits so far, so the least string is the least weight; null is no path."""
    return f"(lpad(CAST(CAST(substr({weight}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({weight}, 10) || '{label}')"


_ANY = "least(s0, s1, s3)"
ORACLES["op11_conversation_repair"] = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
z AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, list_reduce(list_concat([xor(c, b) & 255], [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))) % 20 AS k FROM o),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM z WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, role[1] AS c FROM d),
f AS (SELECT *, lag(c) OVER w AS before, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 't' ELSE '' END AS fault FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
c AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
r AS (SELECT conv_id, 0 AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, {_add("'000000000'", "2", "I")} AS s2, {_add("'000000000'", "4", "II")} AS s3 FROM c
UNION ALL SELECT conv_id, i, s0, s1, least(s2, {_add("s0", "2", "I")}, {_add("s1", "2", "I")}, {_add("s3", "2", "I")}), least(s3, {_add("s2", "2", "I")}, {_add("s0", "4", "II")}, {_add("s1", "4", "II")}) FROM (
  SELECT r.conv_id, r.i + 1 AS i, {_add("s0", "3", "D")} AS s0,
    least({_add("s1", "3", "D")}, CASE WHEN keep AND c = 's' THEN {_add("s0", "more", "K")} END) AS s1,
    least({_add("s2", "3", "D")}, CASE WHEN keep AND c = 'u' THEN {_add(_ANY, "more", "K")} END, CASE WHEN keep THEN {_add(_ANY, "2 + more", "R")} END) AS s2,
    least({_add("s3", "3", "D")}, CASE WHEN keep AND c = 'a' THEN {_add("s2", "more", "K")} END, CASE WHEN keep THEN {_add("s2", "2 + more", "R")} END) AS s3
  FROM r JOIN (SELECT conv_id, i, c, fault NOT IN ('b', 'd') AS keep, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS more FROM f) x ON x.conv_id = r.conv_id AND x.i = r.i + 1)),
e AS (SELECT c.*, least(s0, s3) AS w FROM r JOIN c ON c.conv_id = r.conv_id AND c.n = r.i),
a AS (SELECT conv_id, substr(w, 10) AS audit, k, substr(w, 9 + k, 1) AS edit, k - len(replace(substr(w, 10, k), 'I', 'II')) + k AS i, len(replace(substr(w, 10, k), 'D', '')) AS place FROM e, unnest(range(1, len(w) - 8)) AS u(k)),
p AS (SELECT a.*, f.role, f.text, max(CASE WHEN place = 1 AND edit = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.conv_id) AS s FROM a LEFT JOIN f ON f.conv_id = a.conv_id AND f.i = a.i WHERE edit <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS body FROM p GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(CAST(substr(w, 1, 9) AS INTEGER), 0) AS BIGINT) AS cost, coalesce(substr(w, 10), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN e USING (conv_id) LEFT JOIN t USING (conv_id)"""
ORACLES["op13_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT l.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) l LEFT JOIN k USING (lang) GROUP BY l.lang),
n AS (SELECT g.lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, source),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (total + v) AS BIGINT) AS p FROM n JOIN k ON k.lang = n.lang JOIN v ON v.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
lt AS (SELECT lang, sum(total) AS total FROM n GROUP BY lang),
q AS (SELECT x.lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (x.n + 1) // (total + v) AS BIGINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) x JOIN lt USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
bare AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source JOIN v ON v.lang = a.lang WHERE v = 0),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pair UNION ALL FROM bare UNION ALL FROM term) QUALIFY part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
