"""The queries of this folder's operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, licenses, packing, quality, sharding, simhash, urls, warc
from .common import table

#: Fixed values of the url query: what is blocked and allowed by host and path.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"), "matches")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.train(docs.where(part != 1))
    return langid.predict(docs, model).select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [urls.host_rule(action, where) for action, where in URL_RULES]
    judged = urls.judge(table(spark, sf_dir, "pages"), [*rules, *urls.PATTERN_RULES])
    return judged.select("page_id", "host", "path", F.when(F.col("level") == 1, F.col("rule")).alias("rule"), "verdict")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", F.octet_length("block").cast("long").alias("content_length"), "block_digest", "source_digest", "n_links", F.crc32("record").alias("record_crc32"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


QUERIES = {f.__name__: f for f in (op1_sharding, op2_licenses, op3_language_id, op4_url_filter, op5_simhash, op6_warc, op7_packing, op8_quality, op9_chat, op10_decontamination)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VALUES = ", ".join(f"('{w}', '{w.partition('/')[0]}', '/{w.partition('/')[2]}', '{a}')" for a, w in URL_RULES)
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_UPPER, _LOWER)

_TEXT_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"


def _divergence(name: str, counts: str, references: str) -> str:
    """CTEs that end in ``name`` (rid, ref, j): the Jensen-Shannon divergence of each
    row's ``counts`` (rid, bin, n) from each of ``references`` (ref, bin, n)."""
    return f"""{name}_p AS (SELECT rid, bin, n / sum(n) OVER (PARTITION BY rid) AS p FROM {counts}),
{name}_q AS (SELECT ref, bin, n / sum(n) OVER (PARTITION BY ref) AS q FROM {references}),
{name}_b AS (SELECT rid, ref, p, q, (p + q) / 2 AS m FROM {name}_p JOIN {name}_q USING (bin)),
{name} AS (SELECT rid, ref, greatest(0, sum((CASE WHEN p > 0 THEN 0.5 * p * log2(p / m) ELSE 0 END) + (CASE WHEN q > 0 THEN 0.5 * q * log2(q / m) ELSE 0 END))) AS j FROM {name}_b WHERE m > 0 GROUP BY rid, ref)"""


def _compared(step: str, good: str) -> str:
    """CTEs that end in ``step`` (rid, near): whether a row is near to the reference that the rows of ``good`` give."""
    return f"""{step}_wr AS (SELECT tongue AS ref, bin, sum(n) AS n FROM word_bins JOIN {good} USING (rid) JOIN base USING (rid) WHERE tongue <> '' GROUP BY 1, 2),
{step}_cr AS (SELECT tongue AS ref, bin, sum(n) AS n FROM class_bins JOIN {good} USING (rid) JOIN base USING (rid) WHERE tongue <> '' GROUP BY 1, 2),
{_divergence(f"{step}_w", "word_bins", f"{step}_wr")},
{_divergence(f"{step}_c", "class_bins", f"{step}_cr")},
{step}_own AS (SELECT rid, coalesce(max(CASE WHEN ref = tongue THEN ref END), arg_min(ref, j)) AS ref FROM (SELECT * FROM {step}_w ORDER BY ref) JOIN base USING (rid) GROUP BY rid),
{step}_free AS (SELECT ref, count(*) - 1 AS f FROM (SELECT ref, n, sum(n) OVER (PARTITION BY ref) AS total FROM {step}_wr) WHERE n >= {quality.FILLED} * total GROUP BY ref),
{step} AS (SELECT rid, classes + beyond <= 0.25 * 0.25 AS near FROM (SELECT rid, coalesce(c.j, 0) AS classes, greatest(coalesce(w.j - f / (8 * ln(2) * n_words), 0), 0) AS beyond
  FROM base LEFT JOIN {step}_own USING (rid) LEFT JOIN {step}_w w USING (rid, ref) LEFT JOIN {step}_c c USING (rid, ref) LEFT JOIN {step}_free USING (ref)))"""


ORACLE_SQL: dict[str, str] = {
    # The checksum's table follows from its polynomial.
    "op1_sharding": f"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 + 1 AS size, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
s AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]))) AS crc FROM b, crc),
o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, crc, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM s),
p AS (SELECT *, CAST(before * 8 // total AS INTEGER) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
    "op4_url_filter": f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rule, h, prefix, action) AS (VALUES {_VALUES}),
j AS (SELECT page_id, host, path, (SELECT max_by(rule, length(rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, prefix)) AS rule FROM p)
SELECT page_id, host, path, j.rule AS rule, coalesce(r.action, CASE WHEN regexp_matches(host, '(^|[^a-z0-9])({'|'.join(urls.BLOCKED_HOST_WORDS)})([^a-z0-9]|$)') OR list_has_any(string_split(path, '/')[2:], {list(urls.BLOCKED_SEGMENTS)}) OR regexp_matches(path, '/[^/]*[.]({'|'.join(urls.BLOCKED_ENDINGS)})$') THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN rules r ON j.rule = r.rule""",
    "op8_quality": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS tongue, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_TEXT_WORDS} AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS rows_ FROM d),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
base AS (SELECT rid, doc_id, tongue, t, CAST(len(words) AS BIGINT) AS n_words, CAST(len(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(rows_) - len(list_distinct(rows_)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed FROM w LEFT JOIN cov USING (rid)),
common AS (SELECT DISTINCT word FROM (SELECT word, row_number() OVER (PARTITION BY tongue ORDER BY n DESC, word) AS k FROM (SELECT tongue, word, count(*) AS n FROM (SELECT tongue, unnest(list_distinct(words)) AS word FROM w WHERE tongue <> '') GROUP BY 1, 2 HAVING count(*) > 1)) WHERE k <= {quality.COMMON_PER_LANG}),
marked AS (SELECT rid, CASE WHEN c.word IS NULL THEN {quality.WORD_BINS} ELSE (unicode(s.word) * 7 + unicode(s.word[-1]) * 13 + length(s.word) * 17) % {quality.WORD_BINS} END AS bin FROM (SELECT rid, unnest(words) AS word FROM w) s LEFT JOIN common c ON s.word = c.word),
word_bins AS (SELECT rid, bin, coalesce(n, 0) AS n FROM (SELECT rid, bin FROM base, range({quality.N_COMMON}) r(bin) WHERE n_words > 0) LEFT JOIN (SELECT rid, bin, count(*) AS n FROM marked GROUP BY 1, 2) USING (rid, bin)),
cls AS (SELECT rid, len(t) AS chars, word_chars, n_symbols AS sym, len(regexp_extract_all(t, '\\p{{Lu}}')) AS up, len(regexp_extract_all(t, '[0-9]')) AS dig, len(regexp_extract_all(t, '[.,;:!?''"()-]')) AS stop FROM base),
class_bins AS (SELECT rid, unnest(range(6)) AS bin, unnest([chars - word_chars, up, dig, stop, sym, word_chars - up - dig - stop - sym]) AS n FROM cls WHERE chars > 0),
good AS (SELECT rid FROM base WHERE NOT base_failed),
{_compared("once", "good")},
best AS (SELECT rid FROM good JOIN once USING (rid) WHERE near),
{_compared("twice", "best")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND near AS kept FROM base JOIN twice USING (rid)""",
    "op9_chat": f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS raw FROM conversations),
e AS (SELECT *, regexp_replace(raw, '<(\\\\*)[|]im_', '<\\\\\\1|im_', 'g') AS text, regexp_replace(regexp_replace(speaker, '<(\\\\*)[|]im_', '<\\\\\\1|im_', 'g'), '[\\x00-\\x1F]+', ' ', 'g') AS shown FROM r),
w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
s AS (SELECT e.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role FROM e JOIN w ON e.conv_id IS NOT DISTINCT FROM w.conv_id),
h AS (SELECT *, '{chat.OPEN}' || role || CASE WHEN role = 'user' THEN ' name=' || shown ELSE '' END || chr(10) AS head FROM s),
g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(raw)) - 1 AS position,
  CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(raw) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM g)
SELECT conv_id, perspective, position, turn, role, CASE WHEN role = 'user' THEN speaker END AS name, segment, char_start, char_start + length(segment) AS char_end,
  CASE WHEN role = 'assistant' THEN char_start + length(head) END AS mask_start, CASE WHEN role = 'assistant' THEN char_start + length(segment) - 1 END AS mask_end FROM o""",
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
k AS (SELECT DISTINCT item, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS key FROM (SELECT item, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: {{'i': i, 'key': array_to_string(w[i:i + m - 1], ' ')}})) AS o FROM d, (SELECT DISTINCT m FROM k) WHERE len(w) >= m),
h AS (SELECT doc_id, x.m AS m, o.i AS i, item FROM x JOIN k ON x.m = k.m AND o.key = k.key),
n AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS spot FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
