"""The queries of the ten operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, chat, decontaminate, langid, licenses, minhash, quality, secrets, sharding, urlfilter
from loomtext.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', '{control}'), (-1L, 1L, 'assistant', '{control}') as t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").union(extra)
    return chat.read_back(chat.format_conversations(turns))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    dealt = sharding.shuffle_into_shards(rows, shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    texts = langid.sample(docs.filter(~held))
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), texts, ("doc_id", "held_out"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85, bands=48, rows=8)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch day and come without lists; both follow from ids and hosts by fixed rules."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(730)).cast("int")))
    url = F.col("url")
    known = captures.select(urlfilter.host(url).alias("h"), urlfilter.segment(url).alias("s")).filter("h <> ''").distinct()
    digits = {name: F.conv(F.substring(F.md5("key"), at, 4), 16, 10).cast("long") for name, at in zip("abcd", (1, 5, 9, 13))}
    drawn = known.select(F.explode(urlfilter.keys(F.col("h"), F.col("s"))).alias("key")).distinct().withColumns(digits)
    a, b, c, d = (F.col(x) for x in "abcd")
    spam, trusted = a % 4 == 0, d % 5 == 0
    drafts = (
        ("spam", "deny", spam, b % 600, "add"),
        ("spam", "deny", spam & (c % 3 != 0), b % 600 + c % 200, "remove"),
        ("spam", "deny", spam & (c % 9 == 1), b % 600 + c % 200 + 30, "add"),
        ("trusted", "allow", trusted, c % 500, "add"),
        ("trusted", "allow", trusted & (a % 2 == 0), c % 500 + b % 300, "remove"),
    )
    first = F.lit("2022-07-01").cast("date")
    each = F.array(*(F.struct(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), pick.alias("pick"), F.date_add(first, at.cast("int")).alias("day"), F.lit(action).alias("action")) for name, verdict, pick, at, action in drafts))
    events = drawn.select("key", F.explode(each).alias("e")).select("key", "e.*").filter("pick").drop("pick")
    return urlfilter.filter_captures(captures, events)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_format, op2_sharding, op3_secret_scan, op4_language_id, op5_bpe, op6_minhash_near_dedup, op7_decontaminate, op8_url_filter, op9_quality_rules, op10_license_scan)}

# -- SQL for DuckDB, where SQL can say the same --------------------------------

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links of all pairs of texts by counting common shingles; components by reachability over documents.
_LINKS = rf"""w AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT doc_id, text FROM documents)),
ws AS (SELECT k, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM w),
s AS (SELECT DISTINCT k, doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM ws),
n AS (SELECT k, doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT x.k AS a, y.k AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 100 * common >= 85 * (x.n + y.n - common))"""
_NEAR_DEDUP = rf"""WITH RECURSIVE {_LINKS},
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(coalesce(m, d.doc_id) = d.doc_id, true) AS kept
FROM documents d LEFT JOIN w ON w.doc_id IS NOT DISTINCT FROM d.doc_id AND w.text IS NOT DISTINCT FROM d.text LEFT JOIN n ON n.k = w.k LEFT JOIN c ON c.a = d.doc_id"""

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)', 1))"
_SEGMENT = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1)"


def _event(name: str, verdict: str, pick: str, at: str, action: str) -> str:
    return f"SELECT '{name}' AS list, '{verdict}' AS verdict, key, DATE '2022-07-01' + CAST({at} AS INT) AS day, '{action}' AS action FROM drawn WHERE {pick}"


_URL_FILTER = f"""WITH captures AS (SELECT page_id, url, DATE '2023-01-01' + CAST((page_id * 7919) % 730 AS INT) AS fetched FROM pages),
labelled AS (SELECT DISTINCT url, CASE WHEN regexp_matches({_HOST}, '^(\\[.*|[0-9]+(\\.[0-9]+){{3}})$') THEN [{_HOST}] ELSE string_split({_HOST}, '.') END AS ls, {_SEGMENT} AS seg FROM captures WHERE {_HOST} <> ''),
domains AS (SELECT url, seg, unnest(list_transform(range(1, greatest(len(ls) - 1, 1) + 1), lambda i: array_to_string(ls[i:], '.'))) AS d FROM labelled),
asked AS (SELECT url, d AS key FROM domains UNION ALL SELECT url, d || '/' || seg FROM domains WHERE seg <> ''),
drawn AS (SELECT key, {', '.join(f"CAST('0x' || substr(md5(key), {at}, 4) AS BIGINT) AS {c}" for c, at in zip('abcd', (1, 5, 9, 13)))} FROM (SELECT DISTINCT key FROM asked)),
events AS ({' UNION ALL '.join((
    _event('spam', 'deny', 'a % 4 = 0', 'b % 600', 'add'),
    _event('spam', 'deny', 'a % 4 = 0 AND c % 3 <> 0', 'b % 600 + c % 200', 'remove'),
    _event('spam', 'deny', 'a % 4 = 0 AND c % 9 = 1', 'b % 600 + c % 200 + 30', 'add'),
    _event('trusted', 'allow', 'd % 5 = 0', 'c % 500', 'add'),
    _event('trusted', 'allow', 'd % 5 = 0 AND a % 2 = 0', 'c % 500 + b % 300', 'remove'),
))}),
days AS (SELECT list, verdict, key, day, bool_or(action = 'add') AS active FROM events GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY list, verdict, key ORDER BY day) AS until FROM days),
met AS (SELECT page_id, s.* FROM captures JOIN asked USING (url) JOIN spans s USING (key) WHERE s.active AND s.day <= fetched AND (s.until IS NULL OR fetched < s.until)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, verdict = 'deny' DESC, list DESC, key DESC) AS r, count(*) OVER (PARTITION BY page_id) AS n FROM met)
SELECT c.*, CASE WHEN {_HOST} = '' THEN 'invalid' ELSE coalesce(r.verdict, 'allow') END AS verdict, r.key AS matched_key, r.list AS matched_list, CAST(coalesce(n, 0) AS BIGINT) AS n_active
FROM captures c LEFT JOIN ranked r ON r.page_id = c.page_id AND r.r = 1"""

_PLACE = lambda words: " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(words.split()))
_PLACES = ", ".join(f"list_filter(range(1, len(ws) + 1), lambda i: coalesce({_PLACE(p)}, false)) AS p{k}" for k, (p, _) in enumerate(licenses.PHRASES))
_ALL_PLACES = "list_concat(list_concat(p0, p1), list_concat(p2, p3))"
_BASE = "list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(licenses.PHRASES)) + "], lambda x: x IS NOT NULL)"
_TOKENS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEMPLATES = ", ".join(f"('{label}', [{', '.join(repr(w) for w in ws)}], {licenses._need(len(ws))})" for label, ws in licenses.template_words())

#: Every block against every template, by counting.
_LICENSES = f"""WITH t AS (SELECT * FROM (VALUES {_TEMPLATES}) t(label, tw, need)),
w AS (SELECT doc_id, {_LOWER} AS low, {_TOKENS.format(_LOWER)} AS ws FROM documents),
b AS (SELECT doc_id, unnest(list_concat(string_split(low, chr(10)), string_split_regex(low, '\n[ \t\r]*\n'))) AS block FROM w),
h AS (SELECT doc_id, label, max(k / CAST(len(tw) AS DOUBLE)) AS score FROM (SELECT doc_id, label, tw, need, len(list_intersect(list_distinct({_TOKENS.format('block')}), tw)) AS k FROM b, t) WHERE k >= need GROUP BY ALL),
m AS (SELECT doc_id, list(label) AS more, max(score) AS best FROM h GROUP BY doc_id),
p AS (SELECT doc_id, len(ws) AS n, {_PLACES} FROM w)
SELECT p.doc_id, CAST(n AS BIGINT) AS n_words, CAST(len({_ALL_PLACES}) AS BIGINT) AS n_base, list_min({_ALL_PLACES}) - 1 AS first_word, list_max({_ALL_PLACES}) - 1 AS last_word,
array_to_string(list_sort({_BASE}), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat({_BASE}, coalesce(more, [])))), ',') AS labels,
CASE WHEN len({_ALL_PLACES}) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM p LEFT JOIN m USING (doc_id)"""

ORACLES: dict[str, str] = {
    "op6_minhash_near_dedup": _NEAR_DEDUP,
    "op8_url_filter": _URL_FILTER,
    "op10_license_scan": _LICENSES,
}
