"""Text, hashes, fingerprints, dedupe and leakage over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieve.functions import hashing as H
from sieve.functions import text as X
from sieve.operators import dedupe, fingerprint, leakage, mime
from sieve.operators import features as FE
from sieve.queries.base import MESSAGES_SQL, messages, query, table

NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), 'https?://\S+', ' <url> ', 'g'), '\b\d{{2,}}\b', ' <num> ', 'g'), '\s+', ' ', 'g'))"
TOKENS = r"regexp_extract_all({c}, '[\p{{L}}\p{{Nd}}][\p{{L}}\p{{Nd}}_\-.@]{{1,48}}')"
# UTF-16 units of a string
UNITS = "flatten(list_transform(string_split({c}, ''), lambda x: CASE WHEN unicode(x) > 65535 THEN [55296 + ((unicode(x) - 65536) >> 10), 56320 + ((unicode(x) - 65536) & 1023)] ELSE [unicode(x)] END))"
FNV32 = "list_reduce(list_transform(" + UNITS + ", lambda x: x::BIGINT), lambda h, u: ((xor(h, u) * 16777619) & 4294967295), 2166136261::BIGINT)"
FNV64 = "list_reduce(list_transform(" + UNITS + ", lambda x: x::HUGEINT), lambda h, u: (xor(h, u) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT)"
SIGNED = "(CASE WHEN {h} >= 9223372036854775808 THEN {h} - 18446744073709551616 ELSE {h} END)::BIGINT"


@query(
    "exact_fingerprint",
    f"SELECT doc_id, sha256({NORM.format(c='concat(source, chr(10), lang, chr(10), text)')}) AS fingerprint FROM documents",
)
def exact_fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", fingerprint.exact_fingerprint(F.col("source"), F.col("lang"), F.col("text")).alias("fingerprint"))


DISTINCT_TOKENS = f"tokens AS (SELECT DISTINCT unnest({TOKENS.format(c='lower(text)')}) AS token FROM documents)"


@query("fnv32_token_hash", f"WITH {DISTINCT_TOKENS} SELECT token, {FNV32.format(c='token')} AS h FROM tokens")
def fnv32_token_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token")).distinct()
    return d.select("token", H.fnv32(F.col("token")).alias("h"))


@query("fnv64_token_hash", f"WITH {DISTINCT_TOKENS}, h AS (SELECT token, {FNV64.format(c='token')} AS h FROM tokens) SELECT token, {SIGNED.format(h='h')} AS h FROM h")
def fnv64_token_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token")).distinct()
    return d.select("token", H.fnv64(F.col("token")).alias("h"))


def simhash_sql(name: str, rows: str = "documents", key: str = "doc_id", most: int = 8000, weight: str = "n") -> str:
    """A common table expression ``name`` (key, simhash) for a table with a text; ``weight`` is a token's votes by its count n."""
    return f"""
{name}_toks AS (SELECT {key}, unnest(list_slice({TOKENS.format(c=NORM.format(c='text'))}, 1, {most})) AS token FROM {rows}),
{name}_counted AS (SELECT {key}, token, {weight} AS n FROM (SELECT {key}, token, count(*) AS n FROM {name}_toks GROUP BY ALL)),
{name}_hashes AS (SELECT token, {FNV64.format(c='token')} AS h FROM (SELECT DISTINCT token FROM {name}_counted)),
{name}_votes AS (
  SELECT {key}, b, sum(CASE WHEN (h // (2::HUGEINT ** b)::HUGEINT) % 2 = 1 THEN n ELSE -n END) AS v
  FROM {name}_counted JOIN {name}_hashes USING (token), range(64) r(b) GROUP BY ALL),
{name}_bits AS (SELECT {key}, sum(CASE WHEN v >= 0 THEN (2::HUGEINT ** b)::HUGEINT ELSE 0 END)::HUGEINT AS h FROM {name}_votes GROUP BY {key}),
{name} AS (SELECT d.{key}, coalesce({SIGNED.format(h='h')}, 0)::BIGINT AS simhash FROM {rows} d LEFT JOIN {name}_bits USING ({key}))"""


SIMHASH = simhash_sql("simhashes")


@query("simhash64", f"WITH {SIMHASH} SELECT doc_id, simhash FROM simhashes")
def simhash64(spark, sf_dir):
    return fingerprint.near_fingerprint(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("simhash64_weighted", f"WITH {simhash_sql('simhashes', most=600, weight='least(n, 4)')} SELECT doc_id, simhash FROM simhashes")
def simhash64_weighted(spark, sf_dir):
    return fingerprint.near_fingerprint(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), weighted=True, most=600)


@query(
    "near_duplicate_pairs",
    f"""WITH {SIMHASH}, firsts AS (SELECT simhash AS h, min(doc_id) AS a FROM simhashes GROUP BY simhash)
SELECT a, doc_id AS b, 0 AS distance FROM simhashes JOIN firsts ON simhash = h WHERE doc_id <> a UNION ALL
SELECT least(x.a, y.a), greatest(x.a, y.a), bit_count(xor(x.h, y.h))::INT FROM firsts x JOIN firsts y ON x.h < y.h AND bit_count(xor(x.h, y.h)) <= 2""",
)
def near_duplicate_pairs(spark, sf_dir):
    return fingerprint.near_copies(simhash64(spark, sf_dir), "doc_id", 2)


KEYED = f"keyed AS (SELECT doc_id, y, sha256({NORM.format(c='text')}) AS key FROM messages)"


def _keyed(spark, sf_dir):
    return messages(spark, sf_dir).select("doc_id", "y", fingerprint.exact_fingerprint(F.col("text")).alias("key"))


@query("dedupe_keep_first", f"WITH {MESSAGES_SQL}, {KEYED} SELECT doc_id, y, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) k FROM keyed) WHERE k = 1")
def dedupe_keep_first(spark, sf_dir):
    return dedupe.keep_first(_keyed(spark, sf_dir), "key", "doc_id").select("doc_id", "y", "key")


@query("dedupe_drop_all", f"WITH {MESSAGES_SQL}, {KEYED} SELECT doc_id, y, key FROM (SELECT *, count(*) OVER (PARTITION BY key) n FROM keyed) WHERE n = 1")
def dedupe_drop_all(spark, sf_dir):
    return dedupe.drop_all(_keyed(spark, sf_dir), "key").select("doc_id", "y", "key")


@query(
    "dedupe_drop_conflicts",
    f"WITH {MESSAGES_SQL}, {KEYED} SELECT doc_id, y, key FROM (SELECT *, min(y) OVER (PARTITION BY key) a, max(y) OVER (PARTITION BY key) b, row_number() OVER (PARTITION BY key ORDER BY doc_id) k FROM keyed) WHERE a = b AND k = 1",
)
def dedupe_drop_conflicts(spark, sf_dir):
    return dedupe.drop_conflicts(_keyed(spark, sf_dir), "key", "doc_id").select("doc_id", "y", "key")


@query(
    "dedupe_report",
    f"""WITH {MESSAGES_SQL}, {KEYED}, k AS (SELECT key, count(*) n, count(DISTINCT y) c FROM keyed GROUP BY key)
SELECT sum(n)::BIGINT AS rows, count(*) AS keys, sum(CASE WHEN c > 1 THEN n ELSE 0 END)::BIGINT AS conflict_rows, sum(CASE WHEN c > 1 THEN 0 ELSE n - 1 END)::BIGINT AS repeated_rows FROM k""",
)
def dedupe_report(spark, sf_dir):
    return dedupe.removal_report(_keyed(spark, sf_dir), "key")


CLEAN = r"trim(regexp_replace(lower(coalesce({c}, '')), '\s+', ' ', 'g'))"


@query(
    "content_keys",
    f"WITH {MESSAGES_SQL} SELECT doc_id, sha256(concat_ws(chr(10), {CLEAN.format(c='source')}, {CLEAN.format(c='text')})) AS content, sha256(concat_ws(chr(10), y::VARCHAR, {CLEAN.format(c='source')}, {CLEAN.format(c='text')})) AS labelled FROM messages",
)
def content_keys(spark, sf_dir):
    m = messages(spark, sf_dir)
    fields = (F.col("source"), F.col("text"))
    return m.select("doc_id", fingerprint.content_key(*fields).alias("content"), fingerprint.content_key(*fields, label=F.col("y")).alias("labelled"))


@query("normalised_identity")
def normalised_identity(spark, sf_dir):
    c = X.collapse(X.casefold(X.nfkc(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(c, 256).alias("identity"))


def leaks_sql(rows: str, index: str) -> str:
    """One row of counts from tables of (key, e, simhash)."""
    near = f"EXISTS (SELECT 1 FROM (SELECT DISTINCT simhash FROM {index}) i WHERE bit_count(xor(i.simhash, r.simhash)) <= 2)"
    return f"""marks AS (SELECT r.simhash, r.e IN (SELECT e FROM {index}) AS exact FROM {rows} r),
near AS (SELECT simhash, {near} AS near FROM (SELECT DISTINCT simhash FROM {rows}) r)
SELECT count(*) AS rows, count(*) FILTER (exact) AS exact_leaks, count(*) FILTER (NOT exact AND near) AS near_leaks FROM marks JOIN near USING (simhash)"""


def _marked(rows, key):
    """Rows with exact and near fingerprints of their texts."""
    return rows.select(key, fingerprint.exact_fingerprint(F.col("text")).alias("exact"), fingerprint.simhash(X.tokens(X.fingerprint_text(F.col("text")), most=8000)).alias("simhash"))


MARKED = f"marked AS (SELECT d.doc_id, sha256({NORM.format(c='text')}) AS e, simhash, substr(md5(d.doc_id::VARCHAR), 1, 1) < '8' AS test FROM documents d JOIN simhashes USING (doc_id))"


@query("train_test_leakage", f"WITH {SIMHASH}, {MARKED}, train AS (SELECT * FROM marked WHERE NOT test), tests AS (SELECT * FROM marked WHERE test), {leaks_sql('train', 'tests')}")
def train_test_leakage(spark, sf_dir):
    """Every document is on one side of a split by hash."""
    d = _marked(table(spark, sf_dir, "documents"), "doc_id").withColumn("test", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8")
    return leakage.leak_counts(d.filter("NOT test"), d.filter("test"), "doc_id")


@query(
    "leakage_against_benchmark",
    f"""WITH {SIMHASH}, {simhash_sql('items', 'benchmark', 'item_id')}, docs AS (SELECT doc_id, sha256({NORM.format(c='text')}) AS e, simhash FROM documents JOIN simhashes USING (doc_id)),
bench AS (SELECT sha256({NORM.format(c='text')}) AS e, simhash FROM benchmark JOIN items USING (item_id)), {leaks_sql('docs', 'bench')}""",
)
def leakage_against_benchmark(spark, sf_dir):
    return leakage.leak_counts(_marked(table(spark, sf_dir, "documents"), "doc_id"), _marked(table(spark, sf_dir, "benchmark"), "item_id"), "doc_id")


@query(
    "prior_corpus_anti_join",
    f"WITH d AS (SELECT doc_id, source, sha256({NORM.format(c='text')}) AS e FROM documents) SELECT doc_id, source FROM d WHERE source <> 'src0' AND e NOT IN (SELECT e FROM d WHERE source = 'src0')",
)
def prior_corpus_anti_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("e", fingerprint.exact_fingerprint(F.col("text")))
    return dedupe.not_in(d.filter("source <> 'src0'"), d.filter("source = 'src0'"), "e").select("doc_id", "source")


@query(
    "split_overlap",
    f"WITH d AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, sha256({NORM.format(c='text')}) AS e FROM documents) SELECT e, count(DISTINCT split) AS splits FROM d GROUP BY e HAVING count(DISTINCT split) > 1",
)
def split_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    split = F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train")
    return dedupe.overlapping_keys(d.select(split.alias("split"), fingerprint.exact_fingerprint(F.col("text")).alias("e")), "e")


@query("hamming_distance", "SELECT l_orderkey, l_linenumber, l_partkey, bit_count(xor(l_orderkey * 7919, l_partkey * 104729))::INT AS distance FROM lineitem")
def hamming_distance(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", H.hamming(F.col("l_orderkey") * 7919, F.col("l_partkey") * 104729).alias("distance"))


STRIP = r"regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"


@query("html_strip_tags", f"SELECT page_id, {STRIP} AS text FROM pages")
def html_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query("html_to_text")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query(
    "normalise_whitespace",
    r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\t ]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents",
)
def normalise_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalise_lines(F.col("text")).alias("text"))


@query("url_count", r"SELECT page_id, len(regexp_extract_all(html, '(?i)https?://[^\s<>''" + '"' + r"]+'))::INT AS urls, len(regexp_extract_all(url, '(?i)https?://[^\s<>''" + '"' + r"]+'))::INT AS own FROM pages")
def url_count(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.url_count(F.col("html")).alias("urls"), X.url_count(F.col("url")).alias("own"))


@query("url_hosts", r"SELECT page_id, lower(regexp_extract(regexp_replace(url, '[.,);\]>]+$', ''), '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM pages")
def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.host_of(F.col("url")).alias("host"))


@query("hosts_in_text", r"SELECT page_id, list_transform(list_slice(regexp_extract_all(url || ' ' || html, '(?i)https?://([^/\s:]+)', 1), 1, 25), lambda x: lower(x)) AS hosts FROM pages")
def hosts_in_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", X.url_hosts(F.concat_ws(" ", "url", "html")).alias("hosts"))


@query("address_domains", r"SELECT doc_id, lower(regexp_extract(text, '@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1)) AS domain FROM documents")
def address_domains(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.address_domain(F.col("text")).alias("domain"))


@query(
    "normalise_category",
    r"SELECT p_partkey, CASE WHEN trim(p_type) = '' THEN 'none' ELSE trim(regexp_replace(lower(p_type), '[^\p{L}\p{Nd}]', '_', 'g'), '_') END AS category, substr(regexp_replace(regexp_replace(lower(p_brand), '\d+', '#', 'g'), '[^a-zа-яё0-9_.:@#-]+', '_', 'g'), 1, 80) AS option FROM part",
)
def normalise_category(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.normalise_category(F.col("p_type")).alias("category"), X.normalise_option(F.col("p_brand")).alias("option"))


@query(
    "normalise_subject",
    r"SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+', ' urltoken ', 'g'), '\b[0-9a-f]{8,}\b', ' hextoken ', 'g'), '\d+', ' num ', 'g'), '[^\p{L}\p{N}\s]+', ' ', 'g'), '\s+', ' ', 'g')), 1, 240) AS subject FROM documents",
)
def normalise_subject(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalise_subject(F.col("text")).alias("subject"))


@query("stable_clean", r"SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '[\r\n\x00]', ' ', 'g'), '\s+', ' ', 'g')), 1, 1000) AS text FROM documents")
def stable_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.stable_clean(F.col("text")).alias("text"))


@query(
    "mask_entities",
    r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(?:https?://|www\.)[^\s<>''" + '"' + r"]+', ' urltoken ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', ' emailtoken ', 'g'), '\d{3,}', ' numtoken ', 'g'), '\s+', ' ', 'g')) AS text FROM documents",
)
def mask_entities(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.mask_entities(F.col("text")).alias("text"))


@query("head_tail_windows", "SELECT doc_id, substr(text, 1, 2400) AS head, right(text, 1600) AS tail FROM documents")
def head_tail_windows(spark, sf_dir):
    head, tail = X.head_tail(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", head.alias("head"), tail.alias("tail"))


@query("canonical_document")
def canonical_document(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *mime.canonical(F.col("lang"), F.col("text")))


@query(
    "public_networks",
    r"""WITH q AS (SELECT doc_id, regexp_extract_all(' ' || text || ' ', '[^0-9.]([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?:[^0-9.])', 1) AS q FROM documents),
f AS (SELECT doc_id, list_filter(q, lambda s: split_part(s,'.',1)::INT <= 255 AND split_part(s,'.',2)::INT <= 255 AND split_part(s,'.',3)::INT <= 255 AND split_part(s,'.',4)::INT <= 255
 AND split_part(s,'.',1)::INT NOT IN (10, 127) AND NOT (split_part(s,'.',1) = '192' AND split_part(s,'.',2) = '168') AND NOT (split_part(s,'.',1) = '172' AND split_part(s,'.',2)::INT BETWEEN 16 AND 31)) AS f FROM q)
SELECT doc_id, coalesce(regexp_replace(f[1], '\.[0-9]+$', ''), '') AS net FROM f""",
)
def public_networks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.public_slash24(F.col("text")).alias("net"))


@query("original_dates", "SELECT o_orderkey, o_orderdate AS sent FROM orders")
def original_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.original_date(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("sent"))


@query("token_counts", f"SELECT doc_id, len({TOKENS.format(c='lower(text)')})::INT AS tokens, len(list_distinct({TOKENS.format(c='lower(text)')}))::INT AS different FROM documents")
def token_counts(spark, sf_dir):
    t = X.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("different"))


@query(
    "token_bigrams",
    f"""WITH t AS (SELECT doc_id, {TOKENS.format(c='lower(text)')} AS w FROM documents), b AS (SELECT doc_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || '_' || p[2])) AS bigram FROM t WHERE len(w) > 1)
SELECT bigram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM b GROUP BY bigram""",
)
def token_bigrams(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.bigrams(X.tokens(F.col("text")))).alias("bigram"))
    per = d.groupBy("bigram", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("bigram").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


WORDS2 = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_@.\-]{2,}')"


# words and pairs of neighbours
PAIRS2 = "list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]) ELSE [] END)"


@query("ngram_counts", f"WITH t AS (SELECT doc_id, unnest({PAIRS2}) AS term FROM (SELECT doc_id, {WORDS2} AS w FROM documents)) SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL")
def ngram_counts(spark, sf_dir):
    return FE.ngram_counts(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), 2)


@query(
    "tfidf",
    f"""WITH t AS (SELECT doc_id, unnest({PAIRS2}) AS term FROM (SELECT doc_id, {WORDS2} AS w FROM documents)), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS docs FROM documents), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
i AS (SELECT term, ln((1 + docs) / (1 + df)) + 1 AS idf FROM f, n WHERE df >= 2 AND df <= 0.997 * docs),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM c JOIN i USING (term)), z AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM w GROUP BY doc_id)
SELECT doc_id, term, round(w / z, 6) AS tfidf FROM w JOIN z USING (doc_id)""",
)
def tfidf(spark, sf_dir):
    t = FE.tfidf(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), n=2, most_terms=None)
    return t.select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


INDEX = f"({FNV32.format(c='name')} & 131071)::INT"
NAMES = f"""names AS (SELECT doc_id, unnest(list_concat(list_transform(w, lambda t: 'body:tok:' || t), CASE WHEN len(w) > 1 THEN list_transform(list_slice(list_zip(w[:-2], w[2:]), 1, 1600), lambda p: 'body:bi:' || p[1] || '_' || p[2]) ELSE [] END)) AS name
FROM (SELECT doc_id, list_slice({TOKENS.format(c='lower(text)')}, 1, 5000) AS w FROM documents))"""


def _hashed(spark, sf_dir):
    return FE.hashed(table(spark, sf_dir, "documents"), "doc_id", FE.text_features(F.col("text"), "body", FE.BODY_TOKENS))


@query("hashed_features", f"WITH {NAMES}, c AS (SELECT doc_id, name, count(*) AS n FROM names GROUP BY ALL), h AS (SELECT name, {INDEX} AS idx FROM (SELECT DISTINCT name FROM c)) SELECT doc_id, idx, sum(n)::DOUBLE AS value FROM c JOIN h USING (name) GROUP BY ALL")
def hashed_features(spark, sf_dir):
    return _hashed(spark, sf_dir).select("doc_id", "idx", "value")


def _weights(spark):
    return spark.range(1 << 17).select(F.col("id").cast("int").alias("idx"), ((F.pmod(F.col("id") * 7919, F.lit(2001)) - 1000).cast("double") / 1000).alias("w"))


W_SQL = "((idx::BIGINT * 7919) % 2001 - 1000)::DOUBLE / 1000"


@query(
    "feature_dot_score",
    f"WITH {NAMES}, c AS (SELECT doc_id, name, count(*) AS n FROM names GROUP BY ALL), h AS (SELECT name, {INDEX} AS idx FROM (SELECT DISTINCT name FROM c)) SELECT doc_id, round(sum(n * {W_SQL}) - 0.4, 4) AS margin FROM c JOIN h USING (name) GROUP BY doc_id",
)
def feature_dot_score(spark, sf_dir):
    return FE.dot(_hashed(spark, sf_dir), F.broadcast(_weights(spark)), "doc_id", -0.4).select("doc_id", F.round("margin", 4).alias("margin"))


@query(
    "top_contributions",
    f"""WITH lists AS (SELECT doc_id, list_concat(list_transform(w, lambda t: 'body:tok:' || t), CASE WHEN len(w) > 1 THEN list_transform(list_slice(list_zip(w[:-2], w[2:]), 1, 1600), lambda p: 'body:bi:' || p[1] || '_' || p[2]) ELSE [] END) AS names
FROM (SELECT doc_id, list_slice({TOKENS.format(c='lower(text)')}, 1, 5000) AS w FROM documents)),
o AS (SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) AS ord FROM lists), c AS (SELECT doc_id, name, count(*) AS n, min(ord) AS ord FROM o GROUP BY ALL),
h AS (SELECT name, {INDEX} AS idx FROM (SELECT DISTINCT name FROM c)), g AS (SELECT doc_id, idx, sum(n)::DOUBLE * ({W_SQL}) AS c, arg_min(name, ord) AS feature FROM c JOIN h USING (name) GROUP BY doc_id, idx),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(c) DESC, feature) AS place FROM g WHERE c <> 0)
SELECT doc_id, place::INT AS place, feature, round(c, 6) AS contribution FROM r WHERE place <= 8""",
)
def top_contributions(spark, sf_dir):
    top = FE.top_contributions(_hashed(spark, sf_dir), F.broadcast(_weights(spark)), "doc_id", 8)
    out = top.select("doc_id", F.posexplode("explanations").alias("p", "e"))
    return out.select("doc_id", (F.col("p") + 1).alias("place"), "e.feature", F.round("e.contribution", 6).alias("contribution"))


@query(
    "structural_features",
    r"""SELECT page_id, round(ln(1 + length(html)), 6) AS log_chars, round(ln(1 + len(regexp_extract_all(html, '\S+'))), 6) AS log_words,
round(least(1.0, len(regexp_extract_all(html, '[A-Z]'))::DOUBLE / greatest(length(html), 1)), 6) AS upper_share, round(least(1.0, len(regexp_extract_all(html, '[0-9]'))::DOUBLE / greatest(length(html), 1)), 6) AS digit_share,
CASE WHEN regexp_matches(lower(html), '<form\b') THEN 1 ELSE 0 END AS has_form, round(least(1.0, len(regexp_extract_all(html, '<[a-zA-Z]')) / 80.0::DOUBLE), 6) AS tag_density,
CASE WHEN length(host) - length(replace(host, '.', '')) >= 3 THEN 1 ELSE 0 END AS deep_host FROM (SELECT *, lower(regexp_extract(url, '://([^/\s:]+)', 1)) AS host FROM pages)""",
)
def structural_features(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    f = FE.structural_features(F.col("html"), X.url_hosts(F.col("url")), F.lit(""))
    out = p.select("page_id", *f)
    return out.select("page_id", *(F.round(c, 6).alias(c) for c in ("log_chars", "log_words", "upper_share", "digit_share")), "has_form", F.round("tag_density", 6).alias("tag_density"), "deep_host")


@query(
    "cue_flags",
    "SELECT doc_id, " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN 1 ELSE 0 END AS cue_{k}" for k, p in X.CUES.items()) + " FROM documents",
)
def cue_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *X.cue_flags(F.col("text")))


@query(
    "char_ngrams",
    r"""WITH w AS (SELECT unnest(list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT ' ' || w || ' ' AS p, count(*) AS n FROM w GROUP BY w), g AS (SELECT unnest(flatten(list_transform([3, 4, 5], lambda k: list_transform(range(1, greatest(length(p) - k + 2, 1)), lambda i: substr(p, i, k))))) AS gram, n FROM c)
SELECT gram, sum(n)::BIGINT AS n FROM g GROUP BY gram""",
)
def char_ngrams(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(FE.char_wb_ngrams(F.col("text"))).alias("gram"))
    return d.groupBy("gram").agg(F.count("*").alias("n"))


@query("token_id_sequences")
def token_id_sequences(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", FE.sequence_ids(F.col("text"), 224).alias("ids"), F.size(FE.token_ids(F.col("text"))).alias("bag"))


@query("byte_windows", "SELECT doc_id, 4096 AS n, least(octet_length(encode(text)), 4096)::INT AS filled FROM documents")
def byte_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", FE.byte_window(F.encode("text", "UTF-8")).alias("w"))
    return d.select("doc_id", F.size("w").alias("n"), F.size(F.filter("w", lambda x: x > 0)).alias("filled"))


@query("vector_pair_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_pair_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(FE.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


BODY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[\t ]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(
    "parsed_messages",
    f"""SELECT doc_id, lang AS subject, source || '@example.com' AS "from", sha256({BODY}) AS text, len(regexp_extract_all({BODY}, '(?i)https?://[^\\s<>''"]+'))::INT AS url_count,
octet_length(encode(concat_ws(chr(13) || chr(10), 'From: ' || source || '@example.com', 'To: to@example.org', 'Subject: ' || lang, 'Content-Type: text/plain; charset=utf-8', '', coalesce(text, ''))))::INT AS raw_length FROM documents""",
)
def parsed_messages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = mime.render_message(F.concat("source", F.lit("@example.com")), F.lit("to@example.org"), F.col("lang"), F.col("text"))
    return d.select("doc_id", mime.parse_udf(raw).alias("m")).select("doc_id", "m.subject", "m.`from`", F.sha2("m.text", 256).alias("text"), "m.url_count", "m.raw_length")


@query("rendered_messages", r"SELECT doc_id, concat_ws(chr(13) || chr(10), 'From: ' || source, 'To: ', 'Subject: ' || lang, 'Content-Type: text/plain; charset=utf-8', '', text) AS message FROM documents")
def rendered_messages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.decode(mime.render_message(F.col("source"), F.lit(""), F.col("lang"), F.col("text")), "UTF-8").alias("message"))


@query("scan_cache_keys", "SELECT doc_id, sha256(concat('v1', chr(10), text)) AS key FROM documents")
def scan_cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.scan_key("v1", F.col("text")).alias("key"))


@query("blake2_ids")
def blake2_ids(spark, sf_dir):
    udf = H.blake2b_mod(65_536, reserve=2)
    d = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token")).distinct()
    return d.select("token", udf("token").alias("id"))
