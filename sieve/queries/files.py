"""Readers and writers end to end: tables are written in each format to the shared folder and read back; message parts, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieve.functions import text as X
from sieve.operators import audit, combine, features, mime, scan, split
from sieve.queries.base import MESSAGES_SQL, SCORES_SQL, messages, query, scores, table
from sieve.scratch import fresh_path
from sieve.sources import readers, sinks

BODY = "coalesce(text, '')"
MESSAGE = rf"concat_ws(chr(13) || chr(10), 'From: ' || source || '@example.com', 'To: to@example.org', 'Subject: ' || lang, 'Content-Type: text/plain; charset=utf-8', '', {BODY})"


def _raw():
    return mime.render_message(F.concat("source", F.lit("@example.com")), F.lit("to@example.org"), F.col("lang"), F.col("text"))


def _messages(spark, sf_dir):
    """(doc_id, y, source, raw): labelled documents as messages."""
    return messages(spark, sf_dir).select("doc_id", "y", "source", _raw().alias("raw"))


def _id(path: str):
    return F.regexp_extract(path, r"(\d+)\.eml$", 1).cast("long").alias("doc_id")


@query("message_files", f"SELECT doc_id, sha256({MESSAGE}) AS sha256, octet_length(encode({MESSAGE}))::INT AS bytes FROM documents")
def message_files(spark, sf_dir):
    """Every document as a file of its own, found again by a recursive scan."""
    path = fresh_path(spark, "messages")
    rows = table(spark, sf_dir, "documents").select(F.format_string("%s/%d.eml", F.coalesce("source", F.lit("none")), "doc_id").alias("file"), _raw().alias("raw"))
    sinks.write_messages(rows, path).write.format("noop").mode("overwrite").save()
    return readers.files_under(spark, path).select(_id("path"), F.sha2("raw", 256).alias("sha256"), F.length("raw").alias("bytes"))


@query("labelled_folder_pair", f"WITH {MESSAGES_SQL} SELECT doc_id, y::INT AS y, 'pair' AS source, sha256({MESSAGE}) AS sha256 FROM messages")
def labelled_folder_pair(spark, sf_dir):
    path = fresh_path(spark, "folders")
    rows = _messages(spark, sf_dir).withColumn("file", F.format_string("%s/%d.eml", F.when(F.col("y") == 1, "spam").otherwise("ham"), "doc_id"))
    sinks.write_messages(rows, path).write.format("noop").mode("overwrite").save()
    pair = readers.labelled_folders(spark, f"{path}/spam", f"{path}/ham", "pair")
    return pair.select(_id("path"), "y", "source", F.sha2("raw", 256).alias("sha256"))


@query("single_message", "SELECT 'Hello' AS subject, 'a@b.cc' AS sender, 'one two' AS text, 43 AS raw_length")
def single_message(spark, sf_dir):
    table(spark, sf_dir, "nation")
    one = readers.single_message(spark, b"Subject: Hello\r\nFrom: a@b.cc\r\n\r\none   two\r\n")
    return one.select(mime.parse_udf("raw").alias("m")).select("m.subject", F.col("m.from").alias("sender"), "m.text", "m.raw_length")


@query("archive_corpus", f"SELECT doc_id, sha256({MESSAGE}) AS sha256 FROM documents")
def archive_corpus(spark, sf_dir):
    path = fresh_path(spark, "archives")
    rows = table(spark, sf_dir, "documents").select(F.format_string("mail/%d.eml", "doc_id").alias("file"), _raw().alias("raw"))
    sinks.write_archives(rows, path).write.format("noop").mode("overwrite").save()
    return readers.archive(spark, path).select(_id("path"), F.sha2("raw", 256).alias("sha256"))


@query("csv_corpus", f"WITH {MESSAGES_SQL} SELECT y::INT AS y, sha256(lower(source)) AS subject, sha256(lower(text)) AS text FROM messages GROUP BY ALL")
def csv_corpus(spark, sf_dir):
    path = fresh_path(spark, "csv")
    rows = messages(spark, sf_dir).select(
        F.when(F.col("y") == 1, "spam").otherwise("ham").alias("Spam/Ham"), F.col("source").alias("Subject"), F.col("text").alias("Message"), F.lit("2020-01-01").alias("Date")
    )
    rows.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.csv_corpus(spark, path).select("y", F.sha2(F.lower("subject"), 256).alias("subject"), F.sha2(F.lower("text"), 256).alias("text")).distinct()


@query("multi_source_rows", f"WITH {MESSAGES_SQL} SELECT source AS dataset_name, '' AS sender, lang AS subject, sha256({BODY}) AS text, y::INT AS label FROM messages WHERE doc_id % 3 < 2")
def multi_source_rows(spark, sf_dir):
    """Rows with a label that isn't 0 or 1 are left out by the reader."""
    path = fresh_path(spark, "sources")
    label = F.when(F.col("doc_id") % 3 < 2, F.col("y")).otherwise(7).cast("int")
    null = F.lit(None).cast("string")
    messages(spark, sf_dir).select(
        F.col("source").alias("dataset_name"), null.alias("sender"), null.alias("receiver"), F.col("lang").alias("subject"), null.alias("date"), "text", label.alias("label")
    ).write.parquet(path)
    return readers.multi_source(spark, path).select("dataset_name", "sender", "subject", F.sha2("text", 256).alias("text"), "label")


@query("source_adapters", f"WITH {MESSAGES_SQL} SELECT 'Re: ' || lang AS subject, sha256('Subject: Re: ' || lang || chr(10) || text) AS text, y::INT AS y, 'mixed' AS source FROM messages WHERE text IS NOT NULL")
def source_adapters(spark, sf_dir):
    rows = messages(spark, sf_dir).filter("text is not null").select(F.concat(F.lit("Subject: Re: "), "lang", F.lit("\n"), "text").alias("text"), F.col("y").alias("labels"))
    return readers.adapt(rows, "mixed", "mixed").select("subject", F.sha2("text", 256).alias("text"), "y", "source")


@query("manifest_rows", "SELECT CASE WHEN n_regionkey = 0 THEN 'test' WHEN n_regionkey = 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n, min(n_name) AS first, sum(n_nationkey % 2)::BIGINT AS spam FROM nation GROUP BY 1")
def manifest_rows(spark, sf_dir):
    """A JSON manifest of the nations, by split."""
    path = fresh_path(spark, "manifest")
    rows = table(spark, sf_dir, "nation").select("n_regionkey", F.struct(F.col("n_name").alias("file"), (F.col("n_nationkey") % 2).cast("int").alias("y"), F.lit("n").alias("source")).alias("r"))
    of = lambda test: F.collect_list(F.when(test, F.col("r")))  # noqa: E731  (25 rows)
    k = F.col("n_regionkey")
    rows.agg(F.lit(40).alias("version"), of(k > 1).alias("train"), of(k == 1).alias("val"), of(k == 0).alias("test")).write.json(path)
    found = readers.manifest(spark, path, 40)
    return found.groupBy("split").agg(F.count("*").alias("n"), F.min("file").alias("first"), F.sum("y").alias("spam"))


@query(
    "prediction_csv",
    f"""WITH {SCORES_SQL} SELECT concat_ws(',', '"' || source || '""/' || msg_id || '"', CASE WHEN y = 1 THEN 'spam' ELSE 'ham' END, sha256(msg_id::VARCHAR),
CASE WHEN base_flag OR p1 >= 0.8 THEN 'Spam' WHEN p1 <= 0.2 THEN 'Normal' ELSE 'Unsure' END, printf('%.6f', p1), printf('%.6f', CASE WHEN base_flag THEN 1.0::DOUBLE ELSE p1 END), CASE WHEN base_flag THEN '1' ELSE '0' END,
'"no action"', printf('%.4f', rscore), '"body:a:' || printf('%.4f', p2) || ' | body:b:' || printf('%.4f', p3) || '"') AS line FROM scores""",
)
def prediction_csv(spark, sf_dir):
    s = scores(spark, sf_dir, "msg_id", "source", "y", "base_flag", "rscore", "p1", "p2", "p3")
    reason = lambda name, c: F.struct(F.lit(name).alias("feature"), F.col(c).alias("contribution"))
    rows = s.select(
        F.concat("source", F.lit('"/'), F.col("msg_id").cast("string")).alias("path"), "y", F.sha2(F.col("msg_id").cast("string"), 256).alias("fingerprint"),
        *combine.decision(F.col("p1"), F.col("base_flag")), F.col("p1").alias("p"), "base_flag", F.lit("no action").alias("action"), "rscore",
        F.array(reason("body:a", "p2"), reason("body:b", "p3")).alias("explanations"),
    )
    path = fresh_path(spark, "predictions")
    sinks.write_prediction_csv(rows, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("prediction_jsonl", f"WITH {MESSAGES_SQL} SELECT sha256({MESSAGE}) AS id, y::INT AS y, source FROM messages")
def prediction_jsonl(spark, sf_dir):
    path = fresh_path(spark, "records")
    sinks.write_jsonl(_messages(spark, sf_dir).select("raw", "y", "source"), path)
    return readers.predictions(spark, path, "id string, y int, source string")


@query("model_round_trip", "SELECT p_partkey::INT AS idx, (p_size / 16)::FLOAT AS w, 2 AS prints, 0.5::DOUBLE AS bias FROM part")
def model_round_trip(spark, sf_dir):
    """Weights of the parts' places through the model folder."""
    path = fresh_path(spark, "model")
    w = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("idx"), (F.col("p_size") / 16).alias("w"))
    prints = spark.createDataFrame([("ab", 1), ("cd", 2)], "exact string, simhash long")
    sinks.save_weights(path, {"bias": 0.5}, w, prints)
    settings, found, known = readers.load_weights(spark, path)
    return found.select("idx", "w").crossJoin(known.agg(F.count("*").cast("int").alias("prints"))).withColumn("bias", F.lit(settings["bias"]))  # one row


@query("frozen_split_files", f"WITH {SCORES_SQL} SELECT msg_id, y, CASE WHEN msg_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM scores")
def frozen_split_files(spark, sf_dir):
    path = fresh_path(spark, "splits")
    rows = scores(spark, sf_dir, "msg_id", "y").withColumn("split", F.when(F.col("msg_id") % 5 == 0, "test").otherwise("train"))
    sinks.write_frozen_split(rows, path)
    return spark.read.parquet(path).select("msg_id", "y", "split")


@query("scan_cache_files", f"SELECT sha256(concat('v1', chr(10), {MESSAGE})) AS key, '{{\"score\": ' || (doc_id % 7) || '}}' AS reply, substr(sha256(concat('v1', chr(10), {MESSAGE})), 1, 2) AS prefix FROM documents")
def scan_cache_files(spark, sf_dir):
    """Replies appended to the cache in two runs."""
    path = fresh_path(spark, "cache")
    reply = F.concat(F.lit('{"score": '), (F.col("doc_id") % 7).cast("string"), F.lit("}"))
    rows = table(spark, sf_dir, "documents").select("doc_id", scan.scan_key("v1", _raw()).alias("key"), reply.alias("reply"))
    for part in (0, 1):
        sinks.append_cache(rows.filter(F.col("doc_id") % 2 == part).drop("doc_id"), path)
    # spelled out: a prefix of two digits would be read as a number
    return spark.read.schema("key string, reply string, prefix string").parquet(path)


@query("constant_scanner", "SELECT doc_id, 'add header' AS action, 7.5::DOUBLE AS score, true AS spam FROM documents")
def constant_scanner(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", _raw().alias("raw"))
    found = scan.constant_scanner({"action": "add header", "score": 7.5, "required_score": 15, "symbols": {}})(rows)
    s = scan.parse_lenient(F.col("reply"))
    return found.select("doc_id", s["action"].alias("action"), s["score"].alias("score"), scan.is_spam_action(s["action"]).alias("spam"))


@query("replayed_scans", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 11)::DOUBLE END AS score FROM documents")
def replayed_scans(spark, sf_dir):
    """Recorded replies of every third message, looked up by the scan key; others have none."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), "UTF-8").alias("raw"))
    known = rows.filter("doc_id % 3 = 0").select(scan.scan_key("r", F.col("raw")).alias("key"), F.to_json(F.struct((F.col("doc_id") % 11).alias("score"))).alias("reply"))
    found = scan.replay_scanner(known, "r")(rows)
    return found.select("doc_id", F.get_json_object("reply", "$.score").cast("double").alias("score"))


@query("stdlib_documents", f"SELECT doc_id, sha256(substr('subject ' || lang || chr(10) || 'from ' || source || '@example.com' || chr(10) || 'to to@example.org' || chr(10) || {BODY}, 1, 250000)) AS document, 0 AS attachments FROM documents")
def stdlib_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", mime.document_udf(_raw()).alias("m"))
    return d.select("doc_id", F.sha2("m.document", 256).alias("document"), "m.attachments")


@query("message_identity", "SELECT doc_id, lower(source) || '@example.com' AS sender, 'example.com' AS sender_domain, '' AS return_domain, '' AS ip24, lower(lang) AS subject_key FROM documents")
def message_identity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", mime.parse_udf(_raw()).alias("m"))
    return d.select("doc_id", *mime.identity("m")).select("doc_id", "sender", "sender_domain", "return_domain", "ip24", "subject_key")


@query("raw_subjects", "SELECT doc_id, lang AS subject FROM documents")
def raw_subjects(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.subject_of_raw(F.decode(_raw(), "UTF-8")).alias("subject"))


@query("masked_envelopes", f"SELECT doc_id, replace(replace({MESSAGE}, source || '@example.com', '__sender__'), 'to@example.org', '__receiver__') AS text FROM documents")
def masked_envelopes(spark, sf_dir):
    raw = F.decode(_raw(), "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", X.mask_envelope(raw, F.concat("source", F.lit("@example.com")), F.lit("to@example.org")).alias("text"))


FROZEN = f"""{SCORES_SQL}, m AS (SELECT CASE WHEN msg_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, row_number() OVER (PARTITION BY msg_id % 4 = 0 ORDER BY msg_id) - 1 AS ord, 'm/' || msg_id || '.eml' AS file,
CASE WHEN msg_id % 1000 = 3 THEN 2 ELSE y END AS y, source, sha256((msg_id // CASE WHEN msg_id % 500 < 4 THEN 500 ELSE 1 END)::VARCHAR) AS sha256 FROM scores)"""


def _manifest(spark, sf_dir):
    """A manifest with a few labels and contents that an audit must find."""
    from sieve.operators.prefix import places

    s = scores(spark, sf_dir, "msg_id", "y", "source").withColumn("split", F.when(F.col("msg_id") % 4 == 0, "test").otherwise("train"))
    s = places(s, ("split",), ("msg_id",))
    content = F.when(F.col("msg_id") % 500 < 4, F.floor(F.col("msg_id") / 500)).otherwise(F.col("msg_id"))
    return s.select(
        "split", (F.col("__k") - 1).cast("long").alias("ord"), F.format_string("m/%d.eml", "msg_id").alias("file"),
        F.when(F.col("msg_id") % 1000 == 3, 2).otherwise(F.col("y")).alias("y"), "source", F.sha2(content.cast("string"), 256).alias("sha256"),
    )


@query(
    "manifest_problems",
    f"""WITH {FROZEN}, k AS (SELECT sha256, count(*) AS n, count(DISTINCT split) AS s FROM m GROUP BY sha256) SELECT 'label' AS problem, file AS detail FROM m WHERE y NOT IN (0, 1)
UNION ALL SELECT 'repeated within a split', sha256 FROM k WHERE n > 1 AND s = 1 UNION ALL SELECT 'shared by splits', sha256 FROM k WHERE s > 1
UNION ALL SELECT 'count', 'test:' || count(*) || ':1' FROM m WHERE split = 'test'""",
)
def manifest_problems(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    return audit.manifest_problems(m, {"test": 1}).filter("NOT (problem = 'count' AND detail LIKE 'train:%')")


@query("missing_files", f"WITH {FROZEN} SELECT split, file FROM m WHERE ord % 7 = 0")
def missing_files(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    return audit.missing_files(m, m.filter("ord % 7 <> 0").select(F.col("file").alias("path")))


@query(
    "split_digests",
    f"""WITH {FROZEN}, l AS (SELECT split, ord, '{{"file":"' || file || '","sha256":"' || sha256 || '","label":' || y || ',"source":"' || source || '"}}' AS line FROM m),
b AS (SELECT split, ord // 4096 AS block, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY ord)) AS d FROM l GROUP BY ALL)
SELECT split, sum(n)::BIGINT AS n, sha256(string_agg(d, chr(10) ORDER BY block)) AS digest FROM b GROUP BY split""",
)
def split_digests(spark, sf_dir):
    return audit.split_digest(_manifest(spark, sf_dir))


@query("plan_shortfalls", f"WITH {SCORES_SQL}, h AS (SELECT source, y, count(*) AS have FROM scores GROUP BY ALL) SELECT source, y, 300 AS need, have FROM h WHERE source IN ('n0', 'n1', 'n2') AND have < 300")
def plan_shortfalls(spark, sf_dir):
    plan = split.plan_from_fractions(spark, [(s, y, 300) for s in ("n0", "n1", "n2") for y in (0, 1)], [("train", 0.7), ("test", 0.3)])
    return split.plan_shortfalls(scores(spark, sf_dir, "source", "y"), plan).select("source", "y", "need", "have")


@query("plan_from_fractions", "SELECT * FROM (VALUES ('n0', 1, 'train', 1, 70), ('n0', 1, 'val', 71, 80), ('n0', 1, 'test', 81, 101)) t(source, y, split, first, last)")
def plan_from_fractions(spark, sf_dir):
    table(spark, sf_dir, "nation")
    return split.plan_from_fractions(spark, [("n0", 1, 101)], [("train", 0.7), ("val", 0.1), ("test", 0.2)])


@query("fold_classes", f"WITH {SCORES_SQL} SELECT msg_id % 997 AS fold, sum(y)::BIGINT AS spam, sum(1 - y)::BIGINT AS ham FROM scores GROUP BY ALL HAVING sum(y) = 0 OR sum(1 - y) = 0")
def fold_classes(spark, sf_dir):
    return split.fold_classes(scores(spark, sf_dir, "msg_id", "y").withColumn("fold", F.col("msg_id") % 997))


@query("minimum_length", f"SELECT doc_id FROM documents WHERE length(trim(regexp_replace({BODY}, '\\s+', ' ', 'g'))) >= 40")
def minimum_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.length(X.collapse(F.coalesce("text", F.lit("")))) >= 40).select("doc_id")


@query("source_predicates", "SELECT doc_id, contains(lower(source), '1') AS hard, CASE WHEN contains(lower(source), '1') THEN 1.4 ELSE 1.0 END::DOUBLE AS weight FROM documents")
def source_predicates(spark, sf_dir):
    hard = F.lower("source").contains("1")
    return table(spark, sf_dir, "documents").select("doc_id", hard.alias("hard"), F.when(hard, 1.4).otherwise(1.0).alias("weight"))


@query("symbol_flags", "SELECT event_id, (event_id % 2 = 0)::INT AS dkim_pass, (event_id % 3 = 0)::INT AS spf_pass, (event_id % 5 = 0)::INT AS dmarc_bad FROM events")
def symbol_flags(spark, sf_dir):
    mark = lambda n, name: F.when(F.col("event_id") % n == 0, F.struct(F.lit(name).alias("name")))
    symbols = F.array_compact(F.array(mark(2, "R_dkim_allow"), mark(3, "R_SPF_ALLOW"), mark(5, "DMARC_POLICY_REJECT")))
    return table(spark, sf_dir, "events").select("event_id", *mime.authentication_flags(symbols)).select("event_id", "dkim_pass", "spf_pass", "dmarc_bad")


@query("flipped_labels", f"WITH {SCORES_SQL} SELECT msg_id, 1 - y AS y, round(1 - score, 6) AS score FROM scores")
def flipped_labels(spark, sf_dir):
    return scores(spark, sf_dir, "msg_id", "y", "score").select("msg_id", (1 - F.col("y")).alias("y"), F.round(1 - F.col("score"), 6).alias("score"))


@query("percent_format", f"WITH {SCORES_SQL} SELECT msg_id, printf('%.2f%%', p1 * 100) AS share FROM scores")
def percent_format(spark, sf_dir):
    return scores(spark, sf_dir, "msg_id", "p1").select("msg_id", X.two_decimals(F.col("p1")).alias("share"))


@query("border_scores", f"WITH {SCORES_SQL} SELECT msg_id, round(sqrt(p1 * p2 * p3) * CASE WHEN base_flag THEN 0.55 ELSE 1.0 END, 6) AS score FROM scores")
def border_scores(spark, sf_dir):
    s = scores(spark, sf_dir, "msg_id", "p1", "p2", "p3", "base_flag")
    return s.select("msg_id", F.round(combine.border_score(F.col("p1"), F.col("p2"), F.col("p3"), F.col("base_flag")), 6).alias("score"))


@query("gate_profiles", "SELECT * FROM (VALUES ('safe', 3, 1, 0.7::DOUBLE), ('balanced', 16, 4, 0.9::DOUBLE), ('target', 100, 25, 0.95::DOUBLE)) t(name, most_fp, most_fold_fp, target_recall)")
def gate_profiles(spark, sf_dir):
    from sieve.operators.gates import PROFILES

    table(spark, sf_dir, "nation")
    return spark.createDataFrame([(p.name, p.most_fp, p.most_fold_fp, p.target_recall) for p in PROFILES], "name string, most_fp int, most_fold_fp int, target_recall double")


@query(
    "numeric_rows",
    f"""WITH {SCORES_SQL} SELECT msg_id, round(ln(1 + msg_id % 900), 6) AS log_chars, round(greatest(-3.0, least(3.0, rscore / 15.0)), 6) AS score, round(greatest(-3.0, least(3.0, rscore / 5.0)), 6) AS ratio, base_flag::INT::DOUBLE AS base FROM scores""",
)
def numeric_rows(spark, sf_dir):
    zero, five = F.lit(0), F.lit(5.0)
    c = {"chars": F.col("msg_id") % 900, "raw_bytes": zero, "urls": zero, "attachments": zero, "html": F.lit(False), "rscore": F.col("rscore"), "required": five, "symbols": zero, "base": F.col("base_flag")}
    s = scores(spark, sf_dir, "msg_id", "rscore", "base_flag").select("msg_id", features.numeric_row(c).alias("v"))
    at = lambda k, name: F.round(F.col("v")[k], 6).alias(name)
    return s.select("msg_id", at(0, "log_chars"), at(5, "score"), at(6, "ratio"), at(8, "base"))


@query(
    "scan_histograms",
    "SELECT 'action' AS kind, CASE WHEN event_type = 'error' THEN 'soft reject' WHEN event_type = 'purchase' THEN 'reject' ELSE 'no action' END AS name, count(*) AS n FROM events GROUP BY ALL "
    "UNION ALL SELECT 'symbol', 'BAYES_SPAM', count(*) FROM events UNION ALL SELECT 'symbol', 'S' || (user_id % 7), count(*) FROM events GROUP BY ALL",
)
def scan_histograms(spark, sf_dir):
    from sieve.queries.scored import _replies

    return scan.histograms(_replies(spark, sf_dir).select(scan.parse_lenient(F.col("reply")).alias("scan")))


@query("learning_acknowledgement", "SELECT count(*) AS n, sum((event_id % 4 <> 0)::INT)::BIGINT AS accepted, false AS ok FROM events")
def learning_acknowledgement(spark, sf_dir):
    reply = F.when(F.col("event_id") % 4 == 0, '{"success": true, "error": "ham"}').otherwise('{"success": true}')
    return scan.learning_summary(table(spark, sf_dir, "events").select(reply.alias("reply")))
