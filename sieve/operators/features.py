"""Feature builders: hashed sparse features in long form, n-grams, TF-IDF, id sequences, structural features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieve.functions import text as X
from sieve.functions.hashing import fnv32_all, murmur3_all, utf8
from sieve.functions.numeric import clip
from sieve.operators import terms

# The caps of the hashed features, and the prefix of scanner features.
SUBJECT_TOKENS, BODY_TOKENS, BODY_BIGRAMS, SYMBOLS, OPTIONS, HOSTS = 120, 5000, 1600, 250, 3, 25
SCANNER = "rspamd"


def _named(names: Column, value: Column | float = 1.0) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(value).cast("double").alias("value")))


def _one(name: Column | str, value: Column, when: Column | None = None) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    item = F.array(F.struct(name.alias("name"), value.cast("double").alias("value")))
    return item if when is None else F.when(when, item).otherwise(F.array().cast("array<struct<name:string,value:double>>"))


def text_features(c: Column, prefix: str, most: int, most_bigrams: int = BODY_BIGRAMS) -> Column:
    """Tokens and neighbouring pairs of a text, as (name, value) with value 1 for each occurrence."""
    words = X.tokens(F.coalesce(c, F.lit("")), X.TOKEN, most)
    single = F.transform(words, lambda t: F.concat(F.lit(f"{prefix}:tok:"), t))
    pairs = F.transform(X.bigrams(words, most_bigrams), lambda t: F.concat(F.lit(f"{prefix}:bi:"), t))
    return _named(F.concat(single, pairs))


def message_features(scan: bool = False) -> Column:
    """All features of a parsed message (columns of schema.PARSED, and scan of schema.SCAN), as an array of (name, value)."""
    c = F.col
    parts = [
        text_features(c("subject"), "subject", SUBJECT_TOKENS),
        text_features(c("text"), "body", BODY_TOKENS),
        _one("num:url_count", F.log1p(c("url_count"))),
        _one("num:attachment_count", F.log1p(c("attachment_count"))),
        _one("num:raw_kb", F.log1p(c("raw_length") / 1024.0)),
        _one("flag:html", F.lit(1.0), c("has_html")),
    ]
    for name, column in (("from_domain", "from"), ("to_domain", "to")):
        domain = X.address_domain(c(f"`{column}`"))
        parts.append(_one(F.concat(F.lit(f"{name}:"), domain), F.lit(1.0), domain != ""))
    parts.append(_named(F.transform(X.url_hosts(c("text"), HOSTS), lambda h: F.concat(F.lit("url_domain:"), h))))
    if scan:
        s = c("scan")
        ratio = F.when(s["required"] > 0, clip(s["score"] / s["required"], -3, 3)).otherwise(0.0)
        parts += [
            _one(f"{SCANNER}:score", clip(s["score"] / 15.0, -3, 3)),
            _one(f"{SCANNER}:score_ratio", ratio),
            _one(F.concat(F.lit(f"{SCANNER}:action:"), X.normalise_category(s["action"])), F.lit(1.0)),
        ]
        symbols = F.slice(s["symbols"], 1, SYMBOLS)
        own = F.transform(
            symbols,
            lambda x: F.struct(
                F.concat(F.lit(f"{SCANNER}:symbol:"), X.normalise_category(x["name"])).alias("name"), clip(x["score"], -10, 10).alias("value")
            ),
        )
        options = F.flatten(
            F.transform(
                symbols,
                lambda x: F.transform(
                    F.filter(F.transform(F.slice(F.coalesce(x["options"], F.array().cast("array<string>")), 1, OPTIONS), X.normalise_option), lambda o: o != ""),
                    lambda o: F.concat(F.lit(f"{SCANNER}:option:"), X.normalise_category(x["name"]), F.lit(":"), o),
                ),
            )
        )
        parts += [own, _named(options)]
    return F.concat(*parts)


def _place(rows: np.ndarray, names: pa.Array, values: np.ndarray, dimension: int) -> tuple[np.ndarray, ...]:
    """(row, idx, value, code of the label) and the distinct names, from occurrences in order."""
    coded = names.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = coded.dictionary.to_pylist()
    index = (fnv32_all(known) & np.uint32(0x7FFFFFFF & (dimension - 1))).astype(np.int64)
    pairs, first, inverse = np.unique(rows * max(len(known), 1) + codes, return_index=True, return_inverse=True)
    total = np.bincount(inverse, weights=values, minlength=len(pairs))
    held = total != 0
    row, code, first, total = rows[first[held]], codes[first[held]], first[held], total[held]
    order = np.lexsort((first, index[code], row))
    row, code, total = row[order], code[order], total[order]
    at = row * dimension + index[code]
    begins = np.flatnonzero(np.diff(at, prepend=-1))
    sums = np.add.reduceat(total, begins) if len(begins) else total
    return row[begins], index[code[begins]], sums, code[begins], coded.dictionary


def hashed(rows: DataFrame, key: str, features: Column, dimension: int = 1 << 17) -> DataFrame:
    """(key, idx, value, label) of each row: values summed by place, with the first name that fell there; names whose
    values cancel out are left out.

    Places depend on their row alone: nothing is shuffled. Distinct names of a batch are hashed once.
    """
    if dimension <= 1024 or dimension & (dimension - 1):
        raise ValueError("the dimension must be a power of two above 1024")
    base = rows.select(F.col(key).alias("key"), features.alias("features"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(1)
                counts = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                values = flat.field(1).to_numpy(zero_copy_only=False)
                row, index, value, code, known = _place(np.repeat(np.arange(len(counts), dtype=np.int64), counts), flat.field(0), values, dimension)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(index.astype(np.int32)), pa.array(value.astype(np.float64)), known.take(pa.array(code))],
                    ["key", "idx", "value", "label"],
                )

    kind = base.schema["key"].dataType.simpleString()
    return base.mapInArrow(run, f"key {kind}, idx int, value double, label string").withColumnRenamed("key", key)


def dot(features: DataFrame, weights: DataFrame, key: str, bias: float = 0.0) -> DataFrame:
    """(key, margin): the sum of weight times value, places without a weight adding nothing, plus the bias."""
    joined = features.join(weights, "idx", "left").withColumn("c", F.coalesce(F.col("w") * F.col("value"), F.lit(0.0)))
    return joined.groupBy(key).agg((F.sum("c") + bias).alias("margin"))


def top_contributions(features: DataFrame, weights: DataFrame, key: str, most: int = 8) -> DataFrame:
    """(key, explanations): the features with the largest contributions in absolute value, ties by label.

    A message's features are bounded by the extractor's caps, and so is the list that is sorted here.
    """
    c = features.join(weights, "idx").withColumn("c", F.col("w") * F.col("value")).filter("c <> 0")
    best = c.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.abs("c")).alias("o"), F.col("label").alias("feature"), F.col("c").alias("contribution")))).alias("all"))
    return best.select(key, F.transform(F.slice("all", 1, most), lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution"))).alias("explanations"))


def ngram_counts(rows: DataFrame, key: str, text: Column, n: int = 2, pattern: str = X.TOKEN_PATTERNS["words2"]) -> DataFrame:
    """(key, term, tf): word n-grams of up to n words."""
    words = rows.select(F.col(key), X.tokens(text, pattern).alias("w"))
    grams = [F.col("w")]
    for k in range(2, n + 1):
        last = F.size("w") - (k - 1)
        grams.append(F.when(last >= 1, _grams(k, last)).otherwise(F.array().cast("array<string>")))
    return words.select(key, F.explode(F.concat(*grams)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _grams(k: int, last: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(F.col("w"), i, k), " "))


def char_wb_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded by one space on each side, as a flat array."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), " "), lambda w: w != "")

    def of(n: int) -> Column:
        def cut(w: Column) -> Column:
            p = F.concat(F.lit(" "), w, F.lit(" "))
            last = F.length(p) - (n - 1)
            return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))).otherwise(
                F.array().cast("array<string>")
            )

        return F.flatten(F.transform(words, cut))

    return F.concat(*(of(n) for n in range(low, high + 1)))


def document_frequencies(terms: DataFrame, key: str) -> DataFrame:
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(rows: DataFrame, key: str, text: Column, n: int = 1, min_df: int = 2, max_df: float = 0.997, most_terms: int | None = 180_000) -> DataFrame:
    """(key, term, tfidf): 1 + ln(tf) times ln((1 + docs) / (1 + df)) + 1, L2-normalised over the vocabulary's terms.

    The vocabulary is the most frequent terms, ties by term; None keeps all terms. Spark sorts a capped one by parts, so no task sees all terms.
    All terms of distinct keys are weighed by chunks (terms.py); whether keys repeat is counted at once. Rows of a repeated or null key meet term by
    term in joins, which takes more disk.
    """
    if most_terms is None:
        each = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("size"), F.first(F.col(key).isNull()).alias("null"))
        all_ = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.count_if((F.col("n") > 1) | F.col("null")).alias("odd"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
        if not all_["odd"]:
            partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
            return terms.tfidf(rows, key, X.tokens(text, X.TOKEN_PATTERNS["words2"]), n, all_["docs"], all_["size"], min_df, max_df, partitions)
    return _joined_tfidf(rows, key, text, n, min_df, max_df, most_terms)


def _joined_tfidf(rows: DataFrame, key: str, text: Column, n: int, min_df: int, max_df: float, most_terms: int | None) -> DataFrame:
    counts = ngram_counts(rows, key, text, n)
    docs = rows.agg(F.count("*").alias("docs"))
    df = document_frequencies(counts, key).crossJoin(F.broadcast(docs)).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("docs")))  # one row
    vocabulary = df if most_terms is None else df.orderBy(F.desc("df"), "term").limit(most_terms)  # the feature's own cap
    idf = vocabulary.select("term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = counts.join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("tfidf"))


def _added(rows: np.ndarray, places: np.ndarray, counts: np.ndarray, dimension: int) -> tuple[np.ndarray, ...]:
    """(row, place, sum of counts), in order of row and place."""
    at = rows * dimension + places
    order = np.argsort(at)
    at = at[order]
    begins = np.flatnonzero(np.diff(at, prepend=-1))
    total = np.add.reduceat(counts[order], begins) if len(begins) else counts
    return at[begins] // dimension, at[begins] % dimension, total


def _counted(rows: np.ndarray, codes: np.ndarray, distinct: int) -> tuple[np.ndarray, ...]:
    """(row, code, count) of equal pairs."""
    return _added(rows, codes, np.ones(len(rows)), max(distinct, 1))


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each item, items) of a list column."""
    sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(sizes), dtype=np.int64), sizes), lists.flatten()


def _word_places(lists: pa.Array, dimension: int) -> tuple[np.ndarray, ...]:
    """(row, place, value) of words and neighbouring pairs, of unit length in a row; a batch's distinct ones are hashed once."""
    rows, flat = _flat(lists)
    coded = flat.dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    r1, c1, n1 = _counted(rows, codes, len(names))
    near = np.flatnonzero(rows[1:] == rows[:-1])
    r2, c2, n2 = _counted(rows[near], codes[near] * max(len(names), 1) + codes[near + 1], len(names) ** 2)
    pairs, which = np.unique(c2, return_inverse=True)
    first, second = (names.take(pa.array(c)) for c in np.divmod(pairs, max(len(names), 1)))
    hashes = []
    for found in (names, pc.binary_join_element_wise(first, second, " ")):
        data, edges = utf8(found)
        hashes.append(np.mod(murmur3_all(data, edges[:-1], edges[1:]).astype(np.int64), dimension))
    row, place, count = _added(np.concatenate([r1, r2]), np.concatenate([hashes[0][c1], hashes[1][which]]), np.concatenate([n1, n2]), dimension)
    return row, place, _unit(row, count, len(lists))


def _gram_places(texts: pa.Array, dimension: int, low: int = 3, high: int = 5) -> tuple[np.ndarray, ...]:
    """(row, place, value) of the character n-grams of words padded by a space on each side, of unit length in a row; a batch's distinct words are cut once."""
    rows, words = _flat(pc.split_pattern_regex(pc.fill_null(texts, ""), r"[ \t\n\x0B\f\r]+"))
    some = pc.not_equal(words, "")
    rows, words = rows[some.to_numpy(zero_copy_only=False)], words.filter(some)
    coded = words.dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    r, c, n = _counted(rows, codes, len(names))
    data, edges = utf8(pc.binary_join_element_wise(pa.scalar(" "), names, pa.scalar(" "), ""))
    letters = np.flatnonzero((data[: edges[-1]] & 0xC0) != 0x80)  # where letters begin
    owner, after = np.searchsorted(edges, letters, side="right") - 1, np.append(letters, edges[-1])
    whose, places = [], []
    for size in range(low, high + 1):
        at = np.arange(max(len(letters) - size + 1, 0))
        at = at[owner[at] == owner[at + size - 1]]
        if len(at):
            whose.append(owner[at])
            places.append(np.mod(murmur3_all(data, after[at], after[at + size]).astype(np.int64), dimension))
    if not whose:
        return r[:0], r[:0], n[:0]
    whose, places = np.concatenate(whose), np.concatenate(places)
    order = np.argsort(whose, kind="stable")
    places, many = places[order], np.bincount(whose, minlength=len(names))
    start = np.cumsum(many) - many
    each = many[c]
    inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    row, place, count = _added(np.repeat(r, each), places[np.repeat(start[c], each) + inside], np.repeat(n, each), dimension)
    return row, place, _unit(row, count, len(texts))


def _unit(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Values divided by the length of their row."""
    return values / np.sqrt(np.bincount(rows, weights=values * values, minlength=n))[rows]


def _vectors(parts: Sequence[tuple[np.ndarray, ...]], n: int, shifts: Sequence[int], size: int) -> pa.Array:
    """Sparse vectors of n rows from parts of (row, place, value), one part behind the other."""
    rows, places, values = [], [], []
    for (r, p, v), shift in zip(parts, shifts):
        rows.append(r)
        places.append(p + shift)
        values.append(v)
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    edges = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32))
    indices = pa.ListArray.from_arrays(edges, pa.array(np.concatenate(places)[order].astype(np.int32)))
    own = pa.ListArray.from_arrays(edges, pa.array(np.concatenate(values)[order]))
    return pa.StructArray.from_arrays([pa.array(np.zeros(n, dtype=np.int8)), pa.array(np.full(n, size, dtype=np.int32)), indices, own], ["type", "size", "indices", "values"])


def hashed_vectors(rows: DataFrame, text: str, output: str = "features", words: int = 1 << 18, chars: int = 1 << 17, numeric: Sequence[str] = ()) -> DataFrame:
    """Word 1-2-grams and character 3-5-grams as normalised hashed counts, with numeric columns, in one vector.

    Places are those of pyspark.ml's HashingTF. Rows go through Arrow, as lambdas over characters are many times slower; the vector
    has no list of its attributes in the schema, which every task and plan would carry.
    """

    size = words + chars + len(numeric)

    @F.arrow_udf(VectorUDT())
    def vectors(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, texts, numbers in batches:
            for start in range(0, len(texts), 64):
                own, lower, more = (x[start : start + 64] for x in (lists, texts, numbers))
                parts = [_word_places(own, words), _gram_places(lower, chars)]
                if numeric:
                    value = more.flatten().to_numpy(zero_copy_only=False)
                    held = np.flatnonzero(value)  # nulls are NaN here, and stay
                    parts.append((*np.divmod(held, len(numeric)), value[held]))
                yield _vectors(parts, len(lower), (0, words, words + chars), size)

    given = X.tokens(F.col(text), X.TOKEN_PATTERNS["words2"]), F.lower(F.col(text)), F.array(*(F.col(c).cast("double") for c in numeric)).cast("array<double>")
    return rows.withColumn(output, vectors(*given)).withMetadata(output, {"ml_attr": {"num_attrs": size}})


def tfidf_vectors(rows: DataFrame, text: str, output: str = "features", vocabulary: int = 50_000, min_df: int = 2):
    """(model parts, rows with a normalised TF-IDF vector) by pyspark.ml, for experts that want vectors."""
    rows = rows.withColumn("__w", X.tokens(F.col(text), X.TOKEN_PATTERNS["words2"]))
    counter = CountVectorizer(vocabSize=vocabulary, minDF=min_df, inputCol="__w", outputCol="__tf").fit(rows)
    counted = counter.transform(rows)
    idf = IDF(inputCol="__tf", outputCol="__i").fit(counted)
    out = Normalizer(p=2.0, inputCol="__i", outputCol=output).transform(idf.transform(counted))
    return (counter, idf), out.drop("__w", "__tf", "__i")


def structural_features(text: Column, hosts: Column, sender_domain: Column) -> list[Column]:
    """Lengths, shares and flags of a canonical text; ``hosts`` is an array, ``sender_domain`` may be ''."""
    n = F.greatest(F.length(text), F.lit(1))
    words = F.regexp_count(text, F.lit(r"\S+"))
    share = lambda pattern: F.least(F.lit(1.0), F.regexp_count(text, F.lit(pattern)) / n)
    return [
        F.log1p(F.length(text)).alias("log_chars"),
        F.log1p(words).alias("log_words"),
        F.log1p(F.size(hosts)).alias("log_hosts"),
        share(r"[A-Z]").alias("upper_share"),
        share(r"[0-9]").alias("digit_share"),
        share(r"!").alias("exclaim_share"),
        F.lower(text).rlike(r"<form\b").cast("int").alias("has_form"),
        F.least(F.lit(1.0), F.regexp_count(text, F.lit(r"<[a-zA-Z]")) / 80.0).alias("tag_density"),
        F.exists(hosts, lambda h: h.contains("xn--")).cast("int").alias("punycode"),
        F.exists(hosts, lambda h: (F.length(h) - F.length(F.replace(h, F.lit("."), F.lit("")))) >= 3).cast("int").alias("deep_host"),
        ((sender_domain != "") & ~F.array_contains(hosts, sender_domain)).cast("int").alias("foreign_sender"),
    ]


def context_tokens(action: Column, symbols: Column, most: int = 120) -> Column:
    """Pseudo-words of a scan: action, symbols, and marks of strongly positive or negative ones."""
    first = F.slice(symbols, 1, most)
    name = lambda s: X.normalise_category(s["name"])
    base = F.transform(first, lambda s: F.concat(F.lit("__sym_"), name(s)))
    high = F.transform(F.filter(first, lambda s: s["score"] >= 2), lambda s: F.concat(F.lit("__sympos_"), name(s)))
    low = F.transform(F.filter(first, lambda s: s["score"] <= -2), lambda s: F.concat(F.lit("__symneg_"), name(s)))
    return F.concat(F.array(F.concat(F.lit("__action_"), X.normalise_category(action))), base, high, low)


def numeric_row(c: dict[str, Column]) -> Column:
    """Nine numbers of a message and its scan, as an array."""
    return F.array(
        F.log1p(c["chars"]), F.log1p(c["raw_bytes"]), F.log1p(c["urls"]), F.log1p(c["attachments"]), c["html"].cast("double"),
        clip(c["rscore"] / 15.0, -3, 3), F.when(c["required"] > 0, clip(c["rscore"] / c["required"], -3, 3)).otherwise(0.0),
        F.log1p(c["symbols"]), c["base"].cast("double"),
    )


def token_ids(text: Column, vocabulary: int = 65_536, words: int = 1800, chars: int = 700, stride: int = 7) -> Column:
    """Ids of words, word pairs and strided character 5-grams for an embedding bag; 0 is left for padding."""
    w = X.tokens(text, X.TOKEN_PATTERNS["words2_48"], words)
    s = F.regexp_replace(F.lower(text), r"\s+", " ")
    last = F.least(F.length(s) - 4, F.lit(chars * stride))
    grams = F.when(last >= 1, X.bound(s, lambda v: F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(stride)), lambda i: F.substring(v, i, F.lit(5))))).otherwise(
        F.array().cast("array<string>")
    )
    every = F.concat(F.transform(w, lambda t: F.concat(F.lit("w:"), t)), F.transform(X.bigrams(w), lambda t: F.concat(F.lit("b:"), t)), F.transform(grams, lambda t: F.concat(F.lit("c:"), t)))
    return F.transform(every, lambda t: (F.pmod(F.xxhash64(t), F.lit(vocabulary - 1)) + 1).cast("int"))


def sequence_ids(text: Column, most: int = 320, vocabulary: int = 32_768) -> Column:
    """CLS, head tokens, a mark, tail tokens: at most ``most`` ids; 0 pads and 1 is CLS."""
    w = X.tokens(text, X.TOKEN_PATTERNS["words2_48"])
    ids = F.transform(w, lambda t: (F.pmod(F.xxhash64(t), F.lit(vocabulary - 3)) + 3).cast("int"))
    head = (most - 2) * 3 // 4
    tail = most - 2 - head
    long = F.concat(F.array(F.lit(1)), F.slice(ids, 1, head), F.array(F.lit(2)), F.slice(ids, F.greatest(F.size(ids) - tail + 1, F.lit(1)), F.lit(tail)))
    return F.when(F.size(ids) > most - 1, long).otherwise(F.concat(F.array(F.lit(1)), ids))


def _byte_codes(windows: pa.Array, most: int, rows: int = 256) -> Iterator[pa.Array]:
    """Each window's bytes + 1, padded by 0, ``rows`` windows at a time."""
    for start in range(0, len(windows), rows):
        own = windows[start : start + rows].to_pylist()
        out = np.zeros((len(own), most), dtype=np.int32)
        for k, w in enumerate(own):
            if w:
                out[k, : len(w)] = np.frombuffer(w, dtype=np.uint8)
                out[k, : len(w)] += 1
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * most), pa.array(out.ravel()))


def byte_window(raw: Column, most: int = 4096, head: int = 3072) -> Column:
    """The first and last bytes of a long message, as an array of byte + 1, padded by 0.

    The window is cut in the JVM, so only it travels; an expression over single bytes is many times slower than Arrow here. A
    window becomes four times as large, so a few return at a time.
    """
    tail = most - head
    cut = F.when(F.length(raw) > most, F.concat(F.substring(raw, 1, head), F.substring(raw, -tail, tail))).otherwise(raw)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for windows in batches:
            yield from _byte_codes(windows, most)

    return codes(cut)


def pair_embedding(head: Column, tail: Column) -> Column:
    """Head, tail and their absolute difference, as one array."""
    return F.concat(head, tail, F.transform(F.arrays_zip(head.alias("h"), tail.alias("t")), lambda p: F.abs(p["h"] - p["t"])))


def cosine(a: Column, b: Column) -> Column:
    z = F.arrays_zip(a.alias("a"), b.alias("b"))
    dot_ = F.aggregate(z, F.lit(0.0), lambda s, p: s + p["a"].cast("double") * p["b"].cast("double"))
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot_ / (size(a) * size(b))
