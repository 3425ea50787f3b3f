"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sets as S
from ..functions import text as T
from ..sources.star import table, title, title_sql
from .registry import query

_EDGE_L, _EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
#: Words of distinct titles that are broadcast at most.
_BROADCAST_WORDS = 100_000
#: Distinct words of titles that are looked for within each document's own array at most.
_LISTED_WORDS = 2_000


@query(r"""
SELECT doc_id, sha1(n) AS norm_sha1, length(n)::BIGINT AS n_chars_norm,
  len(list_distinct(list_filter(string_split_regex(n, '[^\p{L}\p{N}]+'), lambda x: x <> '')))::BIGINT AS n_tokens
FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS n FROM documents)
""")
def doc_norm(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", T.norm_fast(F.col("text")).alias("n"))
    return rows.select("doc_id", F.sha1(F.col("n").cast("binary")).alias("norm_sha1"), F.length("n").cast("long").alias("n_chars_norm"), F.size(T.tokens(F.col("n"))).cast("long").alias("n_tokens"))


@query("SELECT sha1(text) AS text_sha1, count(*)::BIGINT AS copies, min(doc_id)::BIGINT AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def doc_exact_dups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("k"), F.sha1(F.col("text").cast("binary")).alias("text_sha1"))
    return rows.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1").drop("k")


@query(rf"""
WITH n AS (SELECT DISTINCT lower({title_sql()}) AS name FROM part),
s AS (SELECT name, regexp_replace(name, '[^\p{{L}}\p{{N}}]+', '', 'g') AS s FROM n),
g AS (SELECT name, list_distinct(list_transform(range(1, greatest(length(s) - 1, 2)), lambda i: substr(s, i, 3))) AS g FROM s),
t AS (SELECT DISTINCT name, unnest(list_filter(string_split_regex(name, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS t FROM n),
p AS (SELECT DISTINCT a.name AS a, b.name AS b FROM t a JOIN t b ON a.t = b.t AND a.name < b.name)
SELECT a, b, round(len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))), 6) AS tri_jacc
FROM p JOIN g x ON x.name = a JOIN g y ON y.name = b
""")
def trigram_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct titles that share a token, and their trigram similarity."""
    names = table(spark, sf, "part").select(F.lower(title()).alias("name")).distinct()
    names = names.select("name", T.trigrams(F.col("name")).alias("g"), T.tokens(F.col("name")).alias("t"))
    token = names.select("name", F.explode("t").alias("t"))
    pairs = token.select(F.col("name").alias("a"), "t").join(token.select(F.col("name").alias("b"), "t"), "t").filter("a < b").select("a", "b").distinct()
    rows = pairs.join(names.select(F.col("name").alias("a"), F.col("g").alias("ga")), "a").join(names.select(F.col("name").alias("b"), F.col("g").alias("gb")), "b")
    return rows.select("a", "b", F.round(S.jaccard("ga", "gb"), 6).alias("tri_jacc"))


@query(r"""
WITH f AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS t FROM documents),
b AS (SELECT DISTINCT list_sort(list_distinct(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS u FROM part),
w AS (SELECT u, unnest(u) AS w FROM b), x AS (SELECT doc_id, t, unnest(t) AS w FROM f),
s AS (SELECT doc_id, t, u, count(*) AS n FROM (SELECT DISTINCT doc_id, t, w FROM x) x JOIN w USING (w) GROUP BY ALL)
SELECT f.doc_id, coalesce(max(round(n / (len(s.t) + len(u) - n), 6)), 0.0::DOUBLE) AS tok_max FROM (SELECT DISTINCT doc_id FROM f) f LEFT JOIN s USING (doc_id) GROUP BY f.doc_id
""")
def token_jaccard_max(spark: SparkSession, sf: str) -> DataFrame:
    """Best token similarity of each document with any title; 0 where none shares a token."""
    docs = table(spark, sf, "documents").select("doc_id", T.tokens(F.lower("text")).alias("t"))
    titles = table(spark, sf, "part").select(F.array_sort(T.tokens(F.lower("p_name"))).alias("u")).distinct()
    words = titles.select("u", F.explode("u").alias("w"))
    known = [r.w for r in words.select("w").distinct().limit(_LISTED_WORDS + 1).collect()]
    if len(known) <= min(_LISTED_WORDS, _BROADCAST_WORDS):
        return _best_of_listed(docs, words, known)
    if words.count() <= _BROADCAST_WORDS:
        words = F.broadcast(words)
    # Rows of one doc_id may differ in text; those with the same tokens count as one.
    tokens = docs.select("doc_id", F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("line"), F.size("t").alias("n"), F.explode("t").alias("w"))
    shared = tokens.join(words, "w").groupBy("doc_id", "line", "n", "u").agg(F.size(F.collect_set("w")).alias("both"))
    best = shared.select("doc_id", F.round(F.col("both") / (F.col("n") + F.size("u") - F.col("both")), 6).alias("tok_max"))
    return docs.select("doc_id", F.lit(0.0).alias("tok_max")).unionByName(best).groupBy("doc_id").agg(F.max("tok_max").alias("tok_max"))


def _best_of_listed(docs: DataFrame, words: DataFrame, known: list[str]) -> DataFrame:
    """Best similarity where titles have few distinct words: a document keeps those that it has and its number of words; each combination meets the titles once."""
    rows = docs.select("doc_id", F.coalesce(F.size("t"), F.lit(0)).alias("n"), F.array_sort(F.array_intersect("t", F.array(*map(F.lit, known)).cast("array<string>"))).alias("s"))
    every = rows.filter("size(s) > 0").select("s").distinct()
    meets = every.select("s", F.explode("s").alias("w")).join(words, "w").groupBy("s", "u").agg(F.count("*").alias("both"))
    meets = meets.groupBy("s").agg(F.collect_set(F.struct(F.size("u").alias("size"), "both")).alias("m"))
    best = F.array_max(F.transform("m", lambda x: F.round(x["both"] / (F.col("n") + x["size"] - x["both"]), 6)))
    return rows.join(meets, "s", "left").groupBy("doc_id").agg(F.max(F.coalesce(best, F.lit(0.0))).alias("tok_max"))


_MARKS = {
    "live": rf"{_EDGE_L}live{_EDGE_R}",
    "remix": "remix",
    "instrumental": rf"instrumental|{_EDGE_L}inst{_EDGE_R}|inst\.",
    "cover": rf"{_EDGE_L}cover{_EDGE_R}",
    "short": "tv ?size|short ?ver",
    "mv": rf"{_EDGE_L}mv{_EDGE_R}",
    "ver": rf"{_EDGE_L}ver{_EDGE_R}|ver\.|version",
    "demo": rf"{_EDGE_L}demo{_EDGE_R}",
    "full": "full ?ver|full size",
}


@query(f"SELECT p_partkey, {', '.join(f'regexp_matches(t, {chr(39)}{p}{chr(39)}) AS m_{k}' for k, p in _MARKS.items())} FROM (SELECT p_partkey, lower(replace({title_sql()}, 'ＦＵＬＬ', 'full')) AS t FROM part)")
def marker_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Version markers of every title, after full normalisation of the distinct ones."""
    parts = table(spark, sf, "part").select("p_partkey", title().alias("name"))
    marks = parts.select("name").distinct().withColumn("m", T.markers(T.norm("name")))
    return parts.join(marks, "name").select("p_partkey", *[F.array_contains("m", k).alias(f"m_{k}") for k in _MARKS])


def _normed(parts: DataFrame) -> DataFrame:
    """Adds ``t``, the title after full normalisation of the distinct ones."""
    parts = parts.withColumn("name", title())
    return parts.join(parts.select("name").distinct().withColumn("t", T.norm("name")), "name", "left")


@query(rf"""
WITH t AS (SELECT p_partkey, p_name, p_brand, lower(replace({title_sql()}, 'ＦＵＬＬ', 'full')) AS t FROM part),
m AS (SELECT p_partkey, p_name, p_brand, {', '.join(f"regexp_matches(t, '{p}') AS m_{k}" for k, p in _MARKS.items())} FROM t)
SELECT a.p_partkey AS entry_a, b.p_partkey AS entry_b, {', '.join(f"(a.m_{k} <> b.m_{k})::INT::DOUBLE AS m_xor_{k}, (a.m_{k} AND b.m_{k})::INT::DOUBLE AS m_both_{k}" for k in _MARKS)}
FROM m a JOIN m b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
""")
def marker_pair_features(spark: SparkSession, sf: str) -> DataFrame:
    """Markers of both sides of every pair."""
    parts = _normed(table(spark, sf, "part")).select("p_partkey", "p_name", "p_brand", T.markers(F.col("t")).alias("m"))
    a = parts.select(F.col("p_partkey").alias("entry_a"), "p_name", "p_brand", F.col("m").alias("ma"))
    b = parts.select(F.col("p_partkey").alias("entry_b"), "p_name", "p_brand", F.col("m").alias("mb"))
    rows = a.join(b, ["p_name", "p_brand"]).filter("entry_a < entry_b")
    out = []
    for k in _MARKS:
        x, y = F.array_contains("ma", k), F.array_contains("mb", k)
        out += [S.flag(x != y).alias(f"m_xor_{k}"), S.flag(x & y).alias(f"m_both_{k}")]
    return rows.select("entry_a", "entry_b", *out)


@query(rf"""
SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '([\p{{L}}\p{{N}}_]+)\s*ver(?:sion|\.)?', 1))), '|') AS versions
FROM (SELECT p_partkey, lower(replace({title_sql()}, 'ＦＵＬＬ', 'full')) AS t FROM part)
""")
def named_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Named versions of every title."""
    return _normed(table(spark, sf, "part")).select("p_partkey", F.array_join(F.array_sort(T.named_versions(F.col("t"))), "|").alias("versions"))


@query(rf"""
WITH t AS (SELECT p_partkey, lower(replace({title_sql()}, 'ＦＵＬＬ', 'full')) AS t FROM part),
b AS (SELECT p_partkey, t, regexp_replace(t, '[\(\[][^\)\]]*[\)\]]', ' ', 'g') AS b FROM t),
s AS (SELECT p_partkey, t, CASE WHEN trim(b) <> '' THEN b ELSE t END AS b FROM b)
SELECT p_partkey, trim(regexp_replace(CASE WHEN trim(regexp_replace(b, '\s*/\s*[^/]*$', '')) <> '' THEN regexp_replace(b, '\s*/\s*[^/]*$', '') ELSE b END, '\s+', ' ', 'g')) AS stripped,
  array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[\(\[]([^\)\]]*)[\)\]]', 1))), '|') AS brackets
FROM s
""")
def bracket_title(spark: SparkSession, sf: str) -> DataFrame:
    """Titles without brackets and tails, and what stood in the brackets."""
    rows = _normed(table(spark, sf, "part")).select("p_partkey", "t")
    rows = rows.withColumn("b", T._unless_empty(F.regexp_replace("t", T.BRACKETS, " "), F.col("t")))
    tail = F.regexp_replace("b", T.java(T.SLASH_TAIL), "")
    return rows.select("p_partkey", T.collapse(T._unless_empty(tail, F.col("b"))).alias("stripped"), F.array_join(F.array_sort(T.bracket_contents(F.col("t"))), "|").alias("brackets"))


def core_sql() -> str:
    """Core titles and artist cores of ASCII names, where \\b needs no lookbehind; one step a column."""
    def trim(x: str) -> str:
        return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

    steps = ["SELECT *, regexp_replace(norm, 'hololive', '', 'g') AS t0 FROM n"]
    for k, (pattern, new) in enumerate(((r"[\(\[<][^\)\]>]*[\)\]>]", " "), (r"\s*[/|]\s*[^/|]*$", "")), 1):
        cut = f"regexp_replace(t{k - 1}, '{pattern}', '{new}', 'g')"
        steps.append(f"SELECT *, CASE WHEN {trim(cut)} <> '' THEN {cut} ELSE t{k - 1} END AS t{k} FROM s{k - 1}")
    for k, p in enumerate(T.MARKERS.values(), 3):
        steps.append(f"SELECT *, regexp_replace(t{k - 1}, '{p}', ' ', 'g') AS t{k} FROM s{k - 1}")
    last = len(steps) - 1
    names = ["norm AS a0"]
    ctes = ", ".join(f"s{k} AS ({q})" for k, q in enumerate(steps))
    wraps = [f"SELECT *, {names[0]} FROM s{last}"]
    for k, p in enumerate(T.ARTIST_STRIP, 1):
        cut = trim(f"regexp_replace(a{k - 1}, '{p}', '', 'g')")
        wraps.append(f"SELECT *, CASE WHEN {cut} <> '' THEN {cut} ELSE a{k - 1} END AS a{k} FROM w{k - 1}")
    ctes += ", " + ", ".join(f"w{k} AS ({q})" for k, q in enumerate(wraps))
    end = len(wraps) - 1
    marks = ", ".join(f"CASE WHEN regexp_matches(t0, '{p}') THEN '{k}' END" for k, p in T.MARKERS.items())
    return f"""
WITH n AS (SELECT DISTINCT {title_sql()} AS name, trim(regexp_replace(lower(replace({title_sql()}, 'ＦＵＬＬ', 'full')), '\\s+', ' ', 'g')) AS norm FROM part), {ctes}
SELECT name, norm, regexp_replace(regexp_replace(t{last}, '\\s+', ' ', 'g'), '^[ _~-]+|[ _~-]+$', '', 'g') AS core, regexp_replace(a{end}, '[\\s._-]+', '', 'g') AS artist_core,
  array_to_string(list_filter([{marks}], lambda x: x IS NOT NULL), '|') AS markers, regexp_matches(norm, '^\\[?(private video|deleted video|untitled|unknown)\\]?$') AS placeholder,
  regexp_matches(a{end}, '^(release|various artists|v\\.?a\\.?|unknown artist|anonymous|traditional)$') AS generic, false AS cjk FROM w{end}"""


@query(core_sql())
def core_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Core titles and artist cores of the distinct titles."""
    from ..operators.names import name_table

    names = name_table(table(spark, sf, "part").select(title().alias("name")))
    return names.select("name", "norm", "core", "artist_core", F.array_join("markers", "|").alias("markers"), "placeholder", "generic", "cjk")


@query(r"""
WITH u AS (SELECT page_id, regexp_replace(regexp_extract(url, '^.*?://(.*)$', 1), '[?#].*$', '') AS rest FROM pages),
s AS (SELECT page_id, list_filter(string_split(rest, '/'), lambda x: x <> '') AS parts FROM u),
n AS (SELECT page_id, regexp_replace(parts[-1], '^@+', '') AS name FROM s)
SELECT page_id, CASE WHEN name = '' OR name = 'watch' OR regexp_matches(name, '^(id)?[0-9]+$') OR regexp_matches(name, '^[0-9a-fA-F]{20,}$') OR regexp_matches(name, '^[A-Z][0-9]{4,}$')
  OR (length(name) >= 15 AND regexp_matches(name, '[0-9]') AND regexp_matches(name, '[A-Z]') AND regexp_matches(name, '[a-z]')) THEN NULL ELSE nullif(url_decode(replace(name, '+', '%2B')), '') END AS handle
FROM n
""")
def url_handle(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.handle_of_url(F.col("url")).alias("handle"))


@query(r"SELECT page_id, p[-1] AS id, CASE WHEN len(p) > 1 THEN p[-2] END AS kind FROM (SELECT page_id, string_split(regexp_replace(url, '/+$', ''), '/') AS p FROM pages)")
def url_last_segment(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.id_of_url(F.col("url")).alias("id"), T.kind_of_url(F.col("url")).alias("kind"))


@query(r"SELECT doc_id, len(d)::BIGINT AS n_numbers, array_to_string(list_sort(d), ',') AS numbers FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '\p{Nd}+')) AS d FROM documents)")
def doc_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = T.digits(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(d).cast("long").alias("n_numbers"), F.array_join(F.array_sort(d), ",").alias("numbers"))


@query(rf"""
WITH t AS (SELECT p_partkey, p_name, p_brand, trim(lower({title_sql()})) AS t FROM part),
d AS (SELECT *, list_distinct(regexp_extract_all(t, '\p{{Nd}}+')) AS d FROM t)
SELECT a.p_partkey AS entry_a, b.p_partkey AS entry_b, least(length(a.t), length(b.t)) / greatest(length(a.t), length(b.t), 1) AS len_ratio,
  (len(a.d) > 0 AND len(b.d) > 0 AND list_sort(a.d) <> list_sort(b.d))::INT::DOUBLE AS num_conflict, ((len(a.d) > 0) <> (len(b.d) > 0))::INT::DOUBLE AS num_xor
FROM d a JOIN d b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
""")
def digit_conflict(spark: SparkSession, sf: str) -> DataFrame:
    t = T.norm_fast(title())
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", t.alias("t"), T.digits(t).alias("d"))
    a = parts.select(F.col("p_partkey").alias("entry_a"), "p_name", "p_brand", F.col("t").alias("ta"), F.col("d").alias("da"))
    b = parts.select(F.col("p_partkey").alias("entry_b"), "p_name", "p_brand", F.col("t").alias("tb"), F.col("d").alias("db"))
    rows = a.join(b, ["p_name", "p_brand"]).filter("entry_a < entry_b")
    conflict = S.both_known("da", "db") & S.known(S.symmetric_difference("da", "db"))
    return rows.select("entry_a", "entry_b", S.ratio(F.length("ta"), F.length("tb")).alias("len_ratio"), S.flag(conflict).alias("num_conflict"), S.flag(S.known("da") != S.known("db")).alias("num_xor"))


@query("SELECT c_custkey, CASE WHEN list_sum(list_transform(string_split(sha1('lm-' || c_custkey::VARCHAR), ''), lambda x: ('0x' || x)::INT)) % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM customer")
def dev_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.when(T.is_dev(F.col("c_custkey")), F.lit("dev")).otherwise(F.lit("train")).alias("split"))


def _csv_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches(coalesce({c}::VARCHAR, ''), '[,\"\\n\\r]') THEN '\"' || replace({c}::VARCHAR, '\"', '\"\"') || '\"' ELSE coalesce({c}::VARCHAR, '') END"


@query(f"SELECT p_partkey, concat({_csv_sql('p_partkey')}, ',', {_csv_sql('name')}, ',', {_csv_sql('p_size')}, ',', {_csv_sql('note')}) AS line FROM (SELECT p_partkey, p_size, p_name || CASE WHEN p_partkey % 3 = 0 THEN ', \"' || p_brand || '\"' ELSE '' END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS note FROM part)")
def csv_row(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(', "'), F.col("p_brand"), F.lit('"'))).otherwise(F.lit("")))
    note = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))
    return parts.select("p_partkey", T.csv_row(F.col("p_partkey"), name, F.col("p_size"), note).alias("line"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce(list_sum(TRY_CAST('[' || (props->>'$.k') || ', 7]' AS BIGINT[])), 0)::BIGINT AS total, length(props)::BIGINT AS n FROM events")
def json_scalars(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    total = F.aggregate(S.json_ints(F.concat(F.lit("["), k, F.lit(", 7]"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf, "events").select("event_id", k.cast("long").alias("k"), total.alias("total"), F.length("props").cast("long").alias("n"))


@query("""
SELECT conv_id, sha256(r) AS key, length(r)::BIGINT AS n_chars FROM (
  SELECT conv_id, string_agg(turn::VARCHAR || ':' || role || ':' || sha1(text), '|' ORDER BY turn, role, text) AS r FROM conversations GROUP BY conv_id)
""")
def canonical_request_key(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered content of each request and its key."""
    turn = F.concat_ws(":", F.col("turn").cast("string"), "role", F.sha1(F.col("text").cast("binary")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", turn.alias("t")))).alias("ts"))
    r = F.array_join(F.transform("ts", lambda x: x["t"]), "|")
    return rows.select("conv_id", F.sha2(r.cast("binary"), 256).alias("key"), F.length(r).cast("long").alias("n_chars"))
