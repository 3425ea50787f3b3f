"""The judge: evidence, requests, cache keys, asking, and what an answer means.

Requests are asked once each: keys are compared with the cache and with each
other before anything is sent, and the sender runs on the executors with a few
threads a task.  Its transport is a plain function from request text to
response text, so that tests and offline runs need no network.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import sets as S
from ..functions import text as T
from ..sources import schema

#: Fixed: sources ranked after others, kinds that name a transformation, list lengths of the evidence.
VIDEO_SOURCES = ("youtube", "nicovideo", "soundcloud", "bilibili")
TRANSFORMATIONS = ("edit", "live", "remix", "instrumental", "cover", "arrangement")
MOST = {"titles": 8, "credited_names": 8, "release_tracks": 12, "track_positions": 5, "handles": 6}
MIN_CONFIDENCE = 0.95

#: Our own wording; the answers' names are the contract.
QUESTIONS = {
    "track": {
        "identity": {"type": "choice", "ask": "How do a and b relate as recordings?", "choices": ["same_identity", "derived", "sibling", "unrelated", "unsure"]},
        "kind": {"type": "choice", "ask": "If one derives from the other, what kind of version is it?", "choices": ["edit", "live", "remix", "instrumental", "cover", "arrangement", "alt_version", "not_applicable"]},
        "direction": {"type": "choice", "ask": "Which of the two is the original?", "choices": ["a_is_original", "b_is_original", "not_applicable"]},
    },
    **{t: {"identity": {"type": "choice", "ask": f"Do a and b name one {t.replace('_', ' ')}?", "choices": ["same_identity", "different_identity", "unsure"]}} for t in ("artist", "release", "release_group")},
}


def source_rank(source: Column) -> Column:
    return F.when(source.isin(*VIDEO_SOURCES), 1).otherwise(0)


def first_names_by_id(rows: DataFrame, group: str) -> DataFrame:
    """Names (group, id, name, rank) keyed by id, or by name where the id is unknown; the first in rank order counts."""
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("name:"), "name"))
    named = rows.filter("name is not null and name <> ''").withColumn("key", key)
    return named.groupBy(group, "key").agg(F.min_by("name", F.struct("rank", "name")).alias("name"))


def evidence(entries: DataFrame, aliases: DataFrame, credits: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """What the judge sees of an entry, as JSON in a fixed order of fields.

    entries: entry_id, entry_type, durations (ms), release_dates, release_types,
    primary_types, sources, identifiers.  aliases: entry_id, source, name,
    primary.  credits: entry_id, id, name, source.  parents: entry_id, id, type,
    name, disc, track, source.  children: entry_id, id, type, name, source.
    """
    title = aliases.groupBy("entry_id", "source", "name").agg(F.bool_or("primary").alias("primary"))
    title = title.withColumn("k", F.row_number().over(Window.partitionBy("entry_id").orderBy(source_rank(F.col("source")), "source", F.desc("primary"), "name"))).filter(F.col("k") <= MOST["titles"])
    title = title.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("k", "source", "name"))).alias("t"))
    title = title.select("entry_id", F.transform("t", lambda x: F.struct(x["source"].alias("source"), x["name"].alias("name"))).alias("titles"))

    def names(rows: DataFrame, name: str) -> DataFrame:
        first = first_names_by_id(rows.withColumn("rank", source_rank(F.col("source"))), "entry_id")
        return first.groupBy("entry_id").agg(F.slice(F.array_sort(F.collect_set("name")), 1, MOST[name]).alias(name))

    release = parents.filter("type = 'release'").withColumn("rank", source_rank(F.col("source")))
    # Editions collapse: a position is keyed by what is shown; release id, disc and track order them, unknown first.
    shown = release.groupBy("entry_id", "name", "disc", "track").agg(F.min_by("id", F.struct("rank", F.coalesce("id", F.lit(-1).cast("long")))).alias("id"))
    order = F.struct(F.coalesce(F.col("id") + 1, F.lit(0).cast("long")).alias("i"), F.coalesce(F.col("disc") + 1, F.lit(0).cast("long")).alias("d"), F.coalesce(F.col("track") + 1, F.lit(0).cast("long")).alias("t"), "name", "disc", "track")
    positions = shown.groupBy("entry_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, MOST["track_positions"]).alias("p"))
    positions = positions.select("entry_id", F.transform("p", lambda x: F.struct(x["name"].alias("release_title"), x["disc"].alias("disc_no"), x["track"].alias("track_no"))).alias("track_positions"))
    groups = parents.filter("type = 'release_group' and id is not null").groupBy("entry_id").agg(F.array_sort(F.collect_set("id")).alias("g"))

    rows = entries
    for part in (title, names(credits, "credited_names"), positions, names(children.filter("type = 'track'"), "release_tracks"), groups):
        rows = rows.join(part, "entry_id", "left")

    def listed(c: str, kind: str) -> Column:
        return F.coalesce(F.col(c), F.array().cast(kind))

    handles = S.first_sorted(F.transform("identifiers", T.handle_of_url), MOST["handles"])
    view = F.struct(
        "entry_type",
        listed("titles", "array<struct<source:string,name:string>>").alias("titles"),
        F.transform("durations", lambda d: d / 1000).alias("durations_sec"),
        "release_dates", "release_types", "primary_types",
        S.sorted_set("sources").alias("sources"),
        listed("credited_names", "array<string>").alias("credited_names"),
        listed("track_positions", "array<struct<release_title:string,disc_no:bigint,track_no:bigint>>").alias("track_positions"),
        listed("release_tracks", "array<string>").alias("release_tracks"),
        handles.alias("handles"),
        F.when(F.col("entry_type") == "release", listed("g", "array<bigint>")).otherwise(F.array().cast("array<bigint>")).alias("release_group_ids"),
    )
    return rows.select("entry_id", "entry_type", F.to_json(view, {"ignoreNullFields": "false"}).alias("view"))


def requests(pairs: DataFrame, views: DataFrame, model: str, questions: dict = QUESTIONS) -> DataFrame:
    """Adds the request text to pairs of one type that has questions; keys keep their order."""
    text = F.lit(None).cast("string")
    for kind, q in questions.items():
        text = F.when(F.col("entry_type") == kind, F.lit(json.dumps(q, ensure_ascii=False, separators=(",", ":")))).otherwise(text)
    rows = pairs.join(views.select(F.col("entry_id").alias("entry_a"), "entry_type", F.col("view").alias("va")), "entry_a")
    rows = rows.join(views.select(F.col("entry_id").alias("entry_b"), F.col("entry_type").alias("type_b"), F.col("view").alias("vb")), "entry_b")
    rows = rows.withColumn("questions", text).filter("entry_type = type_b and questions is not null")
    request = F.concat(F.lit('{"state":{"a":'), "va", F.lit(',"b":'), "vb", F.lit('},"model":'), F.lit(json.dumps(model)), F.lit(',"questions":'), "questions", F.lit("}"))
    return rows.select(*pairs.columns, "entry_type", request.alias("request"))


def canonical_json(text: str) -> str:
    return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def request_key(requests: pd.Series) -> pd.Series:
    """sha256 of the request with its keys sorted at every level; null where it is no JSON."""

    def key(text):
        try:
            return hashlib.sha256(canonical_json(text).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return requests.map(key)


class TransientError(Exception):
    """Worth another try, after ``after`` seconds if the server said so."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


def with_retries(send: Callable[[str], str], request: str, tries: int = 6, most_wait: float = 120.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Waits as told or twice as long each time; other errors pass through at once."""
    for n in range(tries):
        try:
            return send(request)
        except TransientError as e:
            if n + 1 == tries:
                raise
            sleep(min(most_wait, e.after if e.after is not None else 2.0**n))
    raise AssertionError


def ask(rows: DataFrame, cache: DataFrame, send: Callable[[str], str], threads: int = 12) -> tuple[DataFrame, DataFrame]:
    """(rows with response, error and cached; the answers to add to the cache)."""
    keyed = rows.withColumn("key", request_key("request"))
    known = cache.select("key", F.col("response").alias("known"))
    new = keyed.filter("key is not null").join(known, "key", "left_anti").groupBy("key").agg(F.min("request").alias("request"))

    def run(frames):
        def one(text):
            try:
                return with_retries(send, text), None
            except Exception as e:  # an error belongs to its request and does not end the batch
                return None, str(e)[:500]

        with ThreadPoolExecutor(threads) as pool:
            for pdf in frames:
                got = list(pool.map(one, pdf["request"]))
                yield pd.DataFrame({"key": pdf["key"], "request": pdf["request"], "fresh": [r for r, _ in got], "error": [e for _, e in got]})

    answered = new.mapInPandas(run, "key string, request string, fresh string, error string").persist()
    out = keyed.join(known, "key", "left").join(answered.select("key", "fresh", "error"), "key", "left")
    error = F.when(F.col("key").isNull(), F.lit("the request is not JSON")).otherwise(F.col("error"))
    out = out.select(*rows.columns, F.coalesce("known", "fresh").alias("response"), error.alias("error"), F.col("known").isNotNull().alias("cached"))
    put = answered.filter("fresh is not null").select("key", "request", F.col("fresh").alias("response"), F.unix_timestamp().alias("created_at"))
    return out, put


def _choice(answers: Column, name: str) -> Column:
    return F.when(answers[name]["type"] == "choice", answers[name]["choice"])


def answer_verdict(response: Column, entry_type: Column, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """struct(verdict, confidence, transformation, derived_side, reason); null without an identity answer."""
    a = F.from_json(response, schema.ANSWER)["answers"]
    choice, confidence = _choice(a, "identity"), a["identity"]["confidence"]
    kind, direction = F.coalesce(_choice(a, "kind"), F.lit("?")), F.coalesce(_choice(a, "direction"), F.lit("?"))
    low = choice.isin("same_identity", "derived") & (confidence < min_confidence)
    verdict = (
        F.when(low, F.lit("DEFER")).when(choice == "same_identity", F.lit("MERGE")).when(choice == "derived", F.lit("RELATE"))
        .when(choice.isin("sibling", "unrelated", "different_identity"), F.lit("DISTINCT")).otherwise(F.lit("DEFER"))
    )
    relate = verdict == "RELATE"
    side = F.when(direction == "a_is_original", F.lit("b")).when(direction == "b_is_original", F.lit("a"))
    reason = F.concat(choice, F.when(entry_type == "track", F.concat(F.lit(" (kind="), kind, F.lit(", direction="), direction, F.lit(")"))).otherwise(F.lit("")))
    return F.when(
        choice.isNotNull(),
        F.struct(
            verdict.alias("verdict"), confidence.alias("confidence"), F.when(relate & kind.isin(*TRANSFORMATIONS), kind).alias("transformation"),
            F.when(relate, side).alias("derived_side"), reason.alias("reason"),
        ),
    )


def counters(answered: DataFrame) -> DataFrame:
    """One row: cached, asked, failed and the verdicts."""
    v = answer_verdict(F.col("response"), F.col("entry_type"))["verdict"]
    good = F.col("response").isNotNull()
    return answered.withColumn("v", F.when(good, v)).agg(
        F.count_if(good & F.col("cached")).alias("cached"), F.count_if(good & ~F.col("cached")).alias("asked"), F.count_if(F.col("v").isNull()).alias("failed"),
        *[F.count_if(F.col("v") == x).alias(x.lower()) for x in ("MERGE", "RELATE", "DISTINCT", "DEFER")],
    )


def spend(answered: DataFrame, price_per_million: float = 0.042) -> DataFrame:
    """Tokens of fresh answers and their price."""
    tokens = F.from_json("response", schema.ANSWER)["usage"]["input_tokens"]
    out = answered.filter("not cached").agg(F.count("*").alias("calls"), F.coalesce(F.sum(tokens), F.lit(0).cast("long")).alias("tokens"))
    return out.withColumn("cost", F.col("tokens") * F.lit(price_per_million / 1e6))
