"""Views: the facts of any set of (source, identifier) pairs, folded into one row.

A view is a whole entry or a half of one.  ``views`` takes the assignment of
pairs to views and folds each kind of fact in its own aggregation over the
pairs, so every shuffle carries one fact table and is keyed by pair or by view;
nothing is collected.  Lists are bounded where the model bounds them (40 names,
500 credits for each pair).  Orders that matter travel as columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets as S
from ..functions import text as T

#: Sources that carry videos, roles that count as credits.
VIDEO_SOURCES = ("youtube", "nicovideo", "soundcloud", "bilibili")
CREDIT_ROLES = ("listed_artist", "uploader", "vocal")
MOST_NAMES = 40
MOST_CREDITS = 500

PAIR = ["source", "identifier"]


def first_names(alias: DataFrame) -> DataFrame:
    """A pair's first name: primary ones before others, then by id."""
    return alias.groupBy(*PAIR).agg(F.min_by("name", F.struct(~F.coalesce("primary", F.lit(False)), F.col("id"))).alias("first_name"))


def best_names(entry_source: DataFrame, alias: DataFrame) -> DataFrame:
    """A pair's own first name, else that of the first pair of its entry that has one."""
    own = first_names(alias)
    pairs = entry_source.select(*PAIR, "entry_id").join(own, PAIR, "left")
    entry = pairs.groupBy("entry_id").agg(F.min_by("first_name", F.when(F.col("first_name").isNotNull(), F.struct(*PAIR))).alias("entry_name"))
    return pairs.join(entry, "entry_id", "left").select(*PAIR, F.coalesce("first_name", "entry_name").alias("best_name"))


def primary_artists(contribution: DataFrame) -> DataFrame:
    """A pair's first main listed artist, else its first uploader."""
    rank = F.when(F.col("main_artist") & (F.col("role") == "listed_artist"), 0).when(F.col("role") == "uploader", 1)
    ranked = contribution.withColumn("rank", rank).filter("rank is not null")
    artist = F.struct(F.col("artist_source").alias("source"), F.col("artist_identifier").alias("identifier"))
    return ranked.groupBy(*PAIR).agg(F.min_by(artist, F.struct("rank", "id")).alias("artist"))


def _of(pairs: DataFrame, column: Column | str, name: str) -> DataFrame:
    return pairs.groupBy("view").agg(F.array_sort(F.collect_set(column)).alias(name))


def _fold(parts: Iterable[DataFrame], base: DataFrame) -> DataFrame:
    for part in parts:
        base = base.join(part, "view", "left")
    return base


def views(assigned: DataFrame, tables: dict[str, DataFrame], years: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row for each view of ``assigned`` (view, type, source, identifier).

    ``years``, if given, has rec_year and work_year (gid, year) and rec_work
    (recording, work) of the recordings database.
    """
    source, alias, contribution, child, entry = (tables[k] for k in ("entry_source", "entry_alias", "contribution", "entry_child", "entry"))
    entry_of = source.select(*PAIR, "entry_id")
    typed = entry_of.join(entry.select(F.col("id").alias("entry_id"), "entry_type"), "entry_id")
    best = best_names(source, alias)
    base = assigned.groupBy("view").agg(F.first("type").alias("type"))

    own = assigned.join(source, PAIR)
    facts = own.groupBy("view").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(S.durations(F.col("duration_ms"), F.col("duration_ms_all")))))).alias("durations"),
        F.array_sort(F.collect_set(T.year_of(F.col("release_date")))).alias("years"),
        F.array_sort(F.collect_set(T.release_type(F.col("release_type"), F.col("primary_type")))).alias("rtypes"),
    )

    # Names in order of pair, then primary first, then id; equal encoder texts once, the first 40.
    artist = primary_artists(contribution).join(best.select(F.struct(*PAIR).alias("artist"), F.col("best_name").alias("artist_name")), "artist", "left").select(*PAIR, "artist_name")
    named = assigned.join(alias, PAIR).join(artist, PAIR, "left")
    named = named.withColumn("text", T.encoder_text(F.col("name"), F.when(F.col("type") == "track", F.col("artist_name"))))
    place = F.struct(*PAIR, ~F.coalesce("primary", F.lit(False)), "id")
    once = named.groupBy("view", "text").agg(F.min(F.struct(place.alias("place"), "source", "name", "text")).alias("n"))
    kept = once.withColumn("k", F.row_number().over(Window.partitionBy("view").orderBy("n.place"))).filter(F.col("k") <= MOST_NAMES)
    listed = kept.groupBy("view").agg(F.array_sort(F.collect_list(F.struct("k", "n.source", "n.name", "n.text"))).alias("n"))
    listed = listed.select("view", F.col("n.source").alias("name_sources"), F.col("n.name").alias("names"), F.col("n.text").alias("texts"))
    video = F.col("source").isin(*VIDEO_SOURCES)
    seen = named.groupBy("view").agg(F.bool_or(video).alias("has_video"), F.bool_and(video).alias("video_only"))

    credits_of = assigned.join(contribution, PAIR)
    artists = credits_of.filter(F.col("main_artist") | F.col("role").isin(*CREDIT_ROLES))
    artist_pair = [F.col("artist_source").alias("source"), F.col("artist_identifier").alias("identifier")]
    artist_ids = artists.select("view", *artist_pair).distinct().join(entry_of, PAIR)
    artist_names = artists.select("view", *artist_pair).distinct().join(best, PAIR).filter("best_name is not null")
    uploaders = credits_of.filter("role = 'uploader'").select("view", *artist_pair).distinct().join(entry_of, PAIR)

    above = assigned.select("view", "type", F.col("source").alias("child_source"), F.col("identifier").alias("child_identifier")).join(child, ["child_source", "child_identifier"])
    above = above.withColumnsRenamed({"parent_source": "source", "parent_identifier": "identifier"}).join(typed, PAIR)
    releases = above.filter("entry_type = 'release'")
    positions = releases.filter("track_no is not null").select("view", F.struct(F.col("entry_id").alias("release"), F.when(F.coalesce("disc_no", F.lit(0)) == 0, F.lit(1).cast("long")).otherwise(F.col("disc_no")).alias("disc"), F.col("track_no").alias("track")).alias("position"))
    groups = above.filter("type = 'release' and entry_type = 'release_group'")

    below = assigned.select("view", "type", F.col("source").alias("parent_source"), F.col("identifier").alias("parent_identifier")).join(child, ["parent_source", "parent_identifier"])
    below = below.withColumnsRenamed({"child_source": "source", "child_identifier": "identifier"})
    children = below.join(typed, PAIR).filter(F.col("entry_type").isin("track", "release"))
    child_names = below.filter("type = 'release'").join(first_names(alias), PAIR)

    artist_side = assigned.filter("type = 'artist'").select("view", F.col("source").alias("artist_source"), F.col("identifier").alias("artist_identifier"))
    first = Window.partitionBy("artist_source", "artist_identifier").orderBy("id")
    credited = contribution.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= MOST_CREDITS)
    credited = artist_side.join(credited, ["artist_source", "artist_identifier"]).join(entry_of, PAIR)

    parts = [
        facts, listed, seen, _of(artist_ids, "entry_id", "artists"), _of(artist_names, "best_name", "artist_names"), _of(uploaders, "entry_id", "uploaders"),
        _of(releases, "entry_id", "releases"), _of(positions, "position", "positions"), _of(groups, "entry_id", "groups"), _of(children, "entry_id", "children"),
        _of(child_names, "first_name", "child_names"), _of(credited, "entry_id", "credits"),
    ]
    if years:
        rec = assigned.filter((F.col("type") == "track") & (F.col("source") == "musicbrainz") & F.col("identifier").contains("/recording/"))
        rec = rec.select("view", T.id_of_url(F.col("identifier")).alias("gid"))
        parts.append(_of(rec.join(years["rec_year"], "gid"), "year", "rec_years"))
        works = rec.join(years["rec_work"].select(F.col("recording").alias("gid"), "work").distinct(), "gid")
        parts.append(_of(works.join(years["work_year"].withColumnRenamed("gid", "work"), "work"), "year", "work_first"))
    out = _fold(parts, base)
    if not years:
        out = out.withColumns({"rec_years": F.array().cast("array<int>"), "work_first": F.array().cast("array<int>")})
    arrays = [f.name for f in out.schema.fields if f.dataType.typeName() == "array"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)) for c in arrays})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_video", "video_only")})


def whole_entries(tables: dict[str, DataFrame]) -> DataFrame:
    """Each entry as one view."""
    rows = tables["entry_source"].join(tables["entry"].select(F.col("id").alias("entry_id"), F.col("entry_type").alias("type")), "entry_id")
    return rows.select(F.col("entry_id").alias("view"), "type", *PAIR)


def view_key(pairs: Column | str) -> Column:
    """A view's canonical key: its sorted distinct pairs, joined by separators that no identifier holds."""
    pairs = F.col(pairs) if isinstance(pairs, str) else pairs
    return F.array_join(F.transform(F.array_sort(F.array_distinct(pairs)), lambda p: F.concat(p["source"], F.lit("\x1f"), p["identifier"])), "\x1e")


def entry_texts(entries: DataFrame, tables: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """(entry_id, text): an entry's title, conditioned for tracks on an artist.

    The artist is that of the first pair that carries the title, else that of
    the first pair that has one.  ``entries`` has entry_id, entry_type and title.
    Entries without facts have no row; with ``strict`` they are an error.
    """
    source = tables["entry_source"].select(*PAIR, "entry_id")
    best = best_names(tables["entry_source"], tables["entry_alias"])
    artist = primary_artists(tables["contribution"]).join(best.select(F.struct(*PAIR).alias("artist"), F.col("best_name").alias("artist_name")), "artist", "left")
    carries = tables["entry_alias"].select(*PAIR, F.col("name").alias("title")).distinct().withColumn("carries", F.lit(True))
    if strict:
        known = source.select("entry_id").distinct().withColumn("known", F.lit(True))
        lost = F.raise_error(F.concat(F.lit("no facts of entry "), F.col("entry_id").cast("string")))
        entries = entries.join(known, "entry_id", "left").withColumn("title", F.when(F.col("known"), F.col("title")).otherwise(lost)).drop("known")
        # Left: an entry without facts reaches the error instead of going with the join.
        source = entries.select("entry_id", F.col("title").alias("of")).join(source, "entry_id", "left").drop("of")
    rows = entries.join(source, "entry_id").join(artist.select(*PAIR, "artist_name"), PAIR, "left").join(carries, [*PAIR, "title"], "left")
    place = F.when(F.col("artist_name").isNotNull(), F.struct(F.coalesce(~F.col("carries"), F.lit(True)), *PAIR))
    rows = rows.groupBy("entry_id", "entry_type", "title").agg(F.min_by("artist_name", place).alias("artist_name"))
    return rows.select("entry_id", T.encoder_text(F.col("title"), F.when(F.col("entry_type") == "track", F.col("artist_name"))).alias("text"))
