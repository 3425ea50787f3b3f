"""Evidence cards: what a labeller sees of an entry, as bounded sorted lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets as S
from ..functions import text as T

#: Fixed: list lengths, roles that count, sources whose names come last.
MOST = {"aliases": 30, "sources": 25, "dates": 6, "artists": 10, "releases": 8, "children": 30, "credits": 12}
MOST_CREDIT_ROWS = 200
ROLES = ("vocal", "arranger", "remixer", "Arranged By")
LATE_SOURCES = ("youtube", "nicovideo", "soundcloud", "unknown_url")
PAIR = ["source", "identifier"]


def entry_names(tables: dict[str, DataFrame]) -> DataFrame:
    """An entry's best name: primary ones, then clean sources, then by source and name; its number without any."""
    pairs = tables["entry_source"].select(*PAIR, "entry_id")
    place = F.struct(~F.coalesce("primary", F.lit(False)), F.col("source").isin(*LATE_SOURCES), "source", "name")
    named = pairs.join(tables["entry_alias"].drop("id"), PAIR).groupBy("entry_id").agg(F.min_by("name", place).alias("name"))
    every = pairs.select("entry_id").distinct().join(named, "entry_id", "left")
    return every.select("entry_id", F.coalesce("name", F.concat(F.lit("#"), F.col("entry_id").cast("string"))).alias("name"))


def _listed(rows: DataFrame, order: list[Column], most: int, name: str, names: DataFrame) -> DataFrame:
    """Other entries (entry_id, other, extra) in order, each once, the first ``most`` with their names."""
    place = F.struct(*order) if order else F.struct("other", "extra")
    once = rows.filter("other <> entry_id").groupBy("entry_id", "other").agg(F.min(F.struct(place.alias("place"), "extra")).alias("r"))
    kept = once.withColumn("k", F.row_number().over(Window.partitionBy("entry_id").orderBy("r.place", "other"))).filter(F.col("k") <= most)
    kept = kept.join(names.select(F.col("entry_id").alias("other"), "name"), "other", "left")
    listed = kept.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("k", F.col("other").alias("entry_id"), "name", F.col("r.extra").alias("extra")))).alias("l"))
    return listed.select("entry_id", F.transform("l", lambda x: x.dropFields("k")).alias(name))


def entry_cards(entries: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One card for each of ``entries`` (entry_id, entry_type)."""
    pairs = tables["entry_source"].join(entries.select("entry_id"), "entry_id", "left_semi")
    every, types, names = tables["entry_source"].select(*PAIR, "entry_id"), tables["entry"].select(F.col("id").alias("entry_id"), "entry_type"), entry_names(tables)
    url = F.when(F.col("identifier").startswith("http"), F.col("identifier"))
    facts = pairs.groupBy("entry_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("source", F.col("identifier").alias("id"), url.alias("url")))), 1, MOST["sources"]).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(S.durations(F.col("duration_ms"), F.col("duration_ms_all")))))).alias("durations"),
        F.slice(F.array_sort(F.collect_set(F.nullif("release_date", F.lit("")))), 1, MOST["dates"]).alias("dates"),
        F.array_sort(F.collect_set(F.coalesce(F.nullif("release_type", F.lit("")), F.nullif("primary_type", F.lit(""))))).alias("release_types"),
    )
    alias = pairs.select(*PAIR, "entry_id").join(tables["entry_alias"], PAIR).select("entry_id", (~F.coalesce("primary", F.lit(False))).alias("late"), "source", "name").distinct()
    alias = alias.withColumn("k", F.row_number().over(Window.partitionBy("entry_id").orderBy("late", "source", "name"))).filter(F.col("k") <= MOST["aliases"])
    alias = alias.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("k", "source", "name", (~F.col("late")).alias("primary")))).alias("a"))
    alias = alias.select("entry_id", F.transform("a", lambda x: x.dropFields("k")).alias("aliases"))

    own = pairs.select(*PAIR, "entry_id")
    artist_of = every.select(F.col("source").alias("artist_source"), F.col("identifier").alias("artist_identifier"), F.col("entry_id").alias("other"))
    credit = tables["contribution"]
    artists = own.join(credit.filter(F.col("main_artist") | F.col("role").isin(*ROLES)), PAIR).join(artist_of, ["artist_source", "artist_identifier"])
    artists = artists.join(types, "entry_id").filter("entry_type <> 'artist'").select("entry_id", "other", F.col("role").alias("extra"), F.col("id").alias("o"))
    credited = own.select(F.col("source").alias("artist_source"), F.col("identifier").alias("artist_identifier"), "entry_id").join(credit, ["artist_source", "artist_identifier"])
    credited = credited.withColumn("k", F.row_number().over(Window.partitionBy("entry_id").orderBy("id"))).filter(F.col("k") <= MOST_CREDIT_ROWS)
    credited = credited.join(every.select(*PAIR, F.col("entry_id").alias("other")), PAIR).select("entry_id", "other", F.col("role").alias("extra"), F.col("id").alias("o"))

    def place(disc: str = "disc_no", track: str = "track_no") -> Column:
        return F.concat(F.coalesce(F.col(disc).cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.col(track).cast("string"), F.lit("")))

    child = tables["entry_child"]
    up = own.select(F.col("source").alias("child_source"), F.col("identifier").alias("child_identifier"), "entry_id").join(child, ["child_source", "child_identifier"])
    up = up.join(every.join(types, "entry_id").filter("entry_type = 'release'").select(F.col("source").alias("parent_source"), F.col("identifier").alias("parent_identifier"), F.col("entry_id").alias("other")), ["parent_source", "parent_identifier"])
    up = up.join(types, "entry_id").filter("entry_type = 'track'").select("entry_id", "other", place().alias("extra"))
    down = own.select(F.col("source").alias("parent_source"), F.col("identifier").alias("parent_identifier"), "entry_id").join(child, ["parent_source", "parent_identifier"])
    down = down.join(every.join(types, "entry_id").filter("entry_type in ('track', 'release')").select(F.col("source").alias("child_source"), F.col("identifier").alias("child_identifier"), F.col("entry_id").alias("other")), ["child_source", "child_identifier"])
    down = down.join(types, "entry_id").filter("entry_type in ('release', 'release_group')").select("entry_id", "other", place().alias("extra"), "disc_no", "track_no")

    out = entries
    for part in (
        alias, facts, _listed(artists, [F.col("o")], MOST["artists"], "artists", names), _listed(up, [], MOST["releases"], "releases", names),
        _listed(down, [F.col("disc_no"), F.col("track_no")], MOST["children"], "children", names), _listed(credited, [F.col("o")], MOST["credits"], "credits", names),
    ):
        out = out.join(part, "entry_id", "left")
    return out


def blind(items: DataFrame) -> DataFrame:
    """What a labeller may see: no verdict, no stratum."""
    return items.select("item_id", "seq", "type", "a", "b")


def audit_row(scored: DataFrame) -> DataFrame:
    """One CSV line for each scored pair; lists of pairs are written source:identifier, joined by blanks."""

    def pairs(c: str) -> Column:
        return F.array_join(F.transform(c, lambda p: F.concat(p["source"], F.lit(":"), p["identifier"])), " ")

    listed = {c: pairs(c) for c in ("sources_a", "sources_b") if c in scored.columns}
    rows = scored.withColumns(listed) if listed else scored
    return rows.select(T.csv_row(*[F.col(c) for c in rows.columns]).alias("line"))
