"""Training labels from facts: probes, recording and work relations, artists, releases, uploads, judge answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets as S
from ..functions import text as T

#: Fixed: relations of recordings: label, kind, and which end is derived (0 or 1).
RECORDING_RELATIONS = {
    "music video": ("mv", None, 1),
    "edit": ("related", "edit", 0),
    "remix": ("related", "remix", 0),
    "karaoke": ("related", "instrumental", 1),
    "instrumental": ("related", "instrumental", 1),
    "a cappella": ("related", "other", 1),
}
#: Fixed: performance attributes with a kind, attributes that say nothing, artist relations that relate.
PERFORMANCE_KINDS = {"live": "live", "cover": "cover", "instrumental": "instrumental", "karaoke": "instrumental"}
SKIPPED_ATTRIBUTES = ("medley", "partial")
ARTIST_RELATED = ("member of band", "subgroup", "is person", "voice actor", "perform as")
UNNAMED_SOURCES = ("isrc", "upc", "unknown_url")
UPLOAD_SOURCES = ("youtube", "nicovideo")
MV_CUT_MS, MV_DRAMA_MS, UPLOAD_GAP_MS = 15_000, 90_000, 3_000
PROBE_NEGATIVES = 3
# Where a label comes from.
WHY_RECORDING, WHY_ARTIST, WHY_NO_ARTIST, WHY_GROUP, WHY_NO_GROUP = "mb_rec_rec", "mb_artist_rel", "mb_artist_distinct", "mb_same_rg", "mb_rg_disjoint"
WHY_NO_WORK, WHY_GAP_SIBLING, WHY_GAP_DERIVED, WHY_ATTRIBUTE, WHY_SIBLING = "mb_work_disjoint", "mb_work_gap_siblings", "mb_work_gap_derived", "mb_work_attr", "mb_work_siblings"

LABEL = "struct<label:string,kind:string,derived:string,why:string>"


def _label(label: str, kind: Column | str | None = None, derived: Column | str | None = None, why: str = "") -> Column:
    def lit(x):
        return F.lit(x).cast("string") if not isinstance(x, Column) else x.cast("string")

    return F.struct(F.lit(label).alias("label"), lit(kind).alias("kind"), lit(derived).alias("derived"), F.lit(why).alias("why"))


def split_halves(entry_pairs: DataFrame, seed: str = "") -> DataFrame:
    """Pairs (entry_id, source, identifier, named) with the half, 1 or 2, that they fall in.

    An entry's named sources stand in hash order and are cut after a hash-chosen
    one; entries with fewer than two have no halves.  Sources without names fall
    to a side by hash.
    """
    rows = entry_pairs.withColumn("splits", F.max("named").over(Window.partitionBy("entry_id", "source")) & ~F.col("source").isin(*UNNAMED_SOURCES))
    sources = rows.filter("splits").select("entry_id", "source").distinct()
    place = F.sha1(F.concat_ws(":", F.lit(seed), F.col("entry_id").cast("string"), "source").cast("binary"))
    sources = sources.withColumn("k", F.row_number().over(Window.partitionBy("entry_id").orderBy(place, "source")))
    sizes = sources.groupBy("entry_id").agg(F.count("*").alias("n")).filter("n >= 2")
    draw = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(seed), F.lit("cut"), F.col("entry_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    sources = sources.join(sizes.withColumn("cut", 1 + F.pmod(draw, F.col("n") - 1)), "entry_id")
    sides = sources.select("entry_id", "source", F.when(F.col("k") <= F.col("cut"), 1).otherwise(2).alias("half"))
    out = rows.join(sizes.select("entry_id"), "entry_id", "left_semi").join(sides, ["entry_id", "source"], "left")
    coin = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(seed), F.lit("side"), F.col("entry_id").cast("string"), "source").cast("binary")), 1, 8), 16, 10).cast("long")
    return out.withColumn("half", F.coalesce("half", (1 + F.pmod(coin, F.lit(2))).cast("int"))).drop("splits")


def music_video_label(extra: Column, named: Column, audio_ms: Column, video_ms: Column, derived: Column) -> Column:
    """A music video is the same only where it can stand in for the audio."""
    extra = F.array_except(extra, F.array(F.lit("mv"), F.lit("full")))
    return (
        F.when(F.array_contains(extra, "short") | F.coalesce(video_ms < audio_ms - MV_CUT_MS, F.lit(False)), _label("related", "edit", derived, WHY_RECORDING))
        .when(S.known(extra) | S.known(named), _label("related", "alt_version", derived, WHY_RECORDING))
        .when(F.coalesce(video_ms > audio_ms + MV_DRAMA_MS, F.lit(False)), _label("unsure", why=WHY_RECORDING))
        .otherwise(_label("same", why=WHY_RECORDING))
    )


def symmetric_relations(pairs: DataFrame, ids: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations (gid0, gid1, relation) between any ids of the two entries, in either direction.

    Joined through the relation table, so the ids' cross product is never made.
    """
    a = pairs.join(ids.select(F.col("entry_id").alias("entry_a"), F.col("gid").alias("x")), "entry_a")
    ways = relations.select("gid0", "gid1", "relation", F.col("gid0").alias("x"), F.col("gid1").alias("y"), F.lit(False).alias("flip")).union(
        relations.select("gid0", "gid1", "relation", F.col("gid1").alias("x"), F.col("gid0").alias("y"), F.lit(True).alias("flip"))
    )
    b = ids.select(F.col("entry_id").alias("entry_b"), F.col("gid").alias("y"))
    return a.join(ways, "x").join(b, ["entry_b", "y"]).select("entry_a", "entry_b", "gid0", "gid1", "relation", "flip")


def relations_within(entries: DataFrame, ids: DataFrame, relations: DataFrame, same: list[str]) -> DataFrame:
    """``symmetric_relations`` of all pairs of entries that agree in the columns ``same``, entry_a < entry_b.

    Begins at the relations: pairs without one are never made.  A relation that
    stands twice is found once.
    """
    known = ids.select("entry_id", "gid").join(entries.select("entry_id", *same), "entry_id")
    x = known.select(F.col("gid").alias("gid0"), F.col("entry_id").alias("x"), *same)
    y = known.select(F.col("gid").alias("gid1"), F.col("entry_id").alias("y"), *same)
    rows = relations.select("gid0", "gid1", "relation").join(x, "gid0").join(y, ["gid1", *same]).filter("x <> y")
    return rows.select(F.least("x", "y").alias("entry_a"), F.greatest("x", "y").alias("entry_b"), "gid0", "gid1", "relation", (F.col("x") > F.col("y")).alias("flip")).distinct()


def recording_labels(found: DataFrame, recordings: DataFrame) -> DataFrame:
    """One label for each pair of entries from its recording relations, where they agree.

    ``found`` is as ``symmetric_relations`` returns it; ``recordings`` has gid,
    length_ms, markers and versions.
    """
    names = list(RECORDING_RELATIONS)
    rows = found.filter(F.col("relation").isin(*names))
    one = recordings.select(F.col("gid").alias("gid0"), F.col("length_ms").alias("ms0"), F.col("markers").alias("m0"), F.col("versions").alias("v0"))
    two = recordings.select(F.col("gid").alias("gid1"), F.col("length_ms").alias("ms1"), F.col("markers").alias("m1"), F.col("versions").alias("v1"))
    rows = rows.join(one, "gid0", "left").join(two, "gid1", "left")
    none = F.array().cast("array<string>")
    m0, m1, v0, v1 = (F.coalesce(c, none) for c in ("m0", "m1", "v0", "v1"))
    label = F.lit(None).cast(LABEL)
    for name, (kind_of, kind, end) in RECORDING_RELATIONS.items():
        derived = F.when(F.col("flip") == (end == 0), F.lit("b")).otherwise(F.lit("a"))
        value = music_video_label(F.array_except(m1, m0), F.array_except(v1, v0), F.col("ms0"), F.col("ms1"), derived) if kind_of == "mv" else _label(kind_of, kind, derived, WHY_RECORDING)
        label = F.when(F.col("relation") == name, value).otherwise(label)
    return resolved(rows.select("entry_a", "entry_b", label.alias("l")))


def resolved(labels: DataFrame) -> DataFrame:
    """Conflicts: "unsure" gives way to others; exactly one label must be left."""
    rows = labels.groupBy("entry_a", "entry_b").agg(F.collect_set("l").alias("ls"))
    sure = F.filter("ls", lambda x: x["label"] != "unsure")
    left = F.when(F.size(sure) > 0, sure).otherwise(F.col("ls"))
    return rows.filter(F.size(left) == 1).select("entry_a", "entry_b", F.get(left, F.lit(0)).alias("l")).select("entry_a", "entry_b", "l.*")


def work_label(works_a: Column, works_b: Column, attributes_a: Column, attributes_b: Column, shared_a: Column, shared_b: Column, gap_a: Column, gap_b: Column, other_performer: Column) -> Column:
    """Label of two tracks from the works they perform.

    ``shared_*`` are the attributes on the one shared work, ``gap_*`` the years
    from its first recording (null: unknown), ``attributes_*`` those on any work.
    """
    skip = F.array(*map(F.lit, SKIPPED_ATTRIBUTES))

    def kinds(c: Column) -> Column:
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.array_contains(c, k), F.lit(v)) for k, v in PERFORMANCE_KINDS.items()]))))

    clean = F.struct(F.array_remove(shared_a, "demo").alias("a"), F.array_remove(shared_b, "demo").alias("b"))
    none = F.lit(None).cast(LABEL)

    def decide(x: Column) -> Column:
        ka, kb, kind, n = x["ka"], x["kb"], F.get(F.array_sort(F.array_union(x["ka"], x["kb"])), F.lit(0)), x["n"]
        gaps = x["ga"].isNotNull() & x["gb"].isNotNull() & (x["other"] | S.known(ka) | S.known(kb))
        lo, hi = F.least(x["ga"], x["gb"]), F.greatest(x["ga"], x["gb"])
        return (
            F.when((n == 0) & x["skip"], none)
            .when(n == 0, _label("unrelated", why=WHY_NO_WORK))
            .when((n > 1) | x["skip_shared"], none)
            .when(gaps & (lo >= 2), _label("sibling", kind, why=WHY_GAP_SIBLING))
            .when(gaps & (lo <= 1) & (hi >= 2), _label("related", kind, F.when(x["ga"] > x["gb"], F.lit("a")).otherwise(F.lit("b")), WHY_GAP_DERIVED))
            .when(~S.known(ka) & ~S.known(kb), none)
            .when(S.known(ka) & ~S.known(kb), _label("related", kind, "a", WHY_ATTRIBUTE))
            .when(S.known(kb) & ~S.known(ka), _label("related", kind, "b", WHY_ATTRIBUTE))
            .otherwise(_label("sibling", kind, why=WHY_SIBLING))
        )

    # What the rules ask for is bound once per row; each rule then reads it.
    facts = F.transform(F.array(clean), lambda c: F.struct(
        F.size(F.array_intersect(works_a, works_b)).alias("n"), kinds(c["a"]).alias("ka"), kinds(c["b"]).alias("kb"), (S.overlap(c["a"], skip) | S.overlap(c["b"], skip)).alias("skip_shared"),
        (S.overlap(attributes_a, skip) | S.overlap(attributes_b, skip)).alias("skip"), gap_a.alias("ga"), gap_b.alias("gb"), other_performer.alias("other"),
    ))
    return F.when(S.both_known(works_a, works_b), F.get(F.transform(facts, decide), F.lit(0)))


def artist_labels(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Related by one of five relations; other relations say nothing; none at all means unrelated."""
    rows = found.groupBy("entry_a", "entry_b").agg(F.max(F.col("relation").isin(*ARTIST_RELATED)).alias("related"))
    out = pairs.join(rows, ["entry_a", "entry_b"], "left")
    label = F.when(F.col("related"), _label("related", why=WHY_ARTIST)).when(F.col("related").isNull(), _label("unrelated", why=WHY_NO_ARTIST))
    return out.withColumn("l", label).filter("l is not null").select("entry_a", "entry_b", "l.*")


def release_label(groups_a: Column, groups_b: Column) -> Column:
    return F.when(S.both_known(groups_a, groups_b), F.when(S.overlap(groups_a, groups_b), _label("related", why=WHY_GROUP)).otherwise(_label("unrelated", why=WHY_NO_GROUP)))


def provider_labels(relations: DataFrame) -> DataFrame:
    """Relations that a provider asserts, with the derived side where its JSON names it."""
    derived = F.get_json_object("extra", "$.derived_entry").try_cast("long")
    side = F.when(derived == F.col("entry_a"), F.lit("left")).when(derived == F.col("entry_b"), F.lit("right"))
    return relations.filter("origin = 'provider'").select("entry_a", "entry_b", F.lit("related").alias("label"), "kind", side.alias("derived"))


def same_uploader(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate pairs of two uploads by one channel that are different songs.

    ``entries`` has entry_id, uploads_only, uploaders, durations (ms) and markers.
    """
    a = entries.select(F.col("entry_id").alias("entry_a"), F.struct("*").alias("a"))
    b = entries.select(F.col("entry_id").alias("entry_b"), F.struct("*").alias("b"))
    rows = pairs.join(a.filter("a.uploads_only"), "entry_a").join(b.filter("b.uploads_only"), "entry_b")
    return rows.filter(S.overlap("a.uploaders", "b.uploaders") & _different_songs()).select(*pairs.columns)


def _different_songs() -> Column:
    """Of structs a and b: apart in length, alike in version."""
    one = (F.size("a.durations") == 1) & (F.size("b.durations") == 1)
    gap = F.when(one, F.abs(F.get("a.durations", F.lit(0)) - F.get("b.durations", F.lit(0)))).otherwise(S.least_gap("a.durations", "b.durations"))
    versions = F.array_remove(S.symmetric_difference("a.markers", "b.markers"), "mv")
    return (gap > UPLOAD_GAP_MS) & ~S.known(versions)


def same_uploader_pairs(entries: DataFrame) -> DataFrame:
    """``same_uploader`` of all pairs of entries with a channel in common, entry_a < entry_b; they meet by channel, at the least that they share."""
    rows = entries.filter("uploads_only").select(F.explode(F.array_distinct("uploaders")).alias("channel"), F.struct("entry_id", "uploaders", "durations", "markers").alias("a"))
    rows = rows.join(rows.withColumnRenamed("a", "b"), "channel").filter("a.entry_id < b.entry_id")
    first = F.array_min(F.array_intersect("a.uploaders", "b.uploaders")) == F.col("channel")
    return rows.filter(first & _different_songs()).select(F.col("a.entry_id").alias("entry_a"), F.col("b.entry_id").alias("entry_b"))


def judge_labels(answers: DataFrame, groups: DataFrame, track_confidence: float = 0.9, other_confidence: float = 0.8) -> DataFrame:
    """Labels from judge answers (entry_a, entry_b, type, choice, confidence, kind, direction, model_verdict).

    ``groups`` (entry_id, groups) tells editions of one release group apart from
    different releases.
    """
    none = F.array().cast("array<bigint>")
    rows = answers.join(groups.select(F.col("entry_id").alias("entry_a"), F.col("groups").alias("ga")), "entry_a", "left").join(groups.select(F.col("entry_id").alias("entry_b"), F.col("groups").alias("gb")), "entry_b", "left")
    track = F.col("type") == "track"
    sure = (F.col("choice") != "unsure") & (F.col("confidence") >= F.when(track, track_confidence).otherwise(other_confidence))
    kind = F.when(F.col("kind") != "not_applicable", F.col("kind"))
    side = F.when(F.col("direction") == "a_is_original", F.lit("right")).when(F.col("direction") == "b_is_original", F.lit("left"))
    of_track = (
        F.when(F.col("choice") == "same_identity", _label("same"))
        .when(F.col("choice") == "derived", _label("related", kind, side))
        .when(F.col("choice") == "sibling", _label("sibling", kind))
        .when(F.col("choice") == "unrelated", _label("unrelated"))
    )
    edition = (F.col("type") == "release") & S.overlap(F.coalesce("ga", none), F.coalesce("gb", none))
    of_other = F.when(F.col("choice") == "same_identity", _label("same")).when(edition, _label("related")).when(F.col("model_verdict") != "RELATE", _label("unrelated"))
    rows = rows.filter(sure).withColumn("l", F.when(track, of_track).otherwise(of_other)).filter("l is not null")
    return rows.select("entry_a", "entry_b", "type", "l.label", "l.kind", "l.derived", F.concat(F.lit("judge_"), "choice").alias("why"), "confidence")


def half_view_negatives(examples: DataFrame, halves: DataFrame, per_entry: int = PROBE_NEGATIVES, seed: str = "") -> DataFrame:
    """Negatives built like probes: a half of a probe entry against a half (or all) of the other entry.

    ``examples`` has entry_a, entry_b, label, kind, derived ("left"/"right"); ``halves``
    the entry ids that have halves.  Choices are made by hash.
    """
    both = examples.select(F.col("entry_a").alias("entry"), F.col("entry_b").alias("other"), "*").union(examples.select(F.col("entry_b").alias("entry"), F.col("entry_a").alias("other"), "*"))
    rows = both.join(halves.select(F.col("entry_id").alias("entry")), "entry", "left_semi")

    def draw(name: str) -> Column:
        return F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(seed), F.lit(name), F.col("entry").cast("string"), F.col("other").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")

    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("entry").orderBy(draw("order"), "other"))).filter(F.col("k") <= per_entry)
    rows = rows.join(halves.select(F.col("entry_id").alias("other"), F.lit(True).alias("other_has")), "other", "left")
    first = draw("side") % 2 == 0  # the probe entry's half stands left
    derived_entry = F.when(F.col("derived") == "left", F.col("entry_a")).when(F.col("derived") == "right", F.col("entry_b"))
    derived = F.when(derived_entry.isNotNull(), F.when((derived_entry == F.col("entry")) == first, F.lit("left")).otherwise(F.lit("right")))
    return rows.select(
        "entry", "other", (1 + draw("half") % 2).cast("int").alias("half"), F.when(F.col("other_has"), (1 + draw("other") % 2).cast("int")).alias("other_half"),
        first.alias("entry_left"), "label", "kind", derived.alias("derived"),
    )


def without_held_out(pairs: DataFrame, held_out: DataFrame) -> DataFrame:
    """Pairs neither of whose entries (entry_id) is held out."""
    out = pairs.join(held_out.select(F.col("entry_id").alias("entry_a")), "entry_a", "left_anti")
    return out.join(held_out.select(F.col("entry_id").alias("entry_b")), "entry_b", "left_anti").select(pairs.columns)


def with_split(examples: DataFrame) -> DataFrame:
    """dev where either entry is, else train."""
    return examples.withColumn("split", F.when(T.is_dev(F.col("entry_a")) | T.is_dev(F.col("entry_b")), F.lit("dev")).otherwise(F.lit("train")))


def resolve_records(judgements: DataFrame, entry_of: DataFrame) -> DataFrame:
    """Adjudicated items whose either side resolves to exactly one entry, the two distinct; first of a pair.

    ``judgements``: item_id, relation, has_relations, left and right (arrays of
    "source:identifier").
    """
    def side(name: str) -> DataFrame:
        rows = judgements.select("item_id", F.explode(name).alias("r"))
        rows = rows.select("item_id", F.substring_index("r", ":", 1).alias("source"), F.expr("substring(r, instr(r, ':') + 1)").alias("identifier"))
        found = rows.join(entry_of.select("source", "identifier", "entry_id"), ["source", "identifier"])
        return found.groupBy("item_id").agg(F.min("entry_id").alias(name), F.max("entry_id").alias("hi")).filter(F.col(name) == F.col("hi")).drop("hi")

    rows = judgements.select("item_id", "relation", "has_relations").join(side("left"), "item_id").join(side("right"), "item_id").filter("left <> right")
    identity = F.when(F.col("relation") == "same_identity", F.lit("same")).when(F.col("relation") == "different_identity", F.when(F.col("has_relations"), F.lit("related")).otherwise(F.lit("different")))
    rows = rows.select(F.least("left", "right").alias("lo"), F.greatest("left", "right").alias("hi"), "item_id", identity.alias("identity"))
    return rows.groupBy("lo", "hi").agg(F.min_by("identity", "item_id").alias("identity")).filter("identity is not null")
