"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

ENTRY = "id bigint, entry_type string"
ENTRY_SOURCE = "source string, identifier string, entry_id bigint, duration_ms bigint, duration_ms_all string, release_date string, release_type string, primary_type string"
ENTRY_ALIAS = "id bigint, source string, identifier string, name string, primary boolean"
CONTRIBUTION = "id bigint, source string, identifier string, artist_source string, artist_identifier string, role string, main_artist boolean"
ENTRY_CHILD = "parent_source string, parent_identifier string, child_source string, child_identifier string, disc_no bigint, track_no bigint"
ENTRY_RELATION = "entry_a bigint, entry_b bigint, kind string, extra string, origin string"
CATALOGUE = {"entry": ENTRY, "entry_source": ENTRY_SOURCE, "entry_alias": ENTRY_ALIAS, "contribution": CONTRIBUTION, "entry_child": ENTRY_CHILD, "entry_relation": ENTRY_RELATION}

#: Headerless tab-separated extracts of the recordings database.
EXTRACTS = {
    "rec": "gid string, length string, video string, name string, artist_credit string",
    "rec_work": "recording string, work string, attributes string",
    "rec_rec": "gid0 string, gid1 string, relation string",
    "artist_artist": "gid0 string, gid1 string, relation string",
    "artist": "gid string, type string, name string",
    "release_rg": "release string, release_group string",
    "redirect": "kind string, old_gid string, new_gid string",
    "rec_artists": "gid string, artists string",
    "rec_year": "gid string, year int",
    "work_year": "gid string, year int",
}

CANDIDATES = "verdict string, kind string, confidence double, reason string, type string, entry_a bigint, entry_b bigint, main_title_sim double"
ITEMS = "item_id string, batch string, type string, stratum string, stratum_population bigint, stratum_sample bigint, weight double, seq bigint, a struct<entry_id:bigint>, b struct<entry_id:bigint>"
LABELS = "item_id string, type string, identity string, kind string, note string, confidence double, updated_at string"
_PAIR = "array<string>"
EXAMPLES = f"tier string, type string, label string, kind string, derived string, `left` array<{_PAIR}>, `right` array<{_PAIR}>, entry_a bigint, entry_b bigint, meta struct<why:string,stratum:string,conf:double>, split string"
#: Names arrive as [name, primary] with two types in one array: read as strings.
FACTS = (
    "source string, identifier string, entry_id bigint, entry_type string, names array<array<string>>, durations array<double>, release_date string, release_type string, primary_type string, "
    "contributions array<struct<artist:array<string>,artist_entry_id:bigint,artist_name:string,role:string,main:boolean>>, "
    "parents array<struct<entry_id:bigint,entry_type:string,name:string,disc:bigint,track:bigint>>, children array<struct<entry_id:bigint,entry_type:string,name:string>>, "
    "credited array<bigint>, credited_names array<string>"
)
_CHOICE = "struct<type:string,choice:string,confidence:double,probabilities:map<string,double>>"
ANSWER = f"answers struct<identity:{_CHOICE},kind:{_CHOICE},direction:{_CHOICE}>, usage struct<input_tokens:bigint>"
CACHE = "key string, request string, response string, created_at bigint"
