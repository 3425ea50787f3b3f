"""Text functions of titles and artist names, as Column expressions.

Everything but full Unicode folding is built of JVM functions.  ``norm`` needs
NFKC and case folding, which Spark has not, and is the one Arrow UDF here; apply
it to distinct names (see ``operators.names``).  The other functions expect
normalised text.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Python's classes in java.util.regex: \w, \s, and the boundary between \w and not \w.
W = r"\p{L}\p{N}_"
S = r"\s\x{85}\p{Z}\x{1c}-\x{1f}"
B = rf"(?:(?<=[{W}])(?![{W}])|(?<![{W}])(?=[{W}]))"

# Version markers and their patterns, in their order.
MARKERS = {
    "live": r"\blive\b|ライブ|生歌",
    "remix": r"remix|リミックス|\bmix\)|bootleg",
    "instrumental": r"instrumental|\binst\b|inst\.|インスト|off ?vocal|karaoke|カラオケ|backing track",
    "acoustic": r"acoustic|アコースティック|unplugged",
    "cover": r"\bcover\b|カバー|歌ってみた|歌わせていただきました",
    "medley": r"medley|メドレー",
    "short": r"tv ?size|short ?ver|short version|cut ?ver|one chorus|ショート|tv ?ver|\bshort\b|#shorts|試聴|preview|teaser|crossfade|クロスフェード",
    "mv": r"\bmv\b|music video|\bpv\b|ミュージックビデオ|official video",
    "arrange": r"arrange|アレンジ|編曲",
    "edit": r"\bedit\b|radio edit",
    "remaster": r"remaster|リマスター",
    "ver": r"\bver\b|ver\.|version|バージョン",
    "acappella": r"a ?cappella|アカペラ",
    "full": r"full ?ver|full size|フル",
    "demo": r"\bdemo\b",
    "stem": r"stem\b|multitrack|ステム|パラデータ",
    "performance": r"昼公演|夜公演|\bday ?\d|\bnight\b|公演|fes\b",
}
# Wrappers stripped from artist names, one after another.
ARTIST_STRIP = (
    r"\s*-\s*topic$",
    r"\s*\((?:cv|c\.v|vo|voice)[.:：]?[^)]*\)",
    r"\s*（(?:cv|vo)[.:：]?[^）]*）",
    r"\s*\(\d+\)$",
    r"\s*\(all\)$",
    r"様$",
    r"\s*official$",
    r"\s*公式$",
    r"\s*vevo$",
    r"\s*\bch\..*$",
    r"\s*ch\.?$",
    r"\s*channel$",
    r"\s*チャンネル$",
)
# Words and characters with a meaning of their own.
IGNORED = r"hololive|ホロライブ"
NAMED_VERSION = r"([\w぀-ヿ一-鿿]+)\s*ver(?:sion|\.)?"
PLACEHOLDER = r"^\[?(private video|deleted video|untitled|unknown)\]?$"
BRACKETS = r"[\(（\[【<＜〈《][^\)）\]】>＞〉》]*[\)）\]】>＞〉》]"
SLASH_TAIL = r"\s*[/／|｜]\s*[^/／|｜]*$"
GENERIC_ARTIST = r"^(release|various artists|ヴァリアス・アーティスト|v\.?a\.?|unknown artist|不明|anonymous|traditional)$"
CJK = r"[぀-ヿ一-鿿ｦ-ﾟ]"


def java(pattern: str) -> str:
    r"""A pattern written with Python's \b, \s, \w and \d in Java's syntax, ignoring case."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if two in (r"\b", r"\s", r"\w", r"\d"):
            body = {"b": B, "s": S, "w": W, "d": r"\p{Nd}"}[two[1]]
            out.append(body if inside or two == r"\b" else f"[{body}]")
            i += 2
            continue
        if c == "\\":
            out.append(two)
            i += 2
            continue
        inside = True if c == "[" and not inside else False if c == "]" and inside else inside
        out.append(c)
        i += 1
    return "(?iu)" + "".join(out)


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{S}]+|[{S}]+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{S}]+", " "))


@F.pandas_udf(StringType())
def norm(names: pd.Series) -> pd.Series:
    """NFKC, case folding, white space collapsed."""
    return names.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split()))


def norm_fast(c: Column) -> Column:
    """``norm`` for text without compatibility characters: lower case, white space collapsed."""
    return collapse(F.lower(c))


def trigrams(c: Column) -> Column:
    """Distinct code-point trigrams of the letters and digits; a shorter text is its own; none of an empty one."""
    s = F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    # Positions are bound once per row; the lambda only cuts.
    return F.when(s == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3))))
    )


def tokens(c: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(c, r"[^\p{L}\p{N}]+"), ""))


def without_ignored(c: Column) -> Column:
    return F.regexp_replace(c, java(IGNORED), "")


def markers(c: Column) -> Column:
    """Names of the version markers in a normalised text."""
    t = without_ignored(c)
    return F.array_compact(F.array(*[F.when(t.rlike(java(p)), F.lit(k)) for k, p in MARKERS.items()]))


def named_versions(c: Column) -> Column:
    """Words before "ver", "ver." or "version"; within "cover" too."""
    return F.array_distinct(F.regexp_extract_all(without_ignored(c), F.lit(java(NAMED_VERSION)), F.lit(1)))


def _bound(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f names it: chains of steps stay linear."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _unless_empty(new: Column, old: Column) -> Column:
    return F.when(_trim(new) != "", new).otherwise(old)


def _kept_step(c: Column, pattern: str, replacement: str) -> Column:
    """A replacement that is undone where nothing would be left."""
    return _bound(c, lambda x: _bound(F.regexp_replace(x, pattern, replacement), lambda y: _unless_empty(y, x)))


def core_title(c: Column) -> Column:
    """What names the song: no brackets, no tail after a slash, no markers."""
    t = _kept_step(without_ignored(c), BRACKETS, " ")
    t = _kept_step(t, java(SLASH_TAIL), "")
    for p in MARKERS.values():
        t = F.regexp_replace(t, java(p), " ")
    return F.regexp_replace(F.regexp_replace(t, f"[{S}]+", " "), r"^[ \-_~・]+|[ \-_~・]+$", "")


def _strip_step(pattern: str):
    return lambda x: _bound(_trim(F.regexp_replace(x, pattern, "")), lambda y: F.when(y != "", y).otherwise(x))


def artist_core_raw(c: Column) -> Column:
    """An artist's name without platform wrappers; a wrapper that is all of it stays."""
    t = c
    for p in ARTIST_STRIP:
        t = _bound(t, _strip_step(java(p)))
    return t


def artist_core(c: Column) -> Column:
    return F.regexp_replace(artist_core_raw(c), f"[{S}・._-]+", "")


def bracket_contents(c: Column) -> Column:
    inner = F.transform(F.regexp_extract_all(c, F.lit(BRACKETS), F.lit(0)), lambda x: F.trim(F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), f"[{S}]+", " ")))
    return F.array_distinct(F.array_remove(inner, ""))


def digits(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\p{Nd}+"), F.lit(0)))


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def is_placeholder(c: Column) -> Column:
    return c.rlike(java(PLACEHOLDER))


def is_generic_artist(c: Column) -> Column:
    return artist_core_raw(c).rlike(java(GENERIC_ARTIST))


def encoder_text(title: Column, artist: Column) -> Column:
    """Title conditioned on its artist, or the title alone."""
    return F.when(F.coalesce(artist, F.lit("")) != "", F.concat(title, F.lit(" [A] "), artist)).otherwise(title)


def year_of(date: Column) -> Column:
    """Year of a date string that starts with four digits; partial dates occur."""
    return F.when(date.rlike("^[0-9]{4}"), F.substring(date, 1, 4).cast("int"))


def release_type(rtype: Column, primary: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(rtype, F.lit("")), F.nullif(primary, F.lit(""))))


def url_segments(url: Column) -> Column:
    return F.split(F.regexp_replace(url, "/+$", ""), "/")


def id_of_url(url: Column) -> Column:
    """Last path segment of an entity URL."""
    return F.element_at(url_segments(url), -1)


def kind_of_url(url: Column) -> Column:
    return F.try_element_at(url_segments(url), F.lit(-2))


def url_decode(c: Column) -> Column:
    """Percent-decoding as in a path: plus signs stay, and text that does not decode stays as it is."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(decoded.isNull() | decoded.contains("�"), c).otherwise(decoded)


def handle_of_url(url: Column) -> Column:
    """A name that someone chose, from a URL's last segment; null where it looks like an opaque id."""
    rest = F.regexp_replace(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), "(?s)[?#].*$", "")
    parts = F.array_remove(F.split(rest, "/"), "")
    last = F.try_element_at(parts, F.lit(-1))
    before = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    name = F.regexp_replace(last, "^@+", "")
    opaque = (
        ~url.contains("://") | rest.startswith("youtu.be/") | (last == "watch")
        | (rest.contains("youtube.com") & before.isin("shorts", "embed", "live"))
        | (name == "") | name.rlike("^(id)?[0-9]+$") | name.rlike("^UC[A-Za-z0-9_-]{22}$")
        | ((F.length(name) == 36) & (F.size(F.split(name, "-")) == 5)) | name.rlike("^[0-9a-fA-F]{20,}$") | name.rlike("^[A-Z][0-9]{4,}$")
        | ((F.length(name) >= 15) & name.rlike("[0-9]") & name.rlike("[A-Z]") & name.rlike("[a-z]"))
    )
    return F.when(last.isNotNull() & ~opaque, F.nullif(url_decode(name), F.lit("")))


def csv_field(c: Column) -> Column:
    """RFC 4180: quoted where needed, null is empty."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_row(*columns: Column) -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in columns])


def split_digit(key: Column, buckets: int = 5) -> Column:
    """sha1(key) as a number modulo 5 or 3: 16 is 1 in either, so the hex digits' sum decides."""
    if buckets not in (3, 5):
        raise ValueError("buckets: 3 or 5")
    digit = F.transform(F.split(F.sha1(key.cast("binary")), ""), lambda d: F.when(d == "", 0).otherwise(F.conv(d, 16, 10).cast("int")))
    return F.aggregate(digit, F.lit(0), lambda a, x: a + x) % buckets


def is_dev(entry_id: Column, prefix: str = "lm-") -> Column:
    return split_digit(F.concat(F.lit(prefix), entry_id.cast("string"))) == 0
