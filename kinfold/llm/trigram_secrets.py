"""Secret scans through a trigram inverted index, in DataFrame operations.

Each rule's regular expression is turned into a Boolean query over lower-case
trigrams that every match must contain: runs of the expression whose possible
strings are few are spelled out, each string needs all its trigrams, choices are
joined by OR and consecutive runs by AND.  One pass over each text, with an
expression that looks ahead from every place, lists which of the trigrams that any
rule asks for it holds; the index has their postings of document keys in blocks of
about ``BLOCK_ROWS`` documents.  A block's postings are intersected and united as
the query says, which leaves candidates; their texts are verified with the regular
expression itself.  Rules without a mandatory trigram scan every text.

Blocks bound every posting list, and documents fall in blocks by a hash, so
neither a common trigram nor a hot source gathers in one task.  Only texts of
candidates meet a join; all others' spans stay where they are found.  Candidates
are named by 64-bit keys, which can only add some to verify; what is verified is
joined back by 128 bits.

Cases: a null text is empty; empty texts have no spans; rows that repeat in full
are each returned (their key is one, their postings are united); offsets count
code points; very long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

BLOCK_ROWS = 1024
#: Strings up to which a run of an expression is spelled out.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # in the syntax that java.util.regex and re share
    group: int = 0
    least: int = 0  # code points of that group; shorter matches are dropped
    base: bool = False


#: Fixed: the base kinds, in their order. Runs below a length never match again inside, so a length
#: may stand in the pattern; where it does not, short matches are dropped after the search.
BASE_RULES = (
    Rule("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
)
#: Fixed: further kinds, by the published shapes of these credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

#: A query is a set of alternatives, each a set of trigrams; no alternatives mean no demand.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _simplify(query: set[frozenset[str]]) -> Query:
    return frozenset(a for a in query if not any(b < a for b in query))


def _and(a: Query, b: Query) -> Query:
    both = {x | y for x in a for y in b}
    if len(both) > MOST_STRINGS:
        return min(a, b, key=len) if ANY not in (a, b) else ANY
    return _simplify(both)


def _or(a: Query, b: Query) -> Query:
    return _simplify(set(a | b))


def _spelled(strings: set[str]) -> Query:
    return _simplify({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}) if strings else ANY


def _read(items) -> tuple[set[str] | None, Query]:
    """(all strings of the sequence if few, what any match of it must contain)"""
    query, run, whole = ANY, {""}, True
    for op, value in items:
        strings, needs = _one(op, value)
        if strings is not None and len(strings) * len(run) <= MOST_STRINGS:
            run = {a + b for a, b in itertools.product(run, strings)}
            continue
        query = _and(_and(query, _spelled(run)), needs if strings is None else _spelled(strings))
        run, whole = (strings if strings is not None else {""}), False
    return (run, _spelled(run)) if whole else (None, _and(query, _spelled(run)))


def _one(op, value) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(value).lower()}, ANY
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in value:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 16:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 8 else (None, ANY)
    if op is sre.SUBPATTERN:
        return _read(value[3])
    if op is sre.BRANCH:
        read = [_read(x) for x in value[1]]
        if all(s is not None for s, _ in read) and sum(len(s) for s, _ in read) <= MOST_STRINGS:
            return set().union(*(s for s, _ in read)), ANY
        out = read[0][1]
        for _, q in read[1:]:
            out = _or(out, q)
        return None, out
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, body = value
        strings, needs = _read(body)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        if least == most and strings is not None and len(strings) ** least <= MOST_STRINGS:
            return {"".join(x) for x in itertools.product(strings, repeat=least)}, ANY
        return None, needs if least else ANY
    if op is sre.AT:
        return {""}, ANY
    return None, ANY


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams, of which any match of ``pattern`` contains one alternative in full."""
    return _read(parser.parse(pattern))[1]


def _any_of(grams: list[str]) -> str:
    """An expression that finds, from every place, the trigram that begins there: a choice of first characters, then of the rest."""
    def quoted(s: str) -> str:
        return "".join(c if c.isalnum() else "\\" + c for c in s)

    first: dict[str, list[str]] = {}
    for g in grams:
        first.setdefault(g[0], []).append(g[1:])
    return "(?=(" + "|".join(f"{quoted(c)}(?:{'|'.join(map(quoted, rest))})" for c, rest in first.items()) + "))"


def _candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row_key, rules): indices of the rules whose query the row's trigrams satisfy."""
    queries = {i: q for i, r in enumerate(rules) if frozenset() not in (q := trigram_query(r.pattern))}
    grams = sorted({t for q in queries.values() for a in q for t in a})
    blocks = -(-rows.count() // BLOCK_ROWS) or 1
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_of(grams)), F.lit(1)))
    numbers = F.create_map(*[F.lit(x) for n, t in enumerate(grams) for x in (t, n)])
    postings = rows.select("row_key", F.explode(held).alias("t")).select(F.pmod("row_key", F.lit(blocks)).alias("block"), "row_key", numbers[F.col("t")].alias("gram"))
    postings = postings.repartition("block").groupBy("block", "gram").agg(F.collect_set("row_key").alias("rows"))
    index = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "rows"))).alias("of"))
    place = {t: n for n, t in enumerate(grams)}
    none = F.lit(None).cast("array<bigint>")

    def listed(t: str) -> Column:
        return F.coalesce(F.try_element_at("of", F.lit(place[t])), F.array().cast("array<bigint>"))

    found = []
    for i, q in queries.items():
        hits = none
        for alternative in sorted(map(sorted, q)):
            rows_in = listed(alternative[0])
            for t in alternative[1:]:
                rows_in = F.array_intersect(rows_in, listed(t))
            hits = rows_in if hits is none else F.array_union(hits, rows_in)
        found.append(F.transform(hits, _named(i)))
    pairs = index.select(F.inline(F.concat(*found)))
    return materialize(pairs.groupBy("row_key").agg(F.collect_set("rule").alias("rules")), "secret-candidates")


def _named(rule: int):
    return lambda key: F.struct(key.alias("row_key"), F.lit(rule).alias("rule"))


def _matches(rule: Rule) -> Column:
    """array<struct<start, end>> of a text's matches: between them stand the parts of a split."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = F.transform(whole, F.length)
    if rule.least:
        wide = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
    else:
        wide = F.transform(whole, lambda _: F.lit(True))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(lengths)).alias("gap"), lengths.alias("size"), wide.alias("wide"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["size"]).alias("end"))
        return F.struct((begin + x["size"]).alias("at"), F.when(x["wide"], F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.when(F.size(whole) > 0, F.aggregate(rows, start, step, lambda a: a["out"])).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """doc_id and one column of spans, array<struct<start, end>>, for each rule's kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), F.xxhash64(text, F.lit(1), "doc_id").alias("row_check"), text.alias("text"))
    candidates = _candidates(rows, rules)
    asked = [r for r in rules if frozenset() not in trigram_query(r.pattern)]
    empty = F.array().cast("array<struct<start:int,end:int>>")
    # The few candidates, each once; their texts alone meet the join.
    met = rows.join(candidates, "row_key")
    verified = met.select("row_key", "row_check", *[F.when(F.array_contains("rules", rules.index(r)), _matches(r)).otherwise(empty).alias(r.kind) for r in asked])
    verified = materialize(verified.filter(" or ".join(f"size({r.kind}) > 0" for r in asked) or "false").dropDuplicates(["row_key", "row_check"]), "secret-verified")
    everywhere = rows.select("doc_id", "row_key", "row_check", *[_matches(r).alias(r.kind) for r in rules if r not in asked])
    out = everywhere.join(verified, ["row_key", "row_check"], "left")
    return out.select("doc_id", *[F.coalesce(r.kind, empty).alias(r.kind) for r in rules])


def _listed(rules: tuple[Rule, ...]) -> Column:
    """Spans as kind:start:end, by start, then by the order of kinds, comma-joined."""

    def written(n: int, kind: str):
        return lambda s: F.struct(s["start"].alias("a"), F.lit(n).alias("n"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("t"))

    spans = F.concat(*[F.transform(r.kind, written(n, r.kind)) for n, r in enumerate(rules)])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: s["t"]), ",")


def report(scanned: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    base = tuple(r for r in rules if r.base)
    return scanned.select(
        "doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in base],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(rules).alias("spans"),
    )
