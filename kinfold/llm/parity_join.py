"""Exact Jaccard self-join of shingle sets by parity sketches.

A document's set holds its distinct 5-word shingles.  Sets of sizes a and b with
Jaccard similarity t or more differ in at most D = (1 - t) / (1 + t) * (a + b)
shingles.

Sketches.  In a size band (sizes from h/4 to h) every shingle falls in one of m
parts and is XOR-ed into that part's word.  A shingle changes one word only, so
the number of words in which two sketches differ is a lower bound of the
symmetric difference.

Pigeonhole.  With at most D words unlike, two similar sets have all but D of
their nonempty words in common.  Words are put in one global order, and a
document shows the first D + 1 of its nonempty words; the first word that two
similar sets share is among those of either.  Joining on shown words therefore
loses no pair, whatever the order.  It is chosen so that few pairs come up: words
made of common shingles alone, as counted in a bounded sample of the documents,
come last; the others stand by their hash.  Parts hold up to about two shingles, so a
word only matches where the whole part does; in the band of up to 64 shingles there are
as many parts as shingles, so that enough of them are not empty, and in those of up to 16 each
shingle has a part of its own.  A set also shows words at the next band up, if a partner may
lie there.

Position.  Under the first word that two sets share, all words before it are
unlike; as each pair also meets there, it may be dropped under any word where
the words before it are more than D: together where parts hold one shingle, on
either side where they hold more.

Verification.  Candidates are compared by size and by the Hamming distance of
parity sketches of four bits a shingle and more (again a lower bound) before
whole sets are joined to them, then by intersection.  A sketch's length is a power
of two, so of two the longer is folded to the other.  The same sketches, folded by XOR to 1024 bits, stand
in the rows themselves from the second round on, where words are left that many
unlike sets share.

Groups.  Equal sets are one class from the start.  Among the classes under one
word only a few pivots are compared with the rest, components are formed, and
words under which more than one component is left go on without the pivots:
every pair is either connected, or compared, so nothing is lost and the pairs
of a large group of copies are never made.

Cases: null, empty and wordless texts have no shingles and link with nothing
(each its own component); texts of one to four words have one shingle, the whole
sequence; repeated rows with one doc_id are one document each, in one class;
documents with a null id get a null component unless linked; very long texts are
read whole, their sketches grow with their sets; extra columns are ignored.

Shingles and sets are told apart by 64-bit hashes.  Two of n different sets are
taken for one with a probability of about n * n / 2 ** 65: 1e-6 for ten million
documents, while of 3e10 documents some 25 pairs are expected; a pair's
similarity is off only where two of its own shingles collide (1e-9 for sets of
a hundred thousand).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .components import connected_components
from .storage import drop, fresh, materialize

SHINGLE = 5
#: Similarity as a ratio of integers: at least 75 / 100.
NUMERATOR, DENOMINATOR = 75, 100
#: Band up to which a part holds one shingle; band up to which there are as many parts as shingles; shingles of a part above.
SINGLE_UP_TO, EVEN_UP_TO, SHINGLES_PER_PART = 16, 64, 2.2
#: Bits of a sketch, at least and for each shingle.
SKETCH_BITS, BITS_PER_SHINGLE = 2048, 4
#: Jobs in which a round's close pairs are verified, so that their sets take less disk at a time.
VERIFY_JOBS, VERIFY_PAIRS = 4, 8000
#: Documents in the sample that tells common shingles, and in how many of them one must be.
SAMPLE_ROWS, COMMON_IN = 16_000, 2
#: Most common shingles that are told apart; it bounds the broadcast and changes the order only.
MOST_COMMON = 1 << 20
#: Longs of the folded sketch that decides between rows of one word, from the second round on.
FOLDED = 16
#: Classes that a worker remembers to have shown already.
REMEMBERED = 200_000

_SETS = "doc_id bigint, n_shingles bigint, class bigint, words array<bigint>, own int, single int, sketch binary, digest binary"
_SAMPLE = "shingle bigint"
_MEMBERS = "class bigint, hashes binary"
#: Ids up to which the texts to be compared are picked by broadcast; beyond, by a shuffled join.
BROADCAST_IDS = 200_000
_LONGS = [f"k{i}" for i in range(FOLDED)]
_U = np.uint64


def shingle_set(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    n = len(hashes)
    if not n:
        return hashes
    return np.unique(W.grams(hashes, min(size, n)) ^ _U(0 if n >= size else n))


def class_of(shingles: np.ndarray) -> int:
    """A hash of the set and its size."""
    return int(W.signed(W.mix(np.add.reduce(W.mix(shingles), dtype=_U).reshape(1) ^ W.mix(np.array([len(shingles)], _U))))[0])


def _differ(a: int, b: int) -> int:
    """Most shingles in which similar sets of a and b shingles differ."""
    return (DENOMINATOR - NUMERATOR) * (a + b) // (DENOMINATOR + NUMERATOR)


class Common:
    """The shingles that come last in the order."""

    def __init__(self, shingles: np.ndarray):
        self.shingles = np.sort(shingles.astype(_U))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.shingles >> _U(42)] = True

    def among(self, values: np.ndarray) -> np.ndarray:
        out = self.maybe[values >> _U(42)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.shingles, values[at]), len(self.shingles) - 1)
            out[at] = self.shingles[place] == values[at]
        return out


def _level_words(shingles: np.ndarray, common: np.ndarray, top: int, show: int) -> np.ndarray:
    if top <= SINGLE_UP_TO:
        words, last = W.mix(shingles ^ _U(top)), common
    else:
        parts = top if top <= EVEN_UP_TO else int(top / SHINGLES_PER_PART)
        part = (shingles >> _U(32)) * _U(parts) >> _U(32)
        begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        words = W.mix(np.bitwise_xor.reduceat(W.mix(shingles), begin) ^ W.mix(part[begin] + _U(top << 32)))
        last = np.logical_and.reduceat(common, begin)
    if len(words) < show:
        raise ValueError(f"{len(words)} nonempty words where {show} must show; use fewer shingles to a part")
    first = _least(words[~last], show)
    return first if len(first) == show else np.concatenate([first, _least(words[last], show - len(first))])


def _least(words: np.ndarray, n: int) -> np.ndarray:
    return np.sort(np.partition(words, n - 1)[:n] if len(words) > n else words)


def band(n: int) -> int:
    """Upper end of the size band of n."""
    return 1 << 2 * -(-(n - 1).bit_length() // 2)


def shown_words(shingles: np.ndarray, common: Common) -> tuple[np.ndarray, int, int]:
    """Words in order, those of the set's own band first; how many those are; in which bands (1, 2) parts hold one shingle."""
    n = len(shingles)
    if not n:
        return shingles, 0, 0
    frequent = common.among(shingles)
    top = band(n)
    most = n * DENOMINATOR // NUMERATOR
    out = [_level_words(shingles, frequent, top, _differ(n, min(top, most)) + 1)]
    if most > top:
        out.append(_level_words(shingles, frequent, 4 * top, _differ(n, most) + 1))
    return np.concatenate(out), len(out[0]), (top <= SINGLE_UP_TO) + 2 * (4 * top <= SINGLE_UP_TO)


def sketch(shingles: np.ndarray) -> bytes:
    size = max(SKETCH_BITS, 1 << (BITS_PER_SHINGLE * len(shingles) - 1).bit_length())
    bits = np.bincount((shingles >> _U(20)) % _U(size), minlength=size) & 1
    return np.packbits(bits.astype(bool)).tobytes()


def fold(bits: np.ndarray, longs: int) -> np.ndarray:
    """A sketch's parts XOR-ed onto one another: distances never grow."""
    return bits if len(bits) == longs else np.bitwise_xor.reduce(bits.reshape(-1, longs), axis=0)


def near(n_a: int, n_b: int, sketch_a: bytes, sketch_b: bytes) -> bool:
    """Whether sizes and sketches leave a pair possible."""
    if DENOMINATOR * min(n_a, n_b) < NUMERATOR * max(n_a, n_b):
        return False
    a, b = np.frombuffer(sketch_a, _U), np.frombuffer(sketch_b, _U)
    longs = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, longs) ^ fold(b, longs)).sum()) <= _differ(n_a, n_b)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _documents(text: pa.Array):
    """The set and the text's digest of every document."""
    for lo, hi, at, data in W.blocks(text):
        words = W.split(at, data, W.NOT_SPACE, lower=True)
        for d in range(hi - lo):
            yield shingle_set(words.hash[words.doc(d)]), hashlib.sha1(data[at[d] : at[d + 1]]).digest()


def _sample(batches):
    for batch in batches:
        sets = [s for s, _ in _documents(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array(W.signed(np.concatenate(sets)) if sets else [], pa.int64())], names=["shingle"])


def _sets(batches, common):
    common = common.value
    seen: set[int] = set()
    for batch in batches:
        n, classes, shown, own, single, sketches, digests = [], [], [], [], [], [], []
        for s, digest in _documents(batch.column("text")):
            digests.append(digest)
            n.append(len(s))
            classes.append(class_of(s) if len(s) else None)
            words, first, kinds = None, 0, 0
            if len(s) and classes[-1] not in seen:
                words, first, kinds = shown_words(s, common)
                words = W.signed(words)
                if len(seen) < REMEMBERED:
                    seen.add(classes[-1])
            shown.append(words)
            own.append(first)
            single.append(kinds)
            sketches.append(sketch(s) if words is not None else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(shown, pa.list_(pa.int64())), pa.array(own, pa.int32()), pa.array(single, pa.int32()), pa.array(sketches, pa.binary()), pa.array(digests, pa.binary())],
            names=["doc_id", "n_shingles", "class", "words", "own", "single", "sketch", "digest"],
        )


def _members(batches):
    for batch in batches:
        sets = [s for s, _ in _documents(batch.column("text"))]
        classes = [class_of(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array(classes, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["class", "hashes"],
        )


def _near(batches):
    for batch in batches:
        a, b, *rest = (batch.column(c) for c in ("a", "b", "na", "nb", "ka", "kb"))
        keep = [near(*row) for row in zip(*(c.to_pylist() for c in rest), strict=True)]
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches):
    for batch in batches:
        a, b, ha, hb = (batch.column(c) for c in ("a", "b", "ha", "hb"))
        keep = [similar(np.frombuffer(ha[i].as_buffer(), _U), np.frombuffer(hb[i].as_buffer(), _U)) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _fold(batches):
    for batch in batches:
        if batch.num_rows:
            longs = np.stack([fold(np.frombuffer(x.as_py(), np.int64), FOLDED) for x in batch.column("sketch")])
            yield pa.RecordBatch.from_arrays([batch.column("class"), *(pa.array(longs[:, i]) for i in range(FOLDED))], names=["class", *_LONGS])


def _picked(table: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """Rows of a table that grows with the corpus whose class is among ``keys``, ``n`` at most; read by as many tasks as it has splits."""
    return table.join(F.broadcast(keys) if n <= BROADCAST_IDS else keys, "class", "left_semi")


def close_pairs(pairs: DataFrame, sketches: DataFrame, n: int) -> DataFrame:
    """Of the ``n`` class pairs (a, b) those that sketches do not rule out."""
    keys = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    sketches = materialize(_picked(sketches, keys, 2 * n), "parity-met")

    def side(name: str) -> DataFrame:
        return sketches.select(F.col("class").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"k{name}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near, "a bigint, b bigint")


def links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Of the class pairs (a, b) those that are similar."""

    def side(part: DataFrame, name: str) -> DataFrame:
        return members.join(part.select(F.col(name).alias("class")).distinct(), "class", "left_semi").select(F.col("class").alias(name), F.col("hashes").alias(f"h{name}"))

    n = pairs.count()
    jobs = max(1, min(VERIFY_JOBS, -(-n // VERIFY_PAIRS)))
    found = None
    for job in range(jobs):
        part = pairs if jobs == 1 else pairs.filter(F.pmod(F.xxhash64("a"), F.lit(jobs)) == job)
        own = materialize(part.join(side(part, "a"), "a").join(side(part, "b"), "b").mapInArrow(_verify, "a bigint, b bigint"), "parity-new", n)
        found = own if found is None else found.union(own)
    return found


def whole_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, hashes) of the wanted classes (class, first), from the text of each one's first document."""
    ids = wanted.filter("first is not null").select(F.col("first").alias("doc_id"))
    n = wanted.count()
    members = rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id").mapInArrow(_members, _MEMBERS)
    if wanted.filter("first is null").head(1):  # classes of documents without ids
        members = members.union(rows.filter("doc_id is null").mapInArrow(_members, _MEMBERS))
    # A repeated id may bring texts of other classes along.
    return members.join(F.broadcast(wanted.select("class")) if n <= BROADCAST_IDS else wanted.select("class"), "class", "left_semi").dropDuplicates(["class"])


def common_shingles(rows: DataFrame, total: int) -> np.ndarray:
    """Shingles of at least COMMON_IN of about SAMPLE_ROWS documents, the most frequent first; MOST_COMMON at most."""
    every = max(1, total // SAMPLE_ROWS)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)
    counts = sample.select("text").mapInArrow(_sample, _SAMPLE).groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_IN)
    found = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).select("shingle").toArrow()  # at most MOST_COMMON numbers
    return np.asarray(found.column(0).combine_chunks()).astype(np.int64).view(_U)


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, class, digest); classes (class, comp); components of several rows (comp, component_id)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(Common(common_shingles(rows, rows.count())))
    shown = rows.mapInArrow(lambda batches: _sets(batches, common), _SETS).withColumn("row", F.monotonically_increasing_id())
    shown = materialize(shown, "parity-shown")
    sets = materialize(shown.select("row", "doc_id", "n_shingles", "class", "digest"), "parity-sets")
    sketches = shown.filter("sketch is not null").select("class", F.col("n_shingles").cast("int").alias("n"), "sketch").dropDuplicates(["class"])
    sketches = materialize(sketches, "parity-sketches")

    # Words that one row alone shows are dropped here: nearly all. Rows are numbered, as small numbers travel well.
    words = shown.select("row", "own", "single", F.posexplode("words").alias("at", "word"))
    place = F.when(F.col("at") < F.col("own"), F.col("at")).otherwise(F.col("at") - F.col("own"))
    alone = F.when(F.col("at") < F.col("own"), F.col("single").bitwiseAND(F.lit(1))).otherwise(F.col("single").bitwiseAND(F.lit(2))) > 0
    words = words.select("row", "word", F.when(alone, place).otherwise(-place - 1).alias("rank"))
    often = materialize(words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").select("word"), "parity-often")
    # In two jobs by word, each of which lets its shuffle go before the next.
    halves = []
    for half in range(2):
        mine = F.pmod("word", F.lit(2)) == half
        halves.append(materialize(words.filter(mine).join(often.filter(mine), "word"), "parity-under"))
    drop(shown)
    drop(often)
    under = halves[0].union(halves[1]).join(sets.select("row", "class", F.col("n_shingles").cast("int").alias("n")), "row").select("word", "class", "n", "rank").distinct()
    under = materialize(under.withColumn("comp", F.col("class")), "parity-classed")
    for half in halves:
        drop(half)
    under = _open(under)

    classes = materialize(sets.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "parity-classes")
    found, comps, members, salts = None, None, None, 1
    unlike = F.floor((F.col("n") + F.col("pivot_n")) * F.lit(DENOMINATOR - NUMERATOR) / F.lit(DENOMINATOR + NUMERATOR))
    before = F.when(F.col("rank") >= 0, F.col("rank") + F.col("pivot_rank")).otherwise(F.greatest(-F.col("rank") - 1, -F.col("pivot_rank") - 1))
    possible = (F.least("n", "pivot_n") * DENOMINATOR >= F.greatest("n", "pivot_n") * NUMERATOR) & (before <= unlike)
    distance = sum((F.bit_count(F.col(k).bitwiseXOR(F.col("pivot_k")[k])) for k in _LONGS[1:]), F.bit_count(F.col("k0").bitwiseXOR(F.col("pivot_k")["k0"])))
    while left := under.count():
        longs = [k for k in _LONGS if k in under.columns]
        # Pivots: the least class under a word, in up to `salts` salts.
        pivots = under.groupBy("word", F.pmod(F.xxhash64("class"), F.lit(salts)).alias("salt")).agg(F.min(F.struct("class", "comp", "n", "rank", *longs)).alias("p"))
        pivots = pivots.select("word", F.col("p.class").alias("pivot"), F.col("p.comp").alias("pivot_comp"), F.col("p.n").alias("pivot_n"), F.col("p.rank").alias("pivot_rank"), *([F.struct(*[F.col(f"p.{k}") for k in longs]).alias("pivot_k")] if longs else []))
        pivots = materialize(pivots, "parity-pivots", left)
        met = under.join(pivots, "word").filter((F.col("comp") != F.col("pivot_comp")) & possible & ((distance <= unlike) if longs else F.lit(True)))
        pairs = materialize(met.select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct(), "parity-pairs", left * salts)
        n = pairs.count()
        close = materialize(close_pairs(pairs, sketches, n), "parity-close", n)
        wanted = close.select(F.col("a").alias("class")).union(close.select("b")).distinct()
        if members is not None:
            wanted = wanted.join(members.select("class"), "class", "left_anti")
        wanted = materialize(_picked(classes, wanted, 2 * close.count()).select("class", "first"), "parity-wanted")
        if wanted.head(1):
            more = materialize(whole_sets(rows, wanted), "parity-members")
            members = more if members is None else members.union(more)
        if not close.head(1):
            members = members if members is not None else spark.createDataFrame([], _MEMBERS)
        new = links(close, members)
        if new.head(1):
            found = new if found is None else materialize(found.union(new).distinct(), "parity-links", left + found.count())
            comps = connected_components(found)
        rest = under.join(pivots.select("word", F.col("pivot").alias("class")), ["word", "class"], "left_anti").drop("comp")
        if comps is not None:
            rest = rest.join(comps.select(F.col("node").alias("class"), F.col("comp").alias("c")), "class", "left")
        rest = rest.withColumn("comp", F.coalesce(F.col("c") if comps is not None else F.lit(None), F.col("class")))
        rest = materialize(rest.select("word", "class", "n", "rank", "comp", *longs), "parity-left", left)
        for done in (under, pivots, pairs, close, wanted):
            drop(done)
        under = _open(rest, left)
        if not longs and (left := under.count()):
            fold = _picked(sketches, under.select("class").distinct(), left).mapInArrow(_fold, "class bigint, " + ", ".join(f"{k} bigint" for k in _LONGS))
            short, under = under, materialize(under.join(materialize(fold, "parity-folded"), "class"), "parity-sketched", left)
            drop(short)
        salts *= 8
    if comps is None:
        comps = spark.createDataFrame([], "node long, comp long")

    classes = classes.join(comps.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    least = classes.groupBy("comp").agg(F.min("first").alias("component_id"), F.sum("rows").alias("rows"))
    least = materialize(least.filter("rows > 1").select("comp", "component_id"), "parity-least")
    return sets, classes.select("class", "comp"), least


def self_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class, component_id of every row."""
    sets, classes, least = _joined(docs)
    classes = materialize(classes.join(least, "comp").select("class", "component_id"), "parity-components")
    return sets.select("doc_id", "n_shingles", "class").join(classes, "class", "left").select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def _open(under: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Rows of the words under which more than one component is left; the table that is handed in goes."""
    several = under.groupBy("word").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("word")
    several = materialize(several, "parity-words", most_rows)
    out = materialize(under.join(several, "word"), "parity-open", most_rows)
    drop(several)
    drop(under)
    return out


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of its least doc_id (nulls last) the text of least digest, once.

    Rows are told apart by doc_id and text, so rows of one id may have different
    fates; of rows alike in both one stays, whatever their other columns say.
    Rows without words are components of their own and all stay.
    """
    sets, classes, _ = _joined(docs)
    rows = sets.filter("n_shingles > 0").groupBy("class", "doc_id", "digest").agg(F.count("*").alias("rows"))
    rows = materialize(rows.join(classes, "class").select("comp", F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "digest").alias("key"), "rows"), "parity-rows")
    best = materialize(rows.groupBy("comp").agg(F.min("key").alias("best"), F.count("*").alias("n")).filter("n > 1").select("comp", "best"), "parity-best")
    gone = rows.join(best, "comp").filter("key <> best")
    own_id, own_digest, whole = fresh(docs, "own_id", "own_digest", "whole")
    gone = materialize(gone.select(F.col("key.doc_id").alias(own_id), F.col("key.digest").alias(own_digest)), "parity-drop")
    again = rows.filter("rows > 1").join(best, "comp", "left").filter("best is null or key = best")
    again = materialize(again.select(F.col("key.doc_id").alias(own_id), F.col("key.digest").alias(own_digest)), "parity-again")

    keyed = docs.select("*", F.col("doc_id").cast("long").alias(own_id), F.unhex(F.sha1(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias(own_digest))

    def met(keys: DataFrame):
        return keyed[own_id].eqNullSafe(keys[own_id]) & (keyed[own_digest] == keys[own_digest])

    kept = keyed.join(gone, met(gone), "left_anti")
    if not again.head(1):
        return kept.select(docs.columns)
    kept = kept.join(again, kept[own_id].eqNullSafe(again[own_id]) & (kept[own_digest] == again[own_digest]), "left_anti")
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = keyed.join(again, met(again), "left_semi").groupBy(own_id, own_digest).agg(F.min_by(every, F.to_json(every)).alias(whole))
    return kept.select(docs.columns).union(once.select(*[F.col(whole)[c].alias(c) for c in docs.columns]))
