"""Repeated spans by De Bruijn compaction over word k-mers.

A window of ``span`` words is repeated where the same words start earlier: in a
document of smaller id, or before it in the same one.  Every word that a
repeated window covers is removed.

The graph is a sparse De Bruijn graph.  From each window the ``kmer``-word gram
of least hash is taken, so equal windows take equal grams and about one gram in
eight is taken: those are the nodes.  An edge is the token span from the start of
one node to the end of the next one of its document, so neighbouring edges overlap
in the node between them; at a document's ends, edges reach to its first or last
word.  In and out degrees are counted by group-by over all occurrences of nodes
that several documents hold.

Compaction.  A node with one edge in and one out does not branch.  Such nodes are
linked along the edges that they share and pointer jumping, one Spark join a
doubling, gathers each maximal nonbranching path under its first node.  All
occurrences of the path's nodes lie in occurrences of the path, so all windows
between the path's ends whose own node is on it recur exactly where the path does.
A document therefore gets back its paths' first nodes and lengths alone.

Verification.  At its source coordinates every occurrence of a path, the first
one too, digests its words; a path counts only where all digests are equal and
there are as many as each of its nodes has occurrences.  Should hashes ever collide
so that some path fails, no path is believed and all windows are told apart one
by one.  Windows at branches always are: by a 128-bit digest of their words.  The
64-bit hashes thus only choose what is compared.

Whole copies of an earlier document are settled before, by the SHA-256 of their
words, so groups of copies never enter the graph.

Joins are equi-joins of written tables (skewed keys are split), counts and
first documents are aggregated before the shuffle, and a document's text is
moved only where it has a repeated node.

Cases: null and wordless texts have no words and remove none (the digest is
that of the empty string); texts shorter than a window remove none; rows with
one doc_id do not repeat one another, each repeats the documents before; rows
without an id stand as if their id were 2**63 - 1, after all others, and do not
repeat one another; very long texts are read whole, a row at a time; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as W
from .storage import drop, materialize

SPAN = 20
KMER = 6
_LAST = (1 << 63) - 1
_U = np.uint64
_EMPTY = hashlib.sha256(b"").hexdigest()

_GRAPH = "id bigint, doc_id bigint, row_key bigint, n_words bigint, own boolean, kept_sha256 string, nodes array<bigint>, edges array<bigint>"
_PATHS = "id bigint, doc_id bigint, row_key bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string, sure array<int>, asked array<struct<at:int,digest:binary>>, claims array<struct<head:bigint,digest:binary>>"
_DONE = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _digest(words: W.Words, doc: slice, keep: np.ndarray | None = None) -> str:
    pairs = zip(words.start[doc], words.end[doc], strict=True) if keep is None else zip(words.start[doc][keep], words.end[doc][keep], strict=True)
    return hashlib.sha256(b" ".join([words.data[a:b] for a, b in pairs])).hexdigest()


def _said(words: list[bytes], *more: bytes) -> bytes:
    """128 bits that stand for a sequence of words."""
    text = b" ".join(words)
    return hashlib.blake2b(b"\0".join((text, *more)) if more else text, digest_size=16).digest()


def _nodes(hashes: np.ndarray, span: int, kmer: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of a document's nodes, in order, and the node of every window."""
    grams = W.grams(hashes, kmer) & _U((1 << bits) - 1)
    least = W.sliding_min(grams, span - kmer + 1)
    places = np.flatnonzero(np.isin(grams, np.unique(least), kind="sort"))
    return places, grams[places], least


def _edges(hashes: np.ndarray, places: np.ndarray, nodes: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of the edges before, between and after the nodes."""
    begin = np.concatenate(([0], places))
    length = np.diff(np.concatenate((begin, [len(hashes)])))
    offset = np.arange(len(hashes)) - np.repeat(begin, length)
    each = np.concatenate(([0], np.cumsum(W.mix(hashes + offset.astype(_U) * _U(0xC2B2AE3D27D4EB4F)), dtype=_U))).astype(_U)
    inside = each[begin + length] - each[begin]
    # What an edge ends in: the next node, or the document's end; the first edge begins at the document's start.
    ends = np.concatenate((W.mix(nodes + _U(1)), [_U(0x5851F42D4C957F2D)]))
    kind = np.zeros(len(ends), _U)
    kind[0] = _U(0x14057B7EF767814F)
    return W.mix(inside ^ W.mix(length.astype(_U) + ends) ^ kind) & _U((1 << bits) - 1)


def _repeats(values: np.ndarray) -> np.ndarray:
    """Mask of the values that occur earlier in the array."""
    again = np.ones(len(values), bool)
    again[np.unique(values, return_index=True)[1]] = False
    return again


def _own_repeats(windows: np.ndarray, words: list[bytes], span: int) -> np.ndarray:
    """Mask of the windows whose words start earlier in the document: found by hash, then told apart by their words."""
    out = np.zeros(len(windows), bool)
    if len(windows) < 2:
        return out
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    seen: set[bytes] = set()
    for j in np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))]).tolist():
        said = _said(words[j : j + span])
        out[j] = said in seen
        seen.add(said)
    return out


def _lists(values: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _find_edges(batches, span, kmer, bits):
    none = np.zeros(0, np.int64)
    for batch in batches:
        n_words, own, sha, nodes, edges = [], [], [], [], []
        for lo, hi, at, data in W.blocks(batch.column("text")):
            words = W.split(at, data, W.NOT_SPACE)
            for d in range(hi - lo):
                doc = words.doc(d)
                h = words.hash[doc]
                n_words.append(len(h))
                sha.append(_digest(words, doc))
                if len(h) < span:
                    own.append(False)
                    nodes.append(none)
                    edges.append(none)
                    continue
                places, value, _ = _nodes(h, span, kmer, bits)
                own.append(len(np.unique(value)) < len(value) and bool(_repeats(W.grams(h, span)).any()))
                nodes.append(W.signed(value))
                edges.append(W.signed(_edges(h, places, value, bits)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("doc_id"), batch.column("row_key"), pa.array(n_words, pa.int64()), pa.array(own, pa.bool_()), pa.array(sha, pa.string()), _lists(nodes), _lists(edges)],
            names=["id", "doc_id", "row_key", "n_words", "own", "kept_sha256", "nodes", "edges"],
        )


def _own_nodes(places: np.ndarray, nodes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Each window's own node: the first from the window's start on that has the least hash."""
    at = np.searchsorted(places, np.arange(len(least)))
    open_ = np.flatnonzero(nodes[at] != least)
    while len(open_):
        at[open_] += 1
        open_ = open_[nodes[at[open_]] != least[open_]]
    return at


def _on_paths(id_: int, paths: list[dict], places: np.ndarray, nodes: np.ndarray, least: np.ndarray, words: list[bytes], span: int, kmer: int):
    """Of a document's windows: which lie on a path, which of those repeat an earlier document; its paths' nodes, and what their words say."""
    n = len(words)
    on, again, claims, inner = np.zeros(len(least), bool), np.zeros(len(least), bool), [], [np.zeros(0, _U)]
    if not paths:
        return on, again, inner[0], claims
    length = {p["head"]: (p["m"], p["first"]) for p in paths}
    signed = W.signed(nodes)
    own = _own_nodes(places, nodes, least)
    for i in np.flatnonzero(np.isin(signed, np.fromiter(length, np.int64, len(length)))).tolist():
        m, first = length[int(signed[i])]
        if i + m > len(places):  # only where hashes collide: the claim fails
            claims.append((int(signed[i]), b"short"))
            continue
        lo = int(places[i - 1]) if i else 0
        hi = int(places[i + m]) + kmer if i + m < len(places) else n
        shape = np.concatenate((places[i : i + m] - lo, [lo == 0 and i == 0, i + m == len(places)])).astype(np.int64).tobytes()
        claims.append((int(signed[i]), _said(words[lo:hi], shape, nodes[i : i + m].tobytes())))
        inner.append(nodes[i : i + m])
        # Windows between the path's ends whose own node is on it.
        stop = hi - span + 1
        if stop > lo:
            mine = (own[lo:stop] >= i) & (own[lo:stop] < i + m)
            on[lo:stop] |= mine
            if id_ > first:
                again[lo:stop] |= mine
    return on, again, np.concatenate(inner), claims


def _follow(batches, span, kmer, bits):
    """Documents with repeated nodes: done, or with the windows that are still open; and the claims of their paths."""
    for batch in batches:
        out = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "text", "sure", "asked", "claims")}
        ids, texts, unsure = batch.column("id").to_pylist(), batch.column("text"), batch.column("unsure")
        paths = batch.column("paths").to_pylist()
        for lo, hi, at, data in W.blocks(texts):
            words = W.split(at, data, W.NOT_SPACE)
            for d in range(hi - lo):
                doc = words.doc(d)
                h = words.hash[doc]
                said = [words.data[a:b] for a, b in zip(words.start[doc].tolist(), words.end[doc].tolist(), strict=True)]
                places, nodes, least = _nodes(h, span, kmer, bits)
                on, again, inner, claims = _on_paths(ids[lo + d], paths[lo + d] or [], places, nodes, least, said, span, kmer)
                repeated = _own_repeats(W.grams(h, span), said, span) | again
                # All on a path are settled; others ask where several documents hold their node.
                held = np.concatenate((_values(unsure, lo + d), W.signed(inner)))
                ask = np.flatnonzero(np.isin(W.signed(least), held) & ~on & ~repeated)
                out["n_words"].append(len(h))
                out["claims"].append(claims)
                if len(ask):
                    out["n_removed"].append(None)
                    out["kept_sha256"].append(None)
                    out["text"].append(texts[lo + d].as_py())
                    out["sure"].append(np.flatnonzero(repeated).tolist())
                    out["asked"].append([(j, _said(said[j : j + span])) for j in ask.tolist()])
                else:
                    gone = W.covered(np.flatnonzero(repeated), span, len(h))
                    out["n_removed"].append(int(gone.sum()))
                    out["kept_sha256"].append(_digest(words, doc, ~gone))
                    for k in ("text", "sure", "asked"):
                        out[k].append(None)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
        plain = [pa.array(out[k], kind) for k, kind in zip(("n_words", "n_removed", "kept_sha256", "text", "sure"), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("doc_id"), batch.column("row_key"), *plain, _pairs(out["asked"], "at", pa.int32()), _pairs(out["claims"], "head", pa.int64())],
            names=["id", "doc_id", "row_key", *out],
        )


def _pairs(rows: list[list[tuple[int, bytes]] | None], name: str, kind: pa.DataType) -> pa.Array:
    """Lists of (number, digest) structs, without a Python object for each struct."""
    sizes = np.concatenate(([0], np.cumsum([len(r or ()) for r in rows]))).astype(np.int32)
    flat = [x for r in rows for x in r or ()]
    structs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], kind), pa.array([x[1] for x in flat], pa.binary())], names=[name, "digest"])
    return pa.ListArray.from_arrays(pa.array(sizes), structs)


def _values(column: pa.Array, i: int) -> np.ndarray:
    return np.asarray(column[i].values) if column[i].is_valid else np.zeros(0, np.int64)


def _finish(batches, span):
    for batch in batches:
        n_words, removed, sha = [], [], []
        sure, found = batch.column("sure"), batch.column("found")
        for lo, hi, at, data in W.blocks(batch.column("text")):
            words = W.split(at, data, W.NOT_SPACE)
            for d in range(hi - lo):
                doc = words.doc(d)
                n = len(words.hash[doc])
                gone = W.covered(np.concatenate((_values(sure, lo + d), _values(found, lo + d))).astype(np.int64), span, n)
                n_words.append(n)
                removed.append(int(gone.sum()))
                sha.append(_digest(words, doc, ~gone))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def compact(nodes: DataFrame) -> DataFrame:
    """(node, head, at) of nonbranching nodes (node, into, out): the first node of each one's path, and its place on it.

    Pointer jumping: each round a node's pointer goes on to where its pointer
    points, so a path of m nodes takes log2(m) rounds.
    """
    step = nodes.select(F.col("node").alias("before"), F.col("out").alias("edge")).join(nodes.select("node", F.col("into").alias("edge")), "edge").filter("before <> node")
    # An edge joins two nodes; where hashes collide it may seem to join more, and joins none.
    step = step.withColumn("ways", F.count("*").over(Window.partitionBy("edge"))).filter("ways = 1").select("node", "before")
    now = nodes.select("node").join(step, "node", "left").select("node", F.coalesce("before", "node").alias("head"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("at"))
    now = materialize(now, "repeat-pointers")
    for _ in range(now.count().bit_length() + 1):
        onward = now.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("at").alias("more"))
        moved = materialize(now.join(onward, "head").select("node", F.col("next").alias("head"), (F.col("at") + F.col("more")).alias("at"), (F.col("more") > 0).alias("moved")), "repeat-pointers")
        drop(now)
        now = moved
        if not moved.filter("moved").head(1):
            break
    return now.select("node", "head", "at")


def _removed(rows: DataFrame, own: DataFrame, span: int, kmer: int, bits: int, believe: bool) -> DataFrame | None:
    """The rows that have repeats or may have some; None where a path's words differ."""
    # Nodes that several documents hold.
    held = own.select("id", F.explode("nodes").alias("node")).groupBy("node").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).filter("first < last")
    held = materialize(held.select("node", "first", "n"), "repeat-held")
    shown = own.select("row", "edges", F.posexplode("nodes").alias("i", "node")).select("row", "node", F.get("edges", "i").alias("into"), F.get("edges", F.col("i") + 1).alias("out"))
    met = materialize(shown.join(held.select("node"), "node"), "repeat-met")
    if believe:
        ways = met.groupBy("node").agg(F.min("into").alias("into"), F.max("into").alias("into2"), F.min("out").alias("out"), F.max("out").alias("out2")).filter("into = into2 and out = out2")
        nodes = compact(materialize(ways.select("node", "into", "out"), "repeat-ways")).join(held, "node")
        paths = nodes.groupBy("head").agg(F.count("*").alias("m"), F.max("at").alias("last"), F.min("n").alias("n"), F.max("n").alias("n2"), F.min("first").alias("first"), F.max("first").alias("first2"))
        paths = materialize(paths.filter("last = m - 1 and n = n2 and first = first2").select("head", F.col("m").cast("int").alias("m"), "n", "first"), "repeat-unitigs")
        nodes = nodes.select("node", "head").join(paths.drop("n"), "head").select("node", (F.col("node") == F.col("head")).alias("leads"), "m", "first")
        marked = met.select("row", "node").join(nodes, "node", "left")
    else:
        marked = met.select("row", "node").withColumns({"leads": F.lit(None).cast("boolean"), "m": F.lit(0), "first": F.lit(0).cast("long")})
    told = marked.groupBy("row").agg(
        F.collect_set(F.when(F.col("leads"), F.struct(F.col("node").alias("head"), "m", "first"))).alias("paths"),
        F.collect_set(F.when(F.col("leads").isNull(), F.col("node"))).alias("unsure"),
    )
    told = own.select("row", "id", "row_key", "own").join(told, "row", "left").filter("own or paths is not null").drop("row", "own").dropDuplicates(["id", "row_key"])
    told = materialize(told, "repeat-told")
    drop(met)
    followed = rows.join(told, ["id", "row_key"]).mapInArrow(lambda batches: _follow(batches, span, kmer, bits), _PATHS)
    followed = materialize(followed, "repeat-followed")
    if believe:
        said = followed.select(F.inline("claims")).groupBy("head").agg(F.count("*").alias("met"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
        if paths.join(said, "head", "left").filter("met is null or met <> n or lo <> hi").head(1):
            return None

    # Windows at branches, by the first document that has their words.
    asked = followed.filter("n_removed is null").select("id", "row_key", F.inline("asked"))
    first = asked.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    first = materialize(first.select("digest", "first"), "repeat-windows")
    found = asked.join(first, "digest").filter("id > first").groupBy("id", "row_key").agg(F.collect_set("at").alias("found"))
    found = materialize(found, "repeat-found")
    open_ones = followed.filter("n_removed is null").select("id", "doc_id", "row_key", "text", "sure")
    last = open_ones.join(found, ["id", "row_key"], "left").mapInArrow(lambda batches: _finish(batches, span), _DONE)

    # Rows that repeat as a whole (same id, same text) are in every table as often as in the input.
    untouched = own.join(told.select("id", "row_key"), ["id", "row_key"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return untouched.union(followed.filter("n_removed is not null").select("doc_id", "n_words", "n_removed", "kept_sha256")).union(last)


def remove_repeats(docs: DataFrame, span: int = SPAN, kmer: int = KMER, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; ``bits`` is the width of the graph's hashes."""
    id_ = F.col("doc_id").cast("long")
    # Within an id rows are told apart by their text's hash.
    rows = docs.select(F.coalesce(id_, F.lit(_LAST)).alias("id"), id_.alias("doc_id"), F.xxhash64("text").alias("row_key"), F.col("text").cast("string").alias("text"))
    graph = rows.mapInArrow(lambda batches: _find_edges(batches, span, kmer, bits), _GRAPH).withColumn("row", F.monotonically_increasing_id())
    graph = materialize(graph, "repeat-graph")

    # Whole copies of an earlier document.
    long_ones = graph.filter(F.col("n_words") >= span).select("id", F.unhex("kept_sha256").alias("whole"))
    firsts = long_ones.groupBy("whole").agg(F.min("id").alias("before"), F.max("id").alias("last")).filter("before < last")
    firsts = materialize(firsts.select("whole", "before"), "repeat-firsts")
    marked = graph.withColumn("whole", F.unhex("kept_sha256")).join(firsts, "whole", "left").drop("whole")
    own = materialize(marked.filter("before is null or id <= before").drop("before"), "repeat-own")
    copies = marked.filter("id > before").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(_EMPTY).alias("kept_sha256"))
    copies = materialize(copies, "repeat-whole")
    drop(graph)
    out = _removed(rows, own, span, kmer, bits, True)
    return copies.union(_removed(rows, own, span, kmer, bits, False) if out is None else out)
