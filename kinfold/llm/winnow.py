"""Benchmark decontamination by winnowing.

Test items and documents are fingerprinted alike: of the k-word grams in every
window of ``window`` words the one with the least hash is kept, so whatever
span of ``window`` words a document shares with an item, both keep the same
gram from it.  Where a document's fingerprint is one of the items', the hit is
extended to the whole window and compared by the window's hash.  Items of fewer
words are one window each and are looked up by their own length.

The items are read in blocks of about ``block_bytes`` of text.  One block, which
is the usual case, is one pass over the documents.  With more, each block makes a
pass of its own: its index is built when the pass begins, and goes when what the
pass found is written, so only one is broadcast at a time however large the
benchmark is.  Documents are never shuffled with their text; hits of several
passes meet by document.

Cases: null or wordless texts have no words and no hits; wordless items never
occur; a repeated item id counts once; a null item id counts as the empty id;
repeated documents are judged row by row; very long texts are read whole, a
block of words at a time; extra columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .storage import drop, materialize

WINDOW = 10
GRAM = 4
BLOCK_BYTES = 16 << 20

SCHEMA = "doc_id bigint, row_key bigint, n_words bigint, hit_starts array<bigint>, hit_ends array<bigint>, items array<string>"


class Index:
    """Fingerprints and windows of one block of items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.ids = sorted({i for i, _ in items})
        place = {x: n for n, x in enumerate(self.ids)}
        prints: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = W.split(np.array([0, len(raw)]), raw, W.ALNUM, lower=True).hash
            size = min(window, len(words))
            if not size:
                continue
            found.setdefault(size, []).append((W.grams(words, size), place[item]))
            if size == window:
                prints.append(W.sliding_min(W.grams(words, gram), window - gram + 1))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.prints >> np.uint64(44)] = True
        self.windows = {}
        for size, rows in found.items():
            hashes = np.concatenate([h for h, _ in rows])
            of = np.concatenate([np.full(len(h), n) for h, n in rows])
            order = np.lexsort((of, hashes))
            self.windows[size] = (hashes[order], of[order])

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """Starts and widths of the words' hits, and (size, starts) by window size."""
        starts, widths, by = [], [], []
        last = np.repeat(first[1:], np.diff(first))
        for size, (known, _) in self.windows.items():
            if size == self.window:
                least = W.sliding_min(W.grams(hashes, self.gram), size - self.gram + 1)
                at = np.flatnonzero(self.maybe[least >> np.uint64(44)])
                at = at[_among(least[at], self.prints)]
            else:
                at = np.arange(max(0, len(hashes) - size + 1))
            at = at[at + size <= last[at]] if len(at) else at
            if not len(at):
                continue
            whole = W.grams(hashes, size)[at]
            at = at[_among(whole, known)]
            if len(at):
                starts.append(at)
                widths.append(np.full(len(at), size))
                by.append((size, at))
        none = np.zeros(0, np.int64)
        return (np.concatenate(starts) if starts else none, np.concatenate(widths) if widths else none, by)

    def items(self, size: int, hashes: np.ndarray) -> np.ndarray:
        known, of = self.windows[size]
        hashes = np.unique(hashes)
        lo, hi = np.searchsorted(known, hashes, "left"), np.searchsorted(known, hashes, "right")
        return np.unique(np.concatenate([of[a:b] for a, b in zip(lo, hi, strict=True)]))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _clean(batches, index):
    """The rows without a hit, all their columns."""
    index = index.value
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for lo, _, at, data in W.blocks(batch.column("text")):
            words = W.split(at, data, W.ALNUM, lower=True)
            starts = index.hits(words.hash, words.first)[0]
            keep[lo + np.searchsorted(words.first, starts, "right") - 1] = False
        yield batch.filter(pa.array(keep))


def _scan(batches, index):
    index = index.value
    for batch in batches:
        out = {k: [] for k in ("doc_id", "row_key", "n_words", "hit_starts", "hit_ends", "items")}
        text = batch.column("text")
        for lo, hi, at, data in W.blocks(text):
            words = W.split(at, data, W.ALNUM, lower=True)
            starts, widths, by = index.hits(words.hash, words.first)
            spans = [([], [])] * (hi - lo)
            items: list[list[str]] = [[]] * (hi - lo)
            if len(starts):
                hit = W.covered(starts, widths, len(words.hash))
                home = np.searchsorted(words.first, starts, "right") - 1
                for d in np.unique(home):
                    a, b = words.first[d], words.first[d + 1]
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].view(np.int8), [0]))))
                    spans[d] = (edge[::2].tolist(), edge[1::2].tolist())
                    of = [index.items(size, W.grams(words.hash[a:b], size)[x[(x >= a) & (x < b)] - a]) for size, x in by if ((x >= a) & (x < b)).any()]
                    items[d] = [index.ids[n] for n in np.unique(np.concatenate(of))]
            out["n_words"] += np.diff(words.first).tolist()
            out["hit_starts"] += [s for s, _ in spans]
            out["hit_ends"] += [e for _, e in spans]
            out["items"] += items
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(out["n_words"], pa.int64()), pa.array(out["hit_starts"], pa.list_(pa.int64())), pa.array(out["hit_ends"], pa.list_(pa.int64())), pa.array(out["items"], pa.list_(pa.string()))],
            names=["doc_id", "row_key", "n_words", "hit_starts", "hit_ends", "items"],
        )


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in blocks of about ``block_bytes`` of text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    return [items] if n == 1 else [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block) for block in range(n)]


def _broadcast(items: DataFrame, window: int, gram: int):
    return items.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in items.collect()], window, gram))  # one block


@contextlib.contextmanager
def _index(items: DataFrame, window: int, gram: int):
    """A block's broadcast index, for as long as its pass takes."""
    index = _broadcast(items, window, gram)
    try:
        yield index
    finally:
        index.destroy()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that any item occurs in; a pass for each block of items, nothing is shuffled."""
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        index = _broadcast(blocks[0], window, gram)
        return docs.mapInArrow(lambda batches: _clean(batches, index), docs.schema)
    was = None
    for items in blocks:
        with _index(items, window, gram) as index:
            docs = materialize(docs.mapInArrow(lambda batches, index=index: _clean(batches, index), docs.schema), "winnow-clean")
        if was is not None:
            drop(was)
        was = docs
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: its words, the word spans that occur in items (hit_starts, hit_ends) and those items."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) == 1:
        index = _broadcast(blocks[0], window, gram)
        return rows.mapInArrow(lambda batches: _scan(batches, index), SCHEMA)
    every, found = None, None
    for items in blocks:
        with _index(items, window, gram) as index:
            part = rows.mapInArrow(lambda batches, index=index: _scan(batches, index), SCHEMA)
            # The first pass tells every row's words, the others only what they find.
            part = materialize(part if every is None else part.filter("size(hit_starts) > 0").distinct(), "winnow-hits")
        every = part.select("doc_id", "row_key", "n_words") if every is None else every
        hits = part.filter("size(hit_starts) > 0").distinct().drop("n_words")
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy("doc_id", "row_key").agg(
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_starts", "hit_ends")))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # Spans in order of start: a span begins anew where it passes the furthest end so far.
    merged = merged.selectExpr(
        "doc_id as id", "row_key as row", "items",
        """aggregate(s, cast(array() as array<struct<hit_starts:bigint,hit_ends:bigint>>), (a, x) ->
             if(size(a) > 0 and x.hit_starts <= element_at(a, -1).hit_ends,
                concat(slice(a, 1, size(a) - 1), array(named_struct('hit_starts', element_at(a, -1).hit_starts, 'hit_ends', greatest(element_at(a, -1).hit_ends, x.hit_ends)))),
                concat(a, array(x)))) as s""",
    )
    out = every.join(merged, every["doc_id"].eqNullSafe(merged["id"]) & (every["row_key"] == merged["row"]), "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", "row_key", "n_words", F.coalesce("s.hit_starts", none).alias("hit_starts"), F.coalesce("s.hit_ends", none).alias("hit_ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(hits: DataFrame) -> DataFrame:
    """Digest columns of ``decontaminate``'s rows."""
    n_hit = F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    # Ids are ordered as strings by their bytes.
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
