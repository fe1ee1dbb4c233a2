"""Ranked lexical search by the Best Position Algorithm over an index of document shards.

One scan of the texts writes the index: a row is a shard of consecutive documents with, per
document, the terms that some query has. A query has one impact list per term and shard,
sorted by falling impact. All lists are read in parallel from the top; each document met is
looked up at once in the other lists (direct access), and all its positions there count as
seen. The best position of a list is the last one up to which every position is seen; an
unseen document scores at most the sum of the impacts at the best positions. Reading stops
when that sum is strictly below the k-th best score, so ties are still decided by doc_id.

A task carries its best k of a query from shard to shard, so later shards stop sooner, some
before the first access. What tasks leave is merged in two steps, first by a salt.

Equal query texts are searched once. The queries' terms are sent along with the scan of the
texts up to VOCABULARY of them; beyond that the index has every term. Queries are searched
in blocks of about BLOCK_TERMS terms; only the index is read again for the next block.

Defined results: null and empty texts have no term; as documents they count nowhere, as items
they return nothing. Repeated documents and repeated items are rows of their own. A null
doc_id can be returned, after equal scores with an id. With no documents there are no rows.
A term stands for its 64-bit hash; two terms of a table share one with a chance of about
(queried terms x terms) / 2^64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import pack, runs, unpack
from .stored import drop_stored, partitions, store
from .words import ragged, slices

# Terms are runs of ASCII digits and letters and of everything beyond ASCII.
GAP = np.ones(256, np.bool_)
GAP[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = False
# Fixed values of the score.
TF_SCALE, TF_WEIGHT, LENGTH_WEIGHT, B = 1_000_000_000, 1000, 8, 75

VOCABULARY = 1_000_000
BLOCK_TERMS = 1_000_000
# A shard ends when it holds so many documents or entries; results do not depend on it.
SHARD_DOCS = 8192
SHARD_ENTRIES = 2_000_000
# Positions read at once from each list, doubled from round to round up to the second number.
STEP, MOST_STEP = 32, 512
_KINDS = ["<i8", "<u4", "<u8", "<u4", "<u4"]
_INDEX = "docs long, terms long, ids array<long>, blob binary"


def _counted(part, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) of a slice, ordered by text and term; `hashes` is (owner, hash)."""
    owner, terms = hashes
    order = np.lexsort((terms, owner))
    owner, terms = owner[order], terms[order]
    edge = np.ones(len(terms) + 1, np.bool_)
    edge[1:-1] = (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1])
    at = np.flatnonzero(edge)
    return owner[at[:-1]], terms[at[:-1]], np.diff(at)


def _inside(sorted_terms: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each term."""
    place = np.searchsorted(sorted_terms, terms)
    place[place == len(sorted_terms)] = 0
    return place, (sorted_terms[place] == terms) if len(sorted_terms) else np.zeros(len(terms), np.bool_)


def query_terms(items: DataFrame) -> DataFrame:
    """(key, terms array<long>, counts array<long>) of each distinct text that has a term."""
    texts = items.select(items["text"].cast("string").alias("text")).where("text is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, terms, counts = batch.column(0).to_pylist(), [], []
            for part in slices(batch.column(1), gap=GAP):
                owner, term, count = _counted(part, (part.owner, part.hashes(lower=True)))
                ends = np.searchsorted(owner, np.arange(1, len(part)))
                terms += [x.view(np.int64).tolist() for x in np.split(term, ends)]
                counts += [x.tolist() for x in np.split(count, ends)]
            kind = pa.list_(pa.int64())
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(terms, kind), pa.array(counts, kind)], ["key", "terms", "counts"])

    keyed = texts.select(F.unhex(F.md5("text")).alias("key"), "text")
    return keyed.mapInArrow(run, "key binary, terms array<long>, counts array<long>").where("size(terms) > 0")


def build_index(docs: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """Shards of the documents: how many have a term, all their terms, and, of those with a term
    in the sorted vocabulary (None: any term), id, number of terms, and counted terms."""

    def shard(parts: list[tuple], docs_: int, terms_: int) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        lengths, sizes, terms, tf = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
        distinct, place = np.unique(terms, return_inverse=True)
        blob = pack([lengths.astype("<i8"), sizes.astype("<u4"), distinct.astype("<u8"), place.astype("<u4"), tf.astype("<u4")])
        columns = [pa.array([docs_]), pa.array([terms_]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
        return pa.record_batch(columns, ["docs", "terms", "ids", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, entries, with_terms, all_terms = [], 0, 0, 0, 0
        for batch in batches:
            for part in slices(batch.column(1), gap=GAP):
                hashes, owner = part.hashes(lower=True), part.owner
                with_terms += int((part.counts > 0).sum())
                all_terms += len(hashes)
                if vocabulary is not None:
                    _, known = _inside(vocabulary, hashes)
                    hashes, owner = hashes[known], owner[known]
                doc, term, tf = _counted(part, (owner, hashes))
                kept, sizes = runs(doc)
                parts.append((batch.column(0).slice(part.low, len(part)).take(pa.array(kept)), part.counts[kept], sizes, term, tf))
                held, entries = held + len(kept), entries + len(term)
                if held >= SHARD_DOCS or entries >= SHARD_ENTRIES:
                    yield shard(parts, with_terms, all_terms)
                    parts, held, entries, with_terms, all_terms = [], 0, 0, 0, 0
        if parts:
            yield shard(parts, with_terms, all_terms)

    columns = [docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(run, _INDEX)


class Shard:
    """Impact lists of the block's terms, and each document's entries in them."""

    def __init__(self, ids: pa.Array, blob: bytes, terms: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        lengths, sizes, distinct, place, tf = unpack(blob, _KINDS)
        self.unnamed = np.array(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at, there = _inside(terms, distinct)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        use = there[place]
        doc, term, tf = doc[use], at[place[use]], tf[use].astype(np.int64)
        norm = 100 - B + B * lengths * n_docs // n_terms
        impact = weights[term] * (TF_SCALE * tf // (TF_WEIGHT * tf + LENGTH_WEIGHT * norm[doc]))
        doc, term, impact = doc[impact > 0], term[impact > 0], impact[impact > 0]
        # Document by document:
        self.bounds = np.searchsorted(doc, np.arange(len(sizes) + 1))
        self.term, self.impact = term, impact
        # List by list, falling impact, then document order:
        order = np.lexsort((-impact, term))
        self.lists = np.searchsorted(term[order], np.arange(len(terms) + 1))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.position = np.empty(len(order), np.int64)
        self.position[order] = np.arange(len(order)) - self.lists[term[order]]


class Best:
    """The best k of a query so far: highest score, then smallest id, ids before none."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.empty(0, np.int64)
        self.unnamed = np.empty(0, np.bool_)
        self.ids = np.empty(0, np.int64)

    @property
    def kth(self) -> int | None:
        return int(self.score[-1]) if len(self.score) == self.k else None

    def offer(self, score: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        if (kth := self.kth) is not None:
            good = score >= kth
            score, unnamed, ids = score[good], unnamed[good], ids[good]
        if not len(score):
            return
        score, unnamed, ids = np.append(self.score, score), np.append(self.unnamed, unnamed), np.append(self.ids, ids)
        order = np.lexsort((ids, unnamed, -score))[: self.k]
        self.score, self.unnamed, self.ids = score[order], unnamed[order], ids[order]


def best_positions(shard: Shard, terms: np.ndarray, counts: np.ndarray, best: Best, column: np.ndarray) -> int:
    """Offer a shard's best documents for one query; gives the number of documents accessed.
    `column` is scratch, -1 for each term of the block."""
    begin, size = shard.lists[terms], np.diff(shard.lists)[terms]
    terms, counts, begin, size = terms[size > 0], counts[size > 0], begin[size > 0], size[size > 0]
    bound = int((counts * shard.list_impact[begin]).sum())
    if not len(terms) or (best.kth is not None and bound < best.kth):
        return 0
    column[terms] = np.arange(len(terms))
    offset = np.concatenate([[0], np.cumsum(size)])
    met = np.zeros(offset[-1], np.bool_)  # positions seen, list after list
    known = np.zeros(len(shard.ids), np.bool_)
    reach = np.zeros(len(terms), np.int64)  # best position: so many from the top are seen
    depth, step, accessed = 0, STEP, 0
    while True:
        take = np.clip(size - depth, 0, step)
        read = np.unique(shard.list_doc[ragged(begin + depth, take)])
        read = read[~known[read]]
        depth, step = depth + step, min(2 * step, MOST_STEP)
        if len(read):
            known[read] = True
            accessed += len(read)
            low, entries = shard.bounds[read], shard.bounds[read + 1] - shard.bounds[read]
            at = ragged(low, entries)
            place = column[shard.term[at]]
            mine = place >= 0
            gain = np.where(mine, counts[place] * shard.impact[at], 0)
            total = np.concatenate([[0], np.cumsum(gain)])
            ends = np.cumsum(entries)
            best.offer(total[ends] - total[ends - entries], shard.unnamed[read], shard.ids[read])
            met[offset[place[mine]] + shard.position[at[mine]]] = True
        for i in np.flatnonzero(reach < size):
            rest = met[offset[i] + reach[i] : offset[i + 1]]
            gap = int(rest.argmin())
            reach[i] += len(rest) if rest[gap] else gap
        open_ = reach < size
        # Each list was read from the top, so every best position is 1 at least.
        bound = int((counts[open_] * shard.list_impact[begin[open_] + reach[open_] - 1]).sum())
        if not open_.any() or (best.kth is not None and bound < best.kth):
            break
    column[terms] = -1
    return accessed


def _statistics(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents that hold each of the sorted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for blob in batch.column(0):
                _, _, distinct, place, _ = unpack(blob.as_buffer(), _KINDS)
                at, there = _inside(terms, distinct)
                found = np.bincount(place, minlength=len(distinct))
                total[at[there]] += found[there]
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], ["place", "df"])

    out = np.zeros(len(terms), np.int64)
    for r in index.select("blob").mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["place"]] = r["df"]
    return out


def _search_block(index: DataFrame, queries: list, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(key, doc_id, score), at most k rows a query and task."""
    keys = [bytes(q["key"]) for q in queries]
    sizes = np.array([len(q["terms"]) for q in queries])
    flat = np.concatenate([np.array(q["terms"], np.int64) for q in queries]).view(np.uint64)
    counts = np.concatenate([np.array(q["counts"], np.int64) for q in queries])
    terms, place = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in _statistics(index, terms).tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(k) for _ in keys]
        column = np.full(len(terms), -1, np.int64)
        for batch in batches:
            for ids, blob in zip(batch.column(0), batch.column(1), strict=True):
                shard = Shard(ids.values, blob.as_buffer(), terms, weights, n_docs, n_terms)
                for best, end, size in zip(found, ends.tolist(), sizes.tolist(), strict=True):
                    best_positions(shard, place[end - size : end], counts[end - size : end], best, column)
        task = TaskContext.get().partitionId()
        for low in range(0, len(keys), 1000):
            part = range(low, min(low + 1000, len(keys)))
            key = pa.array([keys[i] for i in part for _ in found[i].ids], pa.binary())
            ids = np.concatenate([found[i].ids for i in part])
            unnamed = np.concatenate([found[i].unnamed for i in part])
            score = np.concatenate([found[i].score for i in part])
            yield pa.record_batch([key, pa.array(ids, mask=unnamed), pa.array(score), pa.array([task] * len(key), pa.int32())], ["key", "doc_id", "score", "task"])

    return index.select("ids", "blob").mapInArrow(run, "key binary, doc_id long, score long, task int")


def _top(rows: DataFrame, k: int, *groups: str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "item_id") -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank from 1, doc_id, score above 0."""
    spark = docs.sparkSession
    queries = store(query_terms(items), "queries")
    each = queries.select(F.explode("terms").alias("term")).distinct()
    few = each.limit(VOCABULARY + 1).count() <= VOCABULARY
    vocabulary = np.sort(np.array([r["term"] for r in each.toLocalIterator()], np.int64).view(np.uint64)) if few else None
    index = store(build_index(docs, vocabulary), "index")
    n_docs, n_terms, total = (*index.agg(F.sum("docs"), F.sum("terms")).first(), queries.agg(F.sum(F.size("terms"))).first()[0])
    found = spark.createDataFrame([], "key binary, doc_id long, score long, rank int")
    blocks = -(-(total or 0) // BLOCK_TERMS) if n_docs else 0
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).collect()
        if mine:
            # A query meets at most k rows of a task; the salt keeps a merge far below tasks x k rows.
            rows = _search_block(index, mine, n_docs, n_terms, k).withColumn("salt", F.pmod("task", F.lit(math.isqrt(partitions(spark)) + 1)))
            best = store(_top(_top(rows, k, "key", "salt").drop("rank"), k, "key").select("key", "doc_id", "score", "rank"), "ranks")
            found = best if blocks == 1 else found.unionByName(best)
    for used in (queries, index):
        drop_stored(used)
    named = items.select(items[id_column].cast("long").alias("item_id"), F.unhex(F.md5(items["text"].cast("string"))).alias("key"))
    return named.join(found, "key").select("item_id", "rank", "doc_id", "score")
