"""Exact Jaccard self-join on word shingles by rare-first prefix filtering.

1. Every document becomes the set of its distinct five-word shingles. Documents with equal
   sets are one entry from here on, known by a hash of the set.
2. Document frequencies are counted in hash buckets over all sets. Only shingles that two
   sets share come back to their set; the others are the rarest there are and cannot match.
   Shingles in more than a stated share of the sets are found beforehand (a bounded list)
   and ordered last, so no bucket gathers them.
3. With shingles in the order of their frequency, linked sets share one among the first
   n - ceil(0.75 n) + 1. Sets without a shared shingle there are done.
4. Round one: each set is verified against one partner, the most central set that shares
   most of its prefix. That already joins large groups of near copies, without their pairs.
5. Round two: all pairs that share a prefix shingle and are not joined yet, if they pass the
   length, positional and suffix filters, each verified once. A link lost to the skip would
   be between sets that are joined anyway, so the components are exact.

The suffix filter bounds the overlap by the counts of shared shingles in 32 hash ranges.
Tokens are 48 bits of the shingle's hash and its bucket, which are further bits of it.

Defined results: null, empty and wordless texts have no shingles and no links; with one to
four words the whole sequence is one shingle. Repeated rows and ids get a row each; a null
id is never a component's name unless all of its documents have null ids. Only doc_id and
text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange
from .components import connected
from .stored import drop_stored, partitions, store
from .words import Slice, mix, slices, window_hashes

SHINGLE = 5
PERCENT = 75
# A shingle in at least this share of the sets is ordered last.
COMMON_SHARE = 0.005
# Most shingles on the broadcast list; it only affects the order, never the result.
COMMON_MOST = 200_000
_LOW = np.uint64((1 << 48) - 1)
_ORDER_COMMON = 256
# A bucket is counted about so many shingles at a time, in passes over its compact blobs.
_AT_ONCE = 400_000
# Shingles a sending task gathers before it sends them.
_GATHER = 400_000


def shingle_sets(part: Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, ordered by text and hash; sizes per text."""
    words = part.hashes(lower=True)
    at, keys = part.windows(words, size)
    owner = part.owner[at]
    for n in range(1, size):
        few = np.flatnonzero(part.counts == n)
        if len(few):
            owner = np.append(owner, few)
            keys = np.append(keys, window_hashes(words, part.first[few], n))
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), np.bool_)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    owner, keys = owner[new], keys[new]
    return owner, keys, np.bincount(owner, minlength=len(part))


def set_keys(owner: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's whole set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys))])
    ends = np.cumsum(sizes)
    return mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def _members(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and set key (null without shingles) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for part in slices(batch.column(1)):
                owner, keys, sizes = shingle_sets(part)
                n.append(sizes)
                key.append(set_keys(owner, keys, sizes))
            n, key = np.concatenate(n), np.concatenate(key)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(key, mask=n == 0)], ["doc_id", "n_shingles", "set_key"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key long")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct sets of about _GATHER shingles: (set keys, sizes, set key of each shingle, shingle)."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch.column(1)):
            owner, keys, sizes = shingle_sets(part)
            names = set_keys(owner, keys, sizes)
            held.append((names, sizes, names[owner], keys))
            size += len(keys)
            if size >= _GATHER:
                yield _distinct(held)
                held, size = [], 0
    if size:
        yield _distinct(held)


def _distinct(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    names, sizes, owners, keys = (np.concatenate(c) for c in zip(*held, strict=True))
    full = sizes > 0
    names, first = np.unique(names[full], return_index=True)
    kept = np.zeros(int(full.sum()), np.bool_)
    kept[first] = True
    each = np.repeat(kept, sizes[full])
    return names, sizes[full][first], owners[each], keys[each]


def _common(docs: DataFrame, n_sets: int) -> np.ndarray:
    """Sorted hashes of shingles in at least COMMON_SHARE of the sets. One that is so common
    overall is so common in some sending batch, where it is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, _, _, keys in _gathered(batches):
            found, counts = np.unique(keys, return_counts=True)
            often = counts >= max(8, COMMON_SHARE * len(names))
            yield pa.record_batch([pa.array(found[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["shingle", "n"])

    rows = (
        docs.mapInArrow(run, "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= max(8.0, COMMON_SHARE * n_sets / 2))
        .orderBy(F.desc("n"), "shingle")
        .limit(COMMON_MOST)
        .toPandas()
    )
    return np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))


def _tokens(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = exchange.buckets_of(keys, n_buckets)
    return bucket, (keys & _LOW) | (bucket.astype(np.uint64) << np.uint64(48))


def _six(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def _eight(raw: np.ndarray, bucket: int) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel() | np.uint64(bucket << 48)


_SENT = ("<i8", "<u4", "u1", "<i8", "<u4", "<u8", "<i8", "<u4")
_BACK = ("<u4", "<i8", "<u4", "u1", "u1", "<i8", "<u4", "<u8", "<i8", "<u4")


def _send(common: np.ndarray, n_buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sizes, owners, keys in _gathered(batches):
            last = np.isin(keys, common)
            sections: dict[int, list] = {}

            def section(b: int, sections=sections) -> list:
                return sections.setdefault(b, [np.empty(0, k) for k in _SENT])

            bucket, tokens = _tokens(keys, n_buckets)
            free = ~last
            for b, (k, t) in exchange.parted(bucket[free], (owners[free], tokens[free])):
                section(b)[:3] = [*exchange.runs(k), _six(t)]
            for b, (k, t) in exchange.parted(exchange.slots_of_keys(owners[last], n_buckets), (owners[last], tokens[last])):
                section(b)[3:6] = [*exchange.runs(k), t]
            for b, (k, n) in exchange.parted(exchange.slots_of_keys(names, n_buckets), (names, sizes)):
                section(b)[6:] = [k, n.astype(np.uint32)]
            yield exchange.batch(list(sections), [exchange.pack(c) for c in sections.values()])

    return run


def _count(n_slots: int) -> Callable:
    """Shared tokens of the buckets with their frequency class, back to the slots of sets."""

    blank = [np.empty(0, k) for k in _BACK]

    def shared_of(part: int, parts: int, sent: list[tuple]) -> Iterator[tuple[int, bytes]]:
        """One of the parts of a bucket's tokens, so that memory stays a fraction of it."""
        keys, tokens = [], []
        for bucket, k, n, raw in sent:
            token = _eight(raw, bucket)
            mine = (token & np.uint64(parts - 1)) == np.uint64(part)
            keys.append(np.repeat(k, n)[mine])
            tokens.append(token[mine])
        key, token = np.concatenate(keys), np.concatenate(tokens)
        del keys, tokens
        order = np.lexsort((key, token))
        key, token = key[order], token[order]
        new = np.ones(len(key), np.bool_)
        new[1:] = (key[1:] != key[:-1]) | (token[1:] != token[:-1])
        key, token = key[new], token[new]
        counts = exchange.runs(token)[1]
        frequency = np.repeat(counts, counts)
        shared = frequency > 1
        key, token = key[shared], token[shared]
        grade = np.minimum(8 * np.log2(frequency[shared]), _ORDER_COMMON - 1).astype(np.uint8)
        order = np.lexsort((key, token >> np.uint64(48)))
        key, token, grade = key[order], token[order], grade[order]
        ends = np.cumsum(exchange.runs(token >> np.uint64(48))[1], dtype=np.int64).tolist()
        for low, high in zip([0, *ends], ends, strict=False):
            bucket = np.array([token[low] >> np.uint64(48)], np.uint32)
            part = slice(low, high)
            for s, (k, t, g) in exchange.parted(exchange.slots_of_keys(key[part], n_slots), (key[part], token[part], grade[part])):
                yield s, exchange.pack([bucket, *exchange.runs(k), _six(t), g, *blank[5:]])

    def passed_on(done: list[tuple], sizes: list[tuple]) -> Iterator[tuple[int, bytes]]:
        key, token = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.argsort(key, kind="stable")
        for s, (k, t) in exchange.parted(exchange.slots_of_keys(key, n_slots)[order], (key[order], token[order])):
            yield s, exchange.pack([*blank[:5], *exchange.runs(k), t, *blank[8:]])
        key, n = (np.concatenate(c) for c in zip(*sizes, strict=True))
        for s, (k, m) in exchange.parted(exchange.slots_of_keys(key, n_slots), (key, n)):
            yield s, exchange.pack([*blank[:8], k, m])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, done, sizes = [], [], []
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                k, n, raw, dk, dn, dt, sk, sn = exchange.unpack(blob.as_buffer().to_pybytes(), _SENT)
                sent.append((bucket, k, n, raw))
                done.append((np.repeat(dk, dn), dt))
                sizes.append((sk, sn))
        if not sent:
            return
        parts = 1 << (sum(len(raw) for *_, raw in sent) // 6 // _AT_ONCE).bit_length()
        for found in (passed_on(done, sizes), *(shared_of(part, parts, sent) for part in range(parts))):
            while some := list(islice(found, 256)):
                yield exchange.batch(*map(list, zip(*some, strict=True)), name="slot")

    return run


SETS = "set_key long, n int, before int, prefix array<long>, tokens binary, sketch array<int>"


_RANGES = 32


def _sketch(tokens: np.ndarray) -> list[int]:
    """Shared shingles in each of _RANGES hash ranges."""
    return np.bincount((mix(tokens) >> np.uint64(59)).astype(np.int64), minlength=_RANGES).tolist()


def _order(table: pa.Table) -> pa.Table:
    """Sets of a slot that have a shared shingle in their prefix. `before` counts the shingles
    ahead of the shared ones; `tokens` are the shared ones in ascending value."""
    keys, tokens, grades, names, sizes = [], [], [], [], []
    for blob in table.column("blob"):
        bucket, k, n, raw, g, dk, dn, dt, sk, sn = exchange.unpack(blob.as_buffer().to_pybytes(), _BACK)
        keys += [np.repeat(k, n), np.repeat(dk, dn)]
        tokens += [_eight(raw, int(bucket[0])) if len(bucket) else np.empty(0, np.uint64), dt]
        grades += [g.astype(np.int64), np.full(len(dt), _ORDER_COMMON)]
        names.append(sk)
        sizes.append(sn)
    key, token, grade = np.concatenate(keys), np.concatenate(tokens), np.concatenate(grades)
    names, first = np.unique(np.concatenate(names), return_index=True)
    sizes = np.concatenate(sizes)[first].astype(np.int64)
    order = np.lexsort((token, grade, key))
    key, token = key[order], token[order]
    new = np.ones(len(key), np.bool_)
    new[1:] = (key[1:] != key[:-1]) | (token[1:] != token[:-1])
    key, token = key[new], token[new]
    own, counts = exchange.runs(key)
    ends = np.cumsum(counts, dtype=np.int64)
    rows = []
    for name, end, count, n in zip(own.tolist(), ends.tolist(), counts.tolist(), sizes[np.searchsorted(names, own)].tolist(), strict=True):
        before = n - count
        prefix = n - -(-PERCENT * n // 100) + 1 - before
        if prefix > 0:
            mine = token[end - count : end]
            ranked = np.sort(mine)
            rows.append((name, n, before, mine[:prefix].view(np.int64).tolist(), ranked.tobytes(), _sketch(ranked)))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32())]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SETS.split(", ")])


def _linked(overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * overlap >= PERCENT * (n + m - overlap)


def _possible() -> Column:
    """Suffix filter: the overlap that the sketches of sides a and b allow is enough."""
    most = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, v: s + v)
    return (100 + PERCENT) * most.cast("long") >= PERCENT * (F.col("n_a") + F.col("n_b")).cast("long")


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        overlap = np.array(
            [
                len(np.intersect1d(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), assume_unique=True))
                for x, y in zip(b.column("tokens_a"), b.column("tokens_b"), strict=True)
            ],
            np.int64,
        )
        n, m = (b.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
        yield b.filter(pa.array(_linked(overlap, n, m))).select(["a", "b"])


def _side(sets: DataFrame, name: str, *columns: str) -> DataFrame:
    return sets.select(F.col("set_key").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Linked pairs among distinct pairs (a, b)."""
    sketched = pairs.join(_side(sets, "a", "n", "sketch"), "a").join(_side(sets, "b", "n", "sketch"), "b")
    near = sketched.where(_possible()).drop("sketch_a", "sketch_b")
    full = near.join(_side(sets, "a", "tokens"), "a").join(_side(sets, "b", "tokens"), "b")
    return full.mapInArrow(_exact, "a long, b long")


def _least_size(n: str, m: str) -> str:
    return f"100L * least({n}, {m}) >= {PERCENT}L * greatest({n}, {m})"


def _round_one(index: DataFrame) -> DataFrame:
    """A partner for each set: the most central set, that with the least share of shingles of
    its own, behind most of its prefix tokens. What a group of copies stems from is such a set."""
    own = (F.col("n") - F.col("ahead") - F.col("rest")) / F.col("n")
    central = F.min(F.struct(own.alias("own"), "set_key"))["set_key"]
    heads = index.groupBy("token").agg(central.alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    votes = index.join(heads, "token").where("set_key <> head").groupBy("set_key", "head").count()
    return votes.groupBy("set_key").agg(F.max_by("head", F.struct("count", -F.col("head"))).alias("a")).select("a", F.col("set_key").alias("b"))


def _round_two(index: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs not joined yet that share a prefix token and pass all three filters, which are part
    of the join, so a group's pairs that fail them are never written."""
    named = index.join(labels, index["set_key"] == labels["node"], "left").select(
        "token", "set_key", "n", "ahead", "rest", F.coalesce("root", "set_key").alias("label")
    )
    open_tokens = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    rows = named.join(open_tokens, "token", "left_semi").join(sets.select("set_key", "sketch"), "set_key")
    one, two = (rows.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("set_key", "n", "ahead", "rest", "label", "sketch")]) for s in "ab")
    # Shingles that no other set has stand first and can't overlap, so they don't count as ahead.
    most = "least(ahead_a, ahead_b) + least(rest_a, rest_b)"
    cheap = F.expr(
        f"label_a < label_b and {_least_size('n_a', 'n_b')} and {100 + PERCENT}L * ({most}) >= {PERCENT}L * (n_a + n_b)"
    )
    pairs = one.join(two, "token").where(cheap & _possible())
    return pairs.select(F.col("set_key_a").alias("a"), F.col("set_key_b").alias("b")).distinct()


def linked_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document."""
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    members = store(_members(texts), "members")
    n_sets = members.where("n_shingles > 0").count()
    n_buckets, n_slots = min(partitions(spark), 1 << 16), exchange.slots(spark)
    common = spark.sparkContext.broadcast(_common(texts, n_sets))
    sent = texts.mapInArrow(lambda batches: _send(common.value, n_buckets)(batches), exchange.BLOBS)
    back = exchange.meet(sent).mapInArrow(_count(n_slots), exchange.SLOTS)
    sets = store(back.groupBy("slot").applyInArrow(_order, SETS), "sets")

    # Of a token: shared tokens ahead of it in its set, and tokens from it to the end.
    index = sets.select("set_key", "n", "before", F.posexplode("prefix").alias("ahead", "token")).select(
        "token", "set_key", "n", "ahead", (F.col("n") - F.col("before") - F.col("ahead")).alias("rest")
    )
    first = store(_verify(_round_one(index), sets), "links")
    joined = connected(first)
    second = store(_verify(_round_two(index, joined, sets), sets), "links")
    labels = connected(first.unionByName(second))
    for table in (sets, first, second, joined):
        drop_stored(table)

    classes = members.join(labels, members["set_key"] == labels["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "set_key").alias("class")
    )
    names = classes.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least"))
    out = classes.join(names, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.
    Documents without shingles stay. Rows that repeat both id and text leave one row."""
    found = linked_components(docs).where("doc_id = component_id or doc_id is null or n_shingles = 0").select("doc_id").distinct()
    kept = docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_semi")
    rank = F.row_number().over(Window.partitionBy(docs["doc_id"], F.xxhash64(docs["text"])).orderBy(F.lit(0)))
    row = kept.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), rank.alias("_rank"))
    return row.where("_rank = 1").select("_row.*")
