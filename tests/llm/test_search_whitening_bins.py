import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from cohortloom.llm import best_fit, ranked_search, whitening
from cohortloom.llm.vocab import default_path, json_model

from .conftest import SF, order

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def best_by_hand(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
                for w in terms(text) if w in c
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def test_search_matches_brute_force_with_any_shards(spark, documents, rows, monkeypatch):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "!! ,, ??"), (-4, "zzzz no such qqqq"), (-5, "w1 W1 w1 x3 " * 40), (-6, "Привет МИР 世界"), (None, "one two three")]
    items = benchmark.unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    items = items.unionByName(items.where("item_id in (0, -5)")).withColumns({n: F.lit(1) for n in ("key", "rank", "doc_id", "score", "terms")})
    wanted = order(best_by_hand(rows, [(r["item_id"], r["text"]) for r in items.collect()]))
    assert order(ranked_search.search(documents, items).collect()) == wanted
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 7)
    monkeypatch.setattr(ranked_search, "VOCABULARY", 3)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 900)
    monkeypatch.setattr(ranked_search, "STEP", 1)
    assert order(ranked_search.search(documents, items).collect()) == wanted
    schema = ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.search(documents.where("false"), items).columns == schema
    assert ranked_search.search(documents.where("false"), items).count() == 0
    assert ranked_search.search(documents, items.where("false")).count() == 0
    assert ranked_search.search(documents.where("text is null"), items).count() == 0


def test_search_stops_before_the_end_of_the_lists():
    """One strong document on top of long lists: only the heads are read, and none of a weaker shard."""
    import pyarrow as pa

    n = 4000
    strong = np.array([0, 1], np.uint64)
    terms_ = np.array([5, 9], np.uint64)
    place = np.concatenate([strong, np.tile([0, 1], n)]).astype("<u4")
    tf = np.concatenate([[500, 500], np.ones(2 * n)]).astype("<u4")
    lengths = np.concatenate([[1000], np.arange(2000, 2000 + n)]).astype("<i8")
    blob = ranked_search.pack([lengths, np.full(n + 1, 2, "<u4"), terms_, place, tf])
    weights = np.array([1000, 1000], np.int64)
    shard = ranked_search.Shard(pa.array(range(n + 1), pa.int64()), blob, terms_, weights, n + 1, int(lengths.sum()))
    best, scratch = ranked_search.Best(1), np.full(2, -1, np.int64)
    read = ranked_search.best_positions(shard, np.array([0, 1]), np.array([1, 1]), best, scratch)
    assert best.ids.tolist() == [0] and 1 <= read <= ranked_search.STEP
    weak = ranked_search.Shard(pa.array(range(n), pa.int64()), ranked_search.pack([lengths[1:], np.full(n, 2, "<u4"), terms_, place[2:], tf[2:]]), terms_, weights, n + 1, int(lengths.sum()))
    assert ranked_search.best_positions(weak, np.array([0, 1]), np.array([1, 1]), best, scratch) == 0
    assert (scratch == -1).all()


def whole(vector):
    return tuple(math.floor(256 * c) for c in vector)


def test_whitening_matches_exact_covariance(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    table = table.unionByName(table.where("vec_id < 9")).withColumns({n: F.lit("y") for n in ("x", "v", "n", "place", "component", "whitened")})
    found = whitening.whiten(table.repartition(5)).collect()
    kept = [(r["vec_id"], whole(r["embedding"])) for r in table.collect()]
    fit = np.array(sorted({x for _, x in kept}), object)
    n, sums = len(fit), fit.sum(0)
    centred = n * fit - sums
    exact = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in centred.T @ centred])
    values, vectors = np.linalg.eigh(exact)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert Counter((r["vec_id"], r["component"]) for r in found) == Counter((i, c) for i, _ in kept for c in (1, 2, 3, 4))
    x_of = dict(kept)
    for component in (1, 2, 3, 4):
        mine = [r for r in found if r["component"] == component]
        got = np.array([r["whitened"] for r in mine])
        rows = np.array([[float(Fraction(int(v), n)) for v in n * np.array(x_of[r["vec_id"]], object) - sums] for r in mine])
        expected = rows @ vectors[:, component - 1] / math.sqrt(values[component - 1])
        assert min(np.abs(got - expected).max(), np.abs(got + expected).max()) < 1e-8
        assert {r["n"] for r in mine} == {n} and max(r["identity_error"] for r in mine) < 1e-9
        assert all(abs(r["explained"] / (values[component - 1] / values.sum()) - 1) < 1e-9 for r in mine)
        assert all(r["deviation"] == sum((n * np.array(x_of[r["vec_id"]], object) - sums) ** 2) == int(r["deviation_text"]) for r in mine)


def test_whitening_of_odd_tables(spark):
    bad = [(1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, [0.0, float("-inf")])]
    fine = [(6, [1.0, 2.0]), (None, [3.0]), (7, []), (7, [1.0, 2.0]), (8, [1e38, -1e38])]
    table = spark.createDataFrame(bad + fine, "vec_id long, embedding array<float>")
    found = whitening.whiten(table).collect()
    assert Counter(r["vec_id"] for r in found) == {6: 2, None: 2, 7: 4, 8: 2}
    assert {r["n"] for r in found} == {4}  # (1, 2), (3, 0), (0, 0) and the far one
    top, low = 2**63 - 1, -(2**63)
    rows = np.array([[256, 512], [768, 0], [0, 0], [top, low]], object)
    far = sum((4 * rows[3] - rows.sum(0)) ** 2)
    assert {int(r["deviation_text"]) for r in found if r["vec_id"] == 8} == {far} and {r["deviation"] for r in found if r["vec_id"] == 8} == {None}
    assert whitening.whiten(table.where("vec_id < 6")).count() == 0
    assert whitening.whiten(table.where("false")).count() == 0
    one = whitening.whiten(table.where("vec_id = 6")).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one] == [(None, None, None, 0)] * 2


def test_square_sums_are_exact_for_any_size():
    rng = np.random.default_rng(3)
    for bits in (3, 20, 30, 33, 60):
        t = rng.integers(-(2**bits), 2**bits, (300, 4))
        assert whitening.square_sums(t) == [sum(int(v) ** 2 for v in c) for c in t.T]
    assert whitening.square_sums(np.empty((0, 3), np.int64)) == [0, 0, 0]


def greedy_gaps(counts, capacity):
    items = [s for s, c in counts.items() for _ in range(c)]
    left, gaps = sorted((s for s in items if 3 * s > capacity), reverse=True), []
    while left:
        a = left.pop(0)
        partner = next((k for k, b in enumerate(left) if a + b <= capacity), None)
        gaps.append(capacity - a - (left.pop(partner) if partner is not None else 0))
    for s in sorted((s for s in items if 3 * s <= capacity), reverse=True):
        at = min((i for i, g in enumerate(gaps) if g >= s), key=lambda i: gaps[i], default=None)
        if at is None:
            gaps.append(capacity - s)
        else:
            gaps[at] -= s
    return sorted(gaps)


def test_plan_equals_piece_by_piece_matching():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice([7, 20, 64, 100, 333])
        counts = {s: rng.choice([0, 0, 1, 2, 3, 9]) for s in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        plan = best_fit.make_plan(counts, capacity)
        sizes = np.array([s for s, c in counts.items() for _ in range(c)], np.int64)
        ranks = np.array([i for c in counts.values() for i in range(c)], np.int64)
        fill, large = defaultdict(int), Counter()
        if len(sizes):
            bins, offsets = best_fit.place(plan.arrays(), sizes, ranks)
            for b, o, s in sorted(zip(bins.tolist(), offsets.tolist(), sizes.tolist(), strict=True)):
                assert fill[b] == o
                fill[b] += s
                large[b] += 3 * s > capacity
        assert set(fill) == set(range(plan.bins)) and max(large.values(), default=0) <= 2
        assert sorted(capacity - v for v in fill.values()) == greedy_gaps(counts, capacity)


def test_plan_does_not_grow_with_the_rows():
    small = best_fit.make_plan({s: 3 for s in range(1, 4097)})
    large = best_fit.make_plan({s: 3 * 10**9 for s in range(1, 4097)})
    assert len(large.rows) < 2 * len(small.rows) and large.bins <= 10**9 * small.bins


def test_best_fit_packs_every_id_once(spark, documents, rows):
    model = json_model(default_path("word_bpe_49k.json"))
    docs = documents.unionByName(spark.createDataFrame([(910000 + i, None) for i in range(500)], "doc_id long, text string"), allowMissingColumns=True)
    pieces = best_fit.pack(docs).collect()
    wanted = Counter()
    for doc_id, text in rows + [(910000 + i, None) for i in range(500)]:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for number, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            wanted[doc_id, number, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == wanted
    sequences, counts = defaultdict(list), Counter(p["length"] for p in pieces)
    for p in pieces:
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(4096 - sum(n for _, n in s) for s in sequences.values()) == greedy_gaps(counts, 4096)
    assert best_fit.pack(documents.where("false")).count() == 0
    assert "ids" not in best_fit.pack(documents, with_ids=False).columns
