import hashlib
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from cohortloom.llm import components, decontaminate, ngram_join, repeats
from cohortloom.llm.words import slices

from .conftest import lowered, order


def shingles(text):
    w = lowered(text).split()
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = Counter((a, b) for own in where.values() for k, a in enumerate(own) for b in own[k + 1 :])
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for (a, b), o in shared.items():
        if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            root[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return order((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_ngram_join_matches_brute_force(documents, rows):
    assert order(ngram_join.linked_components(documents).collect()) == brute_components(rows)


def test_ngram_join_on_chains_and_thresholds(spark):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(60)]
    texts = []
    for i in range(40):  # a chain: each text drops a little more of the front
        texts.append(" ".join(base[i // 2 :] + [f"t{60 + j}" for j in range(i // 2)]))
    for i in range(80):  # near copies around one text, and unrelated ones with a shared passage
        words = [f"v{j}" for j in range(70)]
        words[int(rng.integers(70))] = f"edit{i}"
        texts.append(" ".join(words))
        texts.append(" ".join([f"p{j}" for j in range(12)] + [f"u{i}_{j}" for j in range(30)]))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert order(ngram_join.linked_components(docs).collect()) == brute_components(rows)


def test_keep_one_of_each_group(documents, empty):
    kept = ngram_join.keep_one(documents)
    assert kept.columns == documents.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    wanted = {r[2] for r in ngram_join.linked_components(documents).where("doc_id is not null").collect()}
    assert set(ids) - {None} == wanted and len(ids) == len(set(ids))
    assert ngram_join.linked_components(empty).count() == 0


def test_components_of_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(5, 5), (100, 101), (101, 100)]
    found = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def brute_removal(rows, window):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[j : j + window]) for _, w in words for j in range(len(w) - window + 1))
    out = []
    for d, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone.update(range(j, j + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return order(out)


def test_repeats_match_brute_force(documents, rows):
    found = repeats.remove_repeats(documents).drop("kept_text").collect()
    assert order(found) == brute_removal(rows, 35)


def test_repeats_at_other_lengths(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 3, int(rng.integers(0, 120))))) for _ in range(60)] + ["a " * 200, "a b " * 50]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for window in (5, 13, 35):
        found = repeats.remove_repeats(docs, window).collect()
        assert order(r[:4] for r in found) == brute_removal(rows, window)
        assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in found)
    assert repeats.remove_repeats(docs.where("false")).count() == 0


def test_levels_double():
    assert repeats.lengths(35) == [9, 18, 35]
    assert repeats.lengths(5) == [5]


def brute_matches(docs, items):
    def grams(w, size):
        return Counter(tuple(w[j : j + size]) for j in range(len(w) - size + 1))

    found = set()
    for d, text in docs:
        w = lowered(text).split()
        for item, other in items:
            v = lowered(other).split()
            size = min(5, len(v))
            for at in range(len(w) - len(v) + 1 if v else 0):
                a, b = grams(w[at : at + len(v)], size), grams(v, size)
                if 2 * sum((a & b).values()) >= 0.75 * (a.total() + b.total()):
                    found.add((d, item))
                    break
    return found


def test_decontamination_matches_brute_force(spark, documents, empty):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    words = items[0][1].split()
    edited = " ".join(words[:8] + ["another"] + words[9:])
    partly = " ".join(words[: len(words) // 2])
    planted = [(1, f"before it {items[1][1].upper()} after it"), (2, edited), (3, partly), (4, None), (5, ""), (6, "clean text of no benchmark"), (7, "tiny item here")]
    bench = bench.unionByName(spark.createDataFrame([(5000, None), (5001, ""), (5002, "Tiny item")], bench.schema))
    items += [(5000, None), (5001, ""), (5002, "Tiny item")]
    docs = spark.createDataFrame(planted, "doc_id long, text string").unionByName(documents.select("doc_id", "text").where("doc_id < 120"))
    found = decontaminate.contaminated(docs, bench)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    wanted = brute_matches([tuple(r) for r in docs.collect()], items)
    assert got == wanted and (1, items[1][0]) in got and (7, 5002) in got and not {d for d, _ in got} & {3, 4, 5, 6}
    kept = decontaminate.drop_contaminated(documents, bench)
    assert kept.schema == documents.schema
    bad = {r[0] for r in decontaminate.contaminated(documents, bench).select("doc_id").collect()}
    assert kept.count() == sum(r[0] not in bad for r in documents.select("doc_id").collect())
    assert decontaminate.contaminated(documents, bench.where("false")).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0


def test_all_fingerprints_within_radius_are_found():
    rng = np.random.default_rng(7)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(50)]
    index = decontaminate.ItemIndex(items)
    flips = decontaminate.RADIUS + 1
    prints = [int(index.print[k // flips]) ^ sum(1 << int(b) for b in rng.choice(64, k % flips, replace=False)) for k in range(50 * flips)]
    for one, two in ((np.array(prints, np.uint64), index.print), (index.print, np.array(prints, np.uint64))):
        pairs = set(zip(*(c.tolist() for c in decontaminate.near_pairs(one, two)), strict=True))
        wanted = {(i, j) for i, a in enumerate(one.tolist()) for j, b in enumerate(two.tolist()) if (a ^ b).bit_count() <= decontaminate.RADIUS}
        assert pairs == wanted and len(pairs) >= len(prints)


def recall(items, texts):
    """(found, wanted) pairs of texts and items by the items' words: under 30, under 50, 50 and more."""
    index = decontaminate.ItemIndex(list(enumerate(items)))
    found = set()
    for part in slices(pa.array(texts)):
        found |= {(part.low + m[0], m[1]) for m in index.matches(part, decontaminate.SIMILARITY)}
    out = {n: [0, 0] for n in (30, 50, 10**9)}
    for t, i in brute_matches(list(enumerate(texts)), list(enumerate(items))):
        n = min(k for k in out if len(items[i].split()) < k)
        out[n][0] += (t, i) in found
        out[n][1] += 1
    return out


def test_recall_by_item_length(spark):
    """Passages cut at the end or with words replaced, inside other text, against exact similarity."""
    rng = np.random.default_rng(11)
    items = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("text").limit(20).collect()]
    texts = []
    for item in items:
        words = item.split()
        for share in (0.05, 0.1, 0.2):
            around = [" ".join(f"z{k}" for k in rng.integers(0, 500, 30)) for _ in range(2)]
            cut = words[: len(words) - int(share * len(words))]
            other = [f"q{j}" if rng.random() < share / 4 else w for j, w in enumerate(words)]
            texts += [" ".join([around[0], *kept, around[1]]) for kept in (cut, other)]
    found = recall(items, texts)
    assert sum(n for _, n in found.values()) > 60
    assert all(got >= 0.99 * n for got, n in found.values()), found


def test_many_items_take_one_scan_and_long_texts_little_memory(spark):
    bench = spark.range(5000).selectExpr("id item_id", "concat_ws(' ', transform(sequence(1, 12 + int(id % 9)), x -> concat('w', id, 'v', x))) text")
    docs = bench.selectExpr("item_id doc_id", "concat('ahead ', text, ' behind') text").where("doc_id % 10 = 0")
    found = decontaminate.contaminated(docs, bench)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert found.where("doc_id = item_id").count() == 500
    items = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(12 + i))) for i in range(29)]
    text = " ".join(items[k % 29][1] for k in range(500))
    part = next(slices(pa.array([text])))
    tracemalloc.start()
    assert len(list(decontaminate.ItemIndex(items).matches(part, 0.75))) == 29
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000
