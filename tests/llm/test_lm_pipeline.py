import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import decontaminate, fertility, langid, maxent_lm, ngram_join, queries, secret_scan
from cohortloom.llm.words import slices

from .conftest import SF, lowered


def test_scores(documents, rows):
    found = maxent_lm.score(documents, langid.id_fold(7) == F.lit(2)).toPandas()
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    texts = [(d, lowered(t).split() + [None]) for d, t in rows]
    counts = Counter(w for d, ws in texts if not held[d] for w in ws)
    n, v = counts.total(), len(counts)
    wanted = sorted(
        (repr(d), held[d], len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws in texts
    )
    ids = [repr(None) if d != d else repr(int(d)) for d in found["doc_id"]]
    got = sorted(zip(ids, found["held_out"].tolist(), found["n_tokens"].tolist(), found["n_known"].tolist(), found["base_score"].round(5).tolist(), strict=True))
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    assert max(abs(g[4] - w[4]) for g, w in zip(got, wanted, strict=True)) < 1e-4
    assert set(found["train_tokens"]) == {n}
    unseen = found[found["held_out"]]
    assert unseen["score"].sum() > unseen["base_score"].sum()


def _random_weights(seed):
    rng = np.random.default_rng(seed)
    weights = maxent_lm.Weights.start(1 + rng.random((maxent_lm.CLASSES, maxent_lm.LEAVES)), 1000)
    weights.flat[:] = rng.normal(size=len(weights.flat))
    return weights


def test_the_model_is_a_distribution():
    """Class shares add up to one, and so do the leaves of a class."""
    weights = _random_weights(2)
    part = next(slices(pa.array(["a b c d e", "", "x"])))
    hashes, kinds, first = maxent_lm.tokens(part)
    assert first.tolist() == [0, 6, 7, 9] and (kinds == 0).sum() == 3
    at = maxent_lm.features(hashes, first)
    shares = weights.shares(at)
    assert np.allclose(shares.sum(axis=1), 1, atol=1e-5)
    own = np.arange(len(hashes)) % maxent_lm.CLASSES
    assert np.allclose(weights.log_share(at, own), np.log(shares[np.arange(len(own)), own]), atol=1e-5)
    for c in range(maxent_lm.CLASSES):
        each = [weights.log_leaf(at, np.full(len(at), c), np.full(len(at), leaf)) for leaf in range(maxent_lm.LEAVES)]
        if c <= maxent_lm.SINGLE:
            assert not np.any(each)
        else:
            assert np.allclose(np.exp(each).sum(axis=0), 1, atol=1e-4) and np.ptp(each) > 1


def test_without_weights_leaves_have_their_share_of_the_counts():
    mass = 1 + np.random.default_rng(3).integers(0, 50, (maxent_lm.CLASSES, maxent_lm.LEAVES)).astype(float)
    weights = maxent_lm.Weights.start(mass, 1000)
    at = np.zeros((maxent_lm.LEAVES, 5), np.uint64)
    found = weights.log_leaf(at, np.full(maxent_lm.LEAVES, 20), np.arange(maxent_lm.LEAVES))
    assert np.allclose(found, np.log(mass[20] / mass[20].sum()), atol=1e-4)


def test_leaf_mass_is_the_count_of_its_words(spark):
    docs = spark.createDataFrame([("the cat the dog.",), ("The end!",), (None,)], "text string")
    counts = maxent_lm.count_words(docs)
    assert counts.tokens == 6 + 3 and counts.distinct == 5
    unseen = maxent_lm.SINGLE + 1 + (maxent_lm.CLASSES - maxent_lm.SINGLE - 1) * maxent_lm.LEAVES
    assert counts.mass.sum() == counts.tokens + counts.distinct + unseen


def test_tables_grow_with_distinct_words():
    mass = np.ones((maxent_lm.CLASSES, maxent_lm.LEAVES))
    sizes = [len(maxent_lm.Weights.start(mass, n).rows) for n in (0, 100_000, 200_000, 10**9)]
    assert sizes == [1 << 13, 1 << 14, 1 << 15, 1 << 15]


@pytest.mark.parametrize("own", [lambda i: i % 3 + 1, lambda i: np.full(len(i), 20)])
def test_training_lowers_the_loss_of_classes_and_of_words(own):
    place = np.arange(6000) % 3
    at = maxent_lm.features(np.array([11, 22, 33], np.uint64)[place], np.array([0, 6000]))
    wanted, leaf = own(np.arange(6000)), place * 7
    weights = maxent_lm.Weights.start(np.ones((maxent_lm.CLASSES, maxent_lm.LEAVES)), 1000)
    learner = maxent_lm.Learner(weights)

    def fit():
        return (weights.log_share(at, wanted) + weights.log_leaf(at, wanted, leaf)).mean()

    before = fit()
    for _ in range(5):
        learner.learn(at, wanted, leaf)
    assert fit() > before + 1


def _plain_step(w, sums, at, wanted, leaf, step=maxent_lm.STEP):
    """One AdaGrad step, weight by weight as the gradient says; `sums` are the squares so far."""
    n = len(wanted)
    gradient = w.shares(at).astype(np.float64)
    gradient[np.arange(n), wanted] -= 1
    total = np.zeros(w.rows.shape)
    rows = w.at_rows(at)
    for j in range(5):
        np.add.at(total, rows[:, j], gradient)
    sums[0] += (total**2).sum(axis=1)
    bias = gradient.sum(axis=0)
    sums[1] += (bias**2).sum()
    nodes, flat = np.zeros(len(w.pairs)), w.pairs.copy()
    for t in np.flatnonzero(wanted > maxent_lm.SINGLE):
        for level in range(maxent_lm.DEPTH):
            node = wanted[t] * maxent_lm.LEAVES + (1 << level) + (leaf[t] >> (maxent_lm.DEPTH - level))
            place = ((at[t] * maxent_lm._SPREAD[node]) >> w._shift).astype(np.int64)
            right = (leaf[t] >> (maxent_lm.DEPTH - 1 - level)) & 1
            np.add.at(nodes, place, 1 / (1 + math.exp(-w.odds[node] - flat[place].sum())) - right)
    sums[2] += nodes**2
    w.rows -= (step * total / np.sqrt(sums[0] + 1e-6)[:, None]).astype(np.float32)
    w.bias -= (step * bias / math.sqrt(sums[1])).astype(np.float32)
    w.pairs -= (step * nodes / np.sqrt(sums[2])).astype(np.float32)


def _batch(n, seed=4):
    rng = np.random.default_rng(seed)
    words = rng.zipf(1.3, n) % 50_000
    at = maxent_lm.features(maxent_lm.mix(words.astype(np.uint64)), np.array([0, n // 3, n // 3 + 1, n]))
    return at, (words % maxent_lm.CLASSES).astype(np.int64), (words % maxent_lm.LEAVES).astype(np.int64)


@pytest.mark.parametrize("scale", [0.0, 1.0, 40.0])
def test_a_step_is_that_of_the_plain_gradient(scale):
    at, wanted, leaf = _batch(700)
    one, two = _random_weights(5), _random_weights(5)
    for w in (one, two):
        w.flat *= np.float32(scale)
    learner, sums = maxent_lm.Learner(one), [np.ones(len(two.rows)), 1.0, np.ones(len(two.pairs))]
    for _ in range(2):
        learner.learn(at, wanted, leaf)
        _plain_step(two, sums, at, wanted, leaf)
    assert np.allclose(one.flat, two.flat, atol=2e-4 * max(1, scale))


def test_runs_of_rows_add_up():
    rng = np.random.default_rng(6)
    counts = np.array([1, 1, 2, 3, 4, 9, 10, 28, 1, 700])
    values = np.vstack([rng.integers(-9, 9, (50, 32)), np.zeros((1, 32))]).astype(np.float32)
    at = rng.integers(0, 50, counts.sum())
    wanted = [values[part].sum(axis=0) for part in np.split(at, np.cumsum(counts)[:-1])]
    assert np.array_equal(maxent_lm._run_sums(values, at, counts), wanted)


def test_learning_costs_less_than_sums_over_every_run():
    """Summing class gradients run by run, column by column, was most of the CPU time."""
    at, wanted, leaf = _batch(maxent_lm.BATCH)
    weights = _random_weights(7)
    learner, rows = maxent_lm.Learner(weights), weights.at_rows(at).ravel()
    gradient = np.ones((maxent_lm.BATCH, maxent_lm.CLASSES), np.float32)

    def by_runs():
        order = np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
        np.add.reduceat(gradient[order // 5], starts, axis=0)

    def best(step):
        times = []
        for _ in range(9):
            begin = time.process_time()
            step()
            times.append(time.process_time() - begin)
        return min(times)

    assert best(lambda: learner.learn_classes(at, wanted, leaf)) < best(by_runs)


def test_features_of_a_part_are_those_of_the_whole():
    hashes = maxent_lm.mix(np.arange(10_000, dtype=np.uint64))
    first = np.array([0, 1, 2, 5, 4096, 4097, 9000, 10_000])
    whole = maxent_lm.features(hashes, first)
    for low, high in ((0, 4097), (3, 9), (4096, 8192), (9_999, 20_000)):
        assert np.array_equal(maxent_lm.features(hashes, first, low, high), whole[low:high])


def test_frequent_words_are_found_where_slots_are_shared():
    rng = np.random.default_rng(8)
    common = np.unique(np.append(rng.integers(0, 2**63, 5000), np.arange(7, 300, 3)).astype(np.uint64))
    count = rng.integers(1, 99, len(common))
    counts = maxent_lm.Counts(common, count, common[:0], common[:0].astype(np.int64), 1, 1, np.ones((1, 1)))
    asked = np.concatenate([common[::-1], np.arange(0, 300, dtype=np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)])
    place = {int(w): i for i, w in enumerate(common)}
    assert counts.known(asked).tolist() == [place.get(int(w), -1) for w in asked]


def test_scores_hardly_depend_on_tasks(spark):
    """The base score not at all; unseen documents within two per cent."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [maxent_lm.score(docs.repartition(n, "doc_id"), langid.id_fold(7) == F.lit(2)).drop_duplicates().toPandas() for n in (1, 7)]
    one, seven = (f.set_index("doc_id").sort_index() for f in found)
    assert np.allclose(one["base_score"], seven["base_score"], rtol=1e-9)
    totals = [f.loc[f["held_out"], "score"].sum() for f in (one, seven)]
    assert math.isclose(*totals, rel_tol=0.02)


def test_scores_of_empty_table(empty):
    assert maxent_lm.score(empty, F.lit(False)).count() == 0


def test_pipeline_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    left = docs
    verdicts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF).cache()
        assert after.dtypes == docs.dtypes, name
        verdicts.append(after)
        left = after
    good, single, clean, safe = verdicts

    def ids(df):
        return {r[0] for r in df.select("doc_id").collect()}

    assert ids(good) == {r[0] for r in fertility.quality_measures(docs).where("kept").select("doc_id").collect()}
    assert ids(single) == {r[2] for r in ngram_join.linked_components(good).collect()} and single.count() == len(ids(single))
    assert ids(clean) == ids(single) - ids(decontaminate.contaminated(single, bench)) < ids(single)
    assert ids(safe) == ids(clean) and secret_scan.scan(safe).where("n_assign + n_access + n_hex > 0").count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == ids(safe)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_each_query_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).limit(1).count() == 1
