"""Language-model scores: exact shares by hand, a distribution that sums to one, gradients, and edges."""

import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pytest
from boxlake.llm import language_model as lm
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, ids int, held_out string, word string"
EN, DE = "the mill stands by the old river and herons fish below it".split(), "die alte Mühle steht am Fluss und Reiher fischen unter dem Wehr".split()


def rows(n=300, seed=5):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice((EN, DE)[i % 2], rng.integers(5, 40))), "r", 1, "h", "w") for i in range(n)]


EDGES = [(1, None, "", 1, "", ""), (2, "", "", 1, "", ""), (None, "The Mill", "", 1, "", ""), (None, "The Mill", "", 1, "", ""), (3, "ÄRGER  \n\t never\x0bseen", "", 1, "", ""), (4, "long words " * 40_000, "", 1, "", ""), (4, "long words " * 40_000, "", 1, "", "")]


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def by_hand(docs):
    c = Counter()
    for d, t in docs:
        if not held(d):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted((repr(d), held(d), len(w := tokens(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5)) for d, t in docs)


def said(found):
    return sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found)


@pytest.mark.parametrize("most", (lm.HEAD, 20))
def test_scores(spark, most):
    """Also where nearly all words are rare ones."""
    docs = rows() + EDGES
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    found = lm.language_model_scores(df, most).collect()
    assert said(found) == by_hand([r[:2] for r in docs])
    assert all(r.score <= 0 for r in found)
    again = lm.language_model_scores(df, most).collect()
    assert sorted((repr(r.doc_id), round(r.score, 9)) for r in again) == sorted((repr(r.doc_id), round(r.score, 9)) for r in found)


def test_query_beats_shares_of_words(spark):
    found = lm.op11_language_model(spark, SF)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = found.collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert said(found) == by_hand(docs)
    per = lambda c: sum(getattr(r, c) for r in found if r.held_out) / sum(r.n_tokens for r in found if r.held_out)
    assert per("score") > per("base_score") + 0.1


@pytest.mark.parametrize("docs", ([], [(i, "a b", "", 1, "", "") for i in range(200) if held(i)]))
def test_nothing_to_learn_from(spark, docs):
    found = lm.language_model_scores(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(found) == len(docs)
    assert all((r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and abs(r.base_score) < 1e-9 and r.score <= 1e-6 for r in found)


def _trained(spark, most):
    df = spark.createDataFrame(rows(), SCHEMA)
    known = lm.statistics(df.where(~lm.held_out()), most)
    from boxlake.llm.common import stored

    encoded = stored(lm.encode(df, known.head).withColumn("row", F.monotonically_increasing_id()), "encoded")
    return known, encoded, lm.train(encoded, known)


def test_words_sum_to_one(spark):
    """After any words, over the head, every rare word and the unknown."""
    known, _, model = _trained(spark, 20)
    counts = {bytes(r["word"]): r["c"] for r in known.counts.collect()}
    tail = [c for w, c in counts.items() if w not in known.head]
    assert tail
    n = len(known.head)
    for before in ([0, 1, 2], [n, 3, n], [2]):
        total = 0.0
        for w in range(n + 1):
            ids = np.array([*before, w])
            p = math.exp(model.log_classes(ids, np.array([len(ids)]))[-1]) * 10 ** model.within[w]
            total += p if w < n else sum(p * (c + 0.5) for c in [*tail, 0])
        assert abs(total - 1) < 1e-4


def test_gradient_is_that_of_the_likelihood(spark):
    """Observed less expected counts are the slope of the log-likelihood; a step goes up."""
    known, _, model = _trained(spark, 20)
    rng = np.random.default_rng(0)
    ids, sizes = rng.integers(0, len(known.head) + 1, 400), np.array([150, 0, 250])
    o, e = (np.zeros((lm.ROWS, lm.CLASSES), np.int64) for _ in range(2))
    model.gradient(ids, sizes, o, e)
    e = e / lm.PARTS
    assert o.sum() == 4 * len(ids) and abs(e.sum() - 4 * len(ids)) < 1
    cell = np.unravel_index(np.argmax(np.abs(o - e)), o.shape)
    likelihood = []
    for step in (-0.05, 0.05):
        table = model.table.copy()
        table[cell] += step
        likelihood.append(lm.Model(model.classes, model.within, model.bias, table).log_classes(ids, sizes).sum())
    assert abs((likelihood[1] - likelihood[0]) / 0.1 - (o - e)[cell]) < 0.05 * abs((o - e)[cell]) + 0.05


def test_sums_of_tasks_do_not_depend_on_them(spark):
    known, encoded, model = _trained(spark, 20)
    part = encoded.where(~F.col("held_out"))
    one, many = (lm._summed(part.repartition(n, "row"), lm.CLASSES, ("observed", "expected"), lm._Counts(model)) for n in (1, 7))
    assert (one["observed"] == many["observed"]).all() and abs(one["expected"] - many["expected"]).max() <= 7


def test_driver_gets_one_table_of_a_step(spark):
    """The step itself, not the counts that make it; the model goes out without what tasks can compute, and not a second time."""
    known, encoded, model = _trained(spark, 20)
    part = encoded.where(~F.col("held_out"))
    sums = lm._summed(part, lm.CLASSES, ("observed", "expected"), lm._Counts(model))
    found = lm._summed(part, lm.CLASSES, ("observed", "expected"), lm._Counts(model), lambda o, e: lm._step(o, e, 0.5))
    assert list(found) == ["finished"] and found["finished"].dtype == np.float32 and found["finished"].any()
    assert np.allclose(found["finished"], lm._step(sums["observed"], sums["expected"], 0.5), atol=1e-6)
    large = lm.Model(np.zeros(lm.HEAD + 1, model.classes.dtype), np.zeros(lm.HEAD + 1), model.bias, model.table)
    assert len(pickle.dumps(large)) < model.table.nbytes + 9 * lm.HEAD + 10_000
    again = pickle.loads(pickle.dumps(model))
    ids, sizes = np.arange(len(known.head)), np.array([len(known.head)])
    assert (again.log_classes(ids, sizes) == model.log_classes(ids, sizes)).all()


def test_ids_are_one_value_a_row(spark):
    """Spark copies arrays number by number."""
    encoded = lm.encode(spark.createDataFrame([(1, "a b c a", "r", 1, "h", "w"), (2, None, "r", 1, "h", "w")], SCHEMA), [b"a", b"", b"b"])
    assert dict(encoded.dtypes)["ids"] == "binary"
    table = encoded.orderBy("doc_id").toArrow()
    ids, sizes = lm.flat_ids(table["ids"].combine_chunks())
    assert ids.tolist() == [0, 2, 3, 0, 1, 1] and sizes.tolist() == [5, 1]
    assert table["tail"].to_pylist() == [[b"c"], []] and table["tail_n"].to_pylist() == [[1], []]


@pytest.mark.parametrize("same", (True, False))
def test_gradient_adds_up_every_row_of_a_class(same):
    """Against adding one by one; also where a whole chunk falls in one cell, the most that a sum of a chunk holds."""
    rng = np.random.default_rng(3)
    n = 2 * lm.CHUNK + 77
    ids = np.zeros(n, np.int32) if same else rng.integers(0, 40, n).astype(np.int32)
    bias = np.where(np.arange(lm.CLASSES) == 5, 0.0, -90.0) if same else rng.normal(0, 1, lm.CLASSES)
    model = lm.Model(np.full(40, 5, np.uint8), np.zeros(40), bias.astype(np.float32), np.zeros((lm.ROWS, lm.CLASSES), np.float32))
    sizes = np.array([n - 5, 0, 5])
    found, right = ([np.zeros((lm.ROWS, lm.CLASSES), np.int64) for _ in range(2)] for _ in range(2))
    model.gradient(ids, sizes, *found)
    p = np.exp(np.float32(bias.astype(np.float32)))
    p = np.rint(p * (lm.PARTS / lm._row_sums(p[None]))[:, None]).astype(np.int64)[0]
    for r in model.rows(model.contexts(ids, sizes)):
        np.add.at(right[0], (r, 5), 1)
        np.add.at(right[1], r, np.broadcast_to(p, (n, lm.CLASSES)))
    assert (found[0] == right[0]).all() and (abs(found[1] - right[1]).max(axis=1) <= found[0].sum(axis=1) * (not same)).all()
    assert not same or found[1].max() > lm.CHUNK * lm.PARTS


@pytest.mark.parametrize("most", (0, (1 << 31) - 1, 1 << 31, 1 << 40))
def test_sums_take_32_bits_only_where_they_fit(most):
    t = np.array([[0, most], [1, 2], [3, 4]])
    stored = lm._narrow(t)
    assert stored.itemsize == (4 if most < 1 << 31 else 8)
    assert (lm._wide(stored.tobytes(), 3, 2) == t).all()


def test_clusters_tell_languages_apart():
    rng = np.random.default_rng(2)
    company = np.concatenate([rng.poisson([9, 1, 5, 0], (50, 4)), rng.poisson([0, 8, 1, 6], (50, 4))])
    found = lm.clusters(company, company.sum(axis=1).astype(float), 2)
    assert len(set(found[:50])) == 1 and len(set(found[50:])) == 1 and found[0] != found[-1]
    assert len(lm.clusters(np.zeros((0, 4)), np.zeros(0), 3)) == 0
