"""Fill-in-middle, embedding whitening and toxicity against brute force, with every odd input."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from conftest import ROWS

from pathloom.llm import fill_in_middle, toxicity, whitening
from pyspark.sql import functions as F

MARKED = [(20, "a <P> b"), (21, "x<S"), (22, "<M>"), (23, "<" * 40 + "S>" * 3), (24, "é中 A1b" * 50), (-7, "Aé" * 200), (25, "word " * 30_000)]


def forms(doc_id, text):
    text = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    one, two = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = "".join(w[:one]), "".join(w[one:two]), "".join(w[two:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, len(w), "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, docs, empty):
    more = spark.createDataFrame(MARKED + [(100 + i, t) for i, (_, t) in enumerate(MARKED * 12)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    source = both.collect()
    got = fill_in_middle.fill_in_middle(both).select("*", fill_in_middle.restored().alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((forms(r[0], r[1]) for r in source), key=repr)
    assert sorted(r["back"] for r in got) == sorted(r["text"] or "" for r in source)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs).count() == len(ROWS)
    assert fill_in_middle.fill_in_middle(empty).count() == 0
    assert fill_in_middle.fill_in_middle(docs, rate=0).filter("form <> 'plain'").count() == 0


def test_rank_index():
    rng = np.random.default_rng(3)
    lists = [np.array([0])] + [np.cumsum(rng.integers(0, rng.integers(2, 400), rng.integers(1, 3000))) for _ in range(40)]
    lists += [np.cumsum(np.where(np.arange(5000) % 1000 < 500, 1, 300)), np.array([5, 5, 5]), np.array([0, 10**9])]
    first = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    at = np.concatenate(lists).astype(np.int64)
    index = fill_in_middle.RankIndex(at, first)
    assert (index[np.arange(len(at))] == at).all() and index.residual.dtype == np.int8
    assert set(first[:-1]) <= set(index.low) and len(index.low) < len(at) / 2
    straight = fill_in_middle.RankIndex(np.arange(100_000) * 7, np.array([0, 100_000]))
    assert len(straight.low) == 1


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, x int")


def whitened_by_numpy(rows, components=4):
    x = np.array([np.floor(256 * np.array(v, np.float32).astype(float)) + 0 for _, v in rows]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, x.shape[1])
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("dimension", [2, 9, 40])
def test_whitening(spark, dimension):
    rng = np.random.default_rng(dimension)
    base = rng.normal(size=(300, dimension)) * (1 + np.arange(dimension) / 7)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[5].tolist()) for i in range(100)] + [(5, base[6].tolist()), (None, base[7].tolist())]
    odd = [(2000, None), (2001, [float("nan")] * dimension), (2002, [None] * dimension), (2003, [float("inf")] + [0.0] * (dimension - 1))]
    wrong = [(3000, [1.0] * (dimension + 1)), (3001, [])]
    got = whitening.whiten(embeddings(spark, [(*r, 1, 2) for r in rows + odd + wrong])).collect()
    n, deviation, white, explained = whitened_by_numpy(rows)
    k = min(4, dimension)
    assert len(got) == k * (len(rows) + len(wrong)) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    off = [r for r in got if r["vec_id"] in (3000, 3001)]
    assert len(off) == 2 * k and all(r["deviation"] is None and r["whitened"] is None for r in off)
    for c in range(k):
        own = {(r["vec_id"], r["deviation"]): r for r in got if r["component"] == c + 1 and r["deviation"] is not None}
        sign = np.sign(own[0, int(deviation[0])]["whitened"] * white[0, c])
        for (i, _), d, w in zip(rows, deviation.tolist(), white[:, c].tolist(), strict=True):
            assert own[i, d]["whitened"] * sign == pytest.approx(w, abs=1e-8) and own[i, d]["explained"] == pytest.approx(explained[c], rel=1e-9)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(embeddings(spark, [])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, None, 1, 1), (2, [], 1, 1)])).count() == 0
    one = whitening.whiten(embeddings(spark, [(1, [1.0, 2.0], 1, 1), (2, [1.0, 2.0], 1, 1)])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, 0.0)] * 4
    # Two points on a line: one component, the other is flat.
    line = {(r["vec_id"], r["component"]): r for r in whitening.whiten(embeddings(spark, [(1, [0.0, -0.0], 1, 1), (2, [1.0, 1.0], 1, 1)])).collect()}
    assert abs(line[1, 1]["whitened"]) == pytest.approx(1) and line[1, 2]["whitened"] is None and line[2, 1]["explained"] == pytest.approx(1)
    huge = whitening.whiten(embeddings(spark, [(1, [1e18, 0.0], 1, 1), (2, [0.0, 1.0], 1, 1)])).collect()
    assert all(r["deviation"] is None for r in huge)


def test_subspace_iteration_on_close_eigenvalues():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(80, 80)))[0]
    for values in ([9, 8, 7, 6] + [5.99] * 30 + [1.0] * 46, [1.0] * 80, [5.0, 4, 3, 2] + [0.0] * 76):
        v = turn @ np.diag(values) @ turn.T
        found, axes, residual = whitening.leading_pairs(lambda q, v=v: v @ q, 80, 4)
        assert found == pytest.approx(values[:4], rel=1e-9) and residual < 1e-10
        assert np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12


def by_enumeration(field, features, start):
    """Marginals of state 1 and log Z from every tagging of each text."""
    e = field.emissions(features)
    marginal, total = np.zeros(len(start)), 0.0
    edges = [*np.flatnonzero(start), len(start)]
    for a, b in zip(edges, edges[1:]):
        weight, hot = 0.0, np.zeros(b - a)
        for tags in itertools.product((0, 1), repeat=b - a):
            score = field.opening[tags[0]] + sum((t - 0.5) * x for t, x in zip(tags, e[a:b])) + sum(field.transition[i, j] for i, j in zip(tags, tags[1:]))
            weight += math.exp(score)
            hot += math.exp(score) * np.array(tags)
        marginal[a:b], total = hot / weight, total + math.log(weight)
    return marginal, total


def test_field():
    rng = np.random.default_rng(5)
    start = np.zeros(40, bool)
    start[[0, 1, 4, 9, 10, 18, 25, 26, 33]] = True
    features = rng.integers(0, 12, (40, 3)).astype(np.int32)
    label = rng.integers(0, 2, 40)
    vector = rng.normal(size=12 + 7)
    field = toxicity.Field.of(vector)
    marginal, _, log_z = field.tag(features, start)
    want, total = by_enumeration(field, features, start)
    assert marginal[:, 1] == pytest.approx(want) and log_z == pytest.approx(total)
    gradient = field.gradient(features, start, label)

    def loss(v):
        f = toxicity.Field.of(v)
        e = f.emissions(features)
        follows = np.flatnonzero(~start)
        own = ((label - 0.5) * e).sum() + f.opening[label[start]].sum() + f.transition[label[follows - 1], label[follows]].sum()
        return f.tag(features, start)[2] - own

    for i in range(len(vector)):
        step = np.zeros(len(vector))
        step[i] = 1e-5
        assert gradient[i] == pytest.approx((loss(vector + step) - loss(vector - step)) / 2e-5, abs=1e-6)


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    clean = [f"w{i}x" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(clean, int(rng.integers(5, 60))))
        if i % 4 == 0:
            words[int(rng.integers(len(words)))] = ["Scoundrel,", "ROGUE", "knaves!"][i // 4 % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    copy = "a very long toxic text that is repeated " + " ".join(f"odd{j}" for j in range(80)) + " rogue"
    rows += [(1000 + i, copy + f" v{i}") for i in range(12)] + [(2000, " ".join(f"odd{j}" for j in range(60))), (2001, "Ä rogue ä, the scoundrel")]
    labels += [(1000 + i, 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("raw", F.lit(1)).withColumn("score", F.lit("x")).repartition(3)
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    held = [i for i in range(400) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert not got[2000]["predicted"] and got[2001]["predicted"]  # words of a repeated toxic text are not toxic themselves
    text = dict(rows)[2001]
    assert [text[s["start"] : s["end"]] for s in got[2001]["spans"]] == ["rogue", "scoundrel"]


def test_toxicity_of_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 0), (7, 1), (9, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels.withColumn("toxic", F.lit(0))).collect()} == {0.0}
    assert toxicity.toxicity_scores(empty, labels).count() == 0
