"""Nearest neighbours, whitening and spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import forest, queries, spelling, whitening

VECTORS = "vec_id long, embedding array<float>, label string"


def brute_nearest(rows, k=20):
    """query_id -> [(vec_id, score)] of rows (id, vector)."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, v in zip(ids.tolist(), x, strict=True):
        if i % 20 == 0:
            s = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)).tolist() if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def grouped_rows(n, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(30, dims))
    return [(k, (middle[k % 30] + 0.3 * rng.normal(size=dims)).astype(np.float32).tolist()) for k in range(n)]


def found_by(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_forest_walks_nearest_leaves_first():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(500, 6))
    trees = forest.Forest(6, 4, float(np.linalg.norm(rows, axis=1).max()), trees=3)
    p = trees.project(rows, stored=True)
    trees.splits = np.array([forest.Forest.fit(p[t], 4) for t in range(3)])
    leaf = trees.leaves(rows)
    assert leaf.min() >= 0 and leaf.max() < 48 and np.bincount(leaf[:, 0]).max() < 60
    q = rows[:1]
    mine = trees.project(q, stored=False)[:, 0, :]
    far = {}
    for t in range(3):
        for end in range(16):
            node, total = 0, 0.0
            for level in range(4):
                step, beyond = (end >> (3 - level)) & 1, mine[t][level] - trees.splits[t][(1 << level) - 1 + node]
                total += 0 if (beyond > 0) == bool(step) else beyond**2
                node = 2 * node + step
            far[(t << 4) + end] = total
    walked = list(next(trees.nearest_leaves(q)))
    assert sorted(walked) == sorted(far) and np.allclose([far[x] for x in walked], sorted(far.values()))


def test_neighbours_recall_and_scores(spark):
    rows = grouped_rows(3000)
    df = spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS).repartition(5)
    true = brute_nearest(rows)
    got = found_by(forest.neighbours(df, df.where("vec_id % 20 = 0"), leaf=64))
    assert set(got) == set(true) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in true.items())
    assert hits >= 0.9 * 20 * len(true)
    exact = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, near in got.items():
        assert all(s == (exact[i] * exact[q]).sum() for i, s in near) and near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_neighbours_with_a_hot_vector_and_pieces(spark, monkeypatch):
    """A third of all rows are one vector; leaves are cut into pieces; few leaves are everything."""
    monkeypatch.setattr(forest, "PIECE", 50)
    rows = grouped_rows(600)
    rows = [(i, rows[7][1] if i % 3 == 0 else v) for i, v in rows]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS)
    assert found_by(forest.neighbours(df, df.where("vec_id % 20 = 0"), recall=1.0)) == brute_nearest(rows)


def test_neighbours_on_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, None), (4, []), (5, [1.0, None]), (6, [1.0, float("nan")]), (7, [0.0, 0.0]), (None, [1.0, 1.0]), (20, [-1.0, 3.0]), (20, [5.0, 5.0]), (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS).withColumnsRenamed({"label": "score"}).withColumn("query_id", F.lit("clash"))
    got = found_by(forest.neighbours(df, df.where("vec_id % 20 = 0")))
    # id 20 counts with its smaller vector; ties go to the smaller id; other lengths meet nobody
    assert got == {0: [(1, 2.0), (2, 2.0), (20, -1.0)], 20: [(1, 1.0), (2, 1.0), (0, -1.0)]}
    none = df.limit(0)
    assert forest.neighbours(none, none).collect() == [] and forest.neighbours(df, none).collect() == []


def brute_whitening(x, k=8):
    n = len(x)
    y = x - x.mean(axis=0)
    value, vector = np.linalg.eigh(y.T @ y / n)
    return (y @ vector[:, ::-1][:, :k]) / np.sqrt(value[::-1][:k]), value[::-1][:k] / value.sum()


@pytest.mark.parametrize("dims", [1, 5, 20, 40])
def test_leading_pairs_equal_dense_ones(dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(300, dims)) * np.linspace(1, 1.5, dims)
    matrix = x.T @ x / 300
    passes = []
    value, vector, residual = whitening.leading(lambda b: passes.append(b.shape) or matrix @ b, dims, 8)
    dense = np.linalg.eigvalsh(matrix)[::-1][:8]
    assert np.allclose(value, dense, rtol=1e-13) and residual.max() <= 1e-14 * dense[0] * dims
    assert max(b[1] for b in passes) <= 16  # thin blocks only
    assert np.allclose(vector.T @ vector, np.eye(min(8, dims)), atol=1e-13)


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(30, 30))
    a = a @ a.T
    value, vector = np.linalg.eigh(a)
    away, right = vector[:, -2:], rng.normal(size=(30, 3))
    right -= away @ (away.T @ right)
    z = whitening.minres(lambda b: a @ b, right, value[[-1, -2, -3]] + 0.3, away, 200, 1e-12)
    left = a @ z - z * (value[[-1, -2, -3]] + 0.3)
    assert np.allclose(left - away @ (away.T @ left), right, atol=1e-7) and np.allclose(away.T @ z, 0, atol=1e-9)


def test_whitening_against_dense(spark):
    rows = grouped_rows(700, dims=24, seed=4)
    df = spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS).repartition(6)
    got = whitening.whiten(df).orderBy("vec_id", "component").collect()
    x = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(float)) + 100_000
    want, share = brute_whitening(x)
    mine = np.array([r["whitened"] for r in got]).reshape(700, 8)
    sign = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * sign - want).max() < 1e-9
    assert np.allclose([r["explained"] for r in got[:8]], share, rtol=1e-12)
    whole = x.astype(int)
    deviation = ((700 * whole - whole.sum(axis=0)) ** 2).sum(axis=1)
    assert [r["deviation"] for r in got[::8]] == deviation.tolist() and {r["n"] for r in got} == {700}
    assert {r["component"] for r in got} == set(range(1, 9)) and max(r["identity_error"] for r in got) < 1e-12 and max(r["residual"] for r in got) < 1e-13


def test_whitening_on_odd_rows(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [0.25, -1.0]), (3, None), (4, [1.0, None]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [-3.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS).withColumnsRenamed({"label": "n"}).withColumn("x", F.lit("clash"))
    got = whitening.whiten(df).collect()
    # repeated rows count each, the row without id stays; two dimensions give two components
    assert Counter((r["vec_id"], r["component"]) for r in got) == {(1, 1): 2, (1, 2): 2, (2, 1): 1, (2, 2): 1, (None, 1): 1, (None, 2): 1}
    assert {r["n"] for r in got} == {4} and abs(sum(r["explained"] for r in got) - 4) < 1e-12
    same = spark.createDataFrame([(1, [1.0, 2.0], None)] * 3, VECTORS)
    assert whitening.whiten(same).collect() == [] and whitening.whiten(df.limit(0)).collect() == []
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], None) for k in range(5)], VECTORS)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}
    huge = spark.createDataFrame([(1, [3e30, 1.0], None), (2, [-3e30, 2.0], None)], VECTORS)
    assert {(r["vec_id"], r["deviation"]) for r in whitening.whiten(huge).collect()} == {(1, None), (2, None)}


def edits(word, letters):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in letters}
    return out - {word}


def brute_variants(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    letters = set("".join(n))
    near = {w: edits(w, letters) & set(n) for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_one_edit_equals_brute_force():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.choice([7, 7, 8, 8, 9, 66]))) for _ in range(700)})
    i, j = spelling.one_edit(words)
    got = [(words[a], words[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(set(got)) == len(got)
    assert set(got) | {(b, a) for a, b in got} == {(w, x) for w in words for x in edits(w, "abé") & set(words)}
    assert spelling.one_edit(["aaaaaaa"])[0].size == 0 and spelling.one_edit(["a" * 7, "a" * 8])[0].tolist() == [0]


@pytest.mark.parametrize("group", [1024, 8])
def test_spelling_query_equals_brute_force(spark, tmp_path, monkeypatch, group):
    """The query on a fixture whose words share halves; with small groups all of them are cut into slices."""
    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(spelling, "BLOCK", max(64, group))
    rng = random.Random(7)
    base = ["".join(rng.choice(["an", "té", "or", "Ul", "ß"]) for _ in range(5)) for _ in range(12)]
    vary = lambda w: w[: (k := rng.randrange(len(w)))] + rng.choice(["", "x", "é", w[k]]) + w[k + 1 :]
    pool = [w for w in base for _ in range(300)] + [v for w in base for v in [vary(w) for _ in range(12)] * 3] + [vary(vary(w)) for w in base for _ in range(20)] * 2
    rng.shuffle(pool)
    docs = [(k, rng.choice([" ", "-", "1"]).join(pool[k * 20 : k * 20 + 20])) for k in range(len(pool) // 20)]
    docs += [(None, "Untere untere"), (None, None), (9000, ""), (9001, "1 2 3"), (9002, "short w×rdings ābcdefghij")] + [(9003, "repeated rows here")] * 2 + [(k, "z" * 5000) for k in (9004, 9005, 9006)]
    docs += [(9100 + k, "gardener " * 40) for k in range(30)] + [(9200 + k, "gardenar " * 10) for k in range(5)] + [(9300, "gardenxar gardenxar")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for name in ("word", "n", "form", "key", "size"):
        df = df.withColumn(name, F.lit("clash"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    want = brute_variants(docs)
    assert len(got) == len(want) and set(got) == want
    assert any(f for _, f, *_ in want) and any(f and f != r for _, f, r, *_ in want)


def test_spelling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(none).collect() == []
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).collect() == []


def test_shared_halves_meet():
    """Each edit leaves the first or the last half of the shorter word alone."""
    for size in range(7, 12):
        word = "".join(chr(97 + k) for k in range(size))
        for other in edits(word, "z"):
            a, b = sorted((word, other), key=len)
            half = len(a) // 2
            assert a[:half] == b[:half] or a[half:] == b[len(b) - (len(a) - half) :], (a, b)
    assert math.log(10**18, spelling.ODDS) < 19


def test_vector_queries_over_whole_tables(spark, tmp_path):
    """op11 and op13 as registered, on a table of several files, against brute force."""
    rows = grouped_rows(400, dims=16, seed=8)
    spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    near = queries.op11_approximate_nearest_neighbours(spark, str(tmp_path))
    assert near.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert found_by(near) == brute_nearest(rows)  # one leaf holds all rows
    white = queries.op13_embedding_whitening(spark, str(tmp_path))
    assert white.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    want, _ = brute_whitening(np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(float)) + 100_000)
    mine = np.array([r["whitened"] for r in white.orderBy("vec_id", "component").collect()]).reshape(400, 8)
    assert np.abs(np.abs(mine) - np.abs(want)).max() < 1e-9
