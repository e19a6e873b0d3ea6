"""License scan, pieces, language, LM scoring, toxicity: brute force, goldens and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofline.llm import langid, licenses, ngram_lm, sentencepiece, toxicity
from proofline.llm.license_clauses import clauses

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCS)
    return df.withColumn("key", F.lit("k")).withColumn("id", F.lit(None).cast("int")).withColumn("score", F.lit(9)) if extra else df


EDGE = [(1, None, None), (2, "", "en"), (None, "a text without id", "en"), (3, "twice", None), (3, "twice", None), (4, "x " * 30_000, "en"), (5, "É ñ ß 漢字", None)]


def test_licenses_golden(spark):
    got = licenses.summary(docs(spark, [(1, "CC-BY 4.0 and cc by; the GNU General Public License, version 3. All rights reserved.", None)])).first()
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (17, 4, 0, 14)
    assert got["base_labels"] == "cc-by,gpl,reserved" and got["labels"] == "cc-by,gpl,gpl-3,reserved"
    kept = licenses.scan(docs(spark, [(1, "Licensed under the Apache License, Version 2.0.", None)])).first()["kept"]
    assert [k["label"] for k in kept] == ["apache-2.0"]  # shorter and weaker detections inside it are suppressed


def test_licenses_against_sql(spark):
    words = ["cc", "by", "all", "rights", "reserved", "general", "public", "license", "gnu", "version", "3", "mit", "SPDX-License-Identifier:", "Apache-2.0", "x,", "É"]
    rng = random.Random(5)
    rows = EDGE + [(10 + k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), None) for k in range(150)]
    df = docs(spark, rows, extra=True)
    got = licenses.summary(df).toPandas()
    documents = df.select("doc_id", "text").toPandas()  # noqa: F841  duckdb reads it by name
    want = duckdb.sql(licenses.oracle()).df()
    key = lambda d: sorted(str([None if pd.isna(v) else (round(float(v), 9) if isinstance(v, (int, float, np.number)) else v) for v in r]) for r in d[sorted(d.columns)].itertuples(index=False))
    assert key(got) == key(want)


def test_every_rule_has_an_anchor_and_a_true_gate():
    assert len(licenses.RULES) > 500
    for r in licenses.RULES:
        sure = [x.split("/") for x in r.wording.split() if not x.endswith("?")]
        assert any(all(a in x for x in either) for either in sure for a in licenses.ANCHORS), r
        assert r.gate.strip() in r.wording
        shortest = "".join(f" {either[0].replace('#', '7')} " for either in sure)
        assert re.search(r.pattern, shortest) and r.gate in shortest, r


def test_clauses_are_found_and_hold_what_lies_inside_them(spark):
    """Each clause, set in other words, is found at its place; what is kept has no weaker detection inside."""
    rng = random.Random(21)
    own = [(label, [x.split("/")[0].replace("#", "12") for x in words.split() if not x.endswith("?")], p) for label, words, p in clauses()]
    rows = []
    for k, (_, words, _) in enumerate(own):
        before = [rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(6))]
        rows.append((k, " ".join(before) + ", " + ", ".join(words).capitalize() + ". Delta", None))
    scanned = licenses.scan(docs(spark, rows).repartition(8)).collect()
    for r in scanned:
        label, words, priority = own[r["doc_id"]]
        at = len(rows[r["doc_id"]][1].replace(",", " ").replace(".", " ").split()) - 1 - len(words)
        assert any((d["start"], d["end"], d["label"]) == (at, at + len(words), label) for d in r["found"]), own[r["doc_id"]]
        inside = lambda d, f: f["start"] <= d["start"] and f["end"] >= d["end"] and f["priority"] >= d["priority"] and (f["start"], f["end"], f["priority"], f["rule"]) != (d["start"], d["end"], d["priority"], d["rule"])
        beaten = lambda d, f: inside(d, f) and ((f["start"], f["end"], f["priority"]) != (d["start"], d["end"], d["priority"]) or f["rule"] < d["rule"])
        want = [(d["start"], d["end"], d["rule"]) for d in r["found"] if not any(beaten(d, f) for f in r["found"])]
        assert sorted((d["start"], d["end"], d["rule"]) for d in r["kept"]) == sorted(want)


def test_base_phrases_by_brute_force(spark):
    """The base columns against a scanner that knows the three phrases alone."""
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    rng = random.Random(22)
    pool = ["cc", "by", "CC", "BY", "all", "rights", "reserved", "general", "Public", "license", "é", "x1", "-", "/", "_"]
    rows = EDGE + [(10 + k, rng.choice([" ", ", ", "\n"]).join(rng.choice(pool) for _ in range(rng.randrange(60))), None) for k in range(200)]
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.summary(docs(spark, rows)).collect())
    want = Counter()
    for i, t, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = [(k, label) for words, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(words)]) == words]
        at = [k for k, _ in hits]
        want[i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))] += 1
    assert got == want


def brute_segmentations(p, unit):
    s, out = unit.replace(" ", sentencepiece.MARK), []

    def rec(i, ids, sc):
        if i == len(s):
            out.append((sc, ids))
            return
        for j in range(i + 1, len(s) + 1):
            hit = p.score.get(s[i:j])
            if hit:
                rec(j, ids + (hit[0],), sc + hit[1])
        if s[i] not in p.score:
            raw = (" " if s[i] == sentencepiece.MARK else s[i]).encode()
            rec(i + 1, ids + tuple(p.byte[b] for b in raw), sc + p.byte_score * len(raw))

    rec(0, (), 0.0)
    return sorted(out, key=lambda x: -x[0])


def test_nbest_segmentations():
    p, rng = sentencepiece.load(), random.Random(3)
    for unit in [" the", "🙂x", "²..", " É", "\n"] + [" " + "".join(rng.choice("etaonishr") for _ in range(7)) for _ in range(40)]:
        want = brute_segmentations(p, unit)
        for n in (1, 2, 6):
            got = sentencepiece.word_nbest(p, unit, n)
            assert len(got) == min(n, len(want)) and all(abs(a[0] - b[1]) < 1e-9 for a, b in zip(want, got))
            assert len({ids for ids, _ in got}) == len(got)


def test_piece_round_trip_and_edges(spark):
    texts = ["", None, " a  b\n\nc▁d\t🙂", "²..x", "word " * 20_000, "z" * 50_000, "plain text"]
    df = docs(spark, [(k, t, None) for k, t in enumerate(texts)] + [(6, "plain text", None)], extra=True)
    rows = sentencepiece.summary(df).collect()
    assert all(r["restored"] for r in rows) and len(rows) == 8
    assert {r["n_pieces"] for r in rows if r["doc_id"] in (0, 1)} == {0}
    back = {r["doc_id"]: r["text"] for r in sentencepiece.decode_ids(sentencepiece.encode(df)).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(texts))
    best = {(r["doc_id"], r["rank"]): r for r in sentencepiece.nbest(df.where("doc_id = 3"), 3).collect()}
    one = [r for r in rows if r["doc_id"] == 3][0]
    assert abs(best[3, 1]["score"] - one["score"]) < 1e-9 and abs(best[3, 2]["score"] - one["second_score"]) < 1e-9
    assert sentencepiece.summary(df.limit(0)).count() == 0


def invented(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


LANGS = {"aa": ["ko", "ra", "mi"], "bb": ["schu", "ber", "ung"], "cc": ["дом", "река"]}


def test_language_id(spark):
    rng = random.Random(1)
    rows = [(k, invented(rng, LANGS[lang], 40), lang) for k in range(300) for lang in [list(LANGS)[k % 3]]]
    mixed = invented(rng, LANGS["aa"], 30) + ". " + invented(rng, LANGS["bb"], 60)
    rows += [(1000, mixed, None), (1001, None, None), (1002, "123 -- 5", "aa"), (1003, "", None), (1004, "река", None), (1004, "река", None)]
    df = docs(spark, rows, extra=True)
    got = langid.language_id(df).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(by[i]["lang_pred"], lang) for i, _, lang in rows[:300] if by[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert [by[k]["lang_pred"] for k in (1000, 1001, 1002, 1003, 1004)] == ["bb", "und", "und", "und", "cc"]
    spans = langid.spans(df.where("doc_id = 1000"), langid.train(df)).orderBy("start").collect()
    assert [s["lang"] for s in spans] == ["aa", "bb"]
    assert langid.language_id(df.limit(0)).count() == 0


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(0)
    import itertools

    scores, first = rng.normal(size=(11, 3)) * 3, np.array([0, 4, 4, 11])
    path = langid.viterbi(scores, first, 2.0)
    for lo, hi in ((0, 4), (4, 11)):
        value = lambda p: sum(scores[lo + i, s] for i, s in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(3), repeat=hi - lo), key=value)
        assert abs(value(best) - value(path[lo:hi])) < 1e-9


def test_viterbi_with_many_languages():
    rng = np.random.default_rng(0)
    scores = rng.normal(0, 0.1, (6, 200))
    scores[:, 150] += 5
    assert (langid.viterbi(scores, np.array([0, 6])) == 150).all()


def test_many_long_and_mixed_texts(spark):
    """Long texts teach too, and letters count, not bytes."""
    rng = random.Random(12)
    latin, han = ["wa", "ro", "le", "bi"], ["漢", "字", "語", "文"]
    text = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    rows = [(k, text(latin, 3000), "aa") for k in range(6)] + [(10 + k, text(han, 2000), "zz") for k in range(6)]
    rows += [(30, text(latin, 20) + " " + text(han, 14), None), (31, text(latin, 10) + " " + text(han, 25), None)]
    assert min(len(t.encode()) for _, t, lang in rows if lang) > 16_000
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_id(docs(spark, rows)).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows if lang)
    assert got[30][0] == "aa" and abs(got[30][1] - 120 / 162) < 1e-9  # in bytes, Han would hold 126 of 246
    assert got[31][0] == "zz" and abs(got[31][1] - 75 / 135) < 1e-9


def test_lm_base_scores(spark):
    rng = random.Random(2)
    rows = EDGE + [(100 + k, invented(rng, ["ab", "c", "De"], rng.randint(0, 30)), None) for k in range(120)]
    got = ngram_lm.score(docs(spark, rows, extra=True)).collect()
    tokens = [(i, [w for w in (t or "").encode().translate(LOWER).split()] + [b""]) for i, t, _ in rows]
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 1
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_lm_repeated_texts_and_empty_table(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(40))
    rows = [(k, text(), None) for k in range(60)] + [(100 + 2 * k, t, None) for k in range(10) for t in [text()]]
    rows += [(i + 1, t, None) for i, t, _ in rows if i >= 100]
    trained = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in ngram_lm.score(docs(spark, rows)).collect()}
    once = [got[k] for k in range(60) if trained(k)]
    both = [got[k] for k in range(100, 120, 2) if trained(k) and trained(k + 1)]
    assert min(both) > max(once)  # texts that occur twice score apart from those that occur once
    assert ngram_lm.score(docs(spark, rows).limit(0)).count() == 0


def test_lm_scores_are_those_of_all_counts(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(5000)]
    usual = [rng.choice(vocabulary) for _ in range(5000)]
    texts = [" ".join(vocabulary)]  # every word is seen, most of them only here and rarely elsewhere
    for _ in range(60):
        at = rng.randrange(4900)
        texts.append(" ".join(usual[at : at + rng.randrange(60)] + [rng.choice(vocabulary) for _ in range(rng.randrange(6))] + ["Unheard%d" % rng.randrange(90)]))
    texts += ["a b a b a c a b a b", "a", "", None, "a b a b a c a b a b"]
    ids = [*range(len(texts) - 1), None]
    train = [t for i, t in zip(ids, texts) if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    tokens = lambda t: ((t or "").lower().split()) + [None]
    c = [Counter() for _ in range(4)]
    for t in train:
        w = tokens(t)
        for n in (1, 2, 3):
            c[n].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total, types = sum(c[1].values()), len(c[1])

    def p(history, w):
        if not history:
            return (c[1][w,] + 0.5) / (total + 0.5 * (types + 1))
        n, m = c[len(history)][history], ngram_lm.PRIOR[len(history) + 1]
        return (c[len(history) + 1][(*history, w)] + m * p(history[1:], w)) / (n + m)

    want = {i: sum(math.log10(p(tuple(w[max(0, k - 2) : k]), x)) for k, x in enumerate(w)) for i, w in zip(ids, map(tokens, texts))}
    for block, keys in ((2_000_000, 6_000_000), (500, 700), (3_000, 100)):
        monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", block)
        monkeypatch.setattr(ngram_lm, "RANGE_BYTES", keys)
        got = {r["doc_id"]: r["score"] for r in ngram_lm.score(docs(spark, [(i, t, None) for i, t in zip(ids, texts)]).repartition(3)).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    for history in [("a",), ("b", "a"), (vocabulary[7],), ("never", "seen")]:  # each state is a distribution over all types and one unseen
        assert abs(sum(p(history, w) for w, in c[1]) + p(history, "unseen") - 1) < 1e-9


def test_packing_counts_and_keys():
    rng = np.random.default_rng(1)
    for n in (1, 2, 300):
        v = rng.integers(0, 1000, n)
        assert (ngram_lm.unpacked(ngram_lm.packed(v), n) == v).all()
        k = np.unique(rng.integers(1, 2**63, n).astype(np.uint64) * np.uint64(2))
        assert (ngram_lm.unpacked_keys(ngram_lm.packed_keys(k), len(k)) == k).all()


def test_noisy_or_and_its_gradient():
    rng = np.random.default_rng(3)
    bags = [rng.normal(0, 2, n) for n in (0, 1, 3, 7)]
    first = np.cumsum([0] + [len(b) for b in bags])
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    want = [1 - (1 - sigmoid(-2.0)) * np.prod(1 - sigmoid(b)) for b in bags]
    assert np.allclose(toxicity.noisy_or(np.concatenate(bags), first, -2.0), want)
    label, n = np.array([0.0, 1.0, 1.0, 0.0]), int(first[-1])
    s, k = rng.integers(0, n, 40), rng.integers(0, 5, 40)
    theta = rng.normal(0, 0.5, 7)
    value, g = toxicity.loss(theta, label, first, s, k)
    z = np.array([theta[k[s == i]].sum() + theta[-2] for i in range(n)])
    p = np.array([1 - (1 - sigmoid(theta[-1])) * np.prod(1 - sigmoid(z[a:b])) for a, b in zip(first, first[1:])])
    assert abs(value - (-np.log(np.where(label > 0, p, 1 - p)).mean() + toxicity.DECAY / 2 * (theta[:-2] ** 2).sum())) < 1e-9
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        slope = (toxicity.loss(theta + step, label, first, s, k)[0] - toxicity.loss(theta - step, label, first, s, k)[0]) / 2e-6
        assert abs(slope - g[i]) < 1e-5


def test_toxicity_of_long_labelled_texts(spark):
    """Labelled texts teach whatever their length."""
    rng = random.Random(9)
    filler = lambda: ". ".join(invented(rng, ["la", "mo", "ti", "ru"], 40) for _ in range(120))
    rows = [(k, filler() + (". such a vileo thing. " if k % 3 == 0 else ". ") + filler(), None) for k in range(60)]
    assert min(len(t) for _, t, _ in rows) > 16_000
    lab = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs(spark, rows), lab).collect()}
    assert np.mean([got[k] == int(k % 3 == 0) for k in range(60)]) > 0.9


def test_toxicity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for k in range(600):
        words = invented(rng, ["la", "mo", "ti", "ru"], 60).split()
        bad = k % 4 == 0
        if bad:
            words[rng.randrange(60)] = rng.choice(["vileo", "vilea", "grok"])
        words[20] += "."
        words[40] += ".\n"
        rows.append((k, " ".join(words), None))
        if k % 3:
            labels.append((k, 1, int(bad)))
    rows += [(1000, None, None), (1001, "", None), (1002, "so vileo", None), (None, "la mo ti", None), (1003, "la", None), (1003, "la", None)]
    df, lab = docs(spark, rows, extra=True), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert np.mean([(by[k] >= 0.5) == (k % 4 == 0) for k in range(600)]) > 0.98
    assert by[1000] < 0.5 and by[1001] == by[1000] and by[1002] >= 0.5
    found = toxicity.offending_sentences(df.where("doc_id in (0, 1)"), toxicity.train(df, lab)).collect()
    assert len(found) == 1 and any(w in found[0]["text"] for w in ("vileo", "vilea", "grok"))
    kept = toxicity.drop_toxic(df, lab)
    assert kept.columns == df.columns and kept.where("doc_id = 0").count() == 0 and kept.where("doc_id = 1003").count() == 2
    assert toxicity.toxicity(df.limit(0), lab).count() == 0 and toxicity.toxicity(df, lab.limit(0)).where("score >= 0.5").count() == 0


@pytest.mark.parametrize("f", [licenses.summary, langid.language_id, ngram_lm.score, sentencepiece.summary])
def test_edges_give_one_row_each(spark, f):
    assert f(docs(spark, EDGE, extra=True)).count() == len(EDGE)
