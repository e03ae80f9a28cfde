import random

import numpy as np
import pyarrow as pa

from syllaspark.llm import language_id as L
from syllaspark.llm import quality as Q


def test_kneser_ney_sums_to_one():
    texts = pa.array(["abcabd abca", "bca abd", "cab é"])
    g, first, letters = L.grams(texts)
    assert first.tolist() == [0, 11, 18, 23] and letters.tolist() == [10, 6, 4]
    k, n = L.count_sorted(g)
    k2, n2 = L.count_sorted(L.grams(pa.array(["xyz xyz"]))[0])
    m = L.fit([("a", k, n), ("b", k2, n2)])
    for ctx in (0, int(g[4]) >> 12, int(g[7]) >> 12, 12345):
        every = (np.uint64(ctx) << np.uint64(12)) + np.arange(4096, dtype=np.uint64)
        assert np.allclose(np.exp2(m.logs(every & np.uint64((1 << 60) - 1)).astype(float)).sum(axis=0), 1, atol=1e-3)


def test_language_id(spark):
    r = random.Random(1)
    words = {"en": "the and with house of tree", "de": "der und mit haus von baum"}
    rows = [(i, " ".join(r.choices(words[x].split(), k=r.randint(5, 60))), x) for i in range(300) for x in [r.choice(["en", "de"])]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 !!", None), (903, "the tree", None), (904, "Ωμέγα καλημέρα " * 30, None), (None, "der baum", None)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, lang string, score int")
    model = L.train(docs.where(L.fold_of() != 1))
    got = {x.doc_id: x for x in L.identify(docs, model).collect()}
    assert len(got) == len(rows)
    right = [got[i].lang_pred == x for i, _, x in rows[:300] if got[i].held_out]
    assert len(right) > 60 and np.mean(right) > 0.99
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert got[903].lang_pred == "en" and got[None].lang_pred == "de" and got[904].rejected and not got[903].rejected
    kept = L.keep_known(docs, model)
    assert kept.columns == docs.columns and {900, 901, 902, 904}.isdisjoint(x.doc_id for x in kept.collect()) and kept.count() >= 300
    empty = docs.limit(0)
    assert L.identify(empty, L.train(empty)).count() == 0
    assert {x.lang_pred for x in L.identify(docs, L.train(empty)).collect()} == {"und"}


def test_language_id_keeps_every_gram(spark, monkeypatch):
    r = random.Random(3)
    words = {"en": "the and with house of tree", "de": "der und mit haus von baum"}
    rows = [(i, " ".join([*r.choices(words[x].split(), k=r.randint(1, 40)), "".join(r.choices("qxyzj", k=6))]), x) for i in range(200) for x in [r.choice(["en", "de"])]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 !!", None), (903, rows[0][1], "en"), (904, "Ωμέγα " * 30, None), (None, "der baum", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def results():
        model = L.train(docs)
        return sorted(map(tuple, L.identify(docs, model).collect()), key=str), sorted(map(str, L.keep_known(docs, model).collect()))

    whole, kept = results()
    monkeypatch.setattr(L, "MAX_GRAMS", 100)
    got, got_kept = results()
    assert got_kept == kept and len(got) == len(rows)
    for a, b in zip(got, whole, strict=True):
        assert (a[:3], a[5]) == (b[:3], b[5]) and np.allclose(a[3:5], b[3:5], atol=1e-4)


def test_quality(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        w = [r.choice(["tree", "house", "river", "light"]) + r.choice("abcdefgh") for _ in range(r.randint(3, 80))]
        rows.append((i, " ".join(w) if good else " | ".join(w) if i % 2 else "###".join(w)))
        labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "tree")]
    docs = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, quality int")
    lab = spark.createDataFrame([*labels, (7, None)], "doc_id long, quality int")
    got = Q.classify(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    want = dict(labels)
    held = [x.predicted == want[x.doc_id] for x in got if x.held_out and x.doc_id in want]
    assert len(held) > 150 and np.mean(held) > 0.97
    assert Q.classify(docs.limit(0), lab).count() == 0
    assert {x.score for x in Q.classify(docs, lab.limit(0)).collect()} == {0.5}


def plain_kneser_ney(counts):
    """Probability of a 5-gram's last number after the others, by dictionaries."""
    from collections import Counter

    by = {5: counts}
    for order in (4, 3, 2, 1):
        by[order] = Counter(g[1:] for g in by[order + 1])
    d = {}
    for order, c in by.items():
        one, two = (sum(1 for x in c.values() if x == k) for k in (1, 2))
        d[order] = one / (one + 2 * two) if one else 0.5

    def p(g, order=5):
        if order == 0:
            return 2.0**-12
        own = {k: v for k, v in by[order].items() if k[:-1] == g[5 - order : 4]}
        total = sum(own.values())
        if not total:
            return p(g, order - 1)
        return (max(own.get(g[5 - order :], 0) - d[order], 0) + d[order] * len(own) * p(g, order - 1)) / total

    return p


def test_kneser_ney_against_a_plain_one():
    from collections import Counter

    r = random.Random(8)
    texts = {x: ["".join(r.choices(letters, k=r.randint(1, 60))) for _ in range(12)] for x, letters in (("a", "aab cd"), ("b", "bbc e"))}
    split = lambda g: tuple(int(g) >> 12 * k & 4095 for k in (4, 3, 2, 1, 0))
    packed = {x: L.grams(pa.array(t))[0] for x, t in texts.items()}
    m = L.fit([(x, *L.count_sorted(g)) for x, g in packed.items()])
    asked = np.concatenate([*packed.values(), L.grams(pa.array(["abec d", "zzz", "bcbcbc"]))[0]])
    got = np.exp2(m.logs(asked).astype(float))
    for j, x in enumerate(("a", "b")):
        p = plain_kneser_ney(Counter(map(split, packed[x])))
        assert np.allclose(got[:, j], [p(split(g)) for g in asked], rtol=1e-3)


def test_rejection_is_calibrated():
    r = np.random.default_rng(1)
    m = L.Model(["a", "b"], [], [], *(np.zeros(2) for _ in range(4)))
    n = r.integers(5, 2000, 4000)
    h = 2 + r.normal(size=4000) * np.sqrt(0.1**2 + 2.0**2 / n)
    m.calibrate(0, h, n)
    m.calibrate(1, h[:0], n[:0])
    both = np.column_stack([h, h + 5])
    assert m.decide(both, n, n)[3].mean() <= 0.001
    assert m.decide(both + 3, np.full(4000, 300), n)[3].all()  # three bits a character too many
    assert not m.decide(both[:, ::-1] + 20, n, n)[3].any()  # nothing is known of the language: nothing is rejected


def test_rejection_is_calibrated_on_all_texts(spark, monkeypatch):
    r = random.Random(5)
    words = {"en": "the and with house of tree", "de": "der und mit haus von baum"}
    odd = lambda: "".join(r.choices("qxyzj", k=r.randint(0, 4)))
    rows = [(" ".join([*r.choices(words[x].split(), k=r.choice([2, 5, 9, 60])), odd()]), x) for x, k in (("en", 4000), ("de", 2500)) for _ in range(k)]
    rows += [(rows[0][0] + " q", "en")] * 500 + [(None, "en"), ("", "de"), ("12 !!", "de"), ("the tree", None), ("la casa", "es"), ("345", "none")]
    docs = spark.createDataFrame(rows, "text string, lang string")

    def check(model, known):
        m = model.rule if known else model
        want = L.Model(m.langs, [], [], *(np.zeros(len(m.langs)) for _ in range(4)))
        for j, x in enumerate(m.langs):
            own = sorted({t for t, lang in rows if lang == x and t})
            h, n, letters = (known or model).entropies(pa.array(own, pa.string()))
            want.calibrate(j, h[letters > 0, j], n[letters > 0])
        for name in ("mean", "spread", "noise", "sigmas"):
            assert np.allclose(getattr(m, name), getattr(want, name), rtol=1e-4 if known else 1e-9), name
        return m

    whole = L.train(docs)
    check(whole, None)
    assert whole.langs == ["de", "en", "es", "none"] and np.isinf(whole.sigmas[3]) and not np.isinf(whole.sigmas[:3]).any()
    monkeypatch.setattr(L, "MAX_OWN", 0)
    check(L.train(docs), None)
    monkeypatch.setattr(L, "MAX_GRAMS", 100)
    check(L.train(docs), whole)


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(6)
    groups = [r.normal(size=5000), np.zeros(0), np.array([3.5]), np.array([1.0, 2.0]), np.repeat([-1.0, 0.0, 7.0], [40, 41, 1]), np.concatenate([r.random(2000) * 1e-9, [1e12, -1e12]]), np.round(r.normal(size=3000), 1)]
    rows = [(g, x) for g, xs in enumerate(groups) for x in xs.tolist()]
    r.shuffle(rows)
    values = spark.createDataFrame([(int(g), float(x)) for g, x in rows], "g long, x double").cache()
    for q in (0.0, 0.5, 0.999, 1.0):
        got = L.quantiles(values, len(groups), q, bins=8)
        want = [np.quantile(xs, q) if len(xs) else np.nan for xs in groups]
        assert np.allclose(got, want, rtol=1e-12, atol=0, equal_nan=True)
    values.unpersist()


def test_gam_scores_are_sums_of_lookups():
    import bisect
    import math

    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(400, len(Q.FEATURES))), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Q.fit(x, y)
    assert m.pairs and ((m.predict(x) >= 0.5) == (y == 1)).mean() > 0.95
    for row, p in zip(x[:50], m.predict(x[:50]), strict=True):
        z = m.intercept + sum(s[bisect.bisect_right(c.tolist(), v)] for c, s, v in zip(m.cuts, m.scores, row, strict=True))
        z += sum(s[bisect.bisect_right(m.pair_cuts[i].tolist(), row[i])][bisect.bisect_right(m.pair_cuts[j].tolist(), row[j])] for (i, j), s in zip(m.pairs, m.pair_scores, strict=True))
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-9


def test_tree_splits_where_the_gain_is_largest():
    r = np.random.default_rng(3)
    for _ in range(20):
        g, h = r.normal(size=9), r.random(9)
        gain = [g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) for k in range(1, 9)]
        k = int(np.argmax(gain)) + 1
        if max(gain) - g.sum() ** 2 / (h.sum() + 1) > 1e-9:
            want = np.repeat([g[:k].sum() / (h[:k].sum() + 1), g[k:].sum() / (h[k:].sum() + 1)], [k, 9 - k])
            assert np.allclose(Q._tree(g, h, 2), want)
