import random
import re

import numpy as np

from syllaspark.llm import jaccard_join as J
from syllaspark.llm.components import components


def shingle_set(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(docs):
    sets = [shingle_set(x) for _, x in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is None or docs[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["Ä", "日本"]
    docs, shared = [], r.choices(vocab, k=40)
    for i in range(n):
        w = r.choices(vocab, k=r.randint(0, 80))
        if r.random() < 0.2:
            w += shared
        if docs and r.random() < 0.6:
            w = (r.choice(docs)[1] or "").split()
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w = w[: r.randint(0, 5) or None]
        docs.append((i * 3 % n, " ".join(x.upper() if r.random() < 0.1 else x for x in w)))
    return docs + [(n + 1, None), (n + 2, " "), (n + 3, "one two"), (n + 4, "One Two"), (None, docs[0][1]), (docs[2][0], docs[2][1])]


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed, 301)
        df = spark.createDataFrame([(*x, 1, "q") for x in docs], "doc_id long, text string, sig int, gram string").repartition(3)
        got = sorted((tuple(x) for x in J.join(df).collect()), key=str)
        assert got == brute(docs)
        assert len({x[2] for x in got}) < len(got) - 40
    kept = J.keep_one(df).collect()
    assert {x.doc_id for x in kept} == {x[2] for x in got}
    assert J.join(df.limit(0)).count() == 0


def test_trie():
    r = np.random.default_rng(1)
    order = J.Order(np.array([3, 5], np.uint64), np.array([9, 4]))
    base = np.sort(r.choice(1000, 100, replace=False).astype(np.uint64))
    sets = [np.sort(np.unique(np.concatenate([r.choice(base, k, replace=False), r.choice(1000, 100 - k).astype(np.uint64)]))) for k in r.integers(80, 100, 60)]
    trie = J.Trie(base[:0])
    for i, s in enumerate(sets):
        trie.add(order.sorted(s)[::-1], i)
    want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, base)) >= 85 * len(np.union1d(s, base))]
    assert sorted(trie.linked(base, 85)) == want and 0 < len(want) < 60


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (101, 101), (200, 201), (201, 200)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
