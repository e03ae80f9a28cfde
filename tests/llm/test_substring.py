import hashlib
import random
import re

from syllaspark.llm import substring_dedup as S


def brute(docs):
    where = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", x or "")) for i, x in docs]
    key = lambda i: -(1 << 63) if i is None else i
    for i, w in split:
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            where[k] = min(where.get(k, (key(i), j)), (key(i), j))
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - 19):
            if where[tuple(w[j : j + 20])] < (key(i), j):
                gone.update(range(j, j + 20))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1, n=120):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["é", "日本", "\x1c", "\xa0x"]
    passages = [r.choices(vocab, k=r.randint(15, 60)) for _ in range(8)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(r.randint(0, 5)):
            w += r.choices(vocab, k=r.randint(0, 50))
            p = r.choice(passages)
            a = r.randint(0, 10)
            w += p[a:] if r.random() < 0.6 else []
        if r.random() < 0.1:
            w += ["la"] * r.randint(10, 70)
        if r.random() < 0.1:
            w += ["la", "lo"] * r.randint(10, 40)
        if docs and r.random() < 0.15:
            w = (r.choice(docs)[1] or "").split(" ")
        docs.append((i, r.choice([" ", " \n", "\t"]).join(w)))
    docs += [(n, None), (n + 1, ""), (n + 2, "  "), (None, docs[3][1]), (5, docs[5][1]), (n + 3, "x " * 19 + "x"), (-7, docs[8][1])]
    r.shuffle(docs)
    return docs


def test_against_brute_force(spark):
    for seed, block in ((1, 16_000_000), (2, 3000)):
        docs = corpus(seed)
        df = spark.createDataFrame([(*x, 0, "a") for x in docs], "doc_id long, text string, part int, spans string").repartition(5)
        S.BLOCK_BYTES, keep = block, S.BLOCK_BYTES
        try:
            got = sorted((tuple(r) for r in S.dedup(df).collect()), key=str)
        finally:
            S.BLOCK_BYTES = keep
        assert got == brute(docs)
        assert sum(x[2] for x in got) > 1000
    assert S.dedup(df.limit(0)).count() == 0
    r = S.dedup(df, with_text=True).where("n_removed > 0").first()
    assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_short_periodic_passages_that_stand_once(spark):
    docs = []
    for period in (1, 2, 5, 13, 14, 15):
        for n in (20, 21, 22, 25, 28, 33, 34, 35, 40):
            phrase = [f"p{period}n{n}k{k}" for k in range(period)]
            docs.append((len(docs), " ".join(["a%d" % n, *(phrase * 40)[:n], "b%d" % period])))
    got = sorted((tuple(r) for r in S.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == brute(docs)
    assert S.dedup(spark.createDataFrame([(1, "x " * 25)], "doc_id long, text string")).first().n_removed == 24


def test_factors_are_copies_of_earlier_text(spark):
    docs = [(i, x) for i, x in {i: x for i, x in corpus(5) if i is not None and i >= 0}.items()]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", x or "") for i, x in docs}
    got = S.factors(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    covered = {}
    for f in got:
        assert f.length >= 20 and (f.source_key, f.source_start) < (f.doc_key, f.start)
        assert words[f.doc_key][f.start : f.start + f.length] == words[f.source_key][f.source_start : f.source_start + f.length]
        covered.setdefault(f.doc_key, set()).update(range(f.start, f.start + f.length))
    assert {i: len(c) for i, c in covered.items()} == {x[0]: x[2] for x in brute(docs) if x[2]}
    # Greedy: no factor could go on in its source.
    by = {(f.doc_key, f.start): f for f in got}
    assert not any((n := by.get((f.doc_key, f.start + f.length - 19))) and (n.source_key, n.source_start) == (f.source_key, f.source_start + f.length - 19) for f in got)
