import hashlib
import random
import re

from syllaspark.llm import decontaminate as D


def words(x):
    x = re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x)


def brute(docs, items):
    out = []
    for i, x in docs:
        w, hit, got = words(x), set(), set()
        for k, y in items:
            v = words(y)
            for j in range(max(1, len(v) - 7) if v else 0):
                win = v[j : j + 8]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        got |= {str(k)} - {"None"}
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), len(got) >= 2))
    return sorted(out, key=str)


def corpus():
    r = random.Random(3)
    vocab = ["a", "B", "the", "é", "x1", "日本", "of"]
    items = [(k, " ".join(r.choices(vocab, k=r.choice([0, 1, 3, 8, 9, 14])))) for k in range(12)] + [(12, None), (13, "rare unique words only in here"), (13, "and another text of the same item id now"), (None, "words of an item without a name stand in a document")]
    docs = []
    for i in range(60):
        w = r.choices(vocab + ["q"], k=r.randint(0, 40))
        if i % 3 == 0:
            w[5:5] = (r.choice(items)[1] or "").split()
        docs.append((i, r.choice([" ", ", ", "-"]).join(w)))
    docs += [(100, None), (101, ""), (102, "Rare unique-words ONLY in here!"), (102, "Rare"), (103, "rare unique words only in"), (104, "x words of an item without a name stand in a document"), (105, "the a of " * 7000 + items[-1][1]), (None, items[8][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "zz") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in D.decontaminate(d, b).collect()), key=str)
    assert got == brute(docs, items)
    assert any(x[5] for x in got) and any(x[2] == 0 for x in got)
    long = [(k, x) for k, x in items if len(words(x)) >= 8]
    got = sorted((tuple(r) for r in D.decontaminate(d, b, short=False).collect()), key=str)
    assert got == brute(docs, long)
    D.BLOCK_BYTES, keep = 90, D.BLOCK_BYTES
    try:
        assert sum(1 for _ in D.query_blocks(b)) > 2
        assert sorted((tuple(r) for r in D.decontaminate(d, b).collect()), key=str) == brute(docs, items)
    finally:
        D.BLOCK_BYTES = keep


def test_search(spark):
    d = spark.createDataFrame([(1, "x alpha y beta z"), (2, "beta alpha"), (3, "alpha"), (4, "alpha beta alpha beta")], "doc_id long, text string")
    index = D.build_index(d.coalesce(1))
    items = spark.createDataFrame([(7, "Alpha beta")], "item_id long, text string")
    assert sorted(map(tuple, D.search(index, items).collect())) == [(4, "7", 0), (4, "7", 2)]
    assert {r.doc_id for r in D.search(index, items, span=2).collect()} == {1, 2, 4}
    assert {r.doc_id for r in D.search(index, items, span=1).collect()} == {2, 4}


def test_empty(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(d, b).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert D.decontaminate(one, b).collect()[0].n_items == 0
