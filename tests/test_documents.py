"""Whole documents and words without a row for each unit: the same as the row-wise operators, and few rows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from syllaspark.functions import script as S
from syllaspark.operators import documents as D
from syllaspark.operators import encode as E
from syllaspark.operators import metrics as M
from syllaspark.operators import segment as G
from syllaspark.operators import vocab as V

TEXTS = ["ሰላም, ልዩ x,  ቃል ", "ሰው ሰዎች\tልጅ ልጆች\n\nመጽሐፍ። በሰው፣ የሰው é", " በልጅ የልጆች ከከሰዎች የሕኡኣኦች  ኣኣኣኣ <unk> <pad>", "", None, " \n", ",,ሰው ,", "ሑኣ ሀቱኣ ቱኣ" * 40]


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


@pytest.mark.parametrize("kind", [*V.MODELS, "gms joined", "cv joined"])
def test_documents_against_rows(spark, monkeypatch, kind):
    kind, _, joined = kind.partition(" ")
    docs = frame(spark, *TEXTS)
    m = E.fit(kind, frame(spark, *TEXTS[:3]))
    rows = E.encode(m, docs).cache()
    want = {}
    for r in rows.orderBy("doc_id", "pos").collect():
        want.setdefault(r.doc_id, []).append(r)
    back, spans = ({r.doc_id: r.text for r in d.collect()} for d in (E.decode_ids(m, rows), E.decode_spans(rows)))
    if joined:
        monkeypatch.setattr(G, "MOST_TOKENS", 0)
    monkeypatch.setattr(D, "MOST_DISTINCT", 3)
    monkeypatch.setattr(D, "MOST_HERE", 3)
    monkeypatch.setattr(D, "PLACES", 20)
    D._places_md5.cache_clear()
    got = {r.doc_id: tuple(r)[1:] for r in E.encode_documents(m, docs).collect()}
    D._places_md5.cache_clear()
    assert got == {k: (len(v), md5(",".join(str(r.id) for r in v)), md5(",".join(r.token for r in v)), md5(",".join(f"{r.start}:{r.end}" for r in v))) for k, v in want.items()}
    both = {r.doc_id: (r.hyp, r.ref) for r in E.decode_documents(m, docs, original=True).collect()}
    assert both == {k: (back[k], TEXTS[k] if kind in ("morph", "hybrid") else TEXTS[k].rstrip()) for k in want}
    assert {r.doc_id: r.text for r in E.decode_document_spans(m, docs).collect()} == spans
    counts = {(r.token, r.base_id): r.n for r in E.token_counts(m, docs).collect()}
    assert counts == Counter((r.token, r.base_id) for v in want.values() for r in v)


def test_words_by_chunks(spark):
    docs = frame(spark, *TEXTS, "ab ሰላም 中 ٣٤! ሰላም፡ልጅ-12.. abc")
    want = {r.w for r in docs.select(F.explode(S.split_words(S.normalise(F.col("text")))).alias("w")).collect()}
    assert {r.word for r in G.corpus_words(docs).collect()} == want
    assert D.chunk_words(frame(spark, "ሰላም ልዩ " * 50_000)).count() == 2
    assert {r.doc_id: (r.chars, r.cv_md5, r.cv_chars) for r in D.cv_texts(docs).collect()} == {k: (None,) * 3 if t is None else (len(t), md5(S.decompose_py(t)), len(S.decompose_py(t))) for k, t in [(r.doc_id, r.text) for r in docs.collect()]}


def test_only_reachable_words_are_shared(spark):
    r = random.Random(3)
    for trial in range(3):
        words = {"".join(r.choices("ab" if trial else "abc", k=r.randint(1, 9))) for _ in range(60)} | {"c", "ca", "cab", "caba", "cabab", "cababc", "cababca", "d" * 7, "d" * 8, "d" * 9, "d" * 11}
        words = {w for w in words if trial < 2 or len(w) > 1}
        begun = {w: [n for n in range(1, len(w) + 1) if w[:n] in words] for w in words}
        got = {x.token for x in G.reachable(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
        assert got == {w for w, n in begun.items() if n == list(range(n[0], len(w) + 1))} and len(got) < len(words)


def test_grams_are_counted_a_pair_at_a_time(spark):
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choices("abcሀé", k=r.randint(0, 30))) for _ in range(2))
        b = a if r.random() < 0.2 else b
        grams = lambda s, n: Counter(s[i : i + n] for i in range(len(s) - n + 1))  # noqa: E731, B023
        assert M._met(a, b, 6) == [(n, grams(b, n).total(), grams(a, n).total(), (grams(a, n) & grams(b, n)).total()) for n in range(1, 7) if grams(a, n) or grams(b, n)]
    wide = "".join(map(chr, range(0x4E00, 0x5E00)))
    assert M._met(wide + "ab", wide + "ac", 6)[5] == (6, 4093, 4093, 4092)


def test_old_stems_compare_few_words(spark, monkeypatch):
    compared = []
    monkeypatch.setattr(G, "matches", lambda words, tokens, by=None, f=G.matches: (compared.append(words.count()), f(words, tokens, by))[1])
    words = ["ሀለ", "መሰረ", "ቀበተነ", *("ሀለ" + "መ" * k for k in range(1, 20)), *("ወ" + "መሰረ" + "ዘ" * k for k in range(20)), "ቀበተነከ", "ሀ"]
    assert {r.word for r in G.legacy_stems(spark.createDataFrame([(w,) for w in words], "word string")).collect()} == {"ሀለ", "መሰረ", "ቀበተነ"}
    assert compared == [4]


def test_words_of_documents(spark):
    docs = frame(spark, *TEXTS)
    want = {r.doc_id: r.w for r in docs.select("doc_id", M.n_words(F.col("text")).alias("w")).collect()}
    assert {r.doc_id: r.w for r in D.words_of_documents(docs).collect()} == want
