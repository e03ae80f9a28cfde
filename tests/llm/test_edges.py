"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator that reads documents."""

import re

import pytest

from syllaspark.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing, quality, substring_dedup, token_counts

LONG = " ".join(f"w{i % 9973}x{i // 9973}" for i in range(60_000))
ROWS = [(1, "plain words of a text that is not very long", "en"), (1, "plain words of a text that is not very long", "en"), (2, None, None), (3, "", "en"), (4, LONG, "en"), (5, "y" * 200_000, None), (None, "words without an id", "en"), (6, " \t\n", "de"), (7, LONG + " end", "de")]
#: Names that the operators use for their own columns.
CLASH = ["sig", "gram", "n", "part", "run", "keep_id", "kept", "score", "f", "terms", "first", "piece", "length", "component_id", "n_words", "_n", "segment"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, *range(len(CLASH))) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} int" for c in CLASH)).repartition(3)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_pairs_and_copies(docs):
    j = by_id(jaccard_join.join(docs))
    assert j[7][0].component_id == 4 and j[2][0].n_shingles == 0 and j[2][0].component_id == 2 and j[None][0].component_id is None and len(j[1]) == 2
    kept = by_id(jaccard_join.keep_one(docs))
    assert set(kept) == {1, 2, 3, 4, 5, 6, None} and all(len(v) == 1 for v in kept.values())
    e = by_id(exact_dedup.exact_dedup(docs))
    assert e[1][0].group_size == 2 and len(e[1]) == 2 and e[6][0].group_size == 3 and e[6][0].kept and not e[2][0].kept
    kept = exact_dedup.dedup_filter(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == ["1", "4", "5", "6", "7", "None"]


def test_removed_words(docs):
    s = by_id(substring_dedup.dedup(docs))
    assert s[4][0].n_removed == 0 and s[4][0].n_words == 60_000 and (s[7][0].n_words, s[7][0].n_removed) == (60_001, 60_000)
    assert len(s[1]) == 2 and s[1][0] == s[1][1] and s[2][0].n_words == s[6][0].n_words == 0 and s[5][0].n_words == 1


def test_models(docs, spark):
    m = language_id.train(docs)
    got = by_id(language_id.identify(docs, m))
    assert got[2][0].lang_pred == got[3][0].lang_pred == got[6][0].lang_pred == "und" and len(got[1]) == 2 and got[5][0].lang_pred in ("en", "de")
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 1), (None, 1), (9, None)], "doc_id long, quality int")
    q = by_id(quality.classify(docs, labels))
    assert sum(map(len, q.values())) == len(ROWS) and all(0 <= r.score <= 1 for v in q.values() for r in v)


def test_tokens(docs):
    c = by_id(token_counts.token_counts(docs))
    assert c[2][0].n_tokens == c[3][0].n_tokens == 0 and len(c[1]) == 2 and c[4][0].n_tokens > 60_000
    p = by_id(packing.pack_documents(docs))
    assert len(p[1]) == 2 and [r.length for r in p[2]] == [1] and sorted(r.piece for r in p[4]) == list(range(len(p[4])))
    assert {r.sequence_id for r in p[1]} and sum(r.length for r in p[7]) > sum(r.length for r in p[4])


def test_passages(docs, spark):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[100:130]), 0), (2, None, 0), (None, LONG, 0), (3, "", 0)], "item_id long, text string, doc_id int")
    d = by_id(decontaminate.decontaminate(docs, items))
    assert (d[4][0].n_items, d[4][0].n_hit) == (1, len(re.findall("[a-z0-9]+", LONG))) and d[2][0].n_words == 0 and len(d[1]) == 2
