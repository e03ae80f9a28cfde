import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer, models

from syllaspark.llm import packing, token_counts, tokens
from syllaspark.llm.tokens import Unigram, bpe_ids, read_pieces, unigram_counts

TEXTS = ["Hello  world's café\n\nÀ é́ x", "", "   ", "a", "12345 ١٢ don't!!! <|endoftext|>x <|startoftext|>", "日本語 テスト z q ́a", "ΣΑΣ ß İ", "word " * 3000, "x" * 9000, "ab\x1c cd\x85ef"]


def test_bpe_ids_are_the_tokenizers():
    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    ids, first = bpe_ids(pa.array(TEXTS), P.path(packing.VOCABULARY))
    for i, x in enumerate(TEXTS):
        assert ids[first[i] : first[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_unigram_counts_are_the_librarys():
    pieces = read_pieces(P.path(token_counts.VOCABULARY))
    vocab = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *pieces.items()]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    texts = [x for x in TEXTS if "<" not in x]
    n, _ = unigram_counts(pa.array(texts), P.path(token_counts.VOCABULARY))
    for x, k in zip(texts, n, strict=True):
        s = ("▁" + x.replace(" ", "▁")) if x else ""
        assert k == len(t.encode(s).ids), x


def plain_viterbi(pieces, text):
    """Pieces and score of the best segmentation, by trying every piece at every place."""
    low = min(pieces.values()) - 10
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):  # only a better path replaces one whose last piece starts earlier
            s = pieces.get(text[start:end])
            if s is not None and (best[end] is None or best[start][0] + s > best[end][0]):
                best[end] = best[start][0] + s, best[start][1] + 1
        if text[end - 1] not in pieces and (best[end] is None or best[end - 1][0] + low > best[end][0]):
            best[end] = best[end - 1][0] + low, best[end - 1][1] + len(text[end - 1].encode())
    return best[-1][1], best[-1][0]


def test_counts_against_a_plain_viterbi(spark):
    pieces = read_pieces(P.path(token_counts.VOCABULARY))
    texts = [*(x for x in TEXTS if len(x) < 400), "the  quick brown fox, jumps over 12 dogs\n\nagain", " lead and trail  ", None]
    rows = [(i, x, 5) for i, x in enumerate(texts)] + [(1, texts[0], 6), (1, texts[0], 6), (None, "ab", 1)]
    got = sorted(map(tuple, token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()), key=str)
    want = []
    for i, x, _ in rows:
        n, score = plain_viterbi(pieces, "▁" + x.replace(" ", "▁")) if x else (0, 0.0)
        want.append((i, n, pytest.approx(score, abs=1e-6)))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:2] == b[:2]
    assert sorted(x[2] for x in got) == pytest.approx(sorted(x[2].expected for x in want), abs=1e-6)


def test_unigram_ties_and_unknown():
    u = Unigram({"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0})
    assert u.count("ab") == (1, -2.0)
    assert u.count("aba")[1] == -3.0
    assert u.count("é")[0] == 2
    assert u.count("") == (0, 0.0)


def test_pack(spark):
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(99, None), (99, None), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length")
    got = packing.pack_documents(docs).collect()
    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        assert r.start == 4096 * r.piece
    assert len(got) == sum(-(-len(want[i]) // 4096) for i, _ in rows)
    check_layout(got)
    assert len({r.sequence_id for r in got}) == packing.lower_bound(np.array([r.length for r in got]))


def check_layout(got):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096


def test_exchange_between_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, 0, int(n), 7) for i, n in enumerate(rng.integers(1, 2000, 3000))]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(items, per_partition=400).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    check_layout(got)
    bound = packing.lower_bound(np.array([r[3] for r in rows]))
    assert len({r.sequence_id for r in got}) <= bound * 1.01 + 1
    for few in (items.where("doc_id < 40 AND length > 1000"), items.where("length > 1500")):
        one = packing.pack(few).collect()  # a single partition: its sequences are certified if there are as many as the bound
        least = packing.lower_bound(np.array([r.length for r in one]))
        assert all(r.certified for r in one) == (len({r.sequence_id for r in one}) == least)


def test_lower_bound_is_a_bound():
    rng = np.random.default_rng(1)
    for hi in (100, 1500, 3000, 4096):
        x = rng.integers(1, hi, 500)
        b, o, fill = packing.best_fit_decreasing(x)
        assert fill.max() <= 4096 and packing.lower_bound(x) <= len(fill)
    assert packing.lower_bound(np.array([2049] * 5)) == 5
    assert packing.lower_bound(np.array([1366] * 6)) == 3


@pytest.mark.parametrize("op", [packing.pack_documents, token_counts.token_counts])
def test_empty(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_are_found_again_after_the_memo_begins_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 40)
    monkeypatch.setattr(tokens, "JOINED", 7)
    tokens._bpe.cache_clear()
    t = Tokenizer.from_file(P.path(packing.VOCABULARY))
    for k in range(6):
        texts = [" ".join(f"w{(k * 13 + j * j) % 50}<|endo" for j in range(30)), *TEXTS[k:]]
        ids, first = bpe_ids(pa.array(texts), P.path(packing.VOCABULARY))
        for i, x in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids
    tokens._bpe.cache_clear()
