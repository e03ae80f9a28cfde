import pytest
from pyspark.sql import functions as F

from syllaspark.functions import script as S
from syllaspark.operators import encode as E
from syllaspark.operators import segment as G
from syllaspark.operators import vocab as V


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_normalise_and_split(spark):
    assert one(spark, "ab ሰላም 中 ٣٤!", lambda c: S.split_words(S.normalise(c))) == ["ሰላም", "٣", "٤", "!"]
    assert one(spark, "ሰላም፡ልጅ-12..  abc", S.split_words) == ["ሰላም", "፡", "ልጅ", "-", "12", ".", ".", "abc"]


def test_cv_form(spark):
    assert len(S.fidel_pairs()) == 271 == len({v for _, v in S.fidel_pairs()})
    for word, cv, back in [("ሰላም", "ስአልኣምእ", "ሰላም"), ("ልጆች", "ልእጅኦችእ", "ልጆች"), ("ሑኣ", "ሕኡኣ", "ሗ"), ("ቱኣ", "ትኡኣ", "ቷ"), ("ጕድ", "ጕድእ", "ጕድ"), ("እንዴት ነህ?", "እንእድኤትእ ንአህእ?", "እንዴት ነህ?")]:
        assert one(spark, word, S.decompose) == cv == S.decompose_py(word)
        assert one(spark, cv, S.recompose) == back == S.recompose_py(cv)


def test_custom_tokens_and_keys(spark):
    assert len(S.custom_tokens()) == 1422
    keys = S.cv_keys(spark).collect()
    assert len(keys) == 421 and len({(k.consonant, k.vowel) for k in keys}) == 421


UNIT = ["ሰላም ልዩ ቃል", "ሰላም ይደርሳል"]


def test_greedy(spark):
    roles = {(r.token, r.role) for r in G.affixes(G.corpus_words(frame(spark, *UNIT))).collect()}
    assert {t for t, r in roles if r == "stem"} == {"ልዩ", "ሰላም", "ቃል", "ይደርሳል"}
    assert {t for t, r in roles if r == "prefix"} == set("ላልምርሰሳቃዩይደ") and not any(r == "suffix" for _, r in roles)
    words = G.corpus_words(frame(spark, "ሰው ሰዎች ልጅ ልጆች በሰው የሰው ሰ በ"))
    got = {r.word: [p.piece for p in r.pieces] for r in G.greedy_pieces(words).collect()}
    assert got["ሰዎች"] == ["ሰ", "ዎ", "ች"] and got["በሰው"] == ["በ", "ሰው"] and got["ሰው"] == ["ሰው"] and got["የሰው"] == ["የሰው"]
    roles = {(r.token, r.role) for r in G.affixes(words).collect()}
    assert {t for t, r in roles if r == "stem"} == {"ልጅ", "ልጆች", "ሰው", "ዎ", "የሰው"} and {t for t, r in roles if r == "suffix"} == {"ች"}


def test_gms(spark):
    m = E.fit("gms", frame(spark, *UNIT))
    v = {r.token: r.base_id for r in m.vocab.collect()}
    assert len(v) == 1427 and sorted(v, key=v.get)[:6] == ["ይደርሳል", "ሰላም", ", ", "ልዩ", "ቃል", " "] and sorted(v.values()) == list(range(2, 1429))
    t = E.encode(m, frame(spark, "ሰላም", "ሰላም  ሰላም", "ሰላም, ልዩ x,  ቃል ", "", None)).orderBy("doc_id", "pos").collect()
    assert [r.id for r in t if r.doc_id == 0] == [2865] and [r.id for r in t if r.doc_id == 1] == [2865, 2866]
    third = [(r.token, r.start, r.end, r.text) for r in t if r.doc_id == 2]
    assert third == [("ሰላም", 0, 3, "ሰላም"), (", ", 3, 5, ", "), ("ልዩ", 5, 7, "ልዩ"), ("<unk>", 7, 9, " x"), (", ", 9, 11, ", "), ("ቃል", 11, 14, " ቃል")]
    assert {r.doc_id for r in t} == {0, 1, 2}
    e = E.encode(m, frame(spark, "ሰላም, ልዩ ቃል"))
    assert E.decode_ids(m, e).first().text == "ሰላም, ልዩ ቃል" == E.decode_spans(e).first().text


def shown(spark, m, *texts):
    e = E.encode(m, frame(spark, *texts)).cache()
    ids, spans = ({r.doc_id: r.text for r in d.collect()} for d in (E.decode_ids(m, e), E.decode_spans(e)))
    rows = e.orderBy("doc_id", "pos").collect()
    return [([(r.token, r.id) for r in rows if r.doc_id == k], ids[k], spans[k]) for k in range(len(texts))]


def test_hybrid(spark):
    m = E.fit("hybrid", frame(spark, "ልጅ ልጆች ይጫወታሉ ሰው ሰዎች", "በልጅ የልጆች"))
    assert m.vocab.count() == 298
    a, b, c, d, e, f, g = shown(spark, m, "ልጆች ይጫወታሉ", "ሰዎች", "በልጅ", "ለልጆች", "የልጆች", "ከይጫወታሉ", "ልጅ።")
    assert a == ([("ልጅ", 10), ("ኦች", 34), (" ", 282), ("ይጫወታሉ", 2)], "ልጆች ይጫወታሉ", "ልጅኦች ይጫወታሉ")
    assert b[0] == [("ሰው", 11), ("ኦች", 34)] and b[1] == "ሰዎች" and c[0] == [("በልጅ", 6)]
    assert d[0] == [("ለልጅ", 0), ("ኦች", 34)] and d[1] == "<unk>ኦች" and e[0] == [("የልጅ", 0), ("ኦች", 34)]
    assert f[0] == [("ከ", 163), ("ይጫወታሉ", 2)] and g == ([("ልጅ", 10), ("።", 0)], "ልጅ<unk>", "ልጅ።")


def test_morph(spark):
    m = E.fit("morph", frame(spark, "ሰው ሰዎች ልጅ ልጆች መጽሐፍ መጻሕፍት", "በሰው የሰው ለሰው ከሰው"))
    assert m.vocab.count() == 307
    a, b, c, d, e, f, g = shown(spark, m, "ሰዎች", "ልጆች", "የልጆች", "የሰዎች", "በሰው", "ሰው", "መጽሐፍ")
    assert a == ([("ሰው", 619), ("ኦች", 633)], "<unk>ኦች", "ሰውኦች")
    assert [x for x, _ in b[0]] == ["ልጅ", "ኦች"] and [x for x, _ in c[0]] == ["የ", "ልጅ", "ኦች"] and [x for x, _ in d[0]] == ["የ", "ሰው", "ኦች"]
    assert e[0] == [("በ", 677), ("ሰ", 873), ("ው", 653)] and [x for x, _ in f[0]] == ["ሰ", "ው"] and g[0] == [("መጽሐፍ", 713)]


@pytest.mark.parametrize("kind", ["gms", "hybrid"])
def test_large_vocabularies_are_joined(spark, monkeypatch, kind):
    texts = ["ሰው ሰዎች ልጅ ልጆች መጽሐፍ መጻሕፍት", "በሰው የሰው ለሰው ከሰው ይጫወታሉ በልጅ የልጆች", "ሀለሐመሠረሰሸቀበቨ ሀለሐመሠረሰሸቀበ ሀለሐመሠረሰሸ ቀበቨሀለሐመሠረሰሸቀ"]
    docs = frame(spark, *texts, "ከይጫወታሉ ለልጆች የበልጅ። x ሑኣ ከከሰዎች\tየሕኡኣኦች  ኣኣኣኣ ሀለሐመሠረሰሸቀበቨተ ለሀለሐመሠረሰሸቀበ", "", None)

    def run():
        m = E.fit(kind, docs)
        x = E.encode(m, docs)
        out = sorted(map(tuple, m.vocab.collect())), sorted(map(tuple, x.collect())), sorted(map(tuple, E.decode_ids(m, x).collect()))
        spark.catalog.clearCache()
        return out

    want = run()
    monkeypatch.setattr(G, "MOST_TOKENS", 0)
    assert run() == want


def plain_split_morph(w, tokens, suffixes):
    """The rules read off SURVEY §2.4, one word at a time."""
    if len(w) <= 2:
        return [w]
    cut = next((len(s) for s in map(S.decompose_py, S.MORPH_SUFFIXES) if w.endswith(s) and len(w) - len(s) >= 2), None)
    cut = cut or next((n for n in range(min(len(w) - 2, 10), 0, -1) if w[-n:] in suffixes and w[:-n] in tokens), None)
    listed = [S.decompose_py(x) for x in S.MORPH_PREFIXES]
    if cut:
        stem, suffix = w[:-cut], w[-cut:]
        p = next((p for p in listed if stem.startswith(p) and len(stem) - len(p) >= 2), "")
        return [x for x in (p, stem[len(p) :], suffix) if x]
    for p in listed:
        if w.startswith(p) and len(w) - len(p) >= 2 and w[len(p) :] in tokens:
            return [p, w[len(p) :]]
    return plain_longest(w, tokens)


def plain_split_hybrid(word, tokens, corpus):
    cv = S.decompose_py(word)
    for s in S.HYBRID_SUFFIXES:
        c = S.decompose_py(s)
        if cv.endswith(c) and len(cv) > len(c):
            return [S.recompose_py(cv[: -len(c)]), s]
    if word in corpus:
        return [word]
    for p in S.HYBRID_PREFIXES:
        c = S.decompose_py(p)
        if cv.startswith(c) and len(cv) > len(c):
            stem = S.recompose_py(cv[len(c) :])
            if stem in corpus or len(stem) >= 2:
                return [p, *plain_split_hybrid(stem, tokens, corpus)]
    return [S.recompose_py(x) for x in plain_longest(cv, tokens)]


def plain_longest(w, tokens):
    out = []
    while w:
        n = next((n for n in range(len(w), 0, -1) if w[:n] in tokens), 1)
        out.append(w[:n])
        w = w[n:]
    return out


def test_rule_splits_against_plain_ones(spark):
    import random

    r = random.Random(5)
    parts = ["የ", "ለ", "በ", "ስለ", "እንደ", "ልጅ", "ሰው", "ቱኣ", "ሀቱኣ", "ሰላም", "ኦች", "ዎች", "ን", "ጕ", "x", "ቤት", "ው", "ል", "አ"]
    words = sorted({"".join(r.choices(parts, k=r.randint(1, 5))) for _ in range(900)} | {"የል", "ሀቱኣ", "ስአልኣምአ", "የየየ", "በ", "ለን"})
    corpus = set(r.sample(words, 200)) | {"ሀቱኣ"}
    docs = frame(spark, " ".join(sorted(corpus)))
    frame_of = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)], "word string")
    for kind in ("morph", "hybrid"):
        m = E.fit(kind, docs)
        tokens = {x.token for x in m.all_tokens().collect()}
        if kind == "morph":
            suffixes = {x.token for x in V.morph_suffixes(m.roles).collect()}
            own = {S.decompose_py(w) for w in words}
            want = {w: plain_split_morph(w, tokens, suffixes) for w in own}
        else:
            known = {x.token for x in m.roles.collect() if x.role == "word"}
            own, want = words, {w: plain_split_hybrid(w, tokens, known) for w in words}
        got = {x.word: x.pieces for x in E.rule_pieces(kind, frame_of(own), m.all_tokens(), m.roles).collect()}
        assert got == want
    assert want["ሀቱኣ"] == ["ሀቱኣ"] and want["የል"] != ["የ", "ል", "እ"]


def test_long_words_and_foreign_runs(spark):
    long = ["ሀለ" * 10_000, "ሀ" * 3_000 + "ለ", "መ" + "ሀለ" * 1_500]
    docs = frame(spark, " ".join([*long, "ሀለ", "é" * 100_000 + " ሰላም"]))
    m = E.fit("gms", docs)
    t = E.encode(m, docs)
    assert E.decode_ids(m, t).count() == 1 and m.vocab.where("token = 'ሰላም'").count() == 1
    assert {w.word for w in G.corpus_words(docs).collect()} == {*long, "ሀለ", "ሰላም"}


def test_merges(spark):
    def run(f, parts):
        rows = f(spark.createDataFrame([(1, k, p) for k, p in enumerate(parts)], "doc_id int, pos int, piece string")).orderBy("pos").collect()
        return "".join(x.piece for x in rows)

    assert run(E.merge_hybrid, ["ልእ", "ኦችእ", "አ"]) == "ልኦችእአ" and run(E.merge_hybrid, ["ልእ", "ብእ", "ኣ"]) == "ልእብኣ" and run(E.merge_hybrid, []) == ""
    assert run(E.merge_morph, ["ልእጅእ", "ኦችእ", "ኦ"]) == "ልእጅኦችኦ" and run(E.merge_morph, ["እ", "ኦ"]) == "እኦ"


@pytest.mark.parametrize("kind", V.MODELS)
def test_save_load_and_empty(spark, tmp_path, kind):
    from syllaspark.sources import corpus as C

    m = E.fit(kind, frame(spark, *UNIT))
    C.save_model(m, str(tmp_path / "m"))
    n = C.load_model(spark, str(tmp_path / "m"))
    assert n.kind == kind and sorted(map(tuple, n.vocab.collect())) == sorted(map(tuple, m.vocab.collect()))
    assert E.encode(n, frame(spark, "").limit(0)).count() == 0
    x = E.encode(n, frame(spark, "ሰላም ልዩ"))
    assert E.decode_spans(x).count() == 1


def test_streaming(spark, tmp_path):
    from syllaspark.streaming import encode as X

    frame(spark, *UNIT).write.parquet(str(tmp_path / "in"))
    m = E.fit("gms", frame(spark, *UNIT))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    X.encode_stream(stream, m, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    X.grow_vocabulary(stream, "gms", m.vocab, str(tmp_path / "v"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "v/version=0")).count() == 1427


def test_whole_learning_curve(spark, tmp_path):
    from syllaspark.operators import metrics as M
    from syllaspark.plans import queries as Q

    words = "the house of trees and rivers lights up a morning".split()
    rows = [(k, " ".join(words[(i * i + k) % len(words)] for i in range(n))) for k, n in ((0, 50), (3, 800), (4, 240_000), (5, 100_000))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.algorithm, r.step): r.ppl for r in Q.ppl_curve(spark, str(tmp_path)).collect()}
    assert set(got) == {(k, s) for k in ("gms", "cv", "hybrid") for s in Q.STEPS}
    docs = Q.docs_of(spark, str(tmp_path))
    part = docs.where(F.col("doc_id").isin([3, 4]))
    m = E.fit("hybrid", part)
    want = M.unigram_ppl(E.encode(m, part), E.encode(m, docs.where(M.is_test()))).first().ppl
    assert got["hybrid", 250_000] == pytest.approx(want, abs=0.006)
    assert all(got[k, 25_000] == got[k, 225_000] != got[k, 250_000] for k in ("gms", "cv", "hybrid"))


@pytest.mark.parametrize("kind", V.MODELS)
def test_json_models(spark, tmp_path, kind):
    import json

    from syllaspark.sources import corpus as C

    docs = frame(spark, "ሰው ሰዎች ልጅ ልጆች መጽሐፍ", "በሰው የሰው ይጫወታሉ \"")
    m = E.fit(kind, docs)
    C.save_pretrained(m, str(tmp_path / "m"))
    vocab, config = (json.loads((tmp_path / "m" / f).read_text()) for f in ("vocab.json", "tokenizer.json"))
    assert vocab == {r.token: r.base_id for r in m.all_tokens().collect()} and config["tokens"] == sorted(set(vocab) - {"<unk>", "<pad>"}, key=vocab.get)
    n = C.load_pretrained(spark, str(tmp_path / "m"))
    assert n.kind == kind and sorted(map(tuple, E.encode(n, docs).collect())) == sorted(map(tuple, E.encode(m, docs).collect()))


def test_command_line(spark, tmp_path):
    import json

    from syllaspark.__main__ import run

    (tmp_path / "a.txt").write_text("\n".join(UNIT))
    (tmp_path / "b.txt").write_text("ቤት ቤቶች")
    out = str(tmp_path / "m")
    run(spark, ["train", "--corpus", str(tmp_path / "a.txt"), "--outdir", out])
    assert run(spark, ["encode", "--tokenizer", out, "--text", "ሰላም"]) == "2865"
    assert run(spark, ["decode", "--tokenizer", out, "--ids", "2865", "2866"]) == "ሰላም ሰላም"
    run(spark, ["train", "--corpus", str(tmp_path / "a.txt"), "--additional-corpus", str(tmp_path / "b.txt"), "--outdir", out, "--use-old-algorithm"])
    assert {"ቤት", "ሰላም"} <= set(json.loads((tmp_path / "m" / "vocab.json").read_text()))
    run(spark, ["build-maps", "--outdir", str(tmp_path / "maps")])
    keys = json.loads((tmp_path / "maps" / "key_to_glyph.json").read_text())
    assert len(keys) == 421 and all(len(json.loads(k)) == 2 for k in keys)


def plain_old_split(words):
    """Stems, prefixes and suffixes of the older split, word by word: words in order of length, then of code points."""
    words = sorted(set(words), key=lambda w: (len(w), w))
    long = [w for w in words if len(w) > 1]
    stems = [w for w in long if not any(x != w and x in w for x in long)]
    prefixes, suffixes = [w for w in words if len(w) == 1], []
    for s in stems:
        for w in long:
            if w != s and s in w:
                prefixes.append(w[: w.find(s)])
                suffixes.append(w[w.find(s) + len(s) :])
    return set(stems), G.fold_affixes(set(), prefixes), G.fold_affixes(set(), suffixes)


def test_old_split_and_all_matches(spark):
    import random

    r = random.Random(2)
    words = sorted({"".join(r.choices("ሀለመሰ", k=r.randint(1, 12))) for _ in range(120)})
    got = {}
    for x in G.legacy_split(spark.createDataFrame([(w,) for w in words], "word string")).collect():
        got.setdefault(x.role, set()).add(x.token)
    stems, prefixes, suffixes = plain_old_split(words)
    assert got["stem"] == stems and got["prefix"] == prefixes and got.get("suffix", set()) == suffixes
    tokens = ["ሀ", "ለመ", words[-1], "ሀለመሰሀለመሰ"]
    texts = [w + w for w in words] + ["ሀለመሰሀለመሰሀለመሰ"]
    found = sorted((x.word, x.token, x.start, x.end) for x in G.find_all(spark.createDataFrame([(w,) for w in texts], "word string"), V.tokens_frame(spark, tokens)).collect())
    assert found == sorted((w, t, i, i + len(t)) for w in texts for t in tokens for i in range(len(w)) if w.startswith(t, i))


def test_measures(spark, tmp_path):
    import json

    from syllaspark.operators import metrics as M
    from syllaspark.sources import corpus as C

    pairs = spark.createDataFrame([(1, "ab cd", "ab cd"), (2, "efghij", "efgh")], "doc_id long, ref string, hyp string")
    # By hand: 8 of 8, 6 of 6, 4 of 4 and 2 of 2 n-grams match; 10 characters against 8, so exp(1 - 10 / 8).
    assert M.bleu(pairs).first().bleu == 77.88
    assert M.chrf(pairs.where("doc_id = 1")).first().chrf == 100.0
    docs = frame(spark, "ሰላም ልዩ ቃል", "ሰላም ይደርሳል x")
    m = E.fit("gms", docs)
    row = M.evaluate("gms", m, docs, docs)
    r = row.first()
    assert r.vocab_size == 1427 and r.unk_pct == round(100 / 6, 3) and r.tok_per_word == 1.0 and r.ppl == pytest.approx(4.8, abs=0.01) and M.throughput(m, docs) > 0
    assert len(M.table_text(row).splitlines()) == 5
    C.save_metrics(row, str(tmp_path / "m.json"))
    assert json.loads((tmp_path / "m.json").read_text())[0]["algorithm"] == "gms"
    C.save_curve(spark.createDataFrame([("a", 5, None), ("a", 1, 2.0)], "algorithm string, step long, ppl double"), str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text()) == {"checkpoints": [1, 5], "curves": {"a": [{"step": 1, "ppl": 2.0}, {"step": 5, "ppl": None}]}}
    t = E.tokenize(m, frame(spark, "ሰላም ልዩ", None)).orderBy("doc_id").collect()
    assert [x.token_count for x in t] == [2, 0] and E.decode(m, E.tokenize(m, frame(spark, "ሰላም ልዩ"))).first().text == "ሰላም ልዩ"
    assert [tuple(x) for x in M.words_in_order(frame(spark, " ሀ  ለ\n")).collect()] == [(0, 0, "ሀ"), (0, 1, "ለ")]
    assert one(spark, "ሰላም", S.word_mapping) == {"ሰላም": "ስአልኣምእ"}
