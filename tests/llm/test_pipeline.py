import random

import pyarrow as pa

import corpus_pipeline as C
from syllaspark.llm import language_id as L


def test_stages(spark, tmp_path):
    r = random.Random(4)
    vocab = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "lmnrst"]
    base = [" ".join(r.choices(vocab, k=120)) for _ in range(40)]
    passage = " ".join(r.choices(vocab, k=15))
    near = base[3].split()
    near[60] = "changed"
    rows = [(i, x, "en") for i, x in enumerate(base)] + [(100, base[2] + " ", "en"), (101, " ".join(near), "en"), (102, base[5][:200] + " " + passage + " " + " ".join(r.choices(vocab, k=90)), "en"), (103, None, "en"), (104, "123 !!", "en"), (7, base[7], "en"), (7, base[7], "en")]
    spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage), (2, "the")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for k, (name, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        left.append({x.doc_id for x in docs.collect()})
    every = {x[0] for x in rows}
    assert left[0] == every - {103, 104}
    assert left[1] == left[0] - {2}  # the copy with a trailing space is the longest original
    assert left[2] == left[1] - {101} and left[3] == left[2] - {102} and left[4] == left[3]
    got = C.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} == left[4] and len(got) == len(left[4])  # rows that repeat are one


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long, sig int, run int, kept int, score int"
    spark.createDataFrame([], names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
    text = "a text of some words that is long enough to have shingles and the like in it"
    rows = [(i, x, "en", "s", 1, i, i, i, i) for i, x in enumerate([text, text + " too", None, text, "other words"])] + [(0, text, "en", "s", 1, 0, 0, 0, 0)]
    spark.createDataFrame(rows, names).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert sorted(x.doc_id for x in C.run(spark, str(tmp_path)).collect()) == [0, 4]


def test_language_stage_judges_by_all_texts(spark):
    r = random.Random(7)
    odd = lambda share: "".join(r.choice("abc ") if r.random() < share else c for c in " ".join(r.choices(["aab", "bca", "cab", "ac"], k=12)))
    rows = [(i, odd(0 if i >= 12 else i / 20), "en") for i in range(4000)]  # the odd texts of the language are rare, and tell where its threshold lies
    rows += [(10000 + i, odd(i / 1000), None) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs)
    texts = pa.array([x[1] for x in rows])
    h, n, letters = model.entropies(texts)
    model.calibrate(0, h[:4000, 0], n[:4000])
    want = {x[0] for x, no in zip(rows, model.decide(h, n, letters)[3].tolist(), strict=True) if not no}
    assert 4000 < len(want) < 5000 and {x.doc_id for x in C.identify_language(spark, docs, "").collect()} == want
