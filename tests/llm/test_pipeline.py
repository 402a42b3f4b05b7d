import re
from collections import Counter

import corpus_pipeline
from quire.llm import mixing, packing, secret_scan, site_quality
from test_dart_minhash import brute as near_brute
from test_mixing import brute as mix_brute
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_against_its_predecessor(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], FOLDER).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    assert all(t.columns == columns for t in tables[:-1])
    rows = [t.collect() for t in tables]

    kept = {r.doc_id for r in site_quality.assess(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).where("kept").collect()}
    assert Counter(rows[1]) == Counter(r for r in rows[0] if r.doc_id in kept) and 0 < len(rows[1]) < len(rows[0])

    classes = near_brute([(r.doc_id, r.text) for r in rows[1]])
    assert Counter(rows[2]) == Counter(r for r in rows[1] if classes[r.doc_id] == r.doc_id)

    before = {r.doc_id: r for r in rows[2]}
    assert sorted(before) == sorted(r.doc_id for r in rows[3])
    for r in rows[3]:
        clean = secret_scan.redact(before[r.doc_id].text, secret_scan.spans(before[r.doc_id].text)[1])
        assert r.text == clean and r.source == before[r.doc_id].source
        assert r.n_chars == (len(clean) if clean != before[r.doc_id].text else before[r.doc_id].n_chars)

    taken = {i: t for i, _, _, _, t in mix_brute([(r.doc_id, r.text, r.source) for r in rows[3]])}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    got, whole = Counter(), {r.doc_id: words(r.text) for r in rows[3]}
    for r in rows[4]:
        own = words(r.text)
        got[r.doc_id] += len(own)
        assert own == whole[r.doc_id][: len(own)]
    assert got == Counter({i: t for i, t in taken.items() if t})

    encode = Tokenizer.from_file(packing.tokenizer_file())
    want = Counter()
    for r in rows[4]:
        want[r.doc_id] += len(encode.encode(r.text, add_special_tokens=False).ids) + 1
    have = Counter()
    for r in rows[5]:
        have[r.doc_id] += r.length
    assert have == want
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_repeated_and_null_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, "en", "a", 1), (None, None, None, None, None), (3, text, "en", "a", 9), (3, text, "en", "a", 9), (4, None, "en", "b", 0)], schema)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert packing.pack(docs).count() >= docs.count()
    assert mixing.mixed(docs.limit(0)).collect() == []


def test_rows_stay_rows_whatever_the_columns_are_called(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _h long, _first int, _taken long, _size int, row string, words array<int>, node long, class_id long, spans string, m map<string,int>"
    a = " ".join(f"word{i}" for i in range(40))
    b = " ".join(f"other{i}" for i in range(40))
    more = (7, 8, 9, 10, "r", [1], 5, 6, "s", {"k": 1})
    rows = [(1, a, "en", "s", 1, *more), (2, a, "en", "s", 1, *more), (2, b, "en", "s", 1, *more), (3, b, "fr", "s", 1, *more), (5, None, "en", "s", 0, *more), (5, "", "en", "t", 0, *more)]
    docs = spark.createDataFrame(rows, schema)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        seen[name] = [(r.doc_id, r.text, r.lang, r._h, r._first, r._taken, r._size, r.row, r.node, r.class_id, r.spans, r.m["k"]) for r in out.collect()]
    assert {x[3:] for rows in seen.values() for x in rows} == {(7, 8, 9, 10, "r", 5, 6, "s", 1)}
    assert sorted((x[0], x[1]) for x in seen["near_dedup"] if x[1]) == [(1, a), (2, b)] and len(seen["near_dedup"]) == 4
    assert len(seen["secrets"]) == len(rows)
    # rows equal in id, source and text, but not in another column, are mixed each for itself
    twins = spark.createDataFrame([(1, a, "en", "s", 1, *more), (1, a, "fr", "s", 1, *more)], schema)
    assert sorted(r.lang for r in mixing.mixed(twins).collect()) == ["en", "fr"]


def test_one_text_of_an_id_is_rejected_and_another_kept(spark):
    labelled = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    verdicts = site_quality.assess(labelled, labels).select("doc_id", "kept").collect()
    good, bad = (next(r.doc_id for r in verdicts if r.kept == k) for k in (True, False))
    both = labelled.selectExpr("*", f"IF(doc_id = {bad}, {good}, doc_id) AS new_id").drop("doc_id").withColumnRenamed("new_id", "doc_id")
    kept = site_quality.kept_documents(both, labels.where(f"doc_id <> {good}"))
    assert kept.where(f"doc_id = {good}").count() == 1
