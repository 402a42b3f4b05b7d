import hashlib

from pyspark.sql import functions as F

from quire import registry
from quire.operators import text


def test_choice_between_pack_and_sampler(spark):
    rows = [(0, None, 5), (1, "", None), (2, "a" * 70_000, 1000), (3, "b" * 150_000, 1000), (4, "c" * 150_001, None), (5, "d", 1001)]
    got = text.model_input(F.col("t"), F.lit("Some_Book.pdf"), F.lit("H\n\n"), F.col("files"))
    got = {r.id: r for r in spark.createDataFrame(rows, "id int, t string, files int").select("id", *(c.alias(n) for n, c in got.items())).collect()}
    assert [got[i].mode[:6] for i in range(6)] == ["legacy", "legacy", "legacy", "legacy", "eviden", "eviden"]
    assert [got[i].truncated for i in range(6)] == [False, False, False, True, True, True]
    assert got[0].content == got[1].content == ""
    assert got[2].content == "H\n\n" + "a" * 70_000
    assert 79_000 < len(got[3].content) <= 80_000
    assert 8_000 < len(got[4].content) < 30_000
    assert "TAIL ===\nd" in got[5].content


def test_pack_keeps_its_last_parts(spark):
    whole = "x" * 20_000 + "M" * 2000 + "y" * 10_000 + "L" * 1500 + "z" * 6000 + "T" * 500
    d = spark.createDataFrame([(whole,)], "t string").select(text.pack_text(F.col("t"), F.lit("a.pdf")).alias("p"), text.pack_text(F.col("t"), F.lit("a.pdf"), 6000).alias("small"), text.sample(F.col("t"), F.lit("H"), 2000).alias("sampled"))
    got = d.first()
    assert "=== LATE CHAPTER ===" in got.p and got.p.endswith("T" * 500 + "\n\n")
    assert got.small[:6000] == got.p[:6000] and got.small[6000:] == text.PACK_SUFFIX
    assert len(got.sampled) <= 2000 and "T" * 150 in got.sampled
    assert len(registry.queries()["t12_whole_evidence_pack"](spark, "/root/testdata/sf0.001").where("pack_chars > 6100").take(1)) == 1


def test_whole_sampler_passes_what_fits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars between 3000 and 70000 and doc_id % 3 <> 0 and doc_id % 5 <> 0").orderBy("doc_id").first()
    want = hashlib.md5(f"=== FILE METADATA ===\nFilename: {docs.source}\n=== END METADATA ===\n\n{docs.text}".encode()).hexdigest()
    got = registry.queries()["t13_whole_sampler"](spark, "/root/testdata/sf0.001").where(F.col("doc_id") == docs.doc_id).first()
    assert got.sampled == want
