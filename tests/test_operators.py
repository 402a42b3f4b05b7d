from pyspark.sql import functions as F

from quire.operators import catalog, logs, semistructured, store, tasks, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_log_line_classes(spark):
    cases = {
        "Predict: 52%|█████▏    | 14/27 [02:04<01:52,  8.66s/it]": "progress", "OCR-rec Predict: 83%|████████▎ | 120/144 [05:10<01:02]": "progress", "Hybrid processing window 1/1: pages 1-27/27": "window",
        "2026-04-25 10:00:00 page_count=27, window_size=64, total_windows=1": "document-shape", "Using transformers for OCR detection model": "engine-config", "2026-04-25 10:05:00 GET /health 200 OK": "api-noise",
        '"GET /tasks/a8b51d08-a206-4b88 HTTP/1.1" 200': "api-noise", "2026-04-25 10:10:00 ERROR: OutOfMemoryError in CUDA": "error", "some random text": None, " ": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "line string")
    assert {r.line: r.s for r in rows.select("line", logs.signal(F.col("line")).alias("s")).collect()} == cases
    # a leading time stamp leaks into the phase, as the pattern has it
    got = rows.sparkSession.createDataFrame([("2026-04-25 10:00:00 Predict: 5%|x| 1/2",)], "line string").select(logs.progress(F.col("line"))["phase"].alias("p")).first().p
    assert got == "00 Predict"


def test_activity_levels(spark):
    schema = "n_progress int, n_changes int, n_business int, n_noise int, n_error int, same boolean, want string"
    rows = [
        (5, 0, 0, 10, 0, False, "active-progress"), (1, 1, 0, 5, 0, True, "active-stage-change"), (0, 0, 3, 20, 0, False, "active-business-log"), (0, 0, 0, 50, 0, False, "api-alive-only"),
        (0, 0, 0, 0, 0, False, "no-business-signal"), (3, 0, 0, 10, 0, True, "suspected-stale"), (2, 0, 1, 5, 1, False, "log-error-signal"),
    ]
    got = spark.createDataFrame(rows, schema).select("want", logs.activity(F.col("same")).alias("level")).collect()
    assert all(r.want == r.level for r in got)


def test_fifo_order(spark):
    schema = "id string, created_at string, mineru_task_id string, canceled_at timestamp, state string"
    rows = [("1", "2026-01-01 00:00:01", "", None, "pending"), ("2", "2026-01-01 00:00:00", None, None, "pending"), ("3", "2026-01-01 00:00:00", "m", None, "running"), ("4", "2020-01-01", "m", None, "canceled")]
    df = spark.createDataFrame(rows, schema).withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert [r.id for r in tasks.fifo(df, 5).collect()] == ["3", "2", "1"]


def test_text_functions(spark):
    name = "Cambridge IGCSE(0580) Core and Extended Mathematics_2018(Cambridge University Press).pdf"
    assert {"Cambridge", "IGCSE", "0580", "Core", "Extended", "Mathematics", "2018"} <= set(one(spark, text.name_tokens(F.lit(name))))
    md = "# Chapter 1\nx\n## Exercise\n1. Algebra\n#no\n### Final"
    assert one(spark, text.headings(F.lit(md))) == ["# Chapter 1", "## Exercise", "1. Algebra", "### Final"]
    assert one(spark, text.safe_path(F.lit("\\a//./b/c.md"))) == "a/b/c.md" and one(spark, text.safe_path(F.lit("a/../b"))) == ""
    assert one(spark, text.repaired_name(F.lit("学年".encode().decode("latin-1")))) == "学年" and one(spark, text.repaired_name(F.lit("Café"))) == "Café"
    assert one(spark, text.bytes_text(F.lit(2048))) == "2.0 KB" and one(spark, text.duration_text(F.lit(3_725_000))) == "1h 2m"
    assert one(spark, text.context(F.lit("x" * 20000), 5)).count("x") == 10000 - len(text.CUT_MARK)


def test_json_extraction_and_markdown_choice(spark):
    for raw, want in (('{"a":1}', '{"a":1}'), ('<think>{</think> x ```json\n{"a":2}\n```', '{"a":2}'), ('so {"a":3} end', '{"a":3}'), ("none", None), ("{ x", None), (None, None)):
        assert one(spark, semistructured.extract_json(F.lit(raw).cast("string"))) == want
    files = spark.createDataFrame([(1, 0, "b/auto/long.md"), (1, 1, "a.md"), (2, 0, "x/FULL.md"), (2, 1, "a.md"), (3, 0, "only.txt")], "owner int, ordinal int, path string")
    assert {(r.owner, r.path) for r in semistructured.primary_markdown(files).collect()} == {(1, "b/auto/long.md"), (2, "x/FULL.md")}


def test_store_round_trip_and_pages(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    store.save({"materials": rows}, str(tmp_path))
    assert sorted(map(tuple, store.load(spark, str(tmp_path), ("materials",))["materials"].collect())) == [(1, "a"), (2, "b")]
    assert store.upsert(rows, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")).count() == 3
    assert [r.id for r in catalog.page(spark.range(20).orderBy("id"), 2, 12).collect()] == list(range(12, 20))
    assert catalog.page(spark.range(5).orderBy("id"), -3, 0).count() == 1
    assert catalog.search(rows, "  ", ["v"]).count() == 2
