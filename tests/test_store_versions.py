import json

import pytest
from pyspark.sql import functions as F

from quire import sources
from quire.operators import catalog, semistructured, store, tasks


def rows(spark, n):
    return spark.createDataFrame([(str(i), f"row {i}") for i in range(n)], "id string, title string")


def test_load_change_and_save_to_the_same_folder(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert store.save({"materials": rows(spark, 3), "tasks": rows(spark, 2)}, folder) == 1
    now = store.load(spark, folder, ("materials",))
    more = now["materials"].unionByName(spark.createDataFrame([("9", "new")], "id string, title string"))
    assert store.replace_all({"materials": more}, folder) == 2
    after = store.load(spark, folder, ("materials", "tasks"))
    assert after["materials"].count() == 4 and after["tasks"].count() == 2  # what was not given stays
    assert store.load(spark, folder, ("materials",), back=1)["materials"].count() == 3  # the backup
    with pytest.raises(ValueError):
        store.replace_all({"other": more}, folder)


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    folder = str(tmp_path / "store")
    store.save({"materials": rows(spark, 3)}, folder)
    broken = rows(spark, 3).withColumn("title", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        store.save({"materials": broken}, folder)
    assert store.versions(spark, folder) == [1] and store.load(spark, folder, ("materials",))["materials"].count() == 3
    assert store.save({"materials": rows(spark, 5)}, folder) == 3  # the number of the failed one is not used again
    with pytest.raises(FileNotFoundError):
        store.load(spark, folder, ("tasks",))


def test_read_store_stops_on_damage_and_falls_back_to_the_backup(spark, tmp_path):
    schema = "id string, title string"
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    (tmp_path / "a.json.bak").write_text('{"id":"1","title":"old"}\n')
    assert [r.title for r in store.read_store(spark, str(good), schema).collect()] == ["old"]
    bad.write_text('{"id":"1","title":\n')
    with pytest.raises(Exception, match="FAILFAST|[Mm]alformed"):
        store.read_store(spark, str(bad), schema).collect()


def test_export(spark, tmp_path):
    store.export({"materials": rows(spark, 3)}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "materials")).count() == 3


def test_upsert_takes_one_change_for_each_key(spark):
    changes = spark.createDataFrame([("1", "a"), ("1", "b"), ("7", "c")], "id string, title string")
    got = {r.id: r.title for r in store.upsert(rows(spark, 3), changes).collect()}
    assert got == {"0": "row 0", "1": "b", "2": "row 2", "7": "c"}


def test_log_tail(spark, tmp_path):
    (tmp_path / "x.log").write_text("é" * 100 + "end", encoding="utf-8")
    assert sources.log_tail(spark, str(tmp_path / "x.log"), 10).first().text == "é" * 3 + "end"
    assert len(sources.log_tail(spark, str(tmp_path / "x.log")).first().text) == 103


def test_pages_of_keys(spark):
    objects = spark.createDataFrame([(f"parsed/{i:04d}",) for i in range(1203)] + [("raw/1",)], "name string")
    seen, after = [], ""
    while page := [r.name for r in catalog.list_page(objects, "parsed/", after).collect()]:
        assert page == sorted(page) and len(page) <= 500
        seen, after = seen + page, page[-1]
    assert seen == sorted(r.name for r in objects.collect() if r.name.startswith("parsed/"))


def test_migration_classes(spark):
    """Only a main file is expanded-only; an archive and its manifest are zip-source and nothing is removable."""
    files = ["parsed/1/full.md", "parsed/2/mineru-result.zip", "parsed/2/artifact-manifest.json", "parsed/3/mineru-result.zip", "parsed/3/full.md", "parsed/3/images/a.jpg", "parsed/3/x.json"]
    objects = spark.createDataFrame([(f, 10) for f in files], "name string, size long")
    owners = spark.createDataFrame([(str(i),) for i in range(1, 5)], "id string")
    entries = spark.createDataFrame([("3", "images/a.jpg")], "id string, entry string")
    got = {r.id: (r.kind, r.removable, r.removable_bytes, r.samples, r.safe) for r in catalog.migration(owners, objects, entries).collect()}
    assert got == {"1": ("expanded-only", 0, 0, "", False), "2": ("zip-source", 0, 0, "", False), "3": ("legacy-mixed", 2, 20, "images/a.jpg,x.json", False), "4": ("missing-artifacts", 0, 0, "", False)}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_metadata_merges(spark):
    old = {"a": 1, "mineruExecutionProfile": {"parseMethod": "auto", "maxPages": 9, "x": 1}}
    new = {"a": None, "b": [1], "mineruExecutionProfile": {"parseMethod": "", "maxPages": 3, "x": None, "ocrLanguage": None}}
    got = json.loads(one(spark, store.task_metadata(F.lit(json.dumps(old)), F.lit(json.dumps(new)))))
    assert got == {"a": None, "b": [1], "mineruExecutionProfile": {"parseMethod": "auto", "maxPages": 3, "x": None}}
    assert json.loads(one(spark, store.task_metadata(F.lit(None).cast("string"), F.lit('{"b":1}')))) == {"b": 1}
    assert len(store.RUN_KEYS) == 29 and json.loads(one(spark, store.new_run(F.lit('{"aiJobId":1,"x":{"aiJobId":2}}')))) == {"x": {"aiJobId": 2}}
    patched = store.patch_json(spark.createDataFrame([("1", "t", '{"a":1}')], "id string, title string, metadata string"), spark.createDataFrame([("1", '{"title":null,"metadata":null}'), ("2", "{}")], "id string, body string"))
    assert [tuple(r) for r in patched.collect()] == [("1", None, None)]


def test_active_task(spark):
    schema = "id string, engine string, state string, stage string, message string, metadata string"
    meta = '{"mineruTaskId":"m"}'
    run = lambda i: (i, "local-mineru", "running", "mineru-queued", None, meta)
    drift = ("d", "local-mineru", "pending", None, None, meta)
    cases = [([run("a"), drift], "a"), ([drift], "d"), ([run("a"), run("b")], None), ([], None)]
    for given, want in cases:
        assert tasks.active_task(spark.createDataFrame(given, schema)).first().active == want


def test_markdown_of(spark):
    cases = {'" x\\n"': "x", '{"results":{"k":{"mdcontent":" a "}}}': "a", '{"results":{},"text":"t"}': "t", '[{"text":" l "}]': "l", '{"data":[1," s "]}': "s", '{"md_content":"","data":{"markdown":"m"}}': "m", "{}": "", "not json": ""}
    df = spark.createDataFrame([(k,) for k in cases], "j string")
    assert {r.j: r.m for r in df.select("j", semistructured.markdown_of(F.col("j")).alias("m")).collect()} == cases


def test_two_writers_at_once(spark, tmp_path):
    """Each gets a version of its own, and both are whole."""
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "store")
    store.save({"materials": rows(spark, 1)}, folder)
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda n: store.save({"materials": rows(spark, n)}, folder), (2, 3, 4, 5)))
    assert sorted(numbers) == [2, 3, 4, 5] and store.versions(spark, folder) == [1, 2, 3, 4, 5]
    written = {n: k for n, k in zip(numbers, (2, 3, 4, 5), strict=True)}
    assert store.load(spark, folder, ("materials",))["materials"].count() == written[5]
