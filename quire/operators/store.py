"""Keyed collections: every change is a pure function from a table and a change set to the next table."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import blank, json_map, truthy
from quire.functions.skew import lookup

COLLECTIONS = ("materials", "assetDetails", "processTasks", "tasks", "parseTasks", "aiMetadataJobs", "taskEvents", "products", "flexibleTags", "aiRules", "settings")
#: Profile keys that blanks do not overwrite.
PROFILE = "mineruExecutionProfile"
PROTECTED = ("backendEffective", "backendEffectiveReason", "backendRequested", "parseMethod", "enableOcr", "enableFormula", "enableTable", "ocrLanguage", "maxPages")

#: What a new parse run clears from the metadata.
RUN_KEYS = (
    "mineruTaskId", "mineruStatus", "mineruSubmittedAt", "mineruQueuedAhead", "mineruStartedAt", "mineruLastStatusAt", "mineruObservedProgress", "localTimeoutOccurred", "localTimeoutAt",
    "_synthetic_warn", "_synthetic_warn_msg", "submitRetries", "lastSubmitError", "recoveredFromMisjudgedFailed", "previousState", "previousErrorMessage", "recoveredAt", "markdownObjectName",
    "parsedPrefix", "parsedFilesCount", "artifactManifestObjectName", "zipObjectName", "artifactIncomplete", "parsedAt", "aiJobId", "emptyMarkdownRetryAttempted", "emptyMarkdownRetryMineruTaskId",
    "emptyMarkdownRetryError", "emptyMarkdownRetryProfile",
)
RECOVERED_STATES = ("completed", "review-pending", "ai-pending", "running")
RUNNING_STATES = ("running", "mineru-processing", "ai-running")
_CLAIM, _DONE = "_CLAIMED", "_COMPLETE"


def _in_order(changes: DataFrame, order: str | None) -> DataFrame:
    """Changes with the place of each in ``order_``: a column of theirs, or the order in which Spark reads them."""
    return changes.withColumn("order_", F.col(order) if order else F.monotonically_increasing_id())


def upsert(rows: DataFrame, changes: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows of ``changes`` replace or join those of ``rows``; of several changes to a key the last counts."""
    columns = [c for c in changes.columns if c != order or c in rows.columns]
    last = _in_order(changes, order).groupBy(key).agg(F.max_by(F.struct(*columns), "order_").alias("_row")).select("_row.*")
    return rows.join(last.select(key), key, "left_anti").unionByName(last)


def patch(rows: DataFrame, changes: DataFrame, columns: list[str], key: str = "id", insert: bool = False, order: str | None = None) -> DataFrame:
    """Non-null values of ``changes`` overwrite, of several the last; other columns stay; unknown keys are ignored, or added with ``insert``."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("order_"))).alias(f"_new_{c}")
    new = _in_order(changes, order).groupBy(key).agg(*map(last, columns))
    joined = rows.join(new, key, "full" if insert else "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def bulk_patch(rows: DataFrame, ids: DataFrame, values: dict[str, Column], key: str = "id") -> DataFrame:
    """The same values for every listed id; the key itself cannot change."""
    listed = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    return rows.join(listed, key, "left").select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values and c != key else F.col(c) for c in rows.columns))


def protected(old: Column, new: Column) -> Column:
    """A value that a null or blank does not overwrite."""
    return F.when(blank(new), old).otherwise(new)


def delete(rows: DataFrame, ids: DataFrame, key: str = "id", foreign: str | None = None) -> DataFrame:
    """Rows whose key, or foreign key, is not listed."""
    return rows.join(ids.select(F.col(key).alias(foreign or key)), foreign or key, "left_anti")


def insert_missing(rows: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Rows to add: those whose key is not there yet."""
    return incoming.join(rows.select(key), key, "left_anti")


def insert_unless_active(incoming: DataFrame, tasks: DataFrame, active: tuple[str, ...], key: str = "id", owner: str = "material_id", at: str = "created_at") -> DataFrame:
    """``incoming`` with whether it conflicts: at most one task of an owner is active.

    Tasks are taken in the order of (``at``, key), null times first. A new task
    conflicts if its owner has an active task in ``tasks`` or if an active one came
    earlier in the batch, which is the owner's first, as an earlier one could only be
    inactive. What overwrites a task that is there, or that came before under the same
    key, never conflicts, nor does a task without an owner. Firsts are minima per
    owner and key; an owner with many rows is spread.
    """
    is_active = F.col("state").isin(*active)
    ordered = incoming.withColumn("place_", F.struct(F.col(at), F.col(key))).withColumn("owner_", F.when(~blank(F.col(owner)), F.col(owner)))
    busy = tasks.where(is_active & ~blank(F.col(owner))).select(F.col(owner).alias("owner_")).distinct().withColumn("busy_", F.lit(True))
    owners = ordered.where("owner_ is not null").groupBy("owner_").agg(F.min(F.when(is_active, F.col("place_"))).alias("winner_"), F.count("*").alias("rows_")).join(busy, "owner_", "left")
    there = tasks.select(key).distinct().withColumn("there_", F.lit(True))
    judged = lookup(ordered, owners, "owner_", F.col(key))
    late = F.coalesce(F.col("busy_"), F.lit(False)) | F.coalesce(F.col("place_") > F.col("winner_"), F.lit(False))
    judged = judged.withColumn("late_", F.col("owner_").isNotNull() & late)
    first = judged.groupBy(key).agg(F.min_by("late_", F.struct("place_", "late_")).alias("refused_"), F.count("*").alias("rows_")).join(there, key, "left")
    found = lookup(judged, first, key, F.xxhash64(*incoming.columns))
    return found.select(*incoming.columns, (F.coalesce("refused_", F.lit(False)) & F.col("there_").isNull()).alias("conflict"))


def _bodies(changes: DataFrame, columns: list[str], key: str, body: str, metadata: str, insert: bool, order: str | None) -> DataFrame:
    """All bodies of a key as one, applied one after another: (key, ``_new_<column>``, replaced, added, touched), values as variants.

    ``_new_<column>`` is the last value that a body gives a column (null if none does; a
    JSON null is a value). ``replaced`` is what the last value of the metadata that is no
    object puts in its place (null if none does, as with ``insert``), ``added`` the
    metadata keys that came after it as a map, and ``touched`` whether an object did.
    Values are told apart before they are grouped, so a key with many changes is summed
    up like any other. A body is read once, into rows (level, name, value) that need no
    order of their own.
    """
    no_keys = F.create_map(F.lit(""), F.lit(None).cast("variant"))  # one row for a body without keys: no value in JSON is null itself
    read = _in_order(changes, order).select(key, "order_", json_map.entries(F.col(body)).alias("_map"))
    top = read.select(key, "order_", F.explode_outer(F.when(F.size("_map") == 0, no_keys).otherwise(F.col("_map"))).alias("_top", "_value"))
    of_metadata = F.col("_top") == metadata
    # what is no object is no map
    both = top.select(key, "order_", "_top", "_value", F.explode_outer(F.when(of_metadata, F.try_variant_get("_value", "$", json_map.MAP))).alias("_inner", "_inside"))
    level = (
        F.when(F.col("_inner").isNotNull(), "added")
        .when(F.col("_value").isNull(), F.when(F.col("_top").isNotNull(), "changed"))
        .when(of_metadata, F.when(F.schema_of_variant("_value").startswith("OBJECT"), "object").otherwise("changed" if insert else "replaced"))
        .when(F.col("_top").isin(*columns), "given")
        .otherwise("changed")
    )
    flat = both.select(key, "order_", level.alias("level"), "_inner", "_top", F.coalesce("_inside", "_value").alias("value")).where("level is not null")
    told = flat.select(key, "order_", "level", F.when(F.col("level") == "added", F.col("_inner")).when(F.col("level") == "given", F.col("_top")).alias("name"), F.when(F.col("level").isin("given", "added", "replaced"), F.col("value")).alias("value"))
    last = told.groupBy(key, "level", "name").agg(F.max_by("value", "order_").alias("value"), F.max("order_").alias("order_"))
    of = lambda is_it, c: F.when(is_it, F.col(c))
    at = lambda *levels: F.col("level").isin(*levels)
    only = lambda is_it: F.first(of(is_it, "value"), ignorenulls=True)
    whole = last.groupBy(key).agg(
        *(only(at("given") & (F.col("name") == c)).alias(f"_new_{c}") for c in columns),
        F.max(of(at("replaced"), "order_")).alias("_reset"), only(at("replaced")).alias("replaced"), F.max(of(at("added", "object"), "order_")).alias("_object"),
        F.collect_list(F.when(at("added"), F.struct(F.struct("name", "value").alias("entry"), "order_"))).alias("_added"),
    )
    late = lambda at: F.col("_reset").isNull() | (at > F.col("_reset"))
    since = F.when(F.col("_reset").isNull(), F.col("_added")).otherwise(F.filter("_added", lambda x: late(x["order_"])))
    return whole.select(key, F.lit(True).alias("changed_"), *(f"_new_{c}" for c in columns), F.map_from_entries(since["entry"]).alias("added"), "replaced", (F.col("_object").isNotNull() & late(F.col("_object"))).alias("touched"))


def patch_json(rows: DataFrame, changes: DataFrame, key: str = "id", body: str = "body", metadata: str = "metadata", insert: bool = False, order: str | None = None) -> DataFrame:
    """JSON patches (key, body): a top-level key of the body overwrites the text column of its name, also with null.

    A metadata object is merged one level deep, any other value replaces the metadata
    whole; with ``insert`` unknown keys make new rows and the metadata stays an object
    whatever the body has. Several bodies of a key are applied one after another, in
    ``order``. Nothing is lost to what cannot be read: such a body changes nothing, and
    metadata that cannot be read keeps its text; ``unreadable`` lists both.
    """
    columns = [c for c in rows.columns if c not in (key, metadata)]
    joined = rows.join(_bodies(changes, columns, key, body, metadata, insert, order), key, "full" if insert else "left")
    base = F.when(F.col("replaced").isNotNull(), F.from_json(F.lit("{}"), json_map.MAP)).otherwise(json_map.entries(F.col(metadata)))
    as_text = lambda v: F.try_variant_get(v, "$", "string")
    changed = F.when(F.col("touched"), json_map.kept(F.col(metadata), json_map.over(base, F.col("added")))).when(F.col("replaced").isNotNull(), as_text(F.col("replaced"))).otherwise(F.col(metadata))
    if insert:
        changed = F.coalesce(changed, F.when(F.col("changed_"), "{}"))
    pick = lambda c: F.when(F.col(f"_new_{c}").isNotNull(), as_text(F.col(f"_new_{c}"))).otherwise(F.col(c))
    return joined.select(*(F.col(c) if c == key else changed.alias(c) if c == metadata else pick(c).alias(c) for c in rows.columns))


def unreadable(rows: DataFrame, changes: DataFrame, key: str = "id", body: str = "body", metadata: str = "metadata") -> DataFrame:
    """(key, what, text) of the bodies and, for keys that changes name, the metadata that ``patch_json`` cannot read."""
    bodies = changes.where(~json_map.readable(F.col(body))).select(key, F.lit("body").alias("what"), F.col(body).alias("text"))
    named = rows.where(~json_map.readable(F.col(metadata))).join(changes.select(key).distinct(), key, "left_semi")
    return bodies.unionByName(named.select(key, F.lit("metadata").alias("what"), F.col(metadata).alias("text")))


def task_metadata(old: Column, new: Column) -> Column:
    """Task metadata merged one level deep; inside the execution profile blanks do not overwrite the protected keys.

    Where either cannot be read the old text stays; a profile that is no object is a value like any other.
    """
    empty = lambda v: blank(F.try_variant_get(v, "$", "string"))
    inner = lambda m: F.when(F.schema_of_variant(F.element_at(m, PROFILE)).startswith("OBJECT"), F.to_json(F.element_at(m, PROFILE)))

    def profile(was: Column, now: Column) -> Column:
        given = F.map_filter(json_map.entries(now), lambda k, v: ~(k.isin(*PROTECTED) & empty(v)))
        return F.parse_json(json_map.text(json_map.over(json_map.entries(was), given)))

    def merged(m: Column, n: Column) -> Column:
        both = json_map.let(F.struct(inner(m).alias("was"), inner(n).alias("now")), lambda p: F.when(p["was"].isNotNull() & p["now"].isNotNull(), F.create_map(F.lit(PROFILE), profile(p["was"], p["now"]))))
        return json_map.let(both, lambda p: F.when(p.isNull(), json_map.over(m, n)).otherwise(json_map.over(json_map.over(m, n), p)))

    return json_map.kept(old, json_map.let(json_map.entries(old), lambda m: json_map.let(json_map.entries(new), lambda n: merged(m, n))))


def new_run(metadata: Column, extra: Column | None = None) -> Column:
    """Metadata at the start of a new parse run: the run's keys go, those of ``extra`` come."""
    return json_map.without(metadata, RUN_KEYS, extra)


def recovered(tasks: DataFrame) -> DataFrame:
    """Left-over errors of tasks that recovered from a wrong failure move into the metadata, unless an earlier error is kept there; metadata that cannot be read leaves both as they are."""
    flag = F.get_json_object("metadata", "$.recoveredFromMisjudgedFailed") == "true"
    hit = F.coalesce(F.col("state").isin(*RECOVERED_STATES) & flag & (F.trim("error_message") != "") & json_map.readable(F.col("metadata")), F.lit(False))
    earlier = F.get_json_object("metadata", "$.previousErrorMessage")
    keep = F.when(F.trim(earlier) != "", earlier).otherwise(F.col("error_message"))
    moved = json_map.merged(F.col("metadata"), F.to_json(F.create_map(F.lit("previousErrorMessage"), keep)))
    marked = tasks.withColumn("_hit", hit).withColumn("metadata", F.when(F.col("_hit"), moved).otherwise(F.col("metadata")))  # the message moves before it is cleared
    return marked.withColumn("error_message", F.when(F.col("_hit"), "").otherwise(F.col("error_message"))).drop("_hit")


def residue(materials: DataFrame) -> DataFrame:
    """Completed materials that still show a running parse, and the stage they go to."""
    stage = F.when(F.col("ai_status") == "analyzed", "completed").when(F.col("ai_status") == "failed", "ai-failed").otherwise("mineru-completed")
    return materials.where("status = 'completed' and mineru_status = 'processing'").select("id", stage.alias("stage"))


def with_tags(tags: Column, more: tuple[str, ...]) -> Column:
    """An array of tags with others behind it, each once, in order."""
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, more)))


def ui_cascade(ids: DataFrame, tasks: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks and products (source, lineage) that stay when materials (numeric id) go: tasks without a numeric material and products neither made from one nor descended from one."""
    gone = ids.select(F.col("id").try_cast("bigint").alias("gone")).where("gone is not null").distinct()
    kept = tasks.join(gone, F.col("material_id").try_cast("bigint") == F.col("gone"), "left_anti")
    source = F.regexp_replace(F.coalesce("source", F.lit("")), "^material:", "").try_cast("bigint")
    made = products.join(gone, source == F.col("gone"), "left_anti")
    descended = made.select("id", F.explode("lineage").alias("parent")).join(gone, F.col("parent").try_cast("bigint") == F.col("gone"), "left_semi").select("id")
    return kept, made.join(descended, "id", "left_anti")


def related(ids: DataFrame, tasks: DataFrame, jobs: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """Tasks of the materials, jobs and events of these tasks."""
    own = tasks.join(ids.select(F.col("id").alias("material_id")).distinct(), "material_id", "left_semi")
    linked = own.select(F.col("id").alias("parse_task_id"))
    return {"tasks": own, "jobs": jobs.join(linked, "parse_task_id", "left_semi"), "events": events.join(linked.withColumnRenamed("parse_task_id", "task_id"), "task_id", "left_semi")}


def cascade_summary(ids: DataFrame, materials: DataFrame, tasks: DataFrame, jobs: DataFrame, events: DataFrame, objects: DataFrame, force: bool = False) -> DataFrame:
    """One row: what deleting the materials takes along in every collection and bucket, and whether running tasks block it.

    A stored original counts once for its name in the material and once for its
    place under the material's prefix.
    """
    own = materials.join(ids.select("id").distinct(), "id", "left_semi")
    more = related(ids, tasks, jobs, events)
    parts = F.split("name", "/")
    placed = objects.select("bucket", F.get(parts, F.lit(0)).alias("top"), F.get(parts, F.lit(1)).alias("id"), (F.size(parts) > 2).alias("inside")).where("inside").join(own.select("id"), "id", "left_semi")
    n = lambda df, **named: df.agg(*(c.alias(k) for k, c in named.items()))
    one = n(own, materials=F.count("*"), asset_details=F.count("*"), named=F.count_if(truthy(F.col("object_name"))))
    one = one.crossJoin(n(more["tasks"], tasks=F.count("*"), running_tasks=F.count_if(F.col("state").isin(*RUNNING_STATES))))
    one = one.crossJoin(n(more["jobs"], jobs=F.count("*"))).crossJoin(n(more["events"], events=F.count("*")))
    stored = n(placed, originals=F.count_if((F.col("bucket") == "raw") & (F.col("top") == "originals")), parsed_objects=F.count_if((F.col("bucket") == "parsed") & (F.col("top") == "parsed")))
    one = one.crossJoin(stored)  # five rows of totals
    return one.select("materials", "asset_details", "tasks", "jobs", "events", (F.col("named") + F.col("originals")).alias("original_objects"), "parsed_objects", "running_tasks", ((F.col("running_tasks") > 0) & ~F.lit(force)).alias("blocked"))


def cascade(ids: DataFrame, tasks: DataFrame, jobs: DataFrame, running: tuple[str, ...]) -> DataFrame:
    """What deleting these materials would take along, and whether running tasks block it."""
    own = tasks.join(ids.select(F.col("id").alias("material_id")), "material_id", "left_semi")
    linked = jobs.join(own.select(F.col("id").alias("parse_task_id")), "parse_task_id", "left_semi")
    one = ids.agg(F.count("*").alias("materials")).crossJoin(own.agg(F.count("*").alias("tasks"), F.count_if(F.col("state").isin(*running)).alias("running"))).crossJoin(linked.agg(F.count("*").alias("jobs")))
    return one.withColumn("blocked", F.col("running") > 0)  # three rows of totals


def changed(rows: DataFrame, previous: DataFrame, key: str = "id") -> DataFrame:
    """Keys to write (new, or with another fingerprint) and to delete since the previous version."""
    print_of = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*(c for c in df.columns if c != key))), 256).alias("print"))
    both = print_of(rows).join(print_of(previous).withColumnRenamed("print", "before"), key, "full")
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("print").isNull(), "delete").when(F.col("print") != F.col("before"), "update")
    return both.select(key, kind.alias("change")).where("change is not null")


def without_keys(json_map: Column, gone: tuple[str, ...], extra: Column) -> Column:
    """A map without some keys, with others added."""
    return F.map_concat(F.map_filter(json_map, lambda k, _: ~k.isin(*gone)), extra)


def _files(spark, folder: str):
    """The file system of a folder, and its path class."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark, folder: str, name: str | None = None) -> list[int]:
    """Numbers of the complete versions in ``folder``, of those that hold the collection ``name`` if given; rising."""
    files, path = _files(spark, folder)
    if not files.exists(path(folder)):
        return []
    found = [s.getPath().getName() for s in files.listStatus(path(folder))]
    numbers = sorted(int(f[1:]) for f in found if f[:1] == "v" and f[1:].isdigit() and files.exists(path(f"{folder}/{f}/{_DONE}")))
    return [v for v in numbers if name is None or files.exists(path(f"{folder}/v{v:08d}/{name}"))]


def _claimed(spark, folder: str) -> int:
    """A number for a version that no other writer has: a file that only one of them can create."""
    files, path = _files(spark, folder)
    started = [s.getPath().getName() for s in files.listStatus(path(folder))] if files.exists(path(folder)) else []
    number = 1 + max((int(f[1:]) for f in started if f[:1] == "v" and f[1:].isdigit()), default=0)
    while True:
        try:
            files.create(path(f"{folder}/v{number:08d}/{_CLAIM}"), False).close()
            return number
        except Py4JJavaError as taken:
            if not files.exists(path(f"{folder}/v{number:08d}/{_CLAIM}")):
                raise taken
            number += 1


def save(collections: dict[str, DataFrame], folder: str) -> int:
    """The collections as the next version of the store; its number.

    A version is written beside the others and counts once its marker is there,
    so what is being read is never overwritten, a failed write changes nothing and
    the version before is the backup. Writers that save at the same time get numbers
    of their own; the higher one is the newer.
    """
    spark = next(iter(collections.values())).sparkSession
    files, path = _files(spark, folder)
    number = _claimed(spark, folder)
    for name, rows in collections.items():
        rows.write.mode("error").parquet(f"{folder}/v{number:08d}/{name}")
    files.create(path(f"{folder}/v{number:08d}/{_DONE}"), False).close()
    return number


def load(spark, folder: str, names: tuple[str, ...] = COLLECTIONS, back: int = 0) -> dict[str, DataFrame]:
    """Each collection from the newest complete version that holds it, or from the one ``back`` versions before."""
    out = {}
    for name in names:
        have = versions(spark, folder, name)
        if len(have) <= back:
            raise FileNotFoundError(f"{name} has {len(have)} complete versions in {folder}")
        out[name] = spark.read.parquet(f"{folder}/v{have[-1 - back]:08d}/{name}")
    return out


def export(collections: dict[str, DataFrame], folder: str) -> None:
    """Every collection as JSON lines in a folder of its own."""
    for name, rows in collections.items():
        rows.write.mode("error").json(f"{folder}/{name}")


def totals(collections: dict[str, DataFrame]) -> DataFrame:
    """Rows per collection."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(n).alias("collection"), "n") for n, df in collections.items()))


def read_store(spark, path: str, schema) -> DataFrame:
    """A collection from JSON lines; a damaged file stops the job instead of losing rows, a missing one falls back to its ``.bak``."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path + ".bak")


def replace_all(collections: dict[str, DataFrame], folder: str) -> int:
    """Import: the given collections are replaced, the others stay; the versions before are the backup."""
    unknown = set(collections) - set(COLLECTIONS)
    if unknown:
        raise ValueError(f"unknown collections: {sorted(unknown)}")
    return save(collections, folder)
