"""Catalog queries: filters, search, sorting, paging, facets, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import blank, json_map, text_or, truthy


def equals(rows: DataFrame, **wanted: str) -> DataFrame:
    """Equality filters; ``all`` is no filter."""
    for column, value in wanted.items():
        if value != "all":
            rows = rows.where(F.col(column) == value)
    return rows


def search(rows: DataFrame, query: str, columns: list[str], arrays: tuple[str, ...] = ()) -> DataFrame:
    """Rows in which a column or an element of an array contains the trimmed query, whatever the case; a blank query keeps all."""
    q = query.strip().lower()
    if not q:
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    for c in arrays:
        hit = hit | F.coalesce(F.exists(F.col(c), lambda t: F.lower(t).contains(q)), F.lit(False))
    return rows.where(hit)


def newest_first(rows: DataFrame) -> DataFrame:
    """By update time, creation time and id, all descending; missing times count as 0."""
    return rows.orderBy(F.coalesce("update_time", F.lit(0)).desc(), F.coalesce("create_time", F.lit(0)).desc(), F.col("id").desc())


def tasks_newest_first(rows: DataFrame) -> DataFrame:
    """By creation time, descending, and id; missing times come last."""
    return rows.orderBy(F.col("created_at").desc_nulls_last(), F.col("id"))


#: Sort keys of the material list.
ORDERS = {
    "newest": lambda: [F.coalesce("create_time", F.lit(0)).desc(), F.col("id")],
    "oldest": lambda: [F.coalesce("create_time", F.lit(0)), F.col("id")],
    "name": lambda: [F.collate(F.coalesce("title", F.lit("")), "zh"), F.col("id")],
    "size": lambda: [F.coalesce("size_bytes", F.lit(0)).desc(), F.col("id")],
}


#: Sort keys of the product list, each descending.
PRODUCT_ORDERS = {"newest": "created_at", "most used": "use_count", "best rated": "rating"}


def products_ordered(products: DataFrame, by: str) -> DataFrame:
    """In one of ``PRODUCT_ORDERS``, equal ones by id; missing values come last; an unknown name leaves the rows as they are."""
    return products.orderBy(F.col(PRODUCT_ORDERS[by]).desc_nulls_last(), "id") if by in PRODUCT_ORDERS else products


def ordered(rows: DataFrame, by: str) -> DataFrame:
    """In one of ``ORDERS``; an unknown name leaves the rows as they are."""
    return rows.orderBy(*ORDERS[by]()) if by in ORDERS else rows


def page(rows: DataFrame, number: int, size: int = 12, most: int = 1000) -> DataFrame:
    """One page of an ordered frame; numbers below 1 mean the first page, sizes are clamped."""
    size = max(1, min(most, size))
    return rows.offset((max(1, number) - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int = 12) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("pages"))


def counts_of(rows: DataFrame, column: str, values: tuple[str, ...], prefix: str = "n_") -> DataFrame:
    """The total and the number of rows with each of the given values, zero where there are none."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col(column) == v).alias(prefix + v.replace("-", "_")) for v in values))


def count_by(rows: DataFrame, key: Column, default: str) -> DataFrame:
    return rows.groupBy(text_or(key, default).alias("value")).agg(F.count("*").alias("n"))


def totals(rows: DataFrame, size: str, label: str) -> DataFrame:
    """Bytes and distinct non-empty labels of the given rows."""
    return rows.agg(F.coalesce(F.sum(F.coalesce(size, F.lit(0))), F.lit(0)).alias("bytes"), F.countDistinct(F.when(~blank(F.col(label)), F.col(label))).alias("labels"))


def facet(rows: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed non-empty values in Chinese collation order."""
    return rows.select(F.trim(column).alias("value")).where(~blank(F.col("value"))).distinct().orderBy(F.collate("value", "zh"), "value")


def last_rows(rows: DataFrame, order: str, tie: str, n: int, least: int = 1, most: int = 500) -> DataFrame:
    """The last ``n`` rows by ``order``, in rising order."""
    return rows.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(max(least, min(most, n))).orderBy(order, tie)


def storage(objects: DataFrame) -> DataFrame:
    """Objects and bytes per bucket and in total (bucket null)."""
    return objects.rollup("bucket").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


#: The files that a parse result is kept in.
ARCHIVE, MAIN_FILE, MANIFEST = "mineru-result.zip", "full.md", "artifact-manifest.json"
SAMPLES = 5


def migration(owners: DataFrame, objects: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Per owner (id): how its parse result is stored, what could be removed, and whether that is safe.

    ``objects`` (name, size) lie under ``parsed/<id>/``; ``entries`` (id, entry) are
    the files inside the archives. Only a result that is stored both ways has
    removable objects, and it is safe to remove them if the archive has them all.
    """
    prefix = F.substring_index("name", "/", 2)
    placed = objects.where(F.col("name").startswith("parsed/") & (F.size(F.split("name", "/")) > 2)).select(F.substring_index(prefix, "/", -1).alias("id"), F.expr("substring(name, length(substring_index(name, '/', 2)) + 2)").alias("file"), F.coalesce("size", F.lit(0)).alias("size"))
    placed = placed.withColumn("expanded", ~F.col("file").isin(ARCHIVE, MAIN_FILE, MANIFEST))
    first = placed.where("expanded").withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("file"))).where(F.col("nth") <= SAMPLES)
    samples = first.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("samples"))
    found = placed.groupBy("id").agg(
        F.bool_or(F.col("file") == ARCHIVE).alias("has_archive"), F.bool_or(F.col("file") == MAIN_FILE).alias("has_main"), F.count_if("expanded").alias("expanded"),
        F.coalesce(F.sum(F.when(F.col("expanded"), F.col("size"))), F.lit(0)).alias("bytes"),
    )
    rows = owners.select("id").join(found, "id", "left").join(samples, "id", "left")
    kind = F.when(F.col("has_archive").isNull(), "missing-artifacts").when(~F.col("has_archive"), "expanded-only").when(F.col("expanded") == 0, "zip-source").otherwise("legacy-mixed")
    rows = rows.withColumn("kind", kind)
    mixed = F.col("kind") == "legacy-mixed"
    rows = rows.select(
        "id", "kind", F.coalesce("has_main", F.lit(False)).alias("has_main"), F.coalesce("expanded", F.lit(0)).alias("expanded"), F.when(mixed, F.col("expanded")).otherwise(0).alias("removable"),
        F.when(mixed, F.col("bytes")).otherwise(0).alias("removable_bytes"), F.when(mixed, F.col("samples")).otherwise("").alias("samples"),
    )
    if entries is None:
        return rows
    lost = placed.where("expanded").join(entries.select("id", F.col("entry").alias("file")), ["id", "file"], "left_anti").groupBy("id").agg(F.count("*").alias("not_in_archive"))
    rows = rows.join(lost, "id", "left").withColumn("not_in_archive", F.when(mixed, F.coalesce("not_in_archive", F.lit(0))).otherwise(0))
    return rows.withColumn("safe", mixed & (F.col("not_in_archive") == 0))


#: Why a result is not safe to migrate, and how many missing files are named.
NOTHING_PARSED, NO_ARCHIVE = "No parsed artifacts found", "No mineru-result.zip found"
NAMED_MISSING = 3


def migration_details(owners: DataFrame, objects: DataFrame, entries: DataFrame) -> DataFrame:
    """Per owner (id) the whole dry run of a migration: kind, what is there, archive entries, whether ``full.md`` repeats the archive's, what could be removed with its first names, and why that is unsafe.

    ``objects`` (name, size) lie under ``parsed/<id>/``; ``entries`` (id, entry) are
    what the archives hold, folders end with a slash. Both meet once, by owner and
    file; the first names are of bounded number, so no owner's files are collected.
    """
    place = r"^parsed/([^/]+)/(.+)$"
    stored = objects.select(F.regexp_extract("name", place, 1).alias("id"), F.regexp_extract("name", place, 2).alias("file"), F.coalesce("size", F.lit(0)).alias("size")).where("id <> ''")
    sides = stored.select("id", "file", "size", F.lit(True).alias("s"), F.lit(False).alias("e")).unionByName(archive_files(entries).select("id", F.col("entry").alias("file"), F.lit(0).alias("size"), F.lit(False).alias("s"), F.lit(True).alias("e")))
    files = sides.groupBy("id", "file").agg(F.sum("size").alias("size"), F.bool_or("s").alias("stored"), F.bool_or("e").alias("inside"))
    expanded = F.col("stored") & ~F.col("file").isin(ARCHIVE, MAIN_FILE, MANIFEST)
    files = files.withColumns({"expanded": expanded, "lost": expanded & ~F.col("inside")})
    here = lambda name: F.coalesce(F.bool_or(F.col("stored") & (F.col("file") == name)), F.lit(False))
    found = files.groupBy("id").agg(
        F.bool_or("stored").alias("any"), here(ARCHIVE).alias("has_archive"), here(MAIN_FILE).alias("has_main"), F.count_if("expanded").alias("expanded"), F.count_if("inside").alias("entries"),
        F.coalesce(F.sum(F.when(F.col("expanded"), F.col("size"))), F.lit(0)).alias("bytes"), F.count_if("lost").alias("lost"),
    )

    def first(flag: str, n: int) -> DataFrame:
        rows = files.where(flag).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("file"))).where(F.col("nth") <= n)
        return rows.groupBy("id").agg(F.array_sort(F.collect_list("file")).alias(f"first_{flag}"))

    rows = owners.select("id").join(found, "id", "left").join(first("expanded", SAMPLES), "id", "left").join(first("lost", NAMED_MISSING), "id", "left")
    kind = F.when(~F.coalesce("any", F.lit(False)), "missing-artifacts").when(~F.col("has_archive"), "expanded-only").when(F.col("expanded") == 0, "zip-source").otherwise("legacy-mixed")
    mixed, gone = F.col("kind") == "legacy-mixed", F.col("kind") == "missing-artifacts"
    of_mixed = lambda c, name: F.when(mixed, F.col(c)).otherwise(0).alias(name)
    missing = F.concat(F.lit("Found "), F.col("lost").cast("string"), F.lit(" expanded objects missing in zip (e.g. "), F.array_join("first_lost", ", "), F.lit(")"))
    reason = F.when(gone, NOTHING_PARSED).when(F.col("kind") == "expanded-only", NO_ARCHIVE).when(mixed & (F.col("lost") > 0), missing)
    names = F.transform("first_expanded", lambda f: F.concat(F.lit("parsed/"), F.col("id"), F.lit("/"), f))
    return rows.withColumn("kind", kind).select(
        "id", "kind", F.coalesce("has_archive", F.lit(False)).alias("has_archive"), F.coalesce("has_main", F.lit(False)).alias("has_main"), F.when(gone, 0).otherwise(F.col("expanded")).alias("expanded"), of_mixed("entries", "archive_entries"),
        mixed.alias("main_repeats_archive"), of_mixed("expanded", "removable"), F.when(mixed, names).otherwise(F.array().cast("array<string>")).alias("samples"), of_mixed("bytes", "removable_bytes"), (mixed & (F.col("lost") == 0)).alias("safe"),
        F.array_compact(F.array(reason)).alias("reasons"),
    )


def migration_summary(rows: DataFrame) -> DataFrame:
    """Counts of each kind and what could safely be removed, from ``migration`` with archive entries."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    safe = lambda c: F.coalesce(F.sum(F.when(F.col("safe"), F.col(c))), F.lit(0))
    return rows.agg(F.count("*").alias("scanned"), n("legacy-mixed").alias("legacy_mixed"), n("zip-source").alias("zip_source"), n("expanded-only").alias("expanded_only"), safe("removable").alias("removable"), safe("removable_bytes").alias("removable_bytes"))


def persistable(materials: DataFrame) -> DataFrame:
    """Materials worth persisting, by their metadata: no local drafts, and none still processing without a stored original."""
    meta = lambda k: F.get_json_object("metadata", f"$.{k}")
    draft = F.coalesce(meta("localDraft") == "true", F.lit(False))
    stored = F.trim(F.coalesce(meta("objectName"), F.lit(""))) != ""
    return materials.where(~draft & (stored | F.coalesce(F.col("status") != "processing", F.lit(True))))


def suppressed(metadata: Column, asset: bool = False) -> Column:
    """Metadata without links that stored names replace; assets also lose previews that only live in a browser."""
    meta = lambda k: F.get_json_object(metadata, f"$.{k}")
    gone = [("fileUrl", F.coalesce(meta("provider") == "minio", F.lit(False)) & truthy(meta("objectName"))), ("markdownUrl", truthy(meta("markdownObjectName")))]
    if asset:
        gone.append(("previewUrl", F.coalesce(meta("previewUrl").startswith("blob:"), F.lit(False))))
    dropped = F.array_compact(F.array(*(F.when(cond, F.lit(k)) for k, cond in gone)))
    return json_map.kept(metadata, F.map_filter(json_map.entries(metadata), lambda k, _: ~F.array_contains(dropped, k)))


def lasting_preview(url: Column) -> Column:
    """A preview address, empty where it only lives in a browser."""
    return F.when(url.startswith("blob:"), "").otherwise(url)


#: The keys that settings and secrets may have.
SETTINGS_KEYS = ("aiConfig", "aiRuleSettings", "mineruConfig", "minioConfig", "uiPreferences", "systemConfig", "backupConfig", "initialized", "batchProcessing", "batchProcessingUpdatedAt", "serverBatchQueue")
SECRET_KEYS = ("aiKeys", "mineruKey", "minioCredentials", "aiConfig_apiKey", "mineru_apiKey", "minio_accessKey", "minio_secretKey")
PROVIDER_SECRET = "^aiProvider_.*_apiKey$"


def setting_allowed(key: Column) -> Column:
    return F.coalesce(key.isin(*SETTINGS_KEYS), F.lit(False))


def secret_allowed(key: Column) -> Column:
    return F.coalesce(key.isin(*SECRET_KEYS) | key.rlike(PROVIDER_SECRET), F.lit(False))


def workspace_counts(buckets: DataFrame) -> DataFrame:
    """The workspace's filters over (bucket): canceled counts as failed, queued as pending, what is under review or unknown as processing."""
    key = F.when(F.col("bucket").isin("failed", "canceled"), "failed").when(F.col("bucket") == "completed", "completed").when(F.col("bucket") == "queued", "pending").otherwise("processing")
    return counts_of(buckets.select(key.alias("filter")), "filter", ("pending", "processing", "failed", "completed"))


def statistics(materials: DataFrame, size: str, collections: dict[str, DataFrame]) -> DataFrame:
    """One row: bytes of all materials, and rows of each collection."""
    one = materials.agg(F.coalesce(F.sum(F.coalesce(size, F.lit(0))), F.lit(0)).alias("bytes"))
    for name, rows in collections.items():
        one = one.crossJoin(rows.agg(F.count("*").alias(name)))  # rows of one total each
    return one


#: What counts as running at a reset, and the names of stored results in the metadata.
RESET_STATES, RESET_STAGES = ("running", "ai-running", "result-store"), ("mineru-processing", "mineru-queued")
RESULT_NAMES = ("markdownObjectName", "zipObjectName")


def reset_counts(materials: DataFrame, tasks: DataFrame, events: DataFrame, jobs: DataFrame, details: DataFrame, orphans: DataFrame) -> DataFrame:
    """One row: what a reset would delete, by collection and store, orphan objects (bucket, size) with their buckets, canceled tasks in another state, and running tasks.

    A material or task with a stored result counts once, whether it names one or two files.
    """
    meta = lambda k: truthy(F.get_json_object("metadata", f"$.{k}"))
    result = meta(RESULT_NAMES[0]) | meta(RESULT_NAMES[1])
    canceled = meta("canceledAt")
    running = ~canceled & (F.coalesce(F.col("state").isin(*RESET_STATES), F.lit(False)) | F.coalesce(F.col("stage").isin(*RESET_STAGES), F.lit(False)))
    one = materials.agg(F.count("*").alias("materials"), F.count_if(meta("objectName")).alias("originals"), F.count_if(result).alias("parsed_of_materials"))
    one = one.crossJoin(tasks.agg(F.count("*").alias("tasks"), F.count_if(result).alias("parsed_of_tasks"), F.count_if(canceled & F.coalesce(F.col("state") != "canceled", F.lit(True))).alias("drifted"), F.count_if(running).alias("running")))
    for name, rows in (("events", events), ("jobs", jobs), ("asset_details", details)):
        one = one.crossJoin(rows.agg(F.count("*").alias(name)))
    lost = orphans.agg(F.count("*").alias("orphans"), F.coalesce(F.sum("size"), F.lit(0)).alias("orphan_bytes"), F.array_join(F.array_sort(F.collect_set("bucket")), ",").alias("orphan_buckets"))
    one = one.crossJoin(lost)  # rows of totals
    return one.select("materials", "tasks", "events", "jobs", "asset_details", "originals", (F.col("parsed_of_materials") + F.col("parsed_of_tasks")).alias("parsed"), "orphans", "orphan_bytes", "orphan_buckets", "drifted", "running")


def list_page(objects: DataFrame, prefix: str, after: str = "", size: int = 500) -> DataFrame:
    """One page of the keys under a prefix in rising order, those after the last key of the page before."""
    return objects.where(F.col("name").startswith(prefix) & (F.col("name") > after)).orderBy("name").limit(size)


def without_list(rows: DataFrame, heavy: str, count: str) -> DataFrame:
    """A heavy array replaced by its length; null counts as empty."""
    return rows.withColumn(count, F.greatest(F.size(heavy), F.lit(0))).drop(heavy)


def under_prefix(name: Column, top: str, owner: Column) -> Column:
    """Whether a key lies in its owner's folder."""
    return name.startswith(F.concat(F.lit(f"{top}/"), owner, F.lit("/")))


def archive_files(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Entries of archives without the folders."""
    return entries.where(~F.col(entry).endswith("/"))


def unpacked_check(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """Per owner: expanded objects that its archive lacks, entries that were never expanded, and whether removing the expanded ones is safe. Both have (id, file)."""
    sides = objects.select("id", "file", F.lit(1).alias("o"), F.lit(0).alias("e")).unionByName(entries.select("id", "file", F.lit(0).alias("o"), F.lit(1).alias("e")))
    both = sides.groupBy("id", "file").agg(F.max("o").alias("o"), F.max("e").alias("e"))
    rows = both.groupBy("id").agg(F.count_if((F.col("o") == 1) & (F.col("e") == 0)).alias("only_objects"), F.count_if((F.col("o") == 0) & (F.col("e") == 1)).alias("only_entries"))
    return rows.withColumn("safe", F.col("only_objects") == 0)


def bad_paths(materials: DataFrame) -> DataFrame:
    """Materials (id) with whether their stored original, or the parsed file that they name, lies outside their own folder."""
    outside = lambda c, top: ~under_prefix(F.col(c), top, F.col("id"))
    return materials.select("id", outside("object_name", "originals").alias("bad_original"), (~blank(F.col("markdown_object_name")) & outside("markdown_object_name", "parsed")).alias("bad_parsed"))


def manifest(objects: DataFrame, owner: str = "owner") -> DataFrame:
    """Per owner the list of its files (nr, name, size) as one text, in order; an owner has the files of one result."""
    return objects.groupBy(owner).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "nr", "name", "size"))), "|").alias("manifest"))


def first_provider(providers: DataFrame, enabled: Column, priority: Column, name: str, last: int = 999) -> DataFrame:
    """The enabled provider of the lowest priority, those without one at ``last``, then by name; no row if none is enabled."""
    return providers.where(enabled).orderBy(F.coalesce(priority, F.lit(last)), name).limit(1)
