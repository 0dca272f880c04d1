"""Upkeep of tasks, files and content: duplicates, orphans, deletion, retention, workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import clean_file_name
from ..plans.cut import cut, spread


def purged(purge: DataFrame, tasks: DataFrame, contributed: DataFrame, entries: DataFrame, vectors: DataFrame, lineages: DataFrame, branches: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """What goes with tasks (task_id) whose results are taken back, all at once: ids of people, entries, vectors, lineages and branches.

    People go if no document of another task contributed them (contributed: person_id, task_id), entries
    if they are of such a task, vectors with their entry. A lineage that such a task refers to goes, with
    its branches, if no other task does, none of its entries is left, and nobody who is left is a member
    (members: person_id, lineage_id, through branches too).
    """
    gone = purge.select("task_id").distinct()
    # people of such tasks alone: one pass over contributions, which become a row for each person at once
    marked = contributed.select("person_id", "task_id").join(gone.withColumn("_gone", F.lit(True)), "task_id", "left")
    each = marked.groupBy("person_id").agg(F.max("_gone").alias("named"), F.max(F.col("_gone").isNull()).alias("kept"))
    people = cut(each.where("named and not kept").select("person_id"))
    own = entries.join(gone, "task_id", "left_semi").select("entry_id").distinct()
    left = entries.join(gone, "task_id", "left_anti")
    named = tasks.join(gone, "task_id", "left_semi").where("lineage_id is not null").select("lineage_id").distinct()
    # a lineage may have any number of tasks, entries and members: each names it once before all of them meet in one task
    named = named.join(tasks.join(gone, "task_id", "left_anti").select("lineage_id").distinct(), "lineage_id", "left_anti")
    named = named.join(left.select("lineage_id").distinct(), "lineage_id", "left_anti")
    named = named.join(members.join(people, "person_id", "left_anti").select("lineage_id").distinct(), "lineage_id", "left_anti")
    empty = cut(named.join(lineages.select("lineage_id").distinct(), "lineage_id", "left_semi"))
    return {
        "persons": people,
        "entries": own,
        "vectors": vectors.join(own, "entry_id", "left_semi").select("entry_id"),
        "lineages": empty,
        "branches": branches.join(empty, "lineage_id", "left_semi").select("branch_id"),
    }


def upsert(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """old with new's rows by key: present ones get new's columns where those are not null; state says what happened."""
    n = new.select(*key, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("in_new"))
    o = old.select(*key, *columns, F.lit(True).alias("in_old"))
    both = o.join(n, key, "full")
    state = F.when(F.col("in_new").isNull(), "kept").when(F.col("in_old").isNull(), "inserted").otherwise("updated")
    return both.select(*key, *(F.coalesce(f"new_{c}", c).alias(c) for c in columns), state.alias("state"))


def put_settings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Settings (key, value) after new ones (key, value, at): the latest of a key counts, null takes the place of an old value too."""
    last = new.groupBy("key").agg(F.max_by(F.struct("value"), "at").alias("n"))
    return old.select("key", "value").join(last, "key", "full").select("key", F.when(F.col("n").isNotNull(), F.col("n.value")).otherwise(F.col("value")).alias("value"))


def replace_tasks(mirror: DataFrame, fresh: DataFrame) -> DataFrame:
    """Page mirror after rebuilding fresh's tasks: all their old rows go, fresh's come, one for each page."""
    return mirror.join(fresh.select("task_id").distinct(), "task_id", "left_anti").unionByName(fresh.select(*mirror.columns).dropDuplicates(["task_id", "page_no"]))


def duplicate_files(tasks: DataFrame) -> DataFrame:
    """(task_id, duplicate_of): the newest other task that is not failed and has the same digest.

    Rows without a digest match on equal size and file name among rows without one.
    """
    live = tasks.where("status <> 'failed'")
    key = F.coalesce(F.concat(F.lit("d|"), "file_sha256"), F.concat(F.lit("n|"), F.col("file_size").cast("string"), F.lit("|"), "file_name"))
    w = W.partitionBy("key").orderBy(F.desc("created_at"), F.desc("task_id"))
    first = live.withColumn("key", key).withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("key").agg(F.min_by("task_id", "r").alias("newest"), F.max_by("task_id", "r").alias("next"))
    out = tasks.withColumn("key", key).join(first, "key").withColumn("duplicate_of", F.when(F.col("newest") != F.col("task_id"), F.col("newest")).when(F.col("next") != F.col("task_id"), F.col("next")))
    return out.where("duplicate_of is not null").select("task_id", "duplicate_of")


def tasks_by_name(names: DataFrame, tasks: DataFrame) -> DataFrame:
    """(name, r, task_id, status, file_size, created_at): tasks that have a file of each given name, newest first, failed ones aside.

    Names (file_name) are cleaned as those of files are, and each is asked once; one without a task has a
    row of nulls. tasks has (task_id, status, file_path, file_size, created_at).
    """
    asked = names.select(clean_file_name(F.col("file_name")).alias("name")).where("name <> ''").distinct()
    live = tasks.where(F.col("status").isin("pending", "running", "done", "paused"))
    own = live.select(F.element_at(F.split("file_path", "/"), -1).alias("name"), "task_id", "status", "file_size", "created_at").join(asked, "name", "left_semi")
    ranked = own.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy(F.desc("created_at"), F.desc("task_id"))))
    return asked.join(ranked, "name", "left").select("name", "r", "task_id", "status", "file_size", "created_at")


def orphans(files: DataFrame, objects: DataFrame, tasks: DataFrame, entries: DataFrame, lineages: DataFrame) -> DataFrame:
    """(key, kind, name, path, size, files, mtime) of what nothing refers to any more.

    files and objects are listings (path, bytes, mtime), of the upload folder and of the store.
    local_dir: a folder below tasks/ of a task that there is not; minio_prefix: the same below scans/ in
    the store, with the time of the last object by name; loose_file: a file in the upload folder itself;
    orphan_content: entries of a lineage that there is not, whose number counts as files and which take no
    bytes. Entries without a lineage are no orphans.
    """
    known = tasks.select(F.col("task_id").cast("string").alias("name")).distinct()
    parts = F.split("path", "/")
    rows = files.count() + objects.count()  # there are as many folders at most

    def folders(listing: DataFrame, top: str, kind: str, mark: str, mtime: Column) -> DataFrame:
        own = listing.withColumn("name", parts[1]).where((parts[0] == top) & (F.size(parts) > 2) & (F.col("name") != ""))
        own = own.groupBy("name").agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("size"), F.count("*").alias("files"), mtime.cast("string").alias("mtime"))
        own = spread(own, rows, "name").join(spread(known, rows, "name"), "name", "left_anti")
        return own.select(F.concat(F.lit(mark), "name").alias("key"), F.lit(kind).alias("kind"), "name", F.concat(F.lit(f"{top}/"), "name", F.lit("/" if kind == "minio_prefix" else "")).alias("path"), "size", "files", "mtime")

    local = folders(files, "tasks", "local_dir", "local:", F.max("mtime"))
    stored = folders(objects, "scans", "minio_prefix", "minio:", F.max_by("mtime", F.when(F.col("mtime").isNotNull(), F.col("path"))))
    loose = files.where(~F.contains("path", F.lit("/"))).select(F.concat(F.lit("file:"), "path").alias("key"), F.lit("loose_file").alias("kind"), F.col("path").alias("name"), "path", F.col("bytes").cast("long").alias("size"), F.lit(1).cast("long").alias("files"), F.col("mtime").cast("string").alias("mtime"))
    gone = entries.where(F.col("lineage_id").isNotNull()).withColumn("name", F.col("lineage_id").cast("string")).where("name <> ''").groupBy("name", "lineage_id").agg(F.count("*").alias("files")).join(lineages.select("lineage_id"), "lineage_id", "left_anti")
    content = gone.select(F.concat(F.lit("content:"), "name").alias("key"), F.lit("orphan_content").alias("kind"), "name", F.concat(F.lit("lineage_id="), "name").alias("path"), F.lit(0).cast("long").alias("size"), "files", F.lit("").alias("mtime"))
    return local.unionByName(stored).unionByName(loose).unionByName(content)


def orphan_totals(found: DataFrame) -> DataFrame:
    """total_items and total_size of orphans(), one row."""
    return found.agg(F.count("*").alias("total_items"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))


def cleaned(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Wanted removals (kind, id) re-checked against what is an orphan now: removed with its bytes, or skipped."""
    out = wanted.join(found, ["kind", "id"], "left")
    return out.select("kind", "id", F.when(F.col("bytes").isNull(), "skipped").otherwise("removed").alias("outcome"), F.coalesce("bytes", F.lit(0).cast("long")).alias("freed"))


def expired(rows: DataFrame, as_of: str, days: int, column: str = "created_at") -> DataFrame:
    """Rows older than days before as_of; none if days is 0."""
    if days <= 0:
        return rows.limit(0)
    return rows.where(F.col(column) < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def recovery(tasks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """What a restart makes of running tasks: pending, paused or failed, by stage and pages that there are."""
    out = tasks.join(page_counts, "task_id", "left").withColumn("pages", F.coalesce("pages", F.lit(0).cast("long")))
    to = F.when(F.col("stage") == "consolidating", "pending").when(F.col("stage") == "ready", "paused").when(F.col("has_file"), "pending").when(F.col("pages") > 0, "paused").otherwise("failed")
    return out.select("task_id", "stage", "pages", to.alias("status"))


def has_work(total: Column, pages: Column, failed: Column) -> Column:
    """Failed pages, fewer pages than there should be, or an unknown total."""
    return (F.coalesce(failed, F.lit(0)) > 0) | F.coalesce(total, F.lit(0)).eqNullSafe(0) | (F.coalesce(pages, F.lit(0)) < total)


def pages_to_do(stored: DataFrame, good: DataFrame, forced: bool = False) -> DataFrame:
    """Stored pages that still need work: those not good, or all."""
    keys = stored.select("task_id", "page_no").distinct()
    return keys if forced else keys.join(good.select("task_id", "page_no"), ["task_id", "page_no"], "left_anti")


def review_gate(reviewed: Column, reason: Column, force: Column) -> Column:
    """Whether reviewed results may be applied, and why not."""
    return F.when(F.coalesce(reviewed, F.lit(False)), "pass").when(F.coalesce(force, F.lit(False)), "forced").when(F.trim(F.coalesce(reason, F.lit(""))) != "", "reasoned").otherwise("refused")


def submit_requests(wanted: DataFrame, pending: DataFrame) -> DataFrame:
    """Deletions asked for (target_type, target_id, submitted_by, at) with what becomes of them: pending, or a conflict with the oldest request that is pending on the target."""
    key = ["target_type", "target_id"]
    oldest = pending.where("status = 'pending'").groupBy(*key).agg(F.min("request_id").alias("conflict"))
    first = F.row_number().over(W.partitionBy(*key).orderBy("at", "submitted_by"))
    out = wanted.withColumn("turn", first).join(oldest, key, "left")
    return out.select(*key, "submitted_by", "at", "conflict", F.when(F.col("conflict").isNotNull() | (F.col("turn") > 1), "conflict").otherwise("pending").alias("outcome"))


def decide_requests(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Deletion requests (request_id, target_type, target_id, status, snapshot, approve, force) against what there is now (target_type, target_id, n, archived, state).

    Only pending requests are decided. A rejected target stays. Of approved ones a target that is gone is
    done with; an archived one is refused; a lineage that still has people (n) needs force; everything else
    is deleted. changed says whether the target is no longer as in the snapshot, compared whole.
    """
    out = requests.join(current.withColumn("here", F.lit(True)), ["target_type", "target_id"], "left")
    to = (
        F.when(F.col("status") != "pending", "handled already")
        .when(~F.col("approve"), "rejected")
        .when(F.col("here").isNull(), "approved, gone already")
        .when(F.col("archived"), "refused, archived")
        .when((F.col("target_type") == "lineage") & (F.col("n") > 0) & ~F.coalesce("force", F.lit(False)), "needs force")
        .otherwise("approved, deleted")
    )
    changed = F.col("here").isNotNull() & ~F.to_json("snapshot").eqNullSafe(F.to_json("state"))
    return out.select("request_id", "target_type", "target_id", to.alias("outcome"), changed.alias("changed"))


def archived(tasks: DataFrame, wanted: DataFrame, by: int, at: Column) -> DataFrame:
    """Tasks (task_id, status, applied_at, archived_at, archived_by) after those wanted (task_id) are archived, with the outcome: done already, refused before recognition or application, or archived."""
    out = tasks.join(wanted.select("task_id", F.lit(True).alias("asked")), "task_id", "left")
    to = F.when(F.col("asked").isNull(), None).when(F.col("archived_at").isNotNull(), "archived already").when(F.col("status") != "done", "not recognised").when(F.col("applied_at").isNull(), "not applied").otherwise("archived")
    now = to == "archived"
    return out.withColumn("outcome", to).withColumns({"archived_by": F.when(now, by).otherwise(F.col("archived_by")), "archived_at": F.when(now, at).otherwise(F.col("archived_at"))}).drop("asked")


def unarchived(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tasks after those wanted are fetched back: what they have written is to be purged (purge), since they will be written again."""
    out = tasks.join(wanted.select("task_id", F.lit(True).alias("asked")), "task_id", "left")
    back = F.col("asked").isNotNull() & F.col("archived_at").isNotNull()
    return out.withColumn("purge", back).withColumn("outcome", F.when(F.col("asked").isNull(), None).when(back, "fetched back").otherwise("not archived")).withColumn("archived_at", F.when(~back, F.col("archived_at"))).drop("asked")


def reviewed_source(payload: Column, consolidated: Column, pages: Column) -> Column:
    """The first that is there of three arrays of results."""
    return F.coalesce(F.when(F.size(payload) > 0, payload), F.when(F.size(consolidated) > 0, consolidated), pages)


def changed_pages(now: DataFrame, before: DataFrame) -> DataFrame:
    """Pages (task_id, page_no) whose signature differs from before, or that are new."""
    return now.join(before.select("task_id", "page_no", F.col("signature").alias("old")), ["task_id", "page_no"], "left").where(~F.col("signature").eqNullSafe(F.col("old"))).select("task_id", "page_no")


def task_states(events: DataFrame) -> DataFrame:
    """Last state of each task from its events (task_id, at, event): manual pauses hold until a resume; done and failed are final unless restarted.

    Each event maps the state to another one, so the fold is an ordered aggregate over a task's own events.
    """
    ordered = events.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("at", "event"))).alias("e"))

    def step(s: Column, x: Column) -> Column:
        e = x["event"]
        return (
            F.when(e == "restart", "running")
            .when(s.isin("done", "failed"), s)
            .when(s == "paused", F.when(e == "resume", "running").otherwise("paused"))
            .when(e == "pause", "paused")
            .when(e == "start", "running")
            .when(e == "finish", "done")
            .when(e == "error", "failed")
            .otherwise(s)
        )

    return ordered.select("task_id", F.aggregate("e", F.lit("pending"), step).alias("status"))
