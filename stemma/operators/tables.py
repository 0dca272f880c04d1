"""Filters, lookups and aggregates over tasks, pages, entries, users and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def filtered(df: DataFrame, order: list[str], **equal) -> DataFrame:
    """Rows equal to every given value (None does not filter), in order with nulls last."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in order))


def searched(df: DataFrame, text: str, columns: list[str], order: str, offset: int, limit: int, **equal) -> DataFrame:
    """One page of rows any of whose columns holds text, whatever its case, newest first, with the total before paging."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if text:
        pattern = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        any_ = F.lit(False)
        for c in columns:
            any_ = any_ | F.coalesce(F.col(c).ilike(f"%{pattern}%"), F.lit(False))
        df = df.where(any_)
    total = df.agg(F.count("*").alias("total"))  # one row
    return df.orderBy(F.col(order).desc()).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def newest(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie).desc()).limit(n)


def oldest(df: DataFrame, by: str, tie: str, n: int = 1) -> DataFrame:
    return df.orderBy(F.col(by).asc_nulls_last(), F.col(tie)).limit(n)


def visible(df: DataFrame, owner: Column, user: Column, role: Column) -> DataFrame:
    """Rows that a user may see: admins all, others their own."""
    return df.where((role == "admin") | (owner == user))


def permitted(permissions: Column, wanted: list[str]) -> Column:
    """Whether a list of permissions (null: all) has any of wanted."""
    return permissions.isNull() | F.arrays_overlap(permissions, F.array(*map(F.lit, wanted)))


def valid_at(as_of: str, revoked: Column, expires_at: Column) -> Column:
    return ~F.coalesce(revoked, F.lit(False)) & (expires_at.isNull() | (expires_at >= F.lit(as_of).cast("timestamp_ntz")))


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first by order; tasks keep one row for each key before anything is shuffled."""
    rows = F.struct(*df.columns)
    return df.groupBy(key).agg(F.min_by(rows, order).alias("_first")).select(*(F.col("_first")[c].alias(c) for c in df.columns))


def status_counts(tasks: DataFrame) -> DataFrame:
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return tasks.agg(F.count("*").alias("total"), n("done").alias("done"), n("failed").alias("failed"), n("running", "pending").alias("running"))


def page_totals(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("pages"), F.coalesce(F.count_if("failed"), F.lit(0)).alias("failed"), F.coalesce(F.count_if("reviewed"), F.lit(0)).alias("reviewed"))


def array_lengths(json: Column, path: str) -> Column:
    """Sum of the lengths of the JSON arrays at path; what is not an array counts 0."""
    return F.coalesce(F.sum(F.json_array_length(F.get_json_object(json, path))), F.lit(0)).cast("long")


def counted(df: DataFrame, key: Column, name: str = "k") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def top_branches(in_branch: DataFrame, branches: DataFrame, lineages: DataFrame, n: int = 10) -> DataFrame:
    """Largest branches, labelled lineage·branch; equal labels count together."""
    rows = in_branch.join(branches.withColumnRenamed("name", "branch"), "branch_id").join(lineages.select("lineage_id", F.col("name").alias("lineage")), "lineage_id", "left")
    label = F.concat(F.coalesce("lineage", F.lit("")), F.lit("·"), "branch")
    return rows.groupBy(label.alias("k")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "k").limit(n)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled): rows in which each column is not null."""
    one = df.agg(*(F.count(c).alias(c) for c in columns))
    return one.unpivot([], columns, "field", "filled")


def percent(done: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) <= 0, F.lit(0)).otherwise(F.least(F.lit(100), F.floor(done * 100 / total + 0.5))).cast("long")


def bars(df: DataFrame, value: str) -> DataFrame:
    """df with each row's share of the largest value in percent, 2 at least."""
    top = df.agg(F.max(value).alias("_top"))  # one row
    return df.crossJoin(F.broadcast(top)).withColumn("bar", F.greatest(F.lit(2), F.floor(F.col(value) * 100.0 / F.col("_top") + 0.5)).cast("long")).drop("_top")


def scaled(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with value scaled to 0..1 within each key; 0.5 where all are alike."""
    ends = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return df.join(ends, key).withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)).drop("_lo", "_hi")


def review_state(pages: DataFrame) -> DataFrame:
    """task_id, pages, failed, reviewed pages, and whether all pages that did not fail are reviewed, at least one."""
    out = pages.groupBy("task_id").agg(F.count("*").alias("pages"), F.count_if("failed").alias("failed"), F.count_if("reviewed").alias("reviewed_pages"), F.count_if(~F.col("failed")).alias("good"), F.count_if(~F.col("failed") & F.col("reviewed")).alias("good_reviewed"))
    return out.withColumn("reviewed", (F.col("good") > 0) & (F.col("good") == F.col("good_reviewed"))).drop("good", "good_reviewed")


#: What task_list() passes on as it is.
AS_IS = ("task_id", "file_type", "file_size", "status", "pause_reason", "error_msg", "lineage_id", "branch_id", "applied_at", "archived_at", "archived_by", "created_at", "updated_at")


def task_list(tasks: DataFrame, pages: DataFrame, lineages: DataFrame, branches: DataFrame, users: DataFrame, documents: DataFrame, ready: DataFrame) -> DataFrame:
    """Tasks as they are listed, 29 columns: their own, names for ids, and what follows from their pages and results.

    tasks has AS_IS, file_path, total_pages, done_pages, stage, failed_listed (how many failed pages its
    result lists, null without a list), consolidated (whether there is a result of the whole volume),
    volume_reviewed, volume_reviewed_at, volume_reviewed_by and stale; pages (task_id, failed, reviewed,
    relations: how many), users (id, username), documents and ready (task_id) in the graph and with page
    images. applied: it says so or is in the graph. reviewed: the volume is, or without one every page that
    did not fail is, one at least. needs_reconsolidate: it is stale, or done with pages of which none has
    relations and without a volume. can_resume: there are pages or page images.
    """
    n = pages.groupBy("task_id").agg(
        F.count("*").alias("_pages"), F.count_if("failed").alias("_failed"), F.count_if("reviewed").alias("_reviewed"), F.count_if(~F.coalesce("failed", F.lit(False))).alias("_good"),
        F.count_if(~F.coalesce("failed", F.lit(False)) & F.col("reviewed")).alias("_good_reviewed"), F.coalesce(F.sum("relations"), F.lit(0)).alias("_relations"),
    )
    flag = lambda df, name: df.select("task_id").distinct().withColumn(name, F.lit(True))
    out = tasks.join(n, "task_id", "left").join(flag(documents, "_graph"), "task_id", "left").join(flag(ready, "_ready"), "task_id", "left")
    out = out.join(lineages.select("lineage_id", F.col("name").alias("lineage_name")), "lineage_id", "left").join(branches.select("branch_id", F.col("name").alias("branch_name")), "branch_id", "left")
    out = out.join(users.select(F.col("id").alias("archived_by"), F.col("username").alias("archived_by_name")), "archived_by", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    volume = yes("consolidated")
    return out.select(
        *AS_IS, "lineage_name", "branch_name", "archived_by_name",
        F.element_at(F.split(F.coalesce("file_path", F.lit("")), "/"), -1).alias("file_path"), zero("total_pages").alias("total_pages"), zero("done_pages").alias("done_pages"), F.coalesce("stage", F.lit("")).alias("stage"),
        F.coalesce(F.col("failed_listed").cast("long"), zero("_failed")).alias("failed_pages"), (F.col("applied_at").isNotNull() | yes("_graph")).alias("applied"),
        F.when(volume, yes("volume_reviewed")).otherwise((zero("_good") > 0) & (zero("_good") == zero("_good_reviewed"))).alias("reviewed"),
        F.when(volume, F.col("volume_reviewed_at")).alias("reviewed_at"), F.when(volume, F.col("volume_reviewed_by")).alias("reviewed_by_name"),
        zero("_reviewed").alias("reviewed_pages"), zero("_pages").alias("review_total_pages"),
        (yes("stale") | (~volume & (zero("_pages") > 0) & (zero("_relations") == 0) & F.coalesce(F.col("status") == "done", F.lit(False)))).alias("needs_reconsolidate"),
        ((zero("_pages") > 0) | yes("_ready")).alias("can_resume"), F.col("archived_at").isNotNull().alias("archived"),
    )


def rates(samples: DataFrame, key: str, at: str, value: str, bucket_seconds: int = 86_400) -> DataFrame:
    """Change of a counter per second since the sample before, 0 where it fell, null for the first.

    Samples are ordered within buckets of time, so few keys with very many samples are no few tasks' work;
    a bucket's first sample meets the last one of the key's bucket before, of which there is one row each.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    sample = F.struct(micros.alias("us"), F.col("id").alias("id"), F.col(value).alias("v"))
    rows = samples.select(key, "id", at, sample.alias("_s"), F.coalesce(F.floor(micros / (bucket_seconds * 1_000_000)), F.lit(-(2**40))).alias("_b"))
    last = rows.groupBy(key, "_b").agg(F.max("_s").alias("_last"))
    before = last.select(key, "_b", F.lag("_last").over(W.partitionBy(key).orderBy("_b")).alias("_before"))
    joined = rows.join(before.withColumnsRenamed({key: "_key", "_b": "_at"}), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_at")), "left")
    previous = F.coalesce(F.lag("_s").over(W.partitionBy(key, "_b").orderBy("_s")), "_before")
    seconds = F.col("_s.us") - F.col("_p.us")
    return joined.withColumn("_p", previous).select(key, "id", at, F.when(seconds > 0, F.greatest(F.lit(0.0), F.col("_s.v") - F.col("_p.v")) / (seconds / 1e6)).alias("rate"))


def last_samples(samples: DataFrame, key: str, at: str, n: int = 60) -> DataFrame:
    return samples.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at), F.desc("id")))).where(F.col("r") <= n).drop("r")


def time_left(samples: DataFrame) -> DataFrame:
    """(task_id, stage, seconds_left) from progress samples (task_id, stage, at, done, total): mean seconds a page since the stage's first sample."""
    s = samples.groupBy("task_id", "stage").agg(F.min(F.struct("at", "done")).alias("a"), F.max(F.struct("at", "done", "total")).alias("b"))
    seconds = (F.unix_micros(F.col("b.at").cast("timestamp")) - F.unix_micros(F.col("a.at").cast("timestamp"))) / 1e6
    pages = F.col("b.done") - F.col("a.done")
    return s.select("task_id", "stage", F.when(pages > 0, seconds / pages * F.greatest(F.lit(0), F.col("b.total") - F.col("b.done"))).alias("seconds_left"))


def gauges(mounts: DataFrame, n: int = 6) -> DataFrame:
    """Largest file systems (device, mount, kind, total, available): one of a device, none that hold no disk; used and its percent."""
    real = mounts.where(~F.col("kind").isin("proc", "sysfs", "tmpfs", "devtmpfs", "overlay", "cgroup", "cgroup2", "squashfs") & (F.col("total") > 0))
    one = first_seen(real, "device", "mount")
    used = F.col("total") - F.col("available")
    return one.withColumns({"used": used, "used_percent": F.round(used * 100 / F.col("total"), 1)}).orderBy(F.desc("total"), "device").limit(n)


def prefix_sizes(objects: DataFrame) -> DataFrame:
    """(prefix, n, bytes, latest): objects (name, size, modified) by the part of the name before the last slash."""
    return objects.groupBy(F.regexp_extract("name", "^(.*)/", 1).alias("prefix")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("modified").alias("latest"))


def page_of_object(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"page_(\d+)\.png$", 1), F.lit("")).cast("int")


def shown(value: Column, low: int, high: int, default: int) -> Column:
    """A setting within its range, or the default where it is missing or no number."""
    n = value.try_cast("long")
    return F.when(n.isNull(), F.lit(default)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), n))).cast("long")


def colour_of(text: Column, colours: int) -> Column:
    """A stable number below colours: h * 31 + code over the characters, in 32 bits."""
    return F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 4294967296) % colours
