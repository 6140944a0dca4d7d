"""Reading, checking and writing authentication logs and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelog.functions import tables
from kestrelog.functions.accounts import reference
from kestrelog.functions.clock import day_of

AUTH_FIELDS = ["timestamp", "source_user", "destination_user", "source_computer", "destination_computer", "authentication_type", "logon_type", "authentication_orientation", "authentication_result"]
LABEL_FIELDS = ["timestamp", "user", "source_computer", "destination_computer"]
#: Lines of a day that go to one file, and lines that a lookup by filter takes.
STRIPE, LOOKUP = 5_000_000, 1_000
LABEL_COLUMNS = {"is_red_team", "label", "red_team", "is_attack"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text or gzip lines numbered from 1 in file order (source_line, raw), files by name.

    Two passes in the JVM: lines per block of a file, then each line's place in its block after
    the lines of the blocks before. Only a row for each block is put in order.
    """
    place = ["file", "block"]
    text = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = text.groupBy(*place).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = tables.stored(blocks.select(*place, "first", before.alias("before")), "line-offsets")
    return text.join(tables.checked(offsets), place).select((F.col("id") - F.col("first") + F.col("before") + 1).alias("source_line"), "raw")


def apply_line_map(lines: DataFrame, line_map: DataFrame, stripe: int = 1_000_000) -> DataFrame:
    """Replaces line numbers by those of line_map (source_line, mapped), which must be complete, unique and increasing.

    The map is checked in stripes of line numbers; the ends of stripes are compared separately.
    """
    striped = line_map.withColumn("stripe", F.floor(F.col("source_line") / stripe))
    inner = striped.withColumn("low", F.lag("mapped").over(Window.partitionBy("stripe").orderBy("source_line"))).where("mapped <= low")
    ends = striped.groupBy("stripe").agg(F.min("mapped").alias("mapped"), F.max("mapped").alias("last"))
    edges = ends.withColumn("low", F.lag("last").over(Window.orderBy("stripe"))).where("mapped <= low")  # a row for each stripe
    out = lines.join(line_map, "source_line", "left")
    if inner.limit(1).count() or edges.limit(1).count() or out.where("mapped is null").limit(1).count():
        raise ValueError("the line map is not strictly increasing or lacks lines")
    return out.drop("source_line").withColumnRenamed("mapped", "source_line")


def fields_of(raw: Column) -> Column:
    """The comma-separated fields of a line; a line with quotes is read by their rules, doubled quotes inside quoted fields included."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), raw), F.lit(',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    bare = F.transform(parts, lambda p: F.when(p.startswith('"') & p.endswith('"') & (F.length(p) > 1), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p))
    return F.when(raw.contains('"'), bare).otherwise(F.split(raw, ",", -1))


def parse(lines: DataFrame, fields: list[str] = AUTH_FIELDS, prefix: str = "auth.txt") -> DataFrame:
    """(source_line, raw) -> the fields, a reject reason or null, acting user, day and reference.

    Reasons in order: field_count, invalid_timestamp (not a whole number, or below 1), empty_field.
    A line is split once, whatever is asked of the result.
    """

    def record(x: Column) -> Column:
        t = F.when(F.trim(x[0]).rlike("^[+-]?[0-9]+$"), x[0].try_cast("long"))
        reason = F.when(F.size(x) != len(fields), "field_count").when(t.isNull() | (t < 1), "invalid_timestamp").when(F.array_contains(x, ""), "empty_field")
        return F.struct(t.alias("timestamp"), *[F.get(x, F.lit(i)).alias(c) for i, c in enumerate(fields) if i], reason.alias("reason"))

    # a generator, so that filters on its fields stay above it and do not split the line again
    found = lines.select("source_line", "raw", F.explode(F.transform(F.array(fields_of(F.col("raw"))), record)).alias("p"))
    out = found.select("source_line", "raw", "p.*")
    who = "source_user" if "source_user" in fields else "user"
    return out.withColumns({"acting_user": F.col(who), "dataset_day": day_of(F.col("timestamp")), "source_reference": reference(prefix, F.col("source_line"))})


def rejections(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("source_line", "reason", F.col("raw").alias("raw_record"))


def accepted(parsed: DataFrame, first_day: int | None = None, last_day: int | None = None) -> DataFrame:
    ok = parsed.where("reason is null").drop("reason")
    return ok if first_day is None else ok.where(F.col("dataset_day").between(first_day, last_day))


def with_duplicate_ordinal(events: DataFrame, fields: list[str] = AUTH_FIELDS) -> DataFrame:
    """1 for the first of equal rows by source_line, 2 for the next; nothing is dropped.

    Rows are numbered by two hashes of their fields and those of equal hashes by the fields
    themselves; only line numbers and hashes move.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in fields])
    hashed = tables.stored(events.select("source_line", F.md5(text.cast("binary")).alias("h")), "line-hashes")
    repeated = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    again = hashed.join(repeated, "h").withColumn("o", F.row_number().over(Window.partitionBy("h").orderBy("source_line"))).where("o > 1")
    return events.join(tables.checked(tables.stored(again.select("source_line", "o"), "duplicates")), "source_line", "left").withColumn("exact_duplicate_ordinal", F.coalesce("o", F.lit(1))).drop("o")


def check_order(events: DataFrame) -> DataFrame:
    """Fails if timestamps go back in the order of lines; else the events."""
    first = order_inversions(events).orderBy("source_line").limit(1).collect()
    if first:
        raise ValueError(f"line {first[0].source_line}: timestamp {first[0].timestamp} after {first[0].previous}")
    return events


def write_rejections(parsed: DataFrame, path: str) -> None:
    """The rejects as JSON lines (source_line, reason, raw_record)."""
    rejections(parsed).write.json(path)


def read_rejections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source_line long, reason string, raw_record string").json(path)


def order_inversions(events: DataFrame, stripe: int = 1_000_000) -> DataFrame:
    """(source_line, timestamp, previous) where a timestamp is below the one of the line before.

    Lines are looked at in stripes of line numbers; the ends of stripes are compared separately.
    """
    striped = events.select("source_line", "timestamp", F.floor(F.col("source_line") / stripe).alias("stripe"))
    inner = striped.withColumn("previous", F.lag("timestamp").over(Window.partitionBy("stripe").orderBy("source_line")))
    ends = striped.groupBy("stripe").agg(F.min_by("timestamp", "source_line").alias("timestamp"), F.min("source_line").alias("source_line"), F.max_by("timestamp", "source_line").alias("last"))
    edges = ends.withColumn("previous", F.lag("last").over(Window.orderBy("stripe")))  # a row for each stripe
    return inner.select("source_line", "timestamp", "previous").union(edges.select("source_line", "timestamp", "previous")).where("timestamp < previous").distinct()


def reconcile(parsed: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """One row: scanned = accepted + rejected + out_of_scope, and duplicate groups and instances among the accepted."""
    ok, inside = F.col("reason").isNull(), F.col("dataset_day").between(first_day, last_day)
    counts = parsed.agg(F.count("*").alias("scanned"), F.count_if(ok & inside).alias("accepted"), F.count_if(~ok).alias("rejected"), F.count_if(ok & ~inside).alias("out_of_scope"))
    groups = accepted(parsed, first_day, last_day).groupBy(*[c for c in AUTH_FIELDS if c in parsed.columns]).count().where("count > 1")
    doubled = groups.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_instances"))
    return counts.join(F.broadcast(doubled), F.lit(True))  # one row each


def category_counts(events: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) for each of the fields, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields])).alias("x")
    return events.select(pairs).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def rows_per_day(events: DataFrame) -> DataFrame:
    return events.groupBy("dataset_day").agg(F.count("*").alias("n"))


def compare_days(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts against expected (dataset_day, expected): both sides' days, and whether they agree."""
    both = rows_per_day(events).join(expected, "dataset_day", "full_outer")
    return both.select("dataset_day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce(F.col("n") == F.col("expected"), F.lit(False)).alias("agrees"))


def write_days(events: DataFrame, path: str) -> None:
    """Parquet with zstd, a folder for each day, sorted by line, with a Bloom filter on it: a lookup skips files and row groups without its lines."""
    ordered = events.repartition("dataset_day", F.floor(F.col("source_line") / STRIPE)).sortWithinPartitions("dataset_day", "source_line")
    # the filter's size follows from a file's lines, up to 8 MB
    bloom = {"parquet.bloom.filter.enabled#source_line": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(1 << 23)}
    ordered.write.partitionBy("dataset_day").options(compression="zstd", **bloom).parquet(path)


def lookup_lines(spark: SparkSession, path: str, lines: list[int]) -> DataFrame:
    """Events of a written log by their lines, LOOKUP at most, as a filter that the scan applies to statistics and Bloom filters before it reads rows."""
    if len(lines) > LOOKUP:
        raise ValueError(f"more than {LOOKUP} lines are a join, not a lookup")
    return spark.read.parquet(path).where(F.col("source_line").isin(lines))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(part, rows, first, last) of a written log; part is the day's folder and the file."""
    df = spark.read.parquet(path)
    return df.groupBy(F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1).alias("part")).agg(F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def profile(parsed: DataFrame, last_day: int) -> DataFrame:
    """One row: selected, malformed and out-of-range rows and distinct identities."""
    ok = F.col("reason").isNull()
    return parsed.agg(
        F.count("*").alias("rows"), F.count_if(~ok).alias("malformed"), F.count_if(ok & (F.col("dataset_day") > last_day)).alias("out_of_range"), F.min(F.when(ok, F.col("timestamp"))).alias("first"), F.max(F.when(ok, F.col("timestamp"))).alias("last"),
        *[F.countDistinct(F.when(ok, F.col(c))).alias(f"distinct_{c}") for c in ("source_user", "destination_user", "source_computer", "destination_computer")],
    )


def cohort(events: DataFrame, labels: DataFrame, low: int, high: int, humans: int, machines: int, draw: Column | None = None) -> DataFrame:
    """All events of label users with at most `high` events, and of so many drawn human and machine users with low to high events."""
    from kestrelog.functions.accounts import is_machine

    counts = events.groupBy("acting_user").agg(F.count("*").alias("n")).where(F.col("n") <= high)
    flagged = counts.join(labels.select(F.col("user").alias("acting_user")).distinct().withColumn("labelled", F.lit(True)), "acting_user", "left")
    flagged = flagged.withColumn("machine", is_machine(F.col("acting_user")))
    rest = flagged.where(F.col("labelled").isNull() & (F.col("n") >= low))
    order = draw if draw is not None else F.xxhash64(F.lit(42), "acting_user")
    drawn = rest.where("not machine").orderBy(order, "acting_user").limit(humans).union(rest.where("machine").orderBy(order, "acting_user").limit(machines))
    users = drawn.union(flagged.where("labelled")).select("acting_user")
    return events.join(users, "acting_user", "left_semi")


def assert_no_labels(df: DataFrame) -> DataFrame:
    """Fails if a detector's input has a label column."""
    found = LABEL_COLUMNS & {c.lower() for c in df.columns}
    if found:
        raise ValueError(f"label columns in a detector's input: {sorted(found)}")
    return df


def lookup(requests: DataFrame, events: DataFrame) -> DataFrame:
    """requests (position, reference) -> each distinct reference in first-seen order with its event, null if there is none; fails on repeated lines."""
    from kestrelog.functions.accounts import reference_line

    wanted = requests.groupBy("reference").agg(F.min("position").alias("position")).withColumn("source_line", reference_line(F.col("reference")))
    found = events.join(F.broadcast(wanted.select("source_line")), "source_line", "left_semi") if wanted.limit(100_001).count() <= 100_000 else events.join(wanted, "source_line", "left_semi")
    if found.groupBy("source_line").count().where("count > 1").limit(1).count():
        raise ValueError("a reference names several events")
    return wanted.join(found, "source_line", "left").orderBy("position")


def page(refs: DataFrame, offset: int, limit: int) -> DataFrame:
    """refs (id, references array) -> (id, total, position, reference) of one page; repeats are kept."""
    each = refs.select("id", F.size("references").cast("long").alias("total"), F.posexplode("references").alias("position", "reference"))
    return each.where((F.col("position") >= offset) & (F.col("position") < offset + limit))


def page_ahead(refs: DataFrame, offset: int, limit: int) -> DataFrame:
    """refs (id, references) -> (id, items, has_more, next_offset) with a lookahead of one."""
    got = F.slice("references", offset + 1, limit + 1)
    more = F.size(got) > limit
    return refs.select("id", F.slice(got, 1, limit).alias("items"), more.alias("has_more"), F.when(more, F.lit(offset + limit)).alias("next_offset"))


def attach_references(events: DataFrame, keys: list[str], prefix: str = "auth.txt") -> DataFrame:
    """Ordered references and their number per key; fails if a key mixes splits."""
    order = F.sort_array(F.collect_list(F.struct("timestamp", "source_line")))
    out = events.groupBy(*keys).agg(F.transform(order, lambda x: reference(prefix, x["source_line"])).alias("references"), *([F.countDistinct("split").alias("splits")] if "split" in events.columns else []))
    if "splits" in out.columns:
        if out.where("splits > 1").limit(1).count():
            raise ValueError("a sequence mixes splits")
        out = out.drop("splits")
    return out.withColumn("n_references", F.size("references").cast("long"))
