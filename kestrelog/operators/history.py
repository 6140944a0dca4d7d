"""Causal per-event history features: nothing of an event's own or later rows is used.

Events are ordered by (timestamp, source_line); an event of the same second counts as earlier
only if its line is smaller. Lookbacks keep events at exactly t - W. Rolling counts add each
event and take it away W seconds later, both as rows of one table, and read off running sums.
Time is cut into pieces as long as the longest window: an event counts in its own piece and, as
what went before, in the next one, so a key's whole history is never in one task, only a piece of it and the piece before.
What was first is the least (timestamp, source_line) of a pair, an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelog.functions import tables
from kestrelog.functions.accounts import is_machine

ORDER = ["timestamp", "source_line"]


def _piece(t: Column, seconds: int) -> Column:
    return F.floor((t - 1) / seconds)


def _moves(events: DataFrame, seconds: int, kept: list[str]) -> DataFrame:
    """Each event as its arrival (__out), its arrival as history of the next piece, and its expiry there.

    __piece, __at and __kind (0 arrival, 1 expiry) place a row. Columns other than `kept` stay with the arrival that counts.
    """
    t = F.col("timestamp")
    move = lambda piece, at, kind, out: F.struct(piece.alias("piece"), at.alias("at"), F.lit(kind).alias("kind"), F.lit(out).alias("out"))
    own, next_ = _piece(t, seconds), _piece(t, seconds) + 1
    moved = events.withColumn("__m", F.explode(F.array(move(own, t, 0, True), move(next_, t, 0, False), move(next_, t + seconds, 1, False))))
    rest = {c: F.when(F.col("__m.out"), F.col(c)) for c in events.columns if c not in kept}
    return moved.withColumns({**rest, "__piece": F.col("__m.piece"), "__at": F.col("__m.at"), "__kind": F.col("__m.kind"), "__out": F.col("__m.out")}).drop("__m")


def _before(*keys: str):
    return Window.partitionBy(*keys).orderBy("__at", "__kind", "source_line").rowsBetween(Window.unboundedPreceding, -1)


def rolling_sum(events: DataFrame, keys: list[str], seconds: int, value: Column, name: str) -> DataFrame:
    """events with name: the sum of value over earlier events of the same keys in the last `seconds`."""
    moved = _moves(events.withColumn("__v", value.cast("long")), seconds, [*keys, "source_line", "__v"])
    signed = F.when(F.col("__kind") == 0, F.col("__v")).otherwise(-F.col("__v"))
    summed = moved.withColumn("__v", signed).withColumn(name, F.coalesce(F.sum("__v").over(_before(*keys, "__piece")), F.lit(0)))
    return summed.where("__out").select(*events.columns, name)


def _changes(moved: DataFrame, keys: list[str], item: str, count: str) -> DataFrame:
    """moved with `count`, the events of the item that are in the window, and __d: 1 where it enters the window, -1 where the last of it leaves."""
    step = F.when(F.col("__kind") == 0, 1).otherwise(-1).cast("long")
    counted = moved.withColumn("__s", step).withColumn(count, F.coalesce(F.sum("__s").over(_before(*keys, "__piece", item)), F.lit(0)))
    entered, left = (F.col("__kind") == 0) & (F.col(count) == 0), (F.col("__kind") == 1) & (F.col(count) == 1)
    return counted.withColumn("__d", F.when(entered, 1).when(left, -1).otherwise(0).cast("long")).drop("__s")


def rolling_distinct(events: DataFrame, keys: list[str], item: str, seconds: int, name: str) -> DataFrame:
    """events with name: distinct values of item among earlier events of the same keys in the last `seconds`."""
    moved = _moves(events, seconds, [*keys, item, "source_line"]).repartition(*keys, "__piece")  # serves both windows
    summed = _changes(moved, keys, item, "__n").withColumn(name, F.coalesce(F.sum("__d").over(_before(*keys, "__piece")), F.lit(0)))
    return summed.where("__out").select(*events.columns, name)


FIRSTS = {"is_new_user_destination": ("acting_user", "destination_computer"), "is_new_user_source": ("acting_user", "source_computer"), "is_new_host_connection": ("source_computer", "destination_computer")}


def firsts(events: DataFrame, pairs: dict[str, tuple[str, str]] = FIRSTS) -> DataFrame:
    """(source_line, flags): the lines that are the first of some pair of columns, nulls being values; source_line is unique."""
    kinds = F.explode(F.array(*[F.struct(F.lit(1 << k).alias("bit"), F.col(a).alias("a"), F.col(b).alias("b")) for k, (a, b) in enumerate(pairs.values())]))
    least = events.select("timestamp", "source_line", kinds.alias("x")).groupBy("x").agg(F.min(F.struct("timestamp", "source_line"))["source_line"].alias("source_line"))
    bits = least.groupBy("source_line").agg(F.bit_or("x.bit").alias("bits"))
    return bits.select("source_line", *[(F.col("bits").bitwiseAND(1 << k) > 0).alias(name) for k, name in enumerate(pairs)])


def last_before(events: DataFrame, seconds: int) -> DataFrame:
    """(acting_user, __piece, __last): the time of a user's last event before each piece that has events. A user has a row for each piece."""
    each = events.groupBy("acting_user", _piece(F.col("timestamp"), seconds).alias("__piece")).agg(F.max("timestamp").alias("t"))
    return each.withColumn("__last", F.lag("t").over(Window.partitionBy("acting_user").orderBy("__piece"))).drop("t")


def _with_last(rows: DataFrame, events: DataFrame, seconds: int) -> DataFrame:
    """rows (acting_user, __piece, ...) with __last, users without a name being one user."""
    before = last_before(events, seconds).where("__last is not null").withColumnsRenamed({"acting_user": "__u", "__piece": "__q"})
    before = tables.checked(tables.stored(before, "last-before"))
    return rows.join(before, F.col("acting_user").eqNullSafe(F.col("__u")) & (F.col("__piece") == F.col("__q")), "left").drop("__u", "__q")


def _with_firsts(rows: DataFrame, events: DataFrame) -> DataFrame:
    flags = tables.checked(tables.stored(firsts(events), "first-lines"))
    return rows.join(flags, "source_line", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in FIRSTS})


def _gap(latest: Column) -> dict[str, Column]:
    gap = (F.col("timestamp") - latest).cast("double")
    return {"seconds_since_previous_auth": gap, "has_user_history": latest.isNotNull(), "is_machine_account": is_machine(F.col("acting_user"))}


def novelty(events: DataFrame, piece_seconds: int = 86_400) -> DataFrame:
    """The ever-seen flags and per-user gap."""
    w = Window.partitionBy("acting_user", "__piece").orderBy(*ORDER)
    rows = events.withColumn("__piece", _piece(F.col("timestamp"), piece_seconds)).withColumn("__t", F.lag("timestamp").over(w))
    rows = _with_last(rows, events, piece_seconds)
    rows = rows.withColumns(_gap(F.coalesce("__t", "__last"))).drop("__piece", "__t", "__last")
    return _with_firsts(rows, events).select(*events.columns, "seconds_since_previous_auth", *FIRSTS, "has_user_history", "is_machine_account")


def history_features(events: DataFrame, start: int = 1) -> DataFrame:
    """All raw features of the log: rolling counts of an hour and a day, first-time flags, gap, completeness.

    Pieces are days. An hour's expiry is in the event's own day or, past midnight, in the next, where alone it then counts.
    """
    from kestrelog.sources.authlog import assert_no_labels

    day, hour, names = 86_400, 3600, assert_no_labels(events).columns
    base = events.withColumn("__f", (F.col("authentication_result") == "Fail").cast("long"))
    kept = ["acting_user", "destination_computer", "source_line", "__f"]
    moved = _moves(base, day, kept).repartition("acting_user", "__piece")  # serves both windows
    moved = _changes(moved, ["acting_user"], "destination_computer", "prior_user_destination_count_24h")
    # arrivals bring their hour's expiry along, where it falls into the same piece; history that ends before the piece does not count
    goes = (F.col("__kind") == 0) & (_piece(F.col("__at") + hour, day) == F.col("__piece"))
    here = _piece(F.col("__at") + hour, day) >= F.col("__piece")
    counts = F.struct(F.col("__at").alias("at"), F.col("__kind").alias("kind"), F.when((F.col("__kind") == 0) & here, 1).otherwise(0).cast("long").alias("a"), F.col("__d").alias("d"), F.col("__out").alias("out"))
    over = F.struct((F.col("__at") + hour).alias("at"), F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("a"), F.lit(0).cast("long").alias("d"), F.lit(False).alias("out"))
    moved = moved.withColumn("__m", F.explode(F.when(goes, F.array(counts, over)).otherwise(F.array(counts))))
    rest = {c: F.when(F.col("__m.out"), F.col(c)) for c in (*names, "prior_user_destination_count_24h") if c not in kept}
    moved = moved.withColumns({**rest, "__at": F.col("__m.at"), "__kind": F.col("__m.kind"), "__a": F.col("__m.a"), "__d": F.col("__m.d"), "__out": F.col("__m.out")}).drop("__m")
    before = _before("acting_user", "__piece")
    sums = {"prior_auth_count_1h": F.col("__a"), "prior_failure_count_1h": F.col("__a") * F.coalesce("__f", F.lit(0)), "prior_unique_destinations_24h": F.col("__d")}
    summed = moved.withColumns({name: F.coalesce(F.sum(v).over(before), F.lit(0)) for name, v in sums.items()} | {"__t": F.max(F.when(F.col("__kind") == 0, F.col("__at"))).over(before)})
    out = _with_last(summed.where("__out"), events, day)
    out = _with_firsts(out.withColumns(_gap(F.coalesce("__t", "__last"))), events)
    out = out.select(*names, *sums, "is_new_user_destination", "seconds_since_previous_auth", "prior_user_destination_count_24h", "is_new_user_source", "is_new_host_connection", "has_user_history", "is_machine_account")
    return out.withColumns({"history_complete_1h": F.col("timestamp") >= start + hour, "history_complete_24h": F.col("timestamp") >= start + day})


def check_sorted(events: DataFrame, stripe: int = 1_000_000) -> DataFrame:
    """Fails unless lines are distinct and (timestamp, source_line) does not decrease in the order of lines."""
    from kestrelog.sources.authlog import order_inversions

    if order_inversions(events, stripe).limit(1).count() or events.groupBy("source_line").count().where("count > 1").limit(1).count():
        raise ValueError("events are not in the order of time and line")
    return events


def order_problems(events: DataFrame, stripe: int = 1_000_000) -> DataFrame:
    """(source_line, problem) of what check_sorted refuses: time_goes_back, repeated_line."""
    from kestrelog.sources.authlog import order_inversions

    back = order_inversions(events, stripe).select("source_line", F.lit("time_goes_back").alias("problem"))
    twice = events.groupBy("source_line").count().where("count > 1").select("source_line", F.lit("repeated_line").alias("problem"))
    return back.distinct().unionByName(twice)


def join_flags(events: DataFrame, flags: DataFrame, names: list[str]) -> DataFrame:
    """events with flags (source_line, names) joined back by line; fails if an event has none or several."""
    out = events.join(flags.select("source_line", F.lit(True).alias("__there"), *names), "source_line", "left")
    if out.where("__there is null").limit(1).count() or flags.groupBy("source_line").count().where("count > 1").limit(1).count():
        raise ValueError("flags do not match the events one to one")
    return out.drop("__there")


def user_shard(user: Column, n: int) -> Column:
    return F.pmod(F.crc32(user.cast("binary")), F.lit(n)).cast("int")


def state_sizes(events: DataFrame) -> DataFrame:
    """One row: distinct users, computers and pairs ever seen."""
    return events.agg(
        F.countDistinct("acting_user").alias("users"), F.countDistinct("destination_computer").alias("destinations"),
        F.countDistinct("acting_user", "destination_computer").alias("user_destinations"), F.countDistinct("acting_user", "source_computer").alias("user_sources"), F.countDistinct("source_computer", "destination_computer").alias("host_pairs"),
    )
