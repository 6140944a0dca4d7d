"""Conversation structure repair: the cheapest edits by an auction on the lattice of rows and states.

A node is (rows taken, state of the roles written so far). The auction keeps a price per node and a
path that it extends along arcs whose cost equals the fall in price, or contracts where no arc does,
raising the price of the node it leaves. Every node is an origin once, the last rows first, so that a path
ends at the first node whose price is final. Final prices are distances to the end; arcs whose cost
equals the fall in price are those of all cheapest repairs, and the least audit is read off along them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\x0c\r"
RETAG, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Codes of roles and of faults; a row's letter is their pair, in lower case for a further copy of a row.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, DUPLICATE, TRUNCATED, BLANK = range(4)
#: States: nothing written, after the system row, after a user row, after an assistant row.
START, HEAD, ASKED, ANSWERED = range(4)
#: Where Keep leads from a state: (state, role) -> state.
NEXT = {(START, SYSTEM): HEAD, (START, USER): ASKED, (HEAD, USER): ASKED, (ASKED, ASSISTANT): ANSWERED, (ANSWERED, USER): ASKED}
#: The state that an inserted or retagged row leads to.
TURN = (ASKED, ASKED, ANSWERED, ASKED)
NAMES = {ASKED: "user", ANSWERED: "assistant"}
#: Rows of a conversation that are gathered together before it is joined to one string of letters.
BLOCK_BITS = 12
#: How many ways the rows of one role and text are dealt out where they meet their first turn.
SALTS = 16


def _arcs(codes: list[tuple[int, int]], node: int) -> list[tuple[str, int, int]]:
    """(letter, cost, node) of the arcs out of a node in the order of their letters; node 4 i + state, the end is 4 (n + 1)."""
    i, state = divmod(node, 4)
    arcs = [("I", INSERT, 4 * i + TURN[state])]
    if i == len(codes):
        return [("", 0, node - state + 4), *arcs] if state in (START, ANSWERED) else arcs
    role, fault = codes[i]
    arcs.insert(0, ("D", DELETE, node + 4))
    if fault not in (BLANK, DUPLICATE):
        more = CUT_OFF if fault == TRUNCATED else 0
        if (state, role) in NEXT:
            arcs.append(("K", more, 4 * i + 4 + NEXT[state, role]))
        arcs.append(("R", RETAG + more, 4 * i + 4 + TURN[state]))
    return arcs


def auction(codes: list[tuple[int, int]]) -> list[int]:
    """Final price of every node: the least cost from it to the end."""
    end = 4 * (len(codes) + 1)
    price, final = [0] * (end + 1), [False] * end + [True]
    for origin in range(end - 1, -1, -1):
        path = [origin]
        while not final[path[-1]]:
            node = path[-1]
            least, to = min((cost + price[to], to) for _, cost, to in _arcs(codes, node))
            if price[node] < least:  # contraction
                price[node] = least
                if node != origin:
                    path.pop()
            else:  # extension
                path.append(to)
        for node in path:
            final[node] = True
    return price


def repair(codes: list[tuple[int, int]]) -> tuple[int, list[tuple[str, int]]]:
    """Least cost, and (letter, state after it) of the edits with the ASCII-least audit."""
    price, node, edits = auction(codes), 0, []
    cost, end = price[0], 4 * (len(codes) + 1)
    while node != end:
        letter, node = next((letter, to) for letter, paid, to in _arcs(codes, node) if price[node] == paid + price[to])
        if letter:
            edits.append((letter, node % 4))
    return cost, edits


def _solved(codes: str) -> tuple[dict, list[dict]]:
    """Figures of a conversation, and for each of its rows the lines to write before and after it and its role.

    The role is null for a deleted row and empty for one that keeps its own.
    """
    rows = [divmod((ord(c) - 65) % 32, 4) for c in codes]
    cost, edits = repair(rows)
    pairs = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    figures = {
        "blank": sum(f == BLANK for _, f in rows),
        "duplicate": sum(f == DUPLICATE for _, f in rows),
        "truncated": sum(f == TRUNCATED for _, f in rows),
        "illegal": sum((a, b) not in pairs for (a, _), (b, _) in zip(rows, rows[1:])),
        "cost": cost,
        "audit": "".join(letter for letter, _ in edits),
    }
    out, inserted, at = [], "", 0
    for letter, state in edits:
        if letter == "I":
            inserted += f"{NAMES[state]}:\n"
            continue
        if codes[at].isupper():
            out.append({"before": inserted, "role": None if letter == "D" else NAMES[state] if letter == "R" else "", "after": ""})
        else:  # a further copy of the row before is always deleted
            out[-1]["after"] += inserted
        inserted, at = "", at + 1
    if out:
        out[-1]["after"] += inserted
    return figures, out


_EDIT = "struct<before: string, role: string, after: string>"
_SOLVED = f"conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, first_place long, edits array<{_EDIT}>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edit = pa.struct([("before", pa.string()), ("role", pa.string()), ("after", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("first_place", pa.int64()), ("edits", pa.list_(edit))])
    for batch in batches:
        found = []
        for conv_id, blocks in zip(batch.column(0).to_pylist(), batch.column(1)):
            blocks = blocks.as_py()
            figures, edits = _solved("".join(b["codes"] for b in blocks))
            found.append({"conv_id": conv_id, **figures})
            at = 0
            for b in blocks:
                n = sum(map(str.isupper, b["codes"]))
                found.append({"conv_id": conv_id, "first_place": b["first_place"], "edits": edits[at : at + n]})
                at += n
        yield pa.RecordBatch.from_pylist(found, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, from its edits and rows in turns; the last line's end is left out."""
    names, digest, kept, now, edit = ["conv_id", "repaired_sha256"], None, "", None, None
    for batch in batches:
        ids, digests = [], []
        for conv_id, line, before, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if digest is None or conv_id != now:
                if digest is not None:
                    digest.update(kept[:-1].encode())
                    ids.append(now)
                    digests.append(digest.hexdigest())
                digest, kept, now = hashlib.sha256(), "", conv_id
            if not line:
                edit = before, role, text
                continue
            own = "" if edit[1] is None else f"{edit[1] or role}:{text}\n"
            piece = f"{edit[0]}{own}{edit[2]}"
            if piece:
                digest.update(kept.encode())
                kept = piece
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names)
    if digest is not None:
        digest.update(kept[:-1].encode())
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], names)


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> the same and `copies`: 0 drops a row, 2 repeats it.

    What happens follows from crc32("conv_id:turn") mod 20; nulls of role and text become one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _found(rows: DataFrame, others: DataFrame, *names: str) -> DataFrame:
    """Left join on names, of which nulls are equal."""
    others = others.withColumnsRenamed({c: f"their_{c}" for c in names})
    same = F.lit(True)
    for c in names:
        same &= F.col(c).eqNullSafe(F.col(f"their_{c}"))
    return rows.join(others, same, "left").drop(*[f"their_{c}" for c in names])


def placed(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) -> a stored row for equal rows, with `place`, its place in the order of all rows.

    Rows of a conversation stand by turn (nulls first), role and text. Equal rows are added up before any
    other step; rows are then sorted over all partitions by ranges, so a conversation of any length is cut.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    key = ["conv_id", "turn", "role"]
    rows = rows.repartitionByRange(n, *key, F.substring("text", 1, 64)).sortWithinPartitions(*key, "text")
    return common.stored(rows.withColumn("place", F.monotonically_increasing_id()), "turns", "zstd")


def lettered(lines: DataFrame) -> DataFrame:
    """placed() rows -> (conv_id, place, letters): the letter of role and fault of a row, and one in lower case for each further copy. Texts stay where they are."""
    stripped, initial = F.rtrim("text", F.lit(SPACE)), F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(stripped == "", BLANK).when(~F.right(stripped, F.lit(1)).isin(*".!?"), TRUNCATED).otherwise(SOUND)
    light = lines.select("conv_id", "turn", "role", "place", "copies", F.sha2("text", 256).alias("digest"), F.pmod(F.xxhash64("turn"), F.lit(SALTS)).alias("salt"), role.alias("r"), fault.alias("f"))
    firsts = light.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max(F.col("turn").isNull()).alias("none"))
    firsts = firsts.where("turns > 1").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    later = F.coalesce(F.when(F.col("none"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first_turn")), F.lit(False))
    told = _found(light, firsts, "conv_id", "role", "digest", "salt")
    first = F.when((F.col("f") != BLANK) & later, DUPLICATE).otherwise(F.col("f"))
    again = F.when(F.col("f") == BLANK, BLANK).otherwise(DUPLICATE)
    told = told.withColumn("letter", F.char(97 + 4 * F.col("r") + again))
    return told.select("conv_id", "place", F.concat(F.char(65 + 4 * F.col("r") + first), F.expr("repeat(letter, int(copies - 1))")).alias("letters"))


def repaired(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, ...), each as it is -> a row per conversation: faults, cheapest edits, digest of the result.

    Edits and faults are those of op13's contract. A role whose first letter is none of s, u, a (a null one
    counts as a space, an empty one has no letter) can't be kept. Equal turns stand by role and text.
    A conversation that loses all its rows has cost and audit of its cheapest edits and the digest
    of an empty string; null ids are one conversation; an empty table gives no rows.
    """
    return _repaired(rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies")))


def _repaired(rows: DataFrame) -> DataFrame:
    there = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = F.coalesce(F.max(there) - F.min(there) + 1 - F.count_distinct(there), F.lit(0))
    ids = rows.groupBy("conv_id").agg(gaps.alias("gaps"))
    lines = placed(rows)
    block = F.shiftright("place", BLOCK_BITS)
    in_order = lambda c: F.array_sort(F.collect_list(c))
    blocks = lettered(lines).groupBy("conv_id", block.alias("block")).agg(F.min("place").alias("first_place"), F.array_join(F.transform(in_order(F.struct("place", "letters")), lambda x: x["letters"]), "").alias("codes"))
    whole = blocks.groupBy("conv_id").agg(in_order(F.struct("first_place", "codes")).alias("blocks"))
    solved = common.stored(whole.mapInArrow(_solve, _SOLVED), "turn-edits")
    edits = solved.where("edits is not null").select("conv_id", "first_place", F.posexplode("edits")).select("conv_id", (F.col("first_place") + F.col("pos")).alias("place"), F.lit(0).alias("line"), "col.before", F.col("col.role").alias("role"), F.col("col.after").alias("text"))
    # a row's edit (before, role, after) stands right before the row itself (role, text)
    met = edits.unionByName(lines.select("conv_id", "place", F.lit(1).alias("line"), F.lit(None).cast("string").alias("before"), "role", "text"))
    digests = met.repartition("conv_id").sortWithinPartitions("conv_id", "place", "line").select("conv_id", "line", "before", "role", "text").mapInArrow(_digest, "conv_id long, repaired_sha256 string")
    out = _found(_found(ids, solved.where("edits is null"), "conv_id"), digests, "conv_id")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(damage(common.table(spark, sf_dir, "conversations")))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLE_SQL: dict[str, str] = {}
