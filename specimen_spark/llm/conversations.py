"""Repairs the structure of conversations by lightest derivations.

A conversation's rows must become ``(system? (user assistant)+)?`` by keeping, reroling, deleting and
inserting rows.  An item says that the first i rows are dealt with and the roles so far end in state
q; an edit deduces an item from an item.  Its weight is (cost, audit), audits compare as text, and
every deduction adds to both, so functions are monotone and superior: items popped from the agenda
by least weight are final, and the search ends when the goal is popped.

Conversations may be of any length, so rows are numbered in order and cut into blocks.  Part of a
conversation within a block is an item of its own for each pair of states before and behind it; such
items are put together, some hundred at a time, by the same agenda, whose deductions then have two
antecedents.  What was chosen is handed back down, and only then do texts come in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table, tidy

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a block, and items that are put together at a time, as powers of two.
BLOCK_BITS, FAN_BITS = 10, 10
#: The state that a role's initial leads to: nothing yet, system, user, assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GOALS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\f\r"

Edge = tuple[int, int, int, str]


def lightest(start: int, edges: Callable[[int, int], Iterable[Edge]], last: int, goals: tuple[int, ...] = (), trace: bool = False) -> dict[int, tuple[int, str, tuple[int, ...]]]:
    """The least (cost, audit) of each item (last, q) from item (0, start), by q, and with trace the states on the way.

    edges(i, q) gives (i2, q2, cost, audit) of what item (i, q) deduces.  With goals, the first goal
    that is popped ends the search, and only that one is returned.
    """
    agenda, final, out = [(0, "", 0, start, (start,))], set(), {}
    while agenda:
        cost, audit, i, q, path = heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == last and (not goals or q in goals):
            out[q] = (cost, audit, path)
            if goals:
                break
        for i2, q2, more, sign in edges(i, q):
            if (i2, q2) not in final:
                heappush(agenda, (cost + more, audit + sign, i2, q2, (*path, q2) if trace else path))
    return out


def edits_of(initials: str, faults: str) -> Callable[[int, int], Iterator[Edge]]:
    """The edits of rows with these roles and faults, as edges."""

    def edges(i: int, q: int) -> Iterator[Edge]:
        for x in ROLES:
            if (q, x) in NEXT:
                yield i, NEXT[q, x], INSERT, "I"
        if i == len(initials):
            return
        yield i + 1, q, DELETE, "D"
        if faults[i] in "bd":
            return
        more = TRUNCATED if faults[i] == "t" else 0
        if (q, initials[i]) in NEXT:
            yield i + 1, NEXT[q, initials[i]], more, "K"
        for x in ROLES:
            if (q, x) in NEXT:
                yield i + 1, NEXT[q, x], REROLE + more, "R"

    return edges


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage by crc32 of `conv_id:turn` modulo 20; nulls count as one space.

    0 drops a row, 1 empties its text, 2 takes its `.`, `!` and `?`, 3 repeats it, 4 makes it the user's.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), code.alias("_code")).where("_code <> 0")
        .select("conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
        .drop("_copy")
    )


def key_of(conv: str = "conv_id") -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def numbered_turns(rows: DataFrame) -> DataFrame:
    """key, turn, role, text, fault and pos of every row; pos rises by one from row to row of a conversation but for
    where a new partition begins, and is stored."""
    one = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(key_of().alias("key"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), F.monotonically_increasing_id().alias("id"))
    rows = store(rows.withColumn("sha", F.sha2("text", 256)), "turns")
    first = rows.groupBy("key", "role", "sha").agg(F.min(F.struct("turn", "id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = rows.join(first.select("key", "role", "sha", F.col("first.id").alias("first")), ["key", "role", "sha"], "left")
    visible = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(visible == "", "b").when(F.col("id") != F.col("first"), "d").when(~F.substring(visible, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    order = ["key", "turn", "role", "sha", "id"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = seen.select(*order, "text", fault.alias("fault")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return store(ordered.select("key", "turn", "role", "text", "fault", F.monotonically_increasing_id().alias("pos")), "ordered")


WEIGHT = "p int, q int, cost long, audit string, path array<int>"
PARTS = f"key string, at long, first long, open boolean, initials string, illegal long, weights array<struct<{WEIGHT.replace(' ', ':').replace(',:', ',')}>>"
MERGED = f"key string, at long, illegal long, initials string, children array<long>, weights array<struct<{WEIGHT.replace(' ', ':').replace(',:', ',')}>>"


def illegal_pairs(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def weights_of(p: int, found: dict[int, tuple[int, str, tuple[int, ...]]]) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a, "path": list(path)} for q, (c, a, path) in found.items()]


def parts_of(rows: pd.DataFrame) -> pd.DataFrame:
    """The parts of conversations in a block, each with its lightest derivations."""
    rows = rows.sort_values("pos")
    keys = rows["key"].to_numpy()
    cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = rows.iloc[a:b]
        initials, faults = "".join(own["initial"]), "".join(own["fault"])
        is_open = a == 0 or b == len(keys)
        edges, weights = edits_of(initials, faults), []
        for p in range(4 if is_open else 1):  # what begins within a block begins with nothing before it
            if a and p:
                break
            weights += weights_of(p, lightest(p, edges, b - a, () if is_open else GOALS))
        out.append((keys[a], int(own["block"].iloc[0]), int(own["pos"].iloc[0]), is_open, initials, illegal_pairs(initials), weights))
    return pd.DataFrame(out, columns=["key", "at", "first", "open", "initials", "illegal", "weights"])


def merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring parts of one conversation as one."""
    rows = rows.sort_values("at")
    tables = [{(w["p"], w["q"]): (w["cost"], w["audit"]) for w in ws} for ws in rows["weights"]]
    starts = sorted({p for p, _ in tables[0]})

    def edges(i: int, q: int) -> Iterator[Edge]:
        if i < len(tables):
            for (p, q2), (cost, audit) in tables[i].items():
                if p == q:
                    yield i + 1, q2, cost, audit

    weights = [w for p in starts for w in weights_of(p, lightest(p, edges, len(tables), trace=True))]
    ends = "".join(x[0] + x[-1] for x in rows["initials"])
    joints = sum(illegal_pairs(ends[i : i + 2]) for i in range(1, len(ends) - 1, 2))
    row = (rows["key"].iloc[0], int(rows["up"].iloc[0]), int(rows["illegal"].sum()) + joints, ends[0] + ends[-1], rows["at"].tolist(), weights)
    return pd.DataFrame([row], columns=["key", "at", "illegal", "initials", "children", "weights"])


@tidy
def edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per row what is inserted before and behind it, its edit, and the role that it gets if not its own."""
    for batch in batches:
        out = []
        for r in batch.itertuples():
            q, i, before = r.p, 0, []
            for sign in r.audit:
                role = None
                if sign in "IR":
                    x = next(x for x in ROLES if (q, x) in NEXT)
                    q, role = NEXT[q, x], ROLES[x]
                elif sign == "K":
                    q = NEXT[q, r.initials[i]]
                if sign == "I":
                    before.append(role)
                else:
                    out.append([r.first + i, before, sign, role, []])
                    i, before = i + 1, []
            out[-1][4] = before
        yield pd.DataFrame(out, columns=["pos", "before", "edit", "new_role", "after"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a report by conversation, the repaired conversations) of rows (conv_id, turn, role, text).

    The report has key (see key_of), gaps, blank, duplicate, truncated, illegal, cost and audit; the
    conversations have key, pos (rising along a conversation), and lines, an array of (role, text).
    Rows go by turn, null first; rows of one turn by role, then by the SHA-256 of their text, and equal
    ones lie together.  A null role or text is one space, so that such a text is blank and such a role
    none of the three; a null conv_id is a conversation of its own.  Very long texts are read whole
    and conversations of any length are repaired whole.  Other columns are ignored; an empty table
    gives no rows.
    """
    turns = numbered_turns(rows)
    sums = [F.coalesce(F.sum((F.col("fault") == x).cast("long")), F.lit(0)) for x in "bdt"]
    by_turn = turns.groupBy("key", "turn").agg(*(x.alias(n) for x, n in zip(sums, ("blank", "duplicate", "truncated"), strict=True)))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    counts = by_turn.groupBy("key").agg(gaps, *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")))

    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("-")
    blocks = turns.select("key", "pos", "fault", initial.alias("initial"), F.shiftright("pos", BLOCK_BITS).alias("block"))
    parts = store(blocks.groupBy("block").applyInPandas(parts_of, PARTS), "parts")
    level, levels = parts.where("open").select("key", "at", "illegal", "initials", "weights"), []
    while level.groupBy("key").count().where("count > 1").limit(1).count():
        up = level.withColumn("up", F.shiftright("at", FAN_BITS))
        levels.append(store(up.groupBy("key", "up").applyInPandas(merged, MERGED), "merged"))
        level = levels[-1].select("key", "at", "illegal", "initials", "weights")

    goals = parts.where("not open").select("key", "at", "illegal", "weights", F.lit(False).alias("open")).unionByName(level.select("key", "at", "illegal", "weights", F.lit(True).alias("open")))
    goals = goals.select("key", "at", "illegal", "open", F.explode("weights").alias("w")).where(F.col("w.p") == 0).where(F.col("w.q").isin(*GOALS))
    best = goals.groupBy("key").agg(F.min(F.struct("w.cost", "w.audit", "w.q", "at", "illegal", "open")).alias("b")).select("key", "b.*")
    best = store(best, "best")
    report = counts.join(best.select("key", "illegal", "cost", "audit"), "key")

    chosen = best.where("open").select("key", "at", F.lit(0).alias("p"), "q")
    for each in reversed(levels):
        own = chosen.join(each.select("key", "at", "children", "weights"), ["key", "at"])
        way = F.filter("weights", lambda w: (w["p"] == F.col("p")) & (w["q"] == F.col("q")))[0]["path"]
        steps = own.select("key", way.alias("way"), F.posexplode("children").alias("i", "at"))
        chosen = steps.select("key", "at", F.get("way", F.col("i")).alias("p"), F.get("way", F.col("i") + 1).alias("q"))
    piece = F.filter("weights", lambda w: (w["p"] == F.col("p")) & (w["q"] == F.col("q")))[0]["audit"]
    pieces = parts.where("open").join(store(chosen, "chosen"), ["key", "at"]).select("first", "p", "initials", piece.alias("audit"))
    pieces = pieces.unionByName(parts.where("not open").select("first", F.lit(0).alias("p"), "initials", F.col("weights")[0]["audit"].alias("audit")))
    done = pieces.mapInPandas(edits, "pos long, before array<string>, edit string, new_role string, after array<string>")

    empty = lambda x: F.struct(x.alias("role"), F.lit("").alias("text"))
    own = F.when(F.col("edit") != "D", F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))).otherwise(F.array())
    lines = turns.join(done, "pos").select("key", "pos", F.concat(F.transform("before", empty), own, F.transform("after", empty)).alias("lines"))
    return report, lines


def digests(lines: DataFrame) -> DataFrame:
    """key and repaired_sha256: of `role:text` of a conversation's rows, joined by line ends.

    The hash is one sequence by its definition: a conversation's rows stream through one task, a batch at a time.
    """

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha, some = None, None, False
        for batch in batches:
            out = []
            for own, line in zip(batch["key"], batch["line"], strict=True):
                if own != key:
                    if sha is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha, some = own, hashlib.sha256(), False
                if line is not None:
                    sha.update(b"\n" * some + line.encode())
                    some = True
            yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
        if sha is not None:
            yield pd.DataFrame([(key, sha.hexdigest())], columns=["key", "repaired_sha256"])

    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n"))
    return lines.select("key", "pos", line.alias("line")).repartition(n, "key").sortWithinPartitions("key", "pos").mapInPandas(run, "key string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """key, place (from 0 up), role and text of the repaired conversations."""
    lines = repair(rows)[1].select("key", "pos", F.posexplode("lines").alias("i", "x"))
    return lines.select("key", F.struct("pos", "i").alias("place"), "x.role", "x.text")


def repair_report(original: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conv_id of `original`: what is wrong with its rows, the cheapest repair and the hash of its result.

    Conversations without rows have zeros, an empty audit and the hash of the empty string.  See repair().
    """
    report, lines = repair(rows)
    every = original.select("conv_id").distinct().withColumn("key", key_of())
    found = every.join(report.join(digests(lines), "key"), "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_report(rows, damage(rows))
