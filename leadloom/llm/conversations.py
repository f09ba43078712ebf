"""Conversation structure repair by signature deduplication.

A sound conversation is empty, or an optional system turn followed by user and assistant
turns in pairs. A row's first fault counts: blank (nothing but white space), duplicate (its role
and text occur earlier in the conversation), truncated (the last character that is no white
space is none of ``.!?``).

1. Every row becomes a fact of fixed size: where it stands, the hash of role and text, the
   initial of its role and its own faults. Facts, not texts, are shuffled: by ranges of
   (conversation, turn, ...), so a hot conversation lies in many partitions.
2. A row is a duplicate if its hash has an earlier place in the conversation; only hashes that
   occur twice are joined back.
3. The facts of a conversation in one partition make a piece of its signature, one
   character a row; pieces make the signature.
4. Each distinct signature is solved once, by memoised recursion over (row, what the output
   ends with, inserts in a row). The least cost is kept for every state, so the ASCII-least of the
   cheapest audits is read off forwards.
5. Audits are joined back to the conversations by signature, and their edits replayed on the
   rows: texts meet their edits by (conversation, turn, hash), so one conversation's
   texts are spread over tasks.

Rows of one turn stand in order of role, the first 64 characters of the text and the hash
of role and text; null turns come first. A null conversation id is a conversation of its own, a null
role or text is one space (so such a text is blank). Roles other than those that begin with s, u or a
cannot be kept, only renamed or deleted. Repeated rows are duplicates. Long texts are read
whole, by built-in functions. An empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable

WHITE = " \t\n\x0b\x0c\r"
#: Characters of a signature, by initial (system, user, assistant, other): sound, truncated, blank, duplicate.
SOUND, TRUNCATED, BLANK, DUPLICATE = "suao", "SUAO", "0123", "4567"
KEEP, REROLE, DELETE, INSERT = "KRDI"
PRICE = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
UNFINISHED = 3  # what an undeleted truncated row adds
#: What the output ends with: nothing, a system, a user, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STRIDE = 50  # rows by which recursion goes deeper at most
LEGAL = {"su", "ua", "au"}
SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, lines array<struct<place:int,role:string,edit:string>>"


def _key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, text, copies of the rows of (conv_id, turn, role, text); copies is 0 for a dropped row.

    By crc32(conv_id:turn) % 20 a row is dropped (0), emptied (1), stripped of ``.!?`` (2),
    repeated (3) or given the role user (4); the others are left as they are.
    """
    turn, text, role = F.crc32(F.concat(_key(rows["conv_id"]), F.lit(":"), _key(rows["turn"])).cast("binary")) % 20, _key(rows["text"]), _key(rows["role"])
    return rows.select(
        _key(rows["conv_id"]).alias("conv"), rows["conv_id"].alias("conv_id"), rows["turn"].cast("long").alias("turn"),
        F.when(turn == 4, "user").otherwise(role).alias("role"),
        F.when(turn == 1, "").when(turn == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(turn == 0, 0).when(turn == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """The same columns of rows that are taken as they are."""
    return rows.select(_key(rows["conv_id"]).alias("conv"), rows["conv_id"].alias("conv_id"), rows["turn"].cast("long").alias("turn"), _key(rows["role"]).alias("role"), _key(rows["text"]).alias("text"), F.lit(1).alias("copies"))


def _name() -> Column:
    """128 bits of hash of a row's role and text."""
    return F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


def _facts(rows: DataFrame) -> DataFrame:
    """One row of bounded size for each row, ordered: seq grows with (conv, turn, role, text); dropped rows have no kind."""
    tail = F.expr(r"right(rtrim(' \t\n\u000b\u000c\r', text), 1)")
    kind = F.when(F.col("copies") == 0, "").when(tail == "", "b").when(F.instr(F.lit(".!?"), tail) > 0, "-").otherwise("t")
    initial = F.left("role", F.lit(1))
    place = F.greatest(F.instr(F.lit(SOUND[:3]), initial) * (F.length(initial) > 0).cast("int"), F.lit(0))  # 1 to 3, or 0: other
    facts = rows.select("conv", "conv_id", "turn", F.col("role").alias("named"), F.left("text", F.lit(64)).alias("tie"), _name().alias("h"), F.when(place > 0, place - 1).otherwise(3).cast("byte").alias("who"), kind.alias("kind"), F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy"))
    order = ["conv", F.asc_nulls_first("turn"), "named", "tie", "h"]
    dealt = facts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    return durable(dealt.drop("tie", "copy"), "conv-facts")


def _pieces(facts: DataFrame) -> DataFrame:
    """conv, conv_id, part, rows, sig, before: the signature's piece of each partition, and how many rows stand before it."""
    alive = facts.filter("kind != ''")
    again = alive.filter("kind != 'b'").groupBy("conv", "h").agg(F.min("seq").alias("first"), F.count("*").alias("c")).filter("c > 1")
    marked = facts.join(durable(again.drop("c"), "conv-again"), ["conv", "h"], "left")
    row = F.when(F.col("kind") == "b", F.lit(BLANK)).when(F.col("seq") > F.col("first"), F.lit(DUPLICATE)).when(F.col("kind") == "t", F.lit(TRUNCATED)).otherwise(F.lit(SOUND))
    code = F.when(F.col("kind") == "", F.lit("")).otherwise(F.substring(row, F.col("who") + 1, F.lit(1)))
    one = F.struct("seq", code.alias("code"), "turn", "named", "h")
    pieces = marked.groupBy("conv", "conv_id", F.shiftright("seq", 33).alias("part")).agg(F.filter(F.array_sort(F.collect_list(one)), lambda x: x["code"] != "").alias("rows"))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return durable(pieces.withColumns({"sig": F.array_join(F.transform("rows", lambda x: x["code"]), ""), "before": F.coalesce(F.sum(F.size("rows")).over(before), F.lit(0))}), "conv-pieces")


def solve(signature: str) -> tuple[int, str, list[tuple[int, str, str]]]:
    """(least cost, ASCII-least of the cheapest audits, lines of the output as (row or -1, role or '' if kept, edit))."""
    n = len(signature)
    kind = bytes(0 if c in SOUND else 1 if c in TRUNCATED else 2 for c in signature)
    who = ["suao"[max(group.find(c) for group in (SOUND, TRUNCATED, BLANK, DUPLICATE))] for c in signature]
    memo = array("q", [-1]) * (12 * (n + 1))
    never = 1 << 60

    def moves(i: int, state: int, inserts: int) -> Iterator[tuple[str, int, int, int, int]]:
        """(edit, price, next row, next state, next inserts), by the ASCII order of the edits."""
        to = ASSISTANT if state == USER else USER
        if i < n:
            yield DELETE, PRICE[DELETE], i + 1, state, 0
        if inserts < 2:  # a third would come back to a state that was there
            yield INSERT, PRICE[INSERT], i, to, inserts + 1
        if i < n and kind[i] < 2:
            more = UNFINISHED * kind[i]
            kept = {"s": SYSTEM if state == START else -1, "u": USER if to == USER else -1, "a": ASSISTANT if to == ASSISTANT else -1}.get(who[i], -1)
            if kept >= 0:
                yield KEEP, PRICE[KEEP] + more, i + 1, kept, 0
            yield REROLE, PRICE[REROLE] + more, i + 1, to, 0

    def cost(i: int, state: int, inserts: int) -> int:
        at = 12 * i + 3 * state + inserts
        if memo[at] < 0:
            least = 0 if i == n and state in (START, ASSISTANT) else never
            for _, price, j, after, turn in moves(i, state, inserts):
                least = min(least, price + cost(j, after, turn))
            memo[at] = least
        return memo[at]

    for i in range(n, 0, -STRIDE):  # so that recursion meets what is known after STRIDE rows
        for state in range(4):
            cost(i, state, 0)
    total, audit, lines = cost(0, START, 0), [], []
    i, state, inserts = 0, START, 0
    while i < n or state not in (START, ASSISTANT):
        for edit, price, j, after, turn in moves(i, state, inserts):
            if price + cost(j, after, turn) == cost(i, state, inserts):
                audit.append(edit)
                if edit != DELETE:
                    role = "" if edit == KEEP else "user" if after == USER else "assistant"
                    lines.append((-1 if edit == INSERT else i, role, edit))
                i, state, inserts = j, after, turn
                break
    return total, "".join(audit), lines


def _solve_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("signature", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("lines", pa.list_(pa.struct([("place", pa.int32()), ("role", pa.string()), ("edit", pa.string())])))])
    names = str.maketrans(SOUND + TRUNCATED + BLANK + DUPLICATE, SOUND * 4)
    for batch in batches:
        for s in batch.column("signature").to_pylist():
            cost, audit, lines = solve(s)
            who = s.translate(names)
            count = [sum(map(s.count, group)) for group in (BLANK, DUPLICATE, TRUNCATED)]
            illegal = sum(who[i : i + 2] not in LEGAL for i in range(len(who) - 1))
            row = {"signature": s, "blank": count[0], "duplicate": count[1], "truncated": count[2], "illegal": illegal, "cost": cost, "audit": audit, "lines": [dict(zip(("place", "role", "edit"), x, strict=True)) for x in lines]}
            yield pa.RecordBatch.from_pylist([row], schema=schema)


def audit_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows as damage() gives them: what was found in each conversation, and its repaired lines.

    The first has conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; the
    second has conv, conv_id, position, turn, edit, role, text, a row for each line that is left.
    """
    facts = _facts(rows)
    pieces = _pieces(facts)
    parts = F.array_sort(F.collect_list(F.struct("part", "sig")))
    whole = durable(pieces.groupBy("conv", "conv_id").agg(F.array_join(F.transform(parts, lambda x: x["sig"]), "").alias("signature")), "conv-signatures")
    solved = durable(whole.select("signature").distinct().mapInArrow(_solve_all, SOLVED), "conv-solved")
    judged = durable(whole.join(solved, "signature").drop("signature"), "conv-judged")
    turns = facts.filter("kind != ''").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    found = judged.drop("lines").join(turns, "conv", "left").select("conv", "conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    lines = judged.select("conv", "conv_id", F.posexplode("lines").alias("position", "line")).select("conv", "conv_id", "position", "line.*")
    placed = pieces.select("conv", "before", F.posexplode("rows").alias("at", "row")).select("conv", (F.col("before") + F.col("at")).cast("int").alias("place"), "row.turn", "row.named", "row.h")
    known = lines.filter("place >= 0").join(placed, ["conv", "place"]).withColumn("role", F.when(F.col("role") == "", F.col("named")).otherwise(F.col("role")))
    # repeats of a row are one text here, as no second one is left
    texts = rows.filter("copies > 0").select("conv", _key(F.col("turn")).alias("turn_key"), _name().alias("h"), "text").groupBy("conv", "turn_key", "h").agg(F.first("text").alias("text"))
    known = known.withColumn("turn_key", _key(F.col("turn"))).join(texts, ["conv", "turn_key", "h"])
    columns = ["conv", "conv_id", "position", "turn", "edit", "role", "text"]
    made = lines.filter("place < 0").withColumns({"turn": F.lit(None).cast("long"), "text": F.lit("")})
    return found, known.select(columns).unionByName(made.select(columns))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order; only the hash's state is held."""
    now, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv": [now], "repaired_sha256": [state.hexdigest()]})

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c) for c in ("conv", "role", "text")), strict=True):
            if conv.as_py() != now:
                if state is not None:
                    yield done()
                now, state = conv.as_py(), hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(role.as_py().encode() + b":")
            state.update(text.as_buffer())
    if state is not None:
        yield done()


def repair_digests(rows: DataFrame) -> DataFrame:
    """What was found in each conversation of damage()'s rows, with the SHA-256 of its repaired ``role:text`` lines.

    One conversation's hash is one sequential computation, so its lines pass through one
    task, sorted by Spark and read as a stream.
    """
    found, lines = audit_conversations(rows)
    dealt = lines.select("conv", "position", "role", "text").repartition("conv").sortWithinPartitions("conv", "position")
    hashes = dealt.mapInArrow(_digests, "conv string, repaired_sha256 string")
    none = hashlib.sha256().hexdigest()
    return found.join(hashes, "conv", "left").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
