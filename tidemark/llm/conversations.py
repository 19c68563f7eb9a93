"""Repair of damaged conversations: cheapest edits through an automaton that shares suffixes.

The rows of a conversation, in order, spell a signature, a letter per row for its role and fault. What the
best repair of a signature costs from a row on depends on the rest of the signature and on the state of the
grammar alone. So signatures are minimised from the end: equal rests are one node, and the cost to go and the
best audit of a node are worked out once per state for all conversations. Distinct signatures are dealt out by
ranges of their reversed text; within a range neighbours share the nodes of their common end, which stay on a
stack. A node is worked out twice only on the path between two ranges.

Long conversations are cut into blocks. The table of a block says, for each state before and after it, what
its best audit costs; blocks are chained from the end. An insertion belongs to the row that follows it, or to
the end of the conversation, so the audits of a block never continue one another and ties stay comparable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, partitions, tidied, written

BLOCK_ROWS = 64
BLOCK_BYTES = 1 << 16
TURNS = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 60
LAST_LONG = 2**63 - 1

# states of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# the state after a row that takes the role the grammar asks for
ASKED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
TAIL = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
GONE = "x"

# a table: for each state before and each state after, the cost and the least audit
Table = list[list[tuple[int, str]]]


# --- the automaton ---


def end_table() -> Table:
    """The table of an empty rest."""
    return [[(0, "") if p == q else (NEVER, "") for q in STATES] for p in STATES]


def node_table(letter: str, rest: Table) -> Table:
    """The table of ``letter`` followed by a rest."""
    role, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
    direct: Table = []
    for p in STATES:
        ways = [(DELETE, "D", p)]
        if letter != GONE:
            ways.append((REROLE + extra, "R", ASKED[p]))
            if (p, role) in KEPT:
                ways.append((KEEP + extra, "K", KEPT[p, role]))
        direct.append([min((cost + rest[to][q][0], edit + rest[to][q][1]) for cost, edit, to in ways) for q in STATES])
    table = direct
    for _ in range(3):  # more insertions than this come back to a state they have left
        table = [[min(direct[p][q], (INSERT + table[ASKED[p]][q][0], "I" + table[ASKED[p]][q][1])) for q in STATES] for p in STATES]
    return [[entry if entry[0] < NEVER else (NEVER, "") for entry in row] for row in table]


def tables(signatures: Iterator[str]) -> Iterator[tuple[str, Table]]:
    """The table of each signature; those with a common end share its nodes if they are neighbours."""
    stack, before = [end_table()], ""
    for signature in signatures:
        spelled = signature[::-1]
        shared = 0
        while shared < min(len(spelled), len(before)) and spelled[shared] == before[shared]:
            shared += 1
        del stack[shared + 1 :]
        for letter in spelled[shared:]:
            stack.append(node_table(letter, stack[-1]))
        before = spelled
        yield signature, stack[-1]


def _solved(signatures: DataFrame) -> DataFrame:
    """``sig, costs, audits`` of distinct signatures, 16 entries each by state before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (s for batch in batches for s in batch.column("sig").to_pylist())
        held = []

        def made() -> pa.RecordBatch:
            flat = [[e for row in table for e in row] for _, table in held]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([s for s, _ in held], pa.string()),
                    pa.array([[c for c, _ in f] for f in flat], pa.list_(pa.int64())),
                    pa.array([[a for _, a in f] for f in flat], pa.list_(pa.string())),
                ],
                ["sig", "costs", "audits"],
            )

        for solved in tables(texts):
            held.append(solved)
            if len(held) == 512:
                yield made()
                held = []
        if held:
            yield made()

    dealt = signatures.repartitionByRange(partitions(signatures.sparkSession), F.reverse("sig")).sortWithinPartitions(F.reverse("sig"))
    return dealt.mapInArrow(tidied(run), "sig string, costs array<long>, audits array<string>")


# --- rows, blocks ---


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after the damage that the hash of id and turn decides.

    Nulls of role and text count as one blank, in the hash also those of id and turn.
    """
    blank = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.pmod(F.crc32(place.cast("binary")), F.lit(20))
    text = F.coalesce("text", blank)
    return conversations.filter(fault != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def _stretch() -> Column:
    """Which run of turns a row belongs to; blocks of different runs are made by different tasks."""
    return F.floor(F.col("turn") / TURNS).alias("stretch")


def _repeats(rows: DataFrame) -> DataFrame:
    """The ``conv_id, turn, role, digest`` that an earlier turn of the conversation has had."""
    keys = ["conv_id", "role", "digest"]
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    found = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    return rows.join(found, same).filter(place != F.col("first")).select("conv_id", "turn", "role", "digest").distinct()


BLOCK_SCHEMA = (
    "conv_id long, stretch long, part int, sig string, roles array<string>, texts array<string>, opens string, closes string, "
    "illegal long, blank long, duplicate long, truncated long, least long, most long, turns long"
)
BLOCK_TYPE = pa.schema(
    [("conv_id", pa.int64()), ("stretch", pa.int64()), ("part", pa.int32()), ("sig", pa.string()), ("roles", pa.list_(pa.string())),
     ("texts", pa.list_(pa.string())), ("opens", pa.string()), ("closes", pa.string())]
    + [(n, pa.int64()) for n in ("illegal", "blank", "duplicate", "truncated", "least", "most", "turns")]
)


def _blocks(rows: DataFrame) -> DataFrame:
    """Runs of at most BLOCK_ROWS rows, or BLOCK_BYTES of text, of one conversation, in order."""
    marks = _repeats(rows.select("conv_id", "turn", "role", "digest"))
    rows = rows.select("conv_id", "turn", "role", "digest", "text", "copies")
    marks = marks.select("*", F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"))
    met = rows.unionByName(marks).withColumn("stretch", _stretch())
    met = met.repartition(partitions(rows.sparkSession), "conv_id", "stretch")
    met = met.sortWithinPartitions("conv_id", "stretch", "turn", "role", "digest", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, out = None, None, []
        block: dict = {}
        part, turn = 0, None

        def opened() -> dict:
            counts = dict.fromkeys(("illegal", "blank", "duplicate", "truncated", "turns"), 0)
            return {"letters": [], "roles": [], "texts": [], "bytes": 0, "opens": "", "closes": "", "least": None, "most": None, **counts}

        def closed() -> dict:
            named = {k: v for k, v in block.items() if k not in ("letters", "bytes")}
            return {"conv_id": at[0], "stretch": at[1], "part": part, "sig": "".join(block["letters"]), **named}

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256).to_pylist()
                for row in piece:
                    here = (row["conv_id"], row["stretch"])
                    if here != at:
                        if at is not None and block["letters"]:
                            out.append(closed())
                        at, seen, part, turn, block = here, None, 0, (), opened()
                    same = (row["turn"], row["role"], row["digest"])
                    if row["copies"] == 0:
                        seen = same
                        continue
                    for _ in range(row["copies"]):
                        if len(block["letters"]) >= BLOCK_ROWS or block["bytes"] >= BLOCK_BYTES:
                            out.append(closed())
                            part, block = part + 1, opened()
                        first = row["role"][:1]
                        end = row["text"].rstrip(SPACE)
                        if not end:
                            letter, fault = GONE, "blank"
                        elif same == seen:
                            letter, fault = GONE, "duplicate"
                        else:
                            letter, fault = (first if first in ("s", "u", "a") else "o"), None
                            if end[-1] not in ".!?":
                                letter, fault = letter.upper(), "truncated"
                        if fault:
                            block[fault] += 1
                        if block["letters"]:
                            block["illegal"] += block["closes"] + first not in LEGAL
                        else:
                            block["opens"] = first
                        block["closes"] = first
                        block["letters"].append(letter)
                        # what must go is not needed for the repaired text
                        block["roles"].append("" if letter == GONE else row["role"])
                        block["texts"].append("" if letter == GONE else row["text"])
                        block["bytes"] += 0 if letter == GONE else len(row["text"])
                        if row["turn"] is not None:
                            block["turns"] += row["turn"] != turn
                            turn = row["turn"]
                            block["least"] = turn if block["least"] is None else block["least"]
                            block["most"] = turn
                        seen = same
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=BLOCK_TYPE)
                    out = []
        if at is not None and block["letters"]:
            out.append(closed())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=BLOCK_TYPE)

    return met.mapInArrow(tidied(run), BLOCK_SCHEMA)


# --- conversations ---


def _chained(blocks: DataFrame, solved: DataFrame) -> DataFrame:
    """A row per block with its piece of the best audit; the first of a conversation has the totals."""
    counts = ["illegal", "blank", "duplicate", "truncated", "least", "most", "turns"]
    small = blocks.select("conv_id", "stretch", "part", "sig", "opens", "closes", *counts).join(solved, "sig")
    # from the end: turns fall, null turns come last
    small = small.repartition(partitions(blocks.sparkSession), "conv_id")
    small = small.sortWithinPartitions("conv_id", F.desc_nulls_last("stretch"), F.desc("part"))
    schema = pa.schema(
        [("conv_id", pa.int64()), ("stretch", pa.int64()), ("part", pa.int32()), ("state", pa.int32()), ("piece", pa.string())]
        + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, going, choices, total, opens, out = (), None, [], {}, None, []

        def ended() -> None:
            """Walk forward over the blocks of the conversation with the choices that were made from the end."""
            state = START
            cost, audit = going[START]
            span = 0
            if total["least"] is not None:
                span = min(total["most"] - total["least"] + 1 - total["turns"], LAST_LONG)
            for at, (place, options) in enumerate(reversed(choices)):
                to, piece = options[state]
                row = {"conv_id": current, "stretch": place[0], "part": place[1], "state": state, "piece": piece}
                if at == 0:
                    row |= {"gaps": span, "cost": cost, "audit": audit}
                    row |= {n: total[n] for n in ("blank", "duplicate", "truncated", "illegal")}
                out.append(row)
                state = to

        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != current:
                    if choices:
                        ended()
                    current, going, choices, opens = row["conv_id"], [TAIL[p] for p in STATES], [], None
                    total = {"least": None, "most": None} | dict.fromkeys(("illegal", "blank", "duplicate", "truncated", "turns"), 0)
                for name in ("illegal", "blank", "duplicate", "truncated", "turns"):
                    total[name] += row[name]
                if row["least"] is not None:
                    total["least"] = row["least"]
                    total["most"] = row["most"] if total["most"] is None else total["most"]
                total["illegal"] += opens is not None and row["closes"] + opens not in LEGAL
                opens = row["opens"]
                best = [
                    min((row["costs"][4 * p + q] + going[q][0], row["audits"][4 * p + q] + going[q][1], q) for q in STATES) for p in STATES
                ]
                choices.append(((row["stretch"], row["part"]), [(q, row["audits"][4 * p + q]) for p, (_, _, q) in enumerate(best)]))
                going = [(cost, audit) for cost, audit, _ in best]
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if choices:
            ended()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return small.mapInArrow(
        tidied(run),
        "conv_id long, stretch long, part int, state int, piece string, gaps long, blank long, duplicate long, truncated long, "
        "illegal long, cost long, audit string",
    )


def repaired_lines(roles: list[str], texts: list[str], state: int, audit: str) -> Iterator[str]:
    """``role:text`` of the rows that a piece of an audit leaves or puts in."""
    at = 0
    for edit in audit:
        if edit == "I":
            state = ASKED[state]
            yield f"{NAMES[state]}:"
            continue
        if edit == "R":
            state = ASKED[state]
            yield f"{NAMES[state]}:{texts[at]}"
        elif edit == "K":
            state = KEPT[state, roles[at][0]]
            yield f"{roles[at]}:{texts[at]}"
        at += 1


TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` per conversation.

    Rows are damaged by :func:`damaged` first. Then a conversation has its rows by turn, null turns first;
    rows of one turn by role, then by the SHA-256 of their text, so equal rows are neighbours. The first
    fault of a row counts: blank, duplicate (role and text stood earlier), truncated. ``audit`` has the
    cheapest edits that leave roles whose initials spell ``(s?(ua)+)?``, the least in ASCII among equals:
    K keeps a row, R gives it the role the grammar asks for, D deletes it, I inserts an empty row.

    Every ``conv_id`` of the input has a row, the null one too; without rows after the damage it has zeros,
    an empty audit and the hash of nothing. A role without a character, or whose first is not s, u or a,
    cannot be kept. ``gaps`` stays at the largest long where the span of turns is beyond it. Other columns
    are not read; an empty table gives no rows.

    A conversation is cut by its turns, so a long one is not one task's work, but for what its result needs
    as a whole: its audit is one value and its hash reads the repaired text once, in order, as a stream.
    """
    spark = conversations.sparkSession
    rows = damaged(conversations).withColumn("digest", F.sha2("text", 256))
    blocks = written(_blocks(rows), "conversation-blocks")
    solved = written(_solved(blocks.select("sig").distinct()), "conversation-signatures")
    chained = written(_chained(blocks, solved), "conversation-audits")

    none = {n: F.lit(None).cast("long").alias(n) for n in TOTALS}
    no_rows = F.lit(None).cast("array<string>")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    absent = [F.lit(None).cast("long").alias("stretch"), F.lit(-1).alias("part"), F.lit(-1).alias("state"), F.lit("").alias("piece")]
    ids = ids.select("conv_id", *absent, *none.values(), F.lit(None).cast("string").alias("audit"), no_rows.alias("roles"), no_rows.alias("texts"))
    pieces = chained.select("conv_id", "stretch", "part", "state", "piece", *TOTALS, "audit", no_rows.alias("roles"), no_rows.alias("texts"))
    held = blocks.select(
        "conv_id", "stretch", "part", F.lit(STATES[-1] + 1).alias("state"), F.lit("").alias("piece"), *none.values(),
        F.lit(None).cast("string").alias("audit"), "roles", "texts",
    )
    met = ids.unionByName(pieces).unionByName(held).repartition(partitions(spark), "conv_id")
    met = met.sortWithinPartitions("conv_id", "stretch", "part", "state")
    schema = pa.schema([("conv_id", pa.int64())] + [(n, pa.int64()) for n in TOTALS] + [("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, result, digest, empty, piece, out = (), None, None, True, None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if row["conv_id"] != current or result is None:
                        if result is not None:
                            out.append(result | {"repaired_sha256": digest.hexdigest()})
                        current, digest, empty = row["conv_id"], hashlib.sha256(), True
                        result = {"conv_id": current, **dict.fromkeys(TOTALS, 0), "audit": ""}
                    if row["roles"] is None:
                        if row["cost"] is not None:
                            result |= {n: row[n] for n in (*TOTALS, "audit")}
                        piece = (row["state"], row["piece"])
                        continue
                    for line in repaired_lines(row["roles"], row["texts"], *piece):
                        digest.update(("" if empty else "\n").encode() + line.encode())
                        empty = False
                if len(out) >= 1024:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if result is not None:
            out.append(result | {"repaired_sha256": digest.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return met.mapInArrow(
        tidied(run), ", ".join(["conv_id long", *[f"{n} long" for n in TOTALS], "audit string", "repaired_sha256 string"])
    )
