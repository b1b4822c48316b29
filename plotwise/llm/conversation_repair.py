"""Operator 11: conversations brought into a legal order of roles by the cheapest edits, found by a Viterbi search whose survivors coalesce.

A repaired conversation has the role initials ``(s?(ua)+)?``. Rows are kept, given another role, deleted (blank rows and repeats must be), or a row
without text is inserted. The search reads a conversation row by row and keeps, for each state of that pattern, the cheapest edits that
lead to it. The edits are a tree of back pointers with reference counts: what no survivor needs is freed, and as soon as all survivors
descend from one edit, the edits up to it are settled and given out. So what is held is the part on which survivors differ, not
the conversation.

Of edits that cost the same, the least string of initials counts. Two survivors can cost the same without their strings differing only at the end: the
comparison is of the whole unsettled suffixes. It is kept as a rank, which each row carries on: survivors of a row have strings of which none begins
another, so a longer string is ordered by the rank of the survivor that it extends and then by its new letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Costs of the edits, by initial, and what a truncated row costs unless it is deleted.
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
#: White space, in patterns and as signs.
BLANK, SIGNS = r"\x20\x09-\x0D", " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WANTED = ("user", "user", "assistant", "user")
#: BEHIND[x][y]: at most this much more does it cost to go on from y than from x. From USER an assistant row is inserted to be where ASSISTANT
#: is, and so on; from ASSISTANT a system row that START may keep is deleted. A survivor in x that costs more than one in y and this can no
#: longer be part of the cheapest edits, nor tie with them.
BEHIND = ((0, 10, 7, 2), (0, 0, 5, 0), (5, 5, 0, 5), (0, 10, 5, 0))

EDITS = "conv_id long, place long, edit string, turn long, old_role string, role string, text string, fault string"


class Edit:
    """An edit in the tree: ``refs`` counts the edits and survivors that follow it."""

    __slots__ = ("before", "letter", "role", "row", "refs")

    def __init__(self, before, letter, role, row):
        self.before, self.letter, self.role, self.row, self.refs = before, letter, role, row, 0
        if before is not None:
            before.refs += 1


class Repair:
    """The search over one conversation. ``push`` takes a row (initial, must be deleted, truncated, anything) and gives the edits that are settled
    by it; ``finish`` gives the rest. ``held`` counts the edits in the tree."""

    def __init__(self):
        self.root = Edit(None, "", None, None)
        self.root.refs = 1
        self.held = 0
        self.live = {START: (0, (0, ""), self.root)}
        self._settle_layer({START: (0, (0, ""), self.root)})

    def _free(self, node: Edit) -> None:
        while not node.refs and node.before is not None:
            self.held -= 1
            node, gone = node.before, node
            node.refs -= 1
            gone.before = None

    def _settle_layer(self, layer: dict) -> None:
        """``layer``: state -> (cost, key, leaf) after a row. Adds what inserted rows lead to, leaves out the hopeless and frees what they held."""
        ranked = sorted(layer, key=lambda s: layer[s][1])
        layer = {s: (layer[s][0], (rank, ""), layer[s][2]) for rank, s in enumerate(ranked)}
        full = dict(layer)
        for s in (START, SYSTEM, ASSISTANT, USER):
            if s in full:
                cost, key, leaf = full[s]
                to, new = USER if s != USER else ASSISTANT, (cost + COSTS["I"], (key[0], key[1] + "I"))
                if to not in full or new < full[to][:2]:
                    full[to] = (*new, (leaf, WANTED[s]))
        keep = [x for x in full if not any(full[x][0] > full[y][0] + BEHIND[x][y] for y in full)]
        # sources of inserted rows first: an inserted row may follow an inserted one
        made: dict = {}

        def leaf_of(place):
            if isinstance(place, Edit):
                return place
            if id(place) not in made:
                made[id(place)] = Edit(leaf_of(place[0]), "I", place[1], None)
                self.held += 1
            return made[id(place)]

        before, self.live = self.live, {s: (full[s][0], full[s][1], leaf_of(full[s][2])) for s in keep}
        for _, _, leaf in self.live.values():
            leaf.refs += 1
        for _, _, leaf in before.values():
            leaf.refs -= 1
        for node in [x[2] for x in before.values()] + [x[2] for x in layer.values()] + list(made.values()):
            self._free(node)

    def push(self, row: tuple) -> list[Edit]:
        initial, must_go, cut, _ = row
        layer: dict = {}

        def offer(state, cost, key, leaf, letter, role):
            if state not in layer or (cost, key) < layer[state][:2]:
                layer[state] = (cost, key, leaf, letter, role)

        more = TRUNCATED if cut else 0
        for state, (cost, (rank, tail), leaf) in self.live.items():
            offer(state, cost + COSTS["D"], (rank, tail + "D"), leaf, "D", None)
            if not must_go:
                to = NEXT[state].get(initial)
                if to is not None:
                    offer(to, cost + more, (rank, tail + "K"), leaf, "K", None)
                role = WANTED[state]
                offer(NEXT[state][role[0]], cost + more + COSTS["R"], (rank, tail + "R"), leaf, "R", role)
        self.held += len(layer)
        self._settle_layer({s: (cost, key, Edit(leaf, letter, role, row)) for s, (cost, key, leaf, letter, role) in layer.items()})
        return self._settled()

    def _settled(self) -> list[Edit]:
        if self.root.refs != 1 or any(leaf is self.root for _, _, leaf in self.live.values()):
            return []
        ends = {id(leaf) for _, _, leaf in self.live.values()}
        path, node = [], next(iter(self.live.values()))[2]
        while node is not self.root:
            path.append(node)
            node = node.before
        out = []
        while path:
            node = path.pop()
            out.append(node)
            if node.refs != 1 or id(node) in ends:
                break
        self._move_root(out)
        return out

    def _move_root(self, out: list[Edit]) -> None:
        if out:
            self.root = out[-1]
            self.root.before = None
            self.held -= len(out)

    def finish(self) -> list[Edit]:
        _, _, node = min((self.live[s] for s in (START, ASSISTANT) if s in self.live), key=lambda x: x[:2])
        out = []
        while node is not self.root:
            out.append(node)
            node = node.before
        return out[::-1]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of conversations whose rows come one after the other: conv_id, turn, role, text, fault."""
    names = [c.split()[0] for c in EDITS.split(", ")]
    schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (c.split() for c in EDITS.split(", "))])
    out: dict = {n: [] for n in names}
    now, search, place, size = object(), None, 0, 0

    def give(edits):
        nonlocal place, size
        for e in edits:
            turn, role, text, fault = e.row[3] if e.row else (None, None, "", None)
            new = None if e.letter == "D" else e.role or role
            for n, v in zip(names, (now, place, e.letter, turn, role, new, text, fault)):
                out[n].append(v)
            place += 1
            size += len(text)

    def batch():
        nonlocal size
        made = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        for v in out.values():
            v.clear()
        size = 0
        return made

    for part in batches:
        for conv, turn, role, text, fault in zip(*(part.column(k).to_pylist() for k in range(5))):
            if search is None or conv != now:
                if search is not None:
                    give(search.finish())
                now, search, place = conv, Repair(), 0
            give(search.push((role[:1], fault in ("blank", "duplicate"), fault == "truncated", (turn, role, text, fault))))
            if size > 4_000_000 or len(out["edit"]) >= 20_000:
                yield batch()
    if search is not None:
        give(search.finish())
    if out["edit"]:
        yield batch()


def faults(text: Column, again: Column) -> Column:
    """The first fault of a row: blank, duplicate or truncated; null if it has none."""
    end = F.right(F.rtrim(text, F.lit(SIGNS)), F.lit(1))
    return F.when(~text.rlike(f"[^{BLANK}]"), "blank").when(again, "duplicate").when(~end.isin(".", "!", "?"), "truncated")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, old_role, role, text, fault) of the cheapest edits of each conversation in ``rows`` (conv_id, turn, role, text).

    edit is K (kept), R (another role), D (deleted: role is null) or I (inserted: turn, old_role and fault are null, text is empty). The rows with
    edit <> 'D', in order of place, are the repaired conversation. A conversation is taken by turn, null turns first; rows of the same turn
    by role and text, so the result does not depend on the order of the input. Null roles and texts count as one space; a null conv_id
    is a conversation; any other role than system, user and assistant counts by its initial, and has to be changed or deleted if
    that is none of s, u and a. An empty table gives an empty one; other columns are not read.

    One shuffle brings the rows of a conversation together, sorts (which spill) put them in order, and a task reads them as a stream. Its edits
    follow one another in one partition. What a task holds of a conversation is what is unsettled: a few rows as a rule, but as long as rows follow
    whose roles fit nowhere, two ways of reading them stay open.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    held = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    ordered = held.withColumn("again", again).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again")
    return ordered.select("conv_id", "turn", "role", "text", faults(F.col("text"), F.col("again")).alias("fault")).mapInArrow(_repaired, EDITS)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 drops the row, 1 empties its text, 2 takes its
    full stops, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    base = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    done = base.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return done.withColumn("copy", F.explode(times)).drop("kind", "copy")


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a stream of edits."""
    names = [c.split()[0] for c in DIGEST.split(", ")]
    done: list = []
    now = None

    def new(conv):
        return {"conv": conv, "least": None, "most": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False, "initial": None}

    def close(s):
        gaps = s["most"] - s["least"] + 1 - s["turns"] if s["turns"] else 0
        done.append((s["conv"], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest()))

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n, c in zip(names, zip(*done))], names=names)
        done.clear()
        return made

    for part in batches:
        for conv, place, edit, turn, old, role, text, fault in zip(*(part.column(k).to_pylist() for k in range(8))):
            if place == 0:
                if now:
                    close(now)
                now = new(conv)
            now["audit"].append(edit)
            now["cost"] += COSTS[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if edit != "I":
                if fault:
                    now[fault] += 1
                if turn is not None and turn != now["most"]:
                    now["least"], now["most"], now["turns"] = (turn if now["least"] is None else now["least"]), turn, now["turns"] + 1
                if now["initial"] is not None and now["initial"] + old[:1] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["initial"] = old[:1]
            if edit != "D":
                now["sha"].update((("\n" if now["any"] else "") + role + ":" + text).encode())
                now["any"] = True
            if len(done) >= 10_000:
                yield batch()
    if now:
        close(now)
    if done:
        yield batch()


def digests(edits: DataFrame) -> DataFrame:
    """One row for each conversation in the result of :func:`repair_conversations`, whose rows must not have been moved: numbers of faults, of turns
    that lack and of illegal neighbours before the repair, its cost and initials, and the hash of the repaired conversation."""
    return edits.mapInArrow(_digests, DIGEST)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = digests(repair_conversations(damaged(rows)))
    ids = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    joined = ids.hint("merge").join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
