"""Repair of conversation structure: the cheapest edits that give user and assistant in turn.

Edits are found by a dynamic programme over a conversation's rows and the four states of the wanted order
(nothing yet, after system, after user, after assistant). Each state's best edit prefix is a node that links to the prefix it
extends, so prefixes are shared; a node has its ancestors at distances of powers of two and a rolling hash of its whole
prefix. Prefixes of equal cost are compared by a binary search for their longest common prefix over those
hashes; a hash that agrees is verified along the links, and a collision found there decides instead.

Scale. Equal rows are counted first. Rows get their place in their conversation by ranges of the order (``ordered.running``), so no task sorts a whole
conversation, and meet by blocks of ``block`` rows. Nearly all conversations are one block and are done there. A longer
one's blocks each give their best edits from every state to every state; these are chained by conversation, and the chosen
edits go back to the blocks. Text leaves its block only as the repaired lines of a long conversation, whose hash is
taken over the blocks in order without holding them. The audit of a conversation is one value, so it must fit a row.

Defined cases: nulls in role and text are one space, and so in the place that the damage is drawn from; rows without a conv_id are a
conversation of their own; rows of equal turn go by role, then text; equal rows are duplicates of
the first; an empty role has no initial, so it can't be kept. A conversation that loses all rows has zeros, an empty audit and the hash
of nothing. Very long texts are only hashed and scanned. An empty table gives an empty result. Columns other than conv_id, turn, role and text are left out.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import running
from .common import salted_join, written

BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
#: State -> {initial: next state}: nothing yet, after system, after user, after assistant.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
START, ENDS = 0, (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
_LAST_SEEN = re.compile("[^\\x20\\x09-\\x0D](?=[\\x20\\x09-\\x0D]*\\Z)")
_MODULUS, _BASE = (1 << 61) - 1, 911_382_323
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


@dataclass
class Trails:
    """Edit prefixes as linked nodes; node 0 is the empty one."""

    letter: list[str] = field(default_factory=lambda: [""])
    depth: list[int] = field(default_factory=lambda: [0])
    code: list[int] = field(default_factory=lambda: [0])
    up: list[tuple[int, ...]] = field(default_factory=lambda: [()])

    def add(self, node: int, letter: str) -> int:
        above, k = [node], 0
        while k < len(self.up[above[k]]):
            above.append(self.up[above[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.code.append((self.code[node] * _BASE + ord(letter)) % _MODULUS)
        self.up.append(tuple(above))
        return len(self.letter) - 1

    def extend(self, node: int, letters: str) -> int:
        for letter in letters:
            node = self.add(node, letter)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        away = self.depth[node] - depth
        while away:
            k = away.bit_length() - 1
            node, away = self.up[node][k], away - (1 << k)
        return node

    def _difference(self, x: int, y: int) -> tuple[int, int] | None:
        """Of two nodes of one depth, the ancestors (or they) where the prefixes first differ, by walking to the node they share."""
        found = None
        while x != y:
            if self.letter[x] != self.letter[y]:
                found = x, y
            x, y = self.up[x][0], self.up[y][0]
        return found

    def less(self, a: int, b: int) -> bool:
        """Whether a's letters come before b's."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.code[x] != self.code[y]:
            for k in reversed(range(len(self.up[x]))):
                if k < len(self.up[x]) and self.code[self.up[x][k]] != self.code[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            # Here the hashes first differ, and so the letters; an earlier difference is a collision of hashes.
            x, y = self._difference(self.up[x][0], self.up[y][0]) or (x, y)
            return self.letter[x] < self.letter[y]
        if found := self._difference(x, y):
            return self.letter[found[0]] < self.letter[found[1]]
        return self.depth[a] < self.depth[b]

    def letters(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _offer(trails: Trails, layer: dict[int, tuple[int, int]], state: int, cost: int, node: int, letters: str) -> bool:
    """Take an extended prefix for a state if it is cheaper than the state's, or as cheap and before it."""
    old = layer.get(state)
    if old is not None and cost > old[0]:
        return False
    new = trails.extend(node, letters)
    if old is not None and cost == old[0] and not trails.less(new, old[1]):
        return False
    layer[state] = (cost, new)
    return True


def _with_inserts(trails: Trails, layer: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    todo = list(layer)
    while todo:
        state = todo.pop(0)
        cost, node = layer[state]
        for initial in ROLES:
            after = STEPS[state].get(initial)
            if after is not None and _offer(trails, layer, after, cost + INSERT, node, "I"):
                todo.append(after)
    return layer


def best_edits(initials: list[str], faults: list[int], entry: int, first: bool) -> dict[int, tuple[int, str]]:
    """End state -> (cost, edits) of the rows from the entry state. Inserts before the first row belong to the block before, if there is one."""
    trails = Trails()
    layer = {entry: (0, 0)}
    if first:
        _with_inserts(trails, layer)
    for initial, fault in zip(initials, faults, strict=True):
        after: dict[int, tuple[int, int]] = {}
        extra = CUT_SHORT if fault == TRUNCATED else 0
        for state, (cost, node) in layer.items():
            _offer(trails, after, state, cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            if initial in STEPS[state]:
                _offer(trails, after, STEPS[state][initial], cost + KEEP + extra, node, "K")
            for role in ROLES:
                if role in STEPS[state]:
                    _offer(trails, after, STEPS[state][role], cost + REROLE + extra, node, "R")
        layer = _with_inserts(trails, after)
    return {state: (cost, trails.letters(node)) for state, (cost, node) in layer.items()}


def chained(blocks: list[list[dict]]) -> tuple[int, str, list[tuple[int, str]]]:
    """(cost, edits, (entry state, edits) of every block) from each block's best edits by entry and end state."""
    trails = Trails()
    layer, back = {START: (0, 0)}, []
    for table in blocks:
        after: dict[int, tuple[int, int]] = {}
        came = {}
        for way in table:
            if way["entry"] in layer:
                cost, node = layer[way["entry"]]
                if _offer(trails, after, way["end"], cost + way["cost"], node, way["edits"]):
                    came[way["end"]] = way["entry"], way["edits"]
        layer = after
        back.append(came)
    cost, node, end = _least(trails, layer)
    chosen, state = [], end
    for came in reversed(back):
        chosen.append(came[state])
        state = came[state][0]
    return cost, trails.letters(node), chosen[::-1]


def _least(trails: Trails, layer: dict[int, tuple[int, int]]) -> tuple[int, int, int]:
    best = None
    for state in ENDS:
        if state in layer:
            cost, node = layer[state]
            if best is None or cost < best[0] or (cost == best[0] and trails.less(node, best[1])):
                best = cost, node, state
    return best


def replay(rows: list[tuple[str, str]], edits: str, state: int) -> list[str]:
    """The repaired rows as role:text."""
    out, at = [], 0
    for edit in edits:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = STEPS[state][role[:1]]
        else:
            initial = next(i for i in ROLES if i in STEPS[state])
            role, state = ROLES[initial], STEPS[state][initial]
        out.append(f"{role}:{text}")
    return out


def fault_of(role: str, text: str, seen: set[bytes] | None, repeated: bool | None) -> int:
    """The row's first fault; whether it is a duplicate is told by ``repeated`` or found in ``seen``."""
    if seen is not None:
        key = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
        repeated = key in seen
        seen.add(key)
    last = _LAST_SEEN.search(text)
    if last is None:
        return BLANK
    if repeated:
        return DUPLICATE
    return FINE if last.group() in ".!?" else TRUNCATED


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: each row's fate by the checksum of its place, twentieths dropped, emptied, unpunctuated, repeated or given to the user."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(place.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    kept = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("fate")).where("fate <> 0")
    return kept.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_again"),
    ).drop("_again")


def _group():
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))


_WAY = "struct<entry:int,end:int,cost:long,edits:string>"


def _groups(batches, kinds: dict | None = None):
    """Rows of one (g, block) at a time, as lists; rows come sorted."""
    held, key = None, None
    for batch in batches:
        if kinds is not None and "conv_id" in batch.schema.names:
            kinds["conv_id"] = batch.schema.field("conv_id").type
        rows = batch.to_pylist()
        for row in rows:
            if (row["g"], row["block"]) != key:
                if held:
                    yield held
                held, key = [], (row["g"], row["block"])
            held.append(row)
    if held:
        yield held


def _solve(batches):
    names = ["conv_id", "g", "block", "only", "first", "last", "blank", "duplicate", "truncated", "illegal", "ways", "hash"]
    out: list[tuple] = []
    kinds: dict = {}
    for rows in _groups(batches, kinds):
        only = rows[0]["only"]
        seen = set() if only else None
        initials = [r["role"][:1] for r in rows]
        faults = [fault_of(r["role"], r["text"], seen, r["repeated"]) for r in rows]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        digest = None
        if only:
            cost, edits, _ = chained([[{"entry": START, "end": end, "cost": c, "edits": e} for end, (c, e) in best_edits(initials, faults, START, True).items()]])
            ways = [{"entry": START, "end": START, "cost": cost, "edits": edits}]
            digest = hashlib.sha256("\n".join(replay([(r["role"], r["text"]) for r in rows], edits, START)).encode("utf-8", "surrogatepass")).hexdigest()
        else:
            begins = rows[0]["block"] == 0
            ways = [{"entry": e, "end": end, "cost": c, "edits": s} for e in ([START] if begins else range(len(STEPS))) for end, (c, s) in best_edits(initials, faults, e, begins).items()]
        r = rows[0]
        out.append((r["conv_id"], r["g"], r["block"], only, initials[0], initials[-1], faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, ways, digest))
        if len(out) == 1000 or not only:
            yield _rows(out, names, kinds)
            out = []
    if out:
        yield _rows(out, names, kinds)


def _rows(out: list[tuple], names: list[str], kinds: dict) -> pa.RecordBatch:
    way = pa.struct([("entry", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    kinds = {"g": pa.string(), "only": pa.bool_(), "first": pa.string(), "last": pa.string(), "hash": pa.string(), "ways": pa.list_(way)} | kinds
    return pa.RecordBatch.from_arrays([pa.array(list(v), kinds.get(n, pa.int64())) for n, v in zip(names, zip(*out, strict=True), strict=True)], names)


def _chain(batches):
    for batch in batches:
        out = []
        for g, blocks in zip(batch.column("g").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
            cost, edits, chosen = chained([b["ways"] for b in blocks])
            out.append({"g": g, "cost": cost, "edits": edits, "chosen": [{"block": b["block"], "state": s, "edits": e} for b, (s, e) in zip(blocks, chosen, strict=True)]})
        if out:
            chosen = pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32()), ("edits", pa.string())]))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("g", pa.string()), ("cost", pa.int64()), ("edits", pa.string()), ("chosen", chosen)]))


def _replay(batches):
    for rows in _groups(batches):
        lines = replay([(r["role"], r["text"]) for r in rows], rows[0]["edits"], rows[0]["state"])
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["g"]]), pa.array([rows[0]["block"]], pa.int64()), pa.array(["\n".join(lines)], pa.large_string()).cast(pa.string())], ["g", "block", "lines"])


def _hash(batches):
    """Sorted (g, block, lines) -> g, hash: only the running hash is held."""
    now, digest = None, None
    for batch in batches:
        for g, lines in zip(batch.column("g").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            if g != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["g", "hash"])
                now, digest = g, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(lines.encode())
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["g", "hash"])


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row a conversation that has rows."""
    numbered = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("g", _group())
    # Equal rows are counted before they move and are spread again once they have places; ranges are told by the beginnings of texts.
    counted = numbered.groupBy("g", "turn", "role", "text").agg(F.first("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies")).withColumn("head", F.left("text", F.lit(64)))
    placed = running(counted, ["g"], ["g", "turn", "role", "head", "text"], {"upto": "copies"}, deal=["g", "turn", "role", "head"])
    placed = placed.withColumn("at", F.explode(F.sequence(F.col("upto") - F.col("copies"), F.col("upto") - 1)))
    placed = placed.select("conv_id", "g", "role", "text", "at", F.floor(F.col("at") / block).alias("block"), (F.col("all_upto") <= block).alias("only"))
    one_block = placed.where("only").withColumn("repeated", F.lit(None).cast("boolean"))
    long_ = placed.where("not only")
    is_long = bool(long_.take(1))
    if is_long:
        said = long_.withColumn("key", F.sha2(F.concat_ws("\x00", F.length("g").cast("string"), "g", F.length("role").cast("string"), "role", "text"), 256))
        first = said.groupBy(F.col("key").alias("f_key")).agg(F.min("at").alias("f_at"))
        long_ = salted_join(said, first, "key", "f_key", "at").withColumn("repeated", F.col("at") > F.col("f_at")).drop("key", "f_key", "f_at")
        one_block = one_block.unionByName(long_)
    kind = rows.schema["conv_id"].dataType.simpleString()
    met = one_block.repartition("g", "block").sortWithinPartitions("g", "block", "at")
    schema = f"conv_id {kind}, g string, block long, only boolean, first string, last string, blank long, duplicate long, truncated long, illegal long, ways array<{_WAY}>, hash string"
    solved = met.mapInArrow(_solve, schema)
    way = F.col("ways")[0]
    counts = ["blank", "duplicate", "truncated", "illegal"]
    if not is_long:
        return solved.select("conv_id", *counts, way["cost"].alias("cost"), way["edits"].alias("audit"), F.col("hash").alias("repaired_sha256"))
    solved = written(solved, "conversation-blocks")
    done = solved.where("only").select("conv_id", *counts, way["cost"].alias("cost"), way["edits"].alias("audit"), F.col("hash").alias("repaired_sha256"))
    blocks = solved.where("not only").groupBy("g").agg(
        F.first("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in counts], F.array_sort(F.collect_list(F.struct("block", "first", "last", "ways"))).alias("blocks"),
    )
    pairs = F.zip_with(F.slice("blocks", F.lit(1), F.size("blocks") - 1), F.slice("blocks", F.lit(2), F.size("blocks") - 1), lambda a, b: (~F.concat(a["last"], b["first"]).isin(*LEGAL)).cast("long"))
    sums = blocks.withColumn("illegal", F.col("illegal") + F.aggregate(pairs, F.lit(0).cast("long"), lambda s, v: s + v)).drop("blocks")
    chains = written(blocks.select("g", "blocks").mapInArrow(_chain, "g string, cost long, edits string, chosen array<struct<block:long,state:int,edits:string>>"), "conversation-chains")
    picks = chains.select("g", F.explode("chosen").alias("c")).select("g", "c.block", "c.state", "c.edits")
    again = long_.join(picks, ["g", "block"]).select("g", "block", "at", "role", "text", "state", "edits")
    lines = again.repartition("g", "block").sortWithinPartitions("g", "block", "at").mapInArrow(_replay, "g string, block long, lines string")
    hashes = lines.repartition("g").sortWithinPartitions("g", "block").mapInArrow(_hash, "g string, hash string")
    rest = sums.join(chains.select("g", "cost", "edits"), "g").join(hashes, "g", "left")
    return done.unionByName(rest.select("conv_id", *counts, "cost", F.col("edits").alias("audit"), F.coalesce("hash", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


def audit(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Damages conversations and repairs them: one row for every conv_id of rows, with gaps in the numbers of the turns left."""
    left = damaged(rows)
    turns = left.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n"))
    gaps = turns.select(F.col("conv_id").alias("t_id"), F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))
    fixed = repair(left, block).withColumnRenamed("conv_id", "r_id")
    every = rows.select("conv_id").distinct()
    found = every.join(gaps, F.col("conv_id").eqNullSafe(F.col("t_id")), "left").join(fixed, F.col("conv_id").eqNullSafe(F.col("r_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
