"""Structure repair of conversations: the cheapest edits, found by a persistent dynamic program.

Every turn is kept, given another role or deleted, and turns are inserted, so
that the roles follow ``(s?(ua)+)?``. The program walks over the turns with one
best edit string for each place in that pattern. These audits share their
prefixes: an edit is a node that points to its predecessor, with ancestors at
powers of two and a rolling hash of its whole prefix. Of two audits of one cost
the ASCII-least is better; the first edit in which they differ is found by
lifting both along equal hashes. Nodes are unique for their string, so the nodes
before that edit must be one and the same, which tells a hash collision.

Turns are put in order by ranges of (conversation, turn), so a conversation that
holds a third of all rows is spread over partitions. A stretch of a conversation
that is not known to be whole yields its cheapest audits from each place of the
pattern to each other, and these are chained, one row a stretch. What a repaired
conversation's digest needs in one place is streamed there in order, as SHA-256
must read it in order; nothing holds more than a stretch, but for the audit,
which is one value by contract.

Nulls: a null role or text is one space; a null turn sorts first and fills no
gap; rows without conversation form one. Rows of one turn are ordered by role,
the first 64 characters of the text, and its digest; equal rows are all rows
(the later ones are duplicates). A conversation whose rows are all dropped has
zeros, an empty audit and no text. An empty table gives an empty table. Texts
are taken whole; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caseframe.llm import storage

#: A stretch ends after so many rows or bytes of text.
STRETCH_ROWS = 4096
STRETCH_BYTES = 8 << 20
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Places in the pattern: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
HASH_BASE, HASH_PRIME = 1_000_003, (1 << 61) - 1
BLANKS = " \t\n\v\f\r"


class Audits:
    """Edit strings as nodes with shared prefixes; node 0 is the empty string."""

    def __init__(self, prime: int = HASH_PRIME):
        self.prime = prime
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[tuple[int, ...]] = [()]
        self.nodes: dict[tuple[int, str], int] = {}

    def extend(self, node: int, letter: str) -> int:
        found = self.nodes.get((node, letter))
        if found is None:
            found = self.nodes[node, letter] = len(self.letter)
            jumps, k = [node], 0
            while k < len(self.up[jumps[k]]):
                jumps.append(self.up[jumps[k]][k])
                k += 1
            self.up.append(tuple(jumps))
            self.letter.append(letter)
            self.depth.append(self.depth[node] + 1)
            self.hash.append((self.hash[node] * HASH_BASE + ord(letter)) % self.prime)
        return found

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def _part(self, x: int, y: int, same) -> tuple[int, int]:
        """The first nodes of two different strings of one length after which they stay apart under ``same``."""
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and not same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return x, y

    def less(self, x: int, y: int) -> bool:
        """Whether the string of ``x`` comes before that of ``y``."""
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if a == b:
            return self.depth[x] < self.depth[y]
        p, q = self._part(a, b, lambda u, v: self.hash[u] == self.hash[v])
        if self.up[p][0] != self.up[q][0] or p == q or self.letter[p] == self.letter[q]:  # two strings have one hash
            p, q = self._part(a, b, lambda u, v: u == v)
        return self.letter[p] < self.letter[q]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


@dataclass
class Turn:
    """What the program needs of a row: the role's initial and the fault."""

    initial: str
    fault: str  # "", "blank", "duplicate" or "truncated"


Best = dict[int, tuple[int, int]]


def _offer(best: Best, audits: Audits, place: int, cost: int, node: int, letter: str) -> bool:
    now = best.get(place)
    if now is not None and now[0] < cost:
        return False
    made = audits.extend(node, letter)
    if now is None or cost < now[0] or (made != now[1] and audits.less(made, now[1])):
        best[place] = cost, made
        return True
    return False


def _with_inserts(best: Best, audits: Audits) -> Best:
    changed = True
    while changed:
        changed = False
        for place in sorted(best, key=lambda p: best[p][0]):
            cost, node = best[place]
            changed |= _offer(best, audits, NEXT_TURN[place], cost + INSERT, node, "I")
    return best


def _after(place: int, initial: str) -> int | None:
    """The place after a kept turn, if the pattern allows it there."""
    if initial == "s":
        return SYSTEM if place == START else None
    if initial == "u":
        return USER if place != USER else None
    return ASSISTANT if initial == "a" and place == USER else None


def cheapest(turns: list[Turn], start: int = START, prime: int = HASH_PRIME) -> dict[int, tuple[int, str]]:
    """For each place that can be reached from ``start``: least cost, and the ASCII-least edits of that cost."""
    audits = Audits(prime)
    best = _with_inserts({start: (0, 0)}, audits)
    for turn in turns:
        after: Best = {}
        late = TRUNCATED if turn.fault == "truncated" else 0
        for place, (cost, node) in best.items():
            _offer(after, audits, place, cost + DELETE, node, "D")
            if turn.fault in ("", "truncated"):
                kept = _after(place, turn.initial)
                if kept is not None:
                    _offer(after, audits, kept, cost + late, node, "K")
                _offer(after, audits, NEXT_TURN[place], cost + REROLE + late, node, "R")
        best = _with_inserts(after, audits)
    return {place: (cost, audits.text(node)) for place, (cost, node) in best.items()}


def edited(audit: str, turns: list[tuple[str, str]], place: int = START) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stay or come in."""
    rows = iter(turns)
    for edit in audit:
        if edit == "I":
            place = NEXT_TURN[place]
            yield edit, NAMES[place], ""
            continue
        role, text = next(rows)
        if edit == "K":
            place = _after(place, role[:1])
            yield edit, role, text
        elif edit == "R":
            place = NEXT_TURN[place]
            yield edit, NAMES[place], text


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): the table after made faults, which follow from conversation and turn.

    A dropped row stays with 0 copies, without its text.
    """
    named = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    full = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        full.alias("text"), (F.crc32(named.cast("binary")) % 20).alias("fault"),
    )
    changed = (
        F.when(F.col("fault").isin(0, 1), "")
        .when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    return rows.select(
        "conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def as_they_are(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) of the table itself."""
    space = F.lit(" ")
    return conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"), F.lit(1).cast("long").alias("copies"),
    )


KEYS = ["conv", "turn", "role", "lead", "print"]


def _combined(rows: DataFrame) -> DataFrame:
    """Equal rows of one Arrow batch as one row, before anything is moved."""
    schema = rows.schema

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            numbered = table.append_column("at", pa.array(range(len(table))))
            groups = numbered.group_by(KEYS, use_threads=False).aggregate([("copies", "sum"), ("at", "min")]).sort_by("at_min")
            if len(groups) == len(table):
                yield batch
                continue
            one = table.take(groups["at_min"]).set_column(table.schema.get_field_index("copies"), "copies", groups["copies_sum"])
            yield from one.select(schema.names).combine_chunks().to_batches()

    return rows.mapInArrow(combine, schema)


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in order over range partitions, equal ones combined, ``later`` where role and text stand at an earlier turn.

    Columns: KEYS, text (null where it is blank or later), copies, fault, later.
    """
    ink = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)  # the last character that is not blank
    named = rows.withColumns({
        "lead": F.substring("text", 1, 64), "print": F.unhex(F.sha2(F.concat_ws("\0", "role", "text").cast("binary"), 256)), "ink": ink,
    })
    fault = F.when(F.col("ink") == "", "blank").when(~F.col("ink").isin(".", "!", "?"), "truncated").otherwise("")
    full = _combined(named.select(*KEYS, F.when(F.col("ink") != "", F.col("text")).alias("text"), "copies", fault.alias("fault")))
    # Only keys move to find repeats; a role and text that stands at one turn only is done with there.
    places = named.filter("copies > 0 AND ink <> ''").select(*KEYS).distinct()
    never = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    firsts = places.groupBy("conv", "print").agg(F.min(never).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select(F.col("conv").alias("of"), F.col("print").alias("of_print"), F.col("first.turn").alias("first_turn"))
    same = F.col("conv").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print"))
    repeats = places.join(firsts, same).filter(~F.col("turn").eqNullSafe(F.col("first_turn")))
    flags = repeats.select(*KEYS, F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit("").alias("fault"))
    both = full.withColumn("later", F.lit(False)).unionByName(flags.withColumn("later", F.lit(True)))
    spread = both.repartitionByRange(storage.partitions(rows.sparkSession), *KEYS)
    return spread.sortWithinPartitions(*KEYS, F.desc("later"))


@dataclass
class Stretch:
    """Consecutive rows of one conversation in one partition."""

    conv: object
    turns: list[Turn] = field(default_factory=list)
    rows: list[tuple[str, str]] = field(default_factory=list)
    size: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    dates: int = 0
    least: int | None = None
    most: int | None = None

    def add(self, turn: int | None, role: str, text: str | None, fault: str) -> None:
        if turn is not None and turn != self.most:
            self.dates, self.most = self.dates + 1, turn
            self.least = turn if self.least is None else self.least
        if self.turns and self.turns[-1].initial + role[:1] not in LEGAL:
            self.illegal += 1
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        text = "" if text is None or fault in ("blank", "duplicate") else text
        self.turns.append(Turn(role[:1], fault))
        self.rows.append((role, text))
        self.size += len(text)


FACTS = ["blank", "duplicate", "truncated", "illegal", "dates", "least", "most"]
PATH = ["start", "end", "cost", "audit"]
TURN = ["edit", "role", "text"]


def _stretch_schema(conv: T.StructField) -> T.StructType:
    long, string = T.LongType(), T.StringType()
    path = T.StructType([T.StructField(n, t) for n, t in zip(PATH, (T.IntegerType(), T.IntegerType(), long, string))])
    turn = T.StructType([T.StructField(n, string) for n in TURN])
    return T.StructType([
        T.StructField("conv", conv.dataType), T.StructField("whole", T.BooleanType()), T.StructField("part", long), T.StructField("no", long),
        T.StructField("first_initial", string), T.StructField("last_initial", string), *[T.StructField(n, long) for n in FACTS],
        T.StructField("paths", T.ArrayType(path)), T.StructField("turns", T.ArrayType(turn)), T.StructField("sha256", string),
    ])


def _line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode()


def stretches(rows: DataFrame, texts: bool, longest: int = STRETCH_ROWS) -> DataFrame:
    """One row a stretch. A whole conversation has its one audit, and its turns (``texts``) or their digest;

    a part of one has all its paths and its rows.
    """
    names, schema = rows.columns, _stretch_schema(rows.schema["conv"])
    arrow = to_arrow_schema(schema)

    def finish(s: Stretch, part: int, no: int, whole: bool) -> dict:
        out = {
            "conv": s.conv, "whole": whole, "part": part, "no": no,
            "first_initial": s.turns[0].initial if s.turns else None, "last_initial": s.turns[-1].initial if s.turns else None,
        } | {n: getattr(s, n) for n in FACTS}
        if not whole:
            paths = [(start, end, *found) for start in range(4) for end, found in cheapest(s.turns, start).items()]
            rows = [{"role": r, "text": t} for r, t in s.rows]
            return out | {"paths": [dict(zip(PATH, p)) for p in paths], "turns": rows}
        cost, audit = min(found for place, found in cheapest(s.turns).items() if place in ENDS)
        turns = list(edited(audit, s.rows))
        out |= {"paths": [dict(zip(PATH, (START, ASSISTANT, cost, audit)))]}
        if texts:
            return out | {"turns": [dict(zip(TURN, t)) for t in turns]}
        return out | {"sha256": hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in turns).encode()).hexdigest()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, out, size = TaskContext.get().partitionId(), 0, [], 0
        now: Stretch | None = None
        begun = True  # the conversation may have begun in another partition, or has an earlier stretch
        last, later, first = None, False, True

        def close(whole: bool) -> None:
            nonlocal no, size
            out.append(finish(now, part, no, whole))
            no, size = no + 1, size + now.size

        for batch in batches:
            for conv, turn, role, lead, mark, text, copies, fault, flag in zip(*(batch.column(n).to_pylist() for n in names)):
                if now is None or conv != now.conv:
                    if now is not None:
                        close(not begun)
                        begun = False
                    now, last = Stretch(conv), None
                if (turn, role, lead, mark) != last:
                    last, later, first = (turn, role, lead, mark), False, True
                later = later or flag
                for _ in range(copies):
                    if len(now.turns) >= longest or now.size >= STRETCH_BYTES:
                        close(False)
                        now, begun = Stretch(conv), True
                    now.add(turn, role, text, "duplicate" if fault != "blank" and (later or not first) else fault)
                    first = False
                if size > STRETCH_BYTES or len(out) >= STRETCH_ROWS:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out.clear()
                    size = 0
        if now is not None:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(cut, schema)


class Chain:
    """Audits over stretches: like the program over turns, an edit being the audit of a stretch."""

    def __init__(self) -> None:
        self.label, self.parent, self.start = [""], [0], [START]
        self.best: Best = {START: (0, 0)}

    def less(self, x: int, y: int) -> bool:
        """Compare behind the last node that both came through; both passed the same number of stretches."""
        a, b = [], []
        while x != y:
            a.append(self.label[x])
            b.append(self.label[y])
            x, y = self.parent[x], self.parent[y]
        return "".join(reversed(a)) < "".join(reversed(b))

    def better(self, new: tuple[int, int], old: tuple[int, int] | None) -> bool:
        return old is None or new[0] < old[0] or (new[0] == old[0] and self.less(new[1], old[1]))

    def add(self, paths: list[dict]) -> None:
        after: Best = {}
        for path in paths:
            if path["start"] in self.best:
                cost, node = self.best[path["start"]]
                self.label.append(path["audit"])
                self.parent.append(node)
                self.start.append(path["start"])
                new = cost + path["cost"], len(self.label) - 1
                if self.better(new, after.get(path["end"])):
                    after[path["end"]] = new
        self.best = after

    def end(self) -> tuple[int, list[tuple[int, str]]]:
        """The cost, and for each stretch its start in the pattern and its part of the audit."""
        best = None
        for place in ENDS:
            if place in self.best and self.better(self.best[place], best):
                best = self.best[place]
        cost, node = best
        out = []
        while node:
            out.append((self.start[node], self.label[node]))
            node = self.parent[node]
        return cost, out[::-1]


def chained(parts: DataFrame) -> DataFrame:
    """Per stretch of a conversation in parts: start and audit; on its first also the facts, cost and audit of all."""
    long, string = T.LongType(), T.StringType()
    schema = T.StructType([
        parts.schema["conv"], *[T.StructField(n, long) for n in ("part", "no")], T.StructField("start", T.IntegerType()),
        T.StructField("audit", string), *[T.StructField(n, long) for n in (*FACTS, "cost")], T.StructField("whole_audit", string),
    ])
    arrow = to_arrow_schema(schema)
    narrow = parts.select("conv", "part", "no", "first_initial", "last_initial", *FACTS, "paths")
    following = narrow.repartition(storage.partitions(parts.sparkSession), "conv").sortWithinPartitions("conv", "part", "no")

    def finish(conv, names, chain: Chain, facts: dict) -> pa.RecordBatch:
        cost, audits = chain.end()
        rows = [{"conv": conv, "part": p, "no": n, "start": s, "audit": a} for (p, n), (s, a) in zip(names, audits)]
        rows[0] |= facts | {"cost": cost, "whole_audit": "".join(a for _, a in audits)}
        return pa.RecordBatch.from_pylist(rows, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = chain = None
        for batch in batches:
            for row in batch.to_pylist():
                if chain is None or row["conv"] != conv:
                    if chain is not None:
                        yield finish(conv, names, chain, facts)
                    conv, chain, names, initial = row["conv"], Chain(), [], None
                    facts = dict.fromkeys(FACTS, 0) | {"least": None, "most": None}
                chain.add(row["paths"])
                names.append((row["part"], row["no"]))
                for n in ("blank", "duplicate", "truncated", "illegal", "dates"):
                    facts[n] += row[n]
                if row["least"] is not None:
                    facts["dates"] -= row["least"] == facts["most"]
                    facts["least"] = row["least"] if facts["least"] is None else facts["least"]
                    facts["most"] = row["most"]
                if row["first_initial"] is not None:
                    facts["illegal"] += initial is not None and initial + row["first_initial"] not in LEGAL
                    initial = row["last_initial"]
        if chain is not None:
            yield finish(conv, names, chain, facts)

    return following.mapInArrow(run, schema)


def _applied(parts: DataFrame, decided: DataFrame) -> DataFrame:
    """(conv, part, no, turns): the repaired turns of each stretch of a conversation in parts."""
    schema = T.StructType([parts.schema[n] for n in ("conv", "part", "no", "turns")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                turns = edited(row["audit"], [(t["role"], t["text"]) for t in row["turns"]], row["start"])
                done = row | {"turns": [dict(zip(TURN, t)) for t in turns]}
                yield pa.RecordBatch.from_pylist([{n: done[n] for n in schema.names}], arrow)

    joined = parts.select("conv", "part", "no", "turns").join(decided.select("part", "no", "start", "audit"), ["part", "no"])
    return joined.select("conv", "part", "no", "turns", "start", "audit").mapInArrow(run, schema)


def _digested(applied: DataFrame) -> DataFrame:
    """(conv, sha256): SHA-256 of each conversation's turns, read in order, a stretch at a time."""
    schema = T.StructType([applied.schema["conv"], T.StructField("sha256", T.StringType())])
    arrow = to_arrow_schema(schema)
    following = applied.repartition(storage.partitions(applied.sparkSession), "conv").sortWithinPartitions("conv", "part", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = digest = None
        for batch in batches:
            for k in range(batch.num_rows):
                name, turns = batch.column("conv")[k].as_py(), batch.column("turns")[k].as_py()
                if digest is None or name != conv:
                    if digest is not None:
                        yield pa.RecordBatch.from_pylist([{"conv": conv, "sha256": digest.hexdigest()}], arrow)
                    conv, digest, between = name, hashlib.sha256(), b""
                for turn in turns:
                    digest.update(between + f"{turn['role']}:{turn['text']}".encode())
                    between = b"\n"
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "sha256": digest.hexdigest()}], arrow)

    return following.mapInArrow(run, schema)


def _parts_and_whole(rows: DataFrame, texts: bool, longest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole conversations, stretches of the others, and what the chain decided for these."""
    cut = storage.staged(stretches(ordered(rows), texts, longest), "stretches")
    parts = cut.filter("NOT whole")
    return cut.filter("whole"), parts, storage.staged(chained(parts), "audits")


def audits(rows: DataFrame, conv: str = "conv_id", longest: int = STRETCH_ROWS) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` come from ``damaged`` or ``as_they_are``; ``longest`` is the length of a stretch and changes no result.
    Gaps beyond 64 bits are the largest long.
    """
    whole, parts, decided = _parts_and_whole(rows, False, longest)
    digests = _digested(_applied(parts, decided)).select(F.col("conv").alias("of"), "sha256")
    heads = decided.filter("cost IS NOT NULL").join(digests, F.col("conv").eqNullSafe(F.col("of")))
    path = F.col("paths")[0]
    facts = whole.select("conv", *FACTS, path["cost"].alias("cost"), path["audit"].alias("audit"), "sha256").unionByName(
        heads.select("conv", *FACTS, "cost", F.col("whole_audit").alias("audit"), "sha256")
    )
    wide = [F.col(n).cast("decimal(20,0)") for n in ("most", "least", "dates")]
    most = F.lit(2**63 - 1).cast("decimal(20,0)")
    gaps = F.when(F.col("dates") > 0, F.least(wide[0] - wide[1] + 1 - wide[2], most).cast("long"))
    return facts.select(
        F.col("conv").alias(conv), F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated",
        "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"),
    )


def repaired(rows: DataFrame, conv: str = "conv_id", longest: int = STRETCH_ROWS) -> DataFrame:
    """The repaired turns: conversation, place (stretch and number in it, ascending), edit, role, text."""
    whole, parts, decided = _parts_and_whole(rows, True, longest)
    each = whole.select("conv", "part", "no", "turns").unionByName(_applied(parts, decided))
    turns = each.select("conv", "part", "no", F.posexplode("turns").alias("number", "turn"))
    place = F.struct("part", "no", "number").alias("place")
    return turns.select(F.col("conv").alias(conv), place, "turn.edit", "turn.role", "turn.text")
