"""Conversation structure repair: generalised LR over the role grammar.

Grammar of role initials: ``conversation -> | s? pairs``, ``pairs -> pair |
pairs pair``, ``pair -> u a``. A finished pair is reduced at once, so a stack's
top is one of four: nothing yet, a system turn, an open pair, whole pairs. The
graph-structured stack has one level per row: a node per top with the link to
the node it was reached from. Rows are kept (0), reroled to user or assistant
(1), deleted (2; blank and repeated rows must go); empty user or assistant
turns are inserted (5); a truncated row that stays costs 5 more. Equal tops
merge into the one of least (cost, audit), the audit being the initials of the
edits. Tops that cost more than another one can make up for are dropped.

Audits are compared without being built: two audits of one level end with a
row's letter, so none is the beginning of another and the order of two longer
ones is that of (rank at the level before, added letters). The same pattern of
tops, relative costs and ranks recurs all the time, so a level is looked up.

On Spark the rows are sorted by range of (conversation, turn, role, text), so a
conversation of any size is spread over partitions. A *run* is the part of a
conversation in one partition. Runs that begin and end inside a partition are
repaired there. The first and the last of a partition give their best ways
from every top they may be entered with; per conversation these few rows are
chained, and the chosen letters are joined to the rows by (run, row).

Memory of a task: the kept texts of one run, at most a partition's, and one
letter group a row. A run's identical rows share a partition; they are deleted
and held without text. An audit is as long as its conversation. The digest of
a conversation reads its lines in order, in one task, one batch at a time.

Defined results: null role or text is one space; rows of a null conversation
form one; turns are ordered nulls first, equal turns by role and text;
repeated rows are duplicates; ``gaps`` is 0 without turns; a conversation
without rows has zeros and an empty audit; other columns are not read; an
empty table gives empty tables.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sevscope.session import stage

EMPTY, SYSTEM, OPEN, PAIRS = range(4)
SHIFT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): OPEN, (SYSTEM, "u"): OPEN, (PAIRS, "u"): OPEN, (OPEN, "a"): PAIRS}
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Letters inserted at the end so that a top is accepted.
CLOSE = {EMPTY: "", PAIRS: "", OPEN: "A", SYSTEM: "UA"}
#: What a top saves at most against another one, whatever follows.
SAVES = {(EMPTY, PAIRS): 2, (EMPTY, OPEN): 7, (EMPTY, SYSTEM): 10, (SYSTEM, PAIRS): 0, (SYSTEM, OPEN): 5,
         (SYSTEM, EMPTY): 0, (OPEN, PAIRS): 5, (OPEN, SYSTEM): 5, (OPEN, EMPTY): 5, (PAIRS, OPEN): 5,
         (PAIRS, SYSTEM): 10, (PAIRS, EMPTY): 0}
#: A script's letters: K keep, D delete, u and a rerole, U and A insert.
_AUDIT = str.maketrans("uaUA", "RRII")
_SPACE = " \t\n\x0b\x0c\r"
MEMO = 200_000


def audit_of(script: str) -> str:
    return script.translate(_AUDIT)


class Repairer:
    """The levels of the graph-structured stack, looked up once computed."""

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    def level(self, tops, kind):
        """Next level for one row: (tops, cost added to all, links). ``tops``
        holds (top, relative cost, rank); ``kind`` is (initial, must go,
        truncated); a link is top -> (earlier top, script letters)."""
        got = self.known.get((tops, kind))
        if got is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            got = self.known[tops, kind] = self._level(tops, kind)
        return got

    @staticmethod
    def _level(tops, kind):
        initial, must_go, truncated = kind
        best: dict[int, tuple] = {}

        def offer(top, cost, rank, earlier, letters):
            new = (cost, rank, audit_of(letters), earlier, letters)
            if top not in best or new[:3] < best[top][:3]:
                best[top] = new

        stay = TRUNCATED if truncated else 0
        for earlier, cost, rank in tops:
            top, letters = earlier, ""
            while len(letters) <= 3:
                offer(top, cost + DELETE, rank, earlier, letters + "D")
                if not must_go:
                    if (top, initial) in SHIFT:
                        offer(SHIFT[top, initial], cost + stay, rank, earlier, letters + "K")
                    for role in "ua":
                        if role != initial and (top, role) in SHIFT:
                            offer(SHIFT[top, role], cost + stay + REROLE, rank, earlier, letters + role)
                role = "a" if top == OPEN else "u"
                top, letters, cost = SHIFT[top, role], letters + role.upper(), cost + INSERT
        least = min(b[0] for b in best.values())
        alive = {t: b for t, b in best.items()
                 if not any(b[0] > o[0] + SAVES[t, other] for other, o in best.items() if other != t)}
        order = sorted({b[1:3] for b in alive.values()})
        return (tuple((t, alive[t][0] - least, order.index(alive[t][1:3])) for t in sorted(alive)), least,
                {t: b[3:] for t, b in alive.items()})


class Way:
    """The stack of one run entered with one top."""

    def __init__(self, repairer: Repairer, top: int):
        self.repairer, self.entry = repairer, top
        self.tops, self.cost, self.links = ((top, 0, 0),), 0, []

    def read(self, kind):
        self.tops, more, links = self.repairer.level(self.tops, kind)
        self.cost += more
        self.links.append(links)

    def script(self, top: int) -> list[str]:
        """Letters per row on the way to a top of the last level."""
        out = []
        for links in reversed(self.links):
            top, letters = links[top]
            out.append(letters)
        return out[::-1]

    def exits(self):
        return [(top, self.cost + extra, "".join(self.script(top))) for top, extra, _ in self.tops]

    def accepted(self):
        """(cost, letters per row, closing letters) of the cheapest repair."""
        cost, _, _, top = min((extra + INSERT * len(CLOSE[t]), rank, audit_of(CLOSE[t]), t)
                              for t, extra, rank in self.tops)
        return self.cost + cost, self.script(top), CLOSE[top]


def chain(runs: list[list[tuple]]):
    """The cheapest way through consecutive runs, each a list of (entry, exit,
    cost, script): (cost, a script per run)."""
    held = {EMPTY: (0, 0, None)}
    for run in runs:
        best: dict[int, tuple] = {}
        for entry, end, cost, script in run:
            if entry in held:
                before = held[entry]
                new = (before[0] + cost, before[1], audit_of(script), (before[2], script))
                if end not in best or new[:3] < best[end][:3]:
                    best[end] = new
        order = sorted({b[1:3] for b in best.values()})
        held = {t: (b[0], order.index(b[1:3]), b[3]) for t, b in best.items()}
    cost, _, _, top = min((c + INSERT * len(CLOSE[t]), rank, audit_of(CLOSE[t]), t) for t, (c, rank, _) in held.items())
    scripts, link = [], held[top][2]
    while link is not None:
        link, script = link
        scripts.append(script)
    scripts.reverse()
    scripts[-1] += CLOSE[top]
    return cost, scripts


class _Run:
    """The rows of one conversation in a partition, while they stream by."""

    def __init__(self, repairer, conv, number, first):
        self.conv, self.number, self.first = conv, number, first
        self.ways = [Way(repairer, top) for top in (range(4) if first else (EMPTY,))]
        self.rows: list = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None
        self.start = self.end = None

    def add(self, turn, role, text, seen):
        said = text.rstrip(_SPACE)
        same = self.last == (turn, role, text)
        self.last = (turn, role, text)
        blank, duplicate, truncated = not said, bool(said) and (seen or same), False
        if said and not duplicate:
            truncated = said[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        initial = role[:1]
        if self.rows:
            self.illegal += self.end + initial not in ("su", "ua", "au")
        else:
            self.start = initial
        self.end = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        must_go = blank or duplicate
        kind = (initial if initial in ("s", "u", "a") else "", must_go, truncated)
        for way in self.ways:
            way.read(kind)
        self.rows.append(None if must_go else (role, text))

    def facts(self):
        return [self.blank, self.duplicate, self.truncated, self.illegal, self.start, self.end,
                self.low, self.high, self.turns]


def edits_of(rows, scripts, closing=""):
    """(action, role, text) of every edit, in order: letters per row, then
    letters after the last row."""
    for row, letters in zip(rows, scripts):
        for letter in letters[:-1]:
            yield "I", ROLES[letter.lower()], ""
        act = letters[-1]
        if act == "D":
            yield "D", None, None
        else:
            yield ("K", *row) if act == "K" else ("R", ROLES[act], row[1])
    for letter in closing:
        yield "I", ROLES[letter.lower()], ""


_FACTS = "blank long, duplicate long, truncated long, illegal long, start string, end string, low long, high long, turns long"
_WAY = "array<struct<entry: int, exit: int, cost: long, script: string>>"


def _parsed(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)


def _run_schema(conv: T.DataType) -> T.StructType:
    rest = _parsed(f"run long, at long, kind string, action string, role string, text string, {_FACTS}, "
                   f"cost long, script string, ways {_WAY}")
    return T.StructType([T.StructField("conv_id", conv), *rest.fields])


class _Out:
    """Collects output rows and hands them over as Arrow batches."""

    def __init__(self, schema: pa.Schema, rows=20_000, size=4 << 20):
        self.schema, self.limit, self.size = schema, rows, size
        self.rows, self.held = [], 0

    def add(self, row, size=0):
        self.rows.append(row)
        self.held += size

    def full(self):
        return len(self.rows) >= self.limit or self.held >= self.size

    def batch(self):
        columns = zip(*self.rows) if self.rows else [[]] * len(self.schema)
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.held = [], 0
        return out


def _strings(column) -> list[str]:
    return [t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def _runs(schema: pa.Schema):
    def emit_raw(out, run):
        """Rows of a run whose repair is not known yet."""
        for n, row in enumerate(run.rows):
            if row is not None:
                out.add((run.conv, run.number, n, "raw", None, *row, *[None] * 12), len(row[1]))
            if out.full():
                yield out.batch()
        run.rows = []

    def finish(out, run, edge):
        if edge:
            n = len(run.rows)
            yield from emit_raw(out, run)
            ways = [{"entry": w.entry, "exit": t, "cost": c, "script": s} for w in run.ways for t, c, s in w.exits()]
            out.add((run.conv, run.number, n, "run", None, None, None, *run.facts(), None, None, ways))
        else:
            cost, scripts, closing = run.ways[0].accepted()
            for n, (action, role, text) in enumerate(edits_of(run.rows, scripts, closing)):
                out.add((run.conv, run.number, n, "edit", action, role, text, *[None] * 12), len(text or ""))
                if out.full():
                    yield out.batch()
            out.add((run.conv, run.number, len(run.rows), "run", None, None, None, *run.facts(), cost,
                     "".join(scripts) + closing, None))

    def task(batches):
        from pyspark import TaskContext

        repairer, out, run = Repairer(), _Out(schema), None
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), _strings(batch.column(2)),
                       _strings(batch.column(3)), batch.column(4).to_pylist()]
            for conv, turn, role, text, seen in zip(*columns):
                if run is None or conv != run.conv:
                    if run is not None:
                        yield from finish(out, run, run.first)
                    run = _Run(repairer, conv, number, run is None)
                    number += 1
                run.add(turn, role, text, seen)
                if out.full():
                    yield out.batch()
        if run is not None:
            yield from finish(out, run, True)
        if out.rows:
            yield out.batch()
    return task


def _chained(schema: pa.Schema):
    """The edge runs of one conversation: facts joined, scripts chosen."""
    def one(table: pa.Table) -> pa.Table:
        runs = sorted(table.to_pylist(), key=lambda r: r["run"])
        cost, scripts = chain([[(w["entry"], w["exit"], w["cost"], w["script"]) for w in r["ways"]] for r in runs])
        end = high = None
        for k, (r, script) in enumerate(zip(runs, scripts)):
            if end is not None:
                r["illegal"] += end + r["start"] not in ("su", "ua", "au")
            end = r["end"]
            if r["low"] is not None:
                r["turns"] -= r["low"] == high
                high = r["high"]
            r["script"], r["cost"], r["ways"] = script, cost if k == 0 else 0, None
        return pa.Table.from_pylist([{f.name: r[f.name] for f in schema} for r in runs], schema=schema)
    return one


def _letters(batches):
    """(run, at, row, action, role) of every letter of the scripts; an
    inserted turn belongs to no row."""
    names = ["conv_id", "run", "at", "row", "action", "role"]
    for batch in batches:
        kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        out = _Out(pa.schema(list(zip(names, kinds))))
        for conv, run, script in zip(*(batch.column(i).to_pylist() for i in range(3))):
            row = 0
            for at, letter in enumerate(script):
                inserted = letter in "UA"
                out.add((conv, run, at, None if inserted else row, audit_of(letter), ROLES.get(letter.lower())))
                row += not inserted
                if out.full():
                    yield out.batch()
        if out.rows:
            yield out.batch()


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, seen), each conversation in order and in
    neighbouring partitions; ``seen``: role and text occur at an earlier turn.
    Repeated texts are counted before they are shuffled, and only those that
    repeat are joined back."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("said", F.md5(F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("~")), F.lit(":"),
        F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.groupBy("said").agg(F.count("*").alias("n"), F.min(when).alias("first")).where("n > 1").drop("n")
    return (rows.join(first, "said", "left")
            .select("conv_id", "turn", "role", "text",
                    F.coalesce(when > F.col("first"), F.lit(False)).alias("seen"))
            .repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
            .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, conversations) of ``turns(conv_id, turn, role, text)``.

    ``edits``: conv_id, run, at (their order), action (K, R, D or I), role and
    text after it (null when deleted); those not deleted, in order, are the
    repaired conversation. ``conversations``: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit."""
    rows = ordered_turns(turns)
    schema = _run_schema(rows.schema["conv_id"].dataType)
    staged = stage(rows.mapInArrow(_runs(_arrow(schema)), schema), "repair_runs")
    runs = staged.where("kind = 'run'").drop("kind", "action", "role", "text", "at")
    edge = T.StructType([f for f in schema.fields if f.name in runs.columns])
    chosen = stage(runs.where("ways IS NOT NULL").groupBy("conv_id").applyInArrow(_chained(_arrow(edge)), edge),
                   "repair_edges")
    letters = chosen.select("conv_id", "run", "script").mapInArrow(_letters, T.StructType(
        [schema["conv_id"], *_parsed("run long, at long, row long, action string, role string").fields]))
    raw = staged.where("kind = 'raw'").select(
        "run", F.col("at").alias("row"), F.col("role").alias("own"), F.col("text").alias("own_text"))
    late = letters.join(raw, ["run", "row"], "left").select(
        "conv_id", "run", "at", "action",
        F.when(F.col("action") == "K", F.col("own")).when(F.col("action") != "D", F.col("role")).alias("role"),
        F.when(F.col("action") == "I", F.lit("")).when(F.col("action") != "D", F.col("own_text")).alias("text"))
    edits = staged.where("kind = 'edit'").select("conv_id", "run", "at", "action", "role", "text").unionByName(late)
    per_run = runs.where("ways IS NULL").unionByName(chosen).withColumn(
        "audit", F.translate("script", "uaUA", "RRII"))
    total = lambda c: F.sum(c).alias(c)
    conversations = per_run.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        total("blank"), total("duplicate"), total("truncated"), total("illegal"), total("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "audit"))), lambda x: x["audit"]),
                     "").alias("audit"))
    return edits, conversations


def _line_digests(batches):
    """sha256 of each conversation's lines, read in order batch by batch."""
    conv = digest = kind = None
    out: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in out], kind), pa.array([d for _, d in out], pa.string())],
            names=["conv_id", "repaired_sha256"])

    for b in batches:
        kind = b.schema.field(0).type
        for c, line in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            if digest is None or c != conv:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256(line)
            else:
                digest.update(b"\n" + line)
        if len(out) > 10_000:
            yield batch()
            out.clear()
    if digest is not None:
        out.append((conv, digest.hexdigest()))
        yield batch()


def line_digests(edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations that keep any turn."""
    lines = (edits.where("action != 'D'").repartition("conv_id").sortWithinPartitions("conv_id", "run", "at")
             .select("conv_id", F.concat("role", F.lit(":"), "text").alias("line")))
    return lines.mapInArrow(_line_digests, T.StructType(
        [edits.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))


def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20: 0 dropped, 1 text
    emptied, 2 sentence ends taken out, 3 repeated, 4 made a user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                        (F.crc32(key.cast("binary")) % 20).alias("code")).where("code != 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def digests(turns: DataFrame) -> DataFrame:
    """Damage, repair and digest: one row for every conversation of ``turns``."""
    edits, conversations = repair(damage(turns))
    ids = turns.select("conv_id").distinct()
    hashes = line_digests(edits)
    named = lambda df, c: df.withColumnRenamed("conv_id", c)
    out = (ids.join(named(conversations, "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
           .join(named(hashes, "h"), F.col("conv_id").eqNullSafe(F.col("h")), "left"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: The same results by a recursive search over rows in DuckDB: ``ways`` keeps
#: the least (cost, audit) of every top after each row. Tops: E empty, S system
#: turn, O open pair, P pairs. ``crc`` is crc32 by its table of 256 entries.
ORACLE = """
WITH RECURSIVE
crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS t FROM range(256) r(i)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
    FROM conversations),
coded AS (SELECT conv_id, turn, role, text, xor(list_reduce(
            [4294967295] || list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)),
            lambda a, b: xor(a >> 8, t[CAST((xor(a, b) & 255) + 1 AS INT)])), 4294967295) % 20 AS code
    FROM keyed, crc),
damaged AS (SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
        CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE code WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM coded WHERE code <> 0),
placed AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, role, text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
        NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
        NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut
    FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 AS again FROM placed),
d AS (SELECT c, conv_id, turn, role, text, n, left(role, 1) AS initial, blank, again AND NOT blank AS duplicate,
        cut AND NOT blank AND NOT again AS truncated, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY n) AS before
    FROM seen),
shifts(top, initial, next) AS (VALUES ('E', 's', 'S'), ('E', 'u', 'O'), ('S', 'u', 'O'), ('P', 'u', 'O'), ('O', 'a', 'P')),
inserts(top, next, audit, lines) AS (
    SELECT a, b, x, CAST(l AS VARCHAR[]) FROM (VALUES
    ('E', 'E', '', []), ('E', 'O', 'I', ['user:']), ('E', 'P', 'II', ['user:', 'assistant:']),
    ('S', 'S', '', []), ('S', 'O', 'I', ['user:']), ('S', 'P', 'II', ['user:', 'assistant:']),
    ('P', 'P', '', []), ('P', 'O', 'I', ['user:']), ('P', 'P', 'II', ['user:', 'assistant:']),
    ('O', 'O', '', []), ('O', 'P', 'I', ['assistant:']), ('O', 'O', 'II', ['assistant:', 'user:'])) v(a, b, x, l)),
acts AS (
    SELECT c, n, s.top, s.next, CASE WHEN truncated THEN 5 ELSE 0 END AS cost, 'K' AS act, [role || ':' || text] AS line
    FROM d JOIN shifts s ON d.initial = s.initial WHERE NOT blank AND NOT duplicate
    UNION ALL
    SELECT c, n, s.top, s.next, CASE WHEN truncated THEN 6 ELSE 1 END, 'R',
        [CASE s.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
    FROM d JOIN shifts s ON s.initial <> 's' WHERE NOT blank AND NOT duplicate
    UNION ALL
    SELECT c, n, t.top, t.top, 2, 'D', CAST([] AS VARCHAR[]) FROM d, (VALUES ('E'), ('S'), ('O'), ('P')) t(top)),
ways(c, n, top, w) AS (
    SELECT DISTINCT c, CAST(0 AS BIGINT), 'E', {'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])} FROM d
    UNION ALL
    SELECT w.c, a.n, a.next, min({'cost': w.w.cost + 5 * len(i.audit) + a.cost, 'audit': w.w.audit || i.audit || a.act,
        'lines': w.w.lines || i.lines || a.line})
    FROM ways w JOIN inserts i ON w.top = i.top JOIN acts a ON a.c = w.c AND a.n = w.n + 1 AND a.top = i.next
    GROUP BY w.c, a.n, a.next),
facts AS (SELECT c, any_value(conv_id) AS conv_id, max(n) AS n,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
        count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM d GROUP BY c),
chosen AS (SELECT w.c, min({'cost': w.w.cost + 5 * len(i.audit), 'audit': w.w.audit || i.audit, 'lines': w.w.lines || i.lines}) AS w
    FROM ways w JOIN facts f ON f.c = w.c AND f.n = w.n JOIN inserts i ON i.top = w.top AND i.next IN ('E', 'P')
    GROUP BY w.c),
repaired AS (SELECT f.*, chosen.w FROM facts f JOIN chosen ON chosen.c = f.c)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(w.cost, 0) AS BIGINT) AS cost,
    coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
