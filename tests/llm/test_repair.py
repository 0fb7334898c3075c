"""Conversation repair against a plain shortest-path search."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from sevscope.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """Contract's damage on (conv, turn, role, text) rows, then their order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def brute(rows):
    """Result tuple of the rows (turn, role, text) of one conversation: the
    cheapest path over (row, roles so far as a state) with whole audits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen
                      else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def state(roles):  # what matters of the roles so far; None when they lead nowhere
        if roles in ("", "s"):
            return roles
        body = roles[1:] if roles[0] == "s" else roles
        if not re.fullmatch("(ua)*u?", body):
            return None
        return "u" if body.endswith("u") else "ua"

    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, k, roles, lines = heapq.heappop(heap)
        if (k, roles) in done:
            continue
        done.add((k, roles))
        if k == len(rows) and roles in ("", "ua"):
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
            return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal,
                    cost, audit, digest)
        moves = [(5, "I", k, c, f"{repair.ROLES[c]}:") for c in "ua"]
        if k < len(rows):
            _, role, text = rows[k]
            moves.append((2, "D", k + 1, None, None))
            if faults[k] not in ("blank", "duplicate"):
                stay = 5 if faults[k] else 0
                moves.append((stay, "K", k + 1, role[:1], f"{role}:{text}"))
                moves += [(stay + 1, "R", k + 1, c, f"{repair.ROLES[c]}:{text}") for c in "ua"]
        for more, letter, to, c, line in moves:
            after = roles if c is None else state(roles + c) if c and c in "sua" else None
            if after is not None:
                heapq.heappush(heap, (cost + more, audit + letter, to, after, lines if c is None else (*lines, line)))


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def brute_all(rows):
    by = {}
    for conv, turn, role, text in damaged(rows):
        by.setdefault(conv, []).append((turn, role, text))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: brute(by[c]) if c in by else empty for c in {r[0] for r in rows}}


def random_rows(seed, convs, long=0):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "user", "assistant", None, ""]
    texts = ["Yes.", "no", " ", "", None, "Why?", "Yes.", "end. \n", "x.y", "..", "é!", "a\x1c", "long " * 50]
    rows = []
    for conv in range(convs):
        for k in range(rng.randint(1, 9)):
            turn = rng.choice([k, k, k, None, k + 3, 2])
            rows.append((conv or None, turn, rng.choice(roles), rng.choice(texts)))
    for k in range(long):
        rows.append((1000, k, rng.choice(roles[:5]), f"{rng.choice(texts[:4])} {rng.randint(0, long // 2)}."))
    rows += rng.sample(rows, min(5, len(rows)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def found(spark, rows):
    out = repair.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in out}
    assert len(out) == len(got)
    return got


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rows = random_rows(seed, 150)
    assert found(spark, rows) == brute_all(rows)


def test_a_conversation_over_many_partitions(spark):
    rows = random_rows(7, 20, long=600)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == brute_all(rows)


def test_chained_runs_equal_one_run():
    rng = random.Random(3)
    for _ in range(300):
        kinds = [(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 12))]
        repairer = repair.Repairer()
        whole = repair.Way(repairer, repair.EMPTY)
        for kind in kinds:
            whole.read(kind)
        cost, letters, closing = whole.accepted()
        cut = rng.randint(1, len(kinds))
        runs = []
        for part in filter(None, (kinds[:cut], kinds[cut:])):
            ways = [repair.Way(repairer, top) for top in range(4)]
            for way in ways:
                for kind in part:
                    way.read(kind)
            runs.append([(w.entry, *e) for w in ways for e in w.exits()])
        again, scripts = repair.chain(runs)
        assert (again, "".join(scripts)) == (cost, "".join(letters) + closing)


def test_edits_are_a_repaired_conversation(spark):
    rows = [r for r in random_rows(11, 60)]
    edits, conversations = repair.repair(spark.createDataFrame(rows, SCHEMA + ""))
    by = {}
    for r in sorted(edits.collect(), key=lambda r: (r.run, r.at)):
        by.setdefault(r.conv_id, []).append(r)
    for conv in conversations.collect():
        mine = by[conv.conv_id]
        assert "".join(r.action for r in mine) == conv.audit
        assert GRAMMAR.fullmatch("".join(r.role[:1] for r in mine if r.action != "D"))
        assert all((r.text is None) == (r.action == "D") for r in mine)


def test_many_equal_rows_and_long_texts(spark):
    rows = ([(1, 0, "user", "same.")] * 500 + [(1, None, "assistant", "same.")] * 500
            + [(2, k, "user" if k % 2 else "assistant", "x" * 200_000 + ".") for k in range(5)]
            + [(3, None, None, None)] * 30 + [(None, None, None, None), (4, 5, "system", "only.")])
    assert found(spark, rows) == brute_all(rows)


def test_hazards(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.digests(empty).count() == 0
    edits, conversations = repair.repair(empty)
    assert edits.count() == conversations.count() == 0
    clash = "conv_id int, turn int, role string, text string, run long, at string, said string, audit int, code int, copy int"
    rows = [(1, 0, "user", "Hi.", 3, "x", "y", 1, 0, 0), (1, 1, "assistant", "Ho.", 3, "x", "y", 1, 0, 0)]
    out = repair.digests(spark.createDataFrame(rows, clash)).collect()
    assert tuple(out[0][c] for c in COLUMNS) == brute_all([r[:4] for r in rows])[1]


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(r) for r in rows])
    got = con.execute(repair.ORACLE)
    names = [c[0] for c in got.description]
    return {r[0]: tuple(dict(zip(names, r))[c] for c in COLUMNS) for r in got.fetchall()}


@pytest.mark.parametrize("seed", range(2))
def test_sql_equals_the_search(seed):
    rows = random_rows(seed, 100)
    assert by_sql(rows) == brute_all(rows)


def test_sql_on_empty_table():
    assert by_sql([]) == {}
