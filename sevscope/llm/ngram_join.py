"""N-gram Jaccard join by signature trees.

Documents are sets of distinct 5-word shingles (64-bit codes); two link when
the Jaccard similarity of their sets is 0.75 or more. Equal sets are one class
from the start, so exact copies are never joined to each other.

1. Which sets can meet. In any fixed order of the codes, two sets that link
   share a code among the first ``n - ceil(0.75 n) + 1`` of each. The order
   puts codes that many documents share last (by count), others by value; they
   are found among the codes of one class in ``SAMPLE``, which changes the work
   only, never the result. The prefix codes travel as packed arrays, dealt by
   code; codes held by two classes or more give groups, and equal groups are
   kept once, with the number of their codes. Groups over ``SMALL`` classes
   that have the same least hash of a class are joined into one, so a family
   is met a few times and not once for each code that its members share.
2. Signature trees. A class has a bitmap of its codes (4 to 8 bits a code).
   Per unit of a group, bitmaps sorted by size become leaves, leaves become
   nodes that hold the OR of their bitmaps and the range of their sizes. A dual
   traversal drops a pair of nodes when their sizes are too far apart, when the
   maximum possible overlap of their members is too small, or when all members
   are in one component already.
3. Spanning passes. Each class goes to its largest group, groups are cut into
   blocks, and a traversal takes likely links as if they were true, so a dense
   block gives a spanning tree, not its pairs. Checked links join classes to
   components; then one class of each component stands for it, in all groups
   over a block (``SWEEPS`` times, which changes the work only).
   A dense family is one component before any two of its blocks meet.
4. Completing pass. Joined groups that still hold two components are laid into
   blocks by component, and every pair of blocks that is not one component and
   whose sizes allow a link is a unit: first a spanning tree of its likely
   links is checked, then every pair that the bounds allow. In groups of at
   most ``SMALL`` classes the prefix codes that two classes share are counted; a
   link shares several, by the sizes of the sets, and pairs of fewer are
   dropped. What the passes before proposed wrongly is looked at again here, so
   no link is lost. A large family of unlinked texts that the bounds cannot
   part still costs pairs of blocks.
5. Verification. Pairs are checked on the codes of the whole texts: first the
   most similar pair of each component, then of each pair of components, then
   what still joins two.

Links follow the contract on 64-bit codes: two different shingles share a code
with probability 2**-64.

Defined results: null, empty or wordless texts have no shingle and are their
own component; fewer than five words are one shingle; repeated rows are
copies; a null id links with nothing and has a null component; ids that repeat
with different texts are joined through the id only in the smallest id shown,
not as a link; other columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sevscope.llm.common import (BROADCAST_ROWS, Forest, broadcast_if_small, byte_slices, connected_components, few,
                                 text_bytes)
from sevscope.llm.shingles import mix, shingle_sets
from sevscope.session import release, stage

WORDS, SIMILARITY = 5, (75, 100)
HOT_SHARE, HOT_TOKENS, WIDE = 4e-4, 1_000_000, 50_000
SAMPLE, HOT_HELD, COUNT_PARTS = 16, 48, 256      # for the order of the codes only
FLUSH_CODES, PART_CODES = 500_000, 1_000_000
LEAF, FAN, BLOCK = 8, 4, 512
FEW_ROWS = 50_000          # rows that are dealt to a few tasks only
SMALL = 32                 # rows of a group whose pairs are counted one by one
SWEEPS = 1                 # spanning passes over components, before the completing one


def set_code(codes: np.ndarray) -> int:
    """64-bit code of a set of codes (signed, never of an empty set)."""
    return int(mix(mix(codes + np.uint64(len(codes))).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def prefix_length(n: int, similarity=SIMILARITY) -> int:
    a, b = similarity
    return n - (-(-a * n // b)) + 1


# --- pass 1: classes, and codes that many documents share -------------------

_FACTS = "doc_id {id}, n long, code long, part long, codes binary"


def _by_part(parts: np.ndarray, *arrays: np.ndarray):
    """(distinct parts, per array its bytes of each part)."""
    order = np.argsort(parts, kind="stable")
    parts = parts[order]
    cuts = np.flatnonzero(np.diff(parts, prepend=-1))
    ends = np.append(cuts[1:], len(parts))
    return [parts[cuts]] + [[x[a:b].tobytes() for a, b in zip(cuts, ends)] for x in (x[order] for x in arrays)]


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _facts(words: int):
    """Arrow pass over (doc_id, text): per document its set size and class,
    and the codes of one class in ``SAMPLE``, packed by part."""
    def packed(held, id_type):
        codes = np.concatenate(held)
        part, codes = _by_part(_part_of(codes, COUNT_PARTS), codes)
        n = len(part)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
             pa.array(part, pa.int64()), pa.array(codes, pa.binary())], names=names)

    names = ["doc_id", "n", "code", "part", "codes"]

    def run(batches):
        held, size, seen, id_type = [], 0, set(), None
        for batch in byte_slices(batches, 1):
            id_type = batch.schema.field(0).type
            sets = shingle_sets([t or b"" for t in batch.column(1).to_pylist()], words)
            own = [set_code(s) if len(s) else None for s in sets]
            for s, code in zip(sets, own):
                if code is not None and code % SAMPLE == 0 and code not in seen:
                    seen.add(code)
                    held.append(s)
                    size += len(s)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.int64()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)
            if size >= FLUSH_CODES:
                yield packed(held, id_type)
                held, size, seen = [], 0, set()
        if held:
            yield packed(held, id_type)
    return run


def _often(least: float):
    """Arrow pass over parts dealt to a task: codes held ``least`` times or
    more and how often."""
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for part, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(part, []).append(np.frombuffer(codes, dtype=np.uint64))
        for part in held:
            codes, counts = np.unique(np.concatenate(held[part]), return_counts=True)
            many = counts >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], names=["token", "held"])
    return run


# --- pass 2: prefix codes, dealt by code ------------------------------------

def ordered_prefix(codes: np.ndarray, hot: np.ndarray, rank: np.ndarray, similarity=SIMILARITY):
    """The first codes of a set in the global order: codes outside ``hot`` by
    value, then hot ones by rank."""
    n = prefix_length(len(codes), similarity)
    if not len(hot):
        return codes[:n]
    at = np.searchsorted(hot, codes)
    at[at == len(hot)] = 0
    is_hot = hot[at] == codes
    cold = codes[~is_hot]
    if len(cold) >= n:
        return cold[:n]
    warm = codes[is_hot]
    return np.concatenate([cold, warm[np.argsort(rank[at[is_hot]], kind="stable")][:n - len(cold)]])


def _prefixes(hot_side, words: int, parts: int, similarity):
    """Arrow pass over texts: packed (codes, classes) arrays by part. Codes in
    the wide list are dealt by class instead, so none gathers in one task."""
    def packed(held):
        codes = np.concatenate([c for c, _ in held])
        owners = np.repeat(np.array([o for _, o in held], dtype=np.int64), [len(c) for c, _ in held])
        key = np.where(np.isin(codes, hot_side.value[2]), mix(owners.view(np.uint64)), codes)
        part, codes, owners = _by_part(_part_of(key, parts), codes, owners)
        return pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array(codes, pa.binary()), pa.array(owners, pa.binary())],
            names=["part", "codes", "owners"])

    def run(batches):
        hot, rank, _ = hot_side.value
        held, size, seen = [], 0, set()
        for batch in byte_slices(batches, 0):
            for s in shingle_sets([t or b"" for t in batch.column(0).to_pylist()], words):
                code = set_code(s) if len(s) else None
                if code is None or code in seen:
                    continue
                seen.add(code)
                held.append((ordered_prefix(s, hot, rank, similarity), code))
                size += len(held[-1][0])
            if size >= FLUSH_CODES:
                yield packed(held)
                held, size = [], 0
            if len(seen) > FLUSH_CODES:
                seen = set()
        if held:
            yield packed(held)
    return run


def _groups(hot_side):
    """Arrow pass over one partition's packed arrays: (group, code, held) of
    every distinct set of two or more classes that share codes, ``held`` being
    the number of these, and of every class that holds a wide code."""
    def run(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            for part, c, o in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parts.setdefault(part, []).append((np.frombuffer(c, dtype=np.uint64), np.frombuffer(o, dtype=np.int64)))
        while parts:
            tokens, owners = (np.concatenate(x) for x in zip(*parts.popitem()[1]))
            for columns in grouped(tokens, owners):
                for a in range(0, len(columns[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a:a + 100_000]) for c in columns],
                                                     names=["group", "code", "held"])

    def grouped(tokens, owners):
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
        tokens, owners = tokens[new], owners[new]
        wide = np.isin(tokens, hot_side.value[2])
        out = [(mix(tokens[wide]).view(np.int64), owners[wide], np.ones(int(wide.sum()), dtype=np.int64))]
        tokens, owners = tokens[~wide], owners[~wide]
        if len(tokens):
            start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            size = np.diff(np.append(start, len(tokens)))
            name = mix(np.add.reduceat(mix(owners.view(np.uint64)), start) + size.astype(np.uint64))
            many = np.flatnonzero(size > 1)
            _, first, held = np.unique(name[many], return_index=True, return_counts=True)
            kept = many[first]
            rows = np.concatenate([np.arange(s, s + n) for s, n in zip(start[kept], size[kept])]
                                  or [np.zeros(0, dtype=np.int64)])
            out.append((np.repeat(name[kept], size[kept]).view(np.int64), owners[rows],
                        np.repeat(held.astype(np.int64), size[kept])))
        return out

    return run


# --- signatures and trees ---------------------------------------------------

def bitmap_width(n: int) -> int:
    return max(256, 1 << (4 * n - 1).bit_length())


def bitmap(codes: np.ndarray) -> bytes:
    width = bitmap_width(len(codes))
    bits = np.zeros(width, dtype=bool)
    bits[(codes & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: int, width: int, to: int) -> int:
    """The bitmap of the same codes with fewer bits."""
    while width > to:
        width //= 2
        bits = (bits | bits >> width) & ((1 << width) - 1)
    return bits


class Node:
    """A node of a signature tree: OR of its members' bitmaps, their range of
    sizes, and how many more codes than bits a member can have."""

    __slots__ = ("bits", "width", "low", "high", "slack", "members", "below", "solid")

    def __init__(self, members, below=()):
        self.members, self.below, self.solid = [m[0] for m in members], below, False
        self.width = min(m[3] for m in members)
        self.low, self.high = min(m[1] for m in members), max(m[1] for m in members)
        self.bits = self.slack = 0
        for _, n, bits, width in members:
            own = fold(bits, width, self.width)
            self.bits |= own
            self.slack = max(self.slack, n - own.bit_count())


def tree(members: list[tuple]) -> Node:
    """Signature tree of (place, size, bitmap, width) rows."""
    members = sorted(members, key=lambda m: (int(16 * math.log(m[1])), m[0]))
    level = [(members[k:k + LEAF], ()) for k in range(0, len(members), LEAF)]
    nodes = [(rows, Node(rows)) for rows, _ in level]
    while len(nodes) > 1:
        up = []
        for k in range(0, len(nodes), FAN):
            rows = [m for r, _ in nodes[k:k + FAN] for m in r]
            up.append((rows, Node(rows, tuple(n for _, n in nodes[k:k + FAN]))))
        nodes = up
    return nodes[0][1]


def similarity_bound(a: tuple, b: tuple, similarity) -> tuple[float, float]:
    """(largest possible, expected) Jaccard similarity of two members by their
    bitmaps; (0, 0) when their sizes are too far apart."""
    num, den = similarity
    (_, na, xa, wa), (_, nb, xb, wb) = a, b
    if den * min(na, nb) < num * max(na, nb):
        return 0.0, 0.0
    width = min(wa, wb)
    xa, xb = fold(xa, wa, width), fold(xb, wb, width)
    bits_a, bits_b, both = xa.bit_count(), xb.bit_count(), (xa & xb).bit_count()
    only_a, only_b = bits_a - both, bits_b - both     # each hides a code that the other lacks
    most = min(na - only_a, nb - only_b)
    likely = (na - only_a / max(0.05, 1 - bits_b / width) + nb - only_b / max(0.05, 1 - bits_a / width)) / 2
    return most / (na + nb - most), likely / (na + nb - likely)


def dual_traversal(left: Node, right: Node, rows: list[tuple], forest: Forest, similarity, spanning: bool):
    """(place, place, expected similarity) of pairs, one below each node, that
    may link and are not in one component yet. With ``spanning`` only likely
    pairs are taken and each is treated as a link at once, so they form a
    forest."""
    num, den = similarity

    def solid(node):
        if not node.solid:
            root = forest.find(node.members[0])
            node.solid = all(forest.find(m) == root for m in node.members)
        return node.solid

    todo = [(left, right)]
    while todo:
        a, b = todo.pop()
        if den * a.high < num * b.low or den * b.high < num * a.low:
            continue
        width = min(a.width, b.width)
        common = (fold(a.bits, a.width, width) & fold(b.bits, b.width, width)).bit_count()
        slack = min(x.slack for x in (a, b) if x.width == width)
        if (num + den) * (common + slack) < num * (a.low + b.low):
            continue
        if solid(a) and solid(b) and forest.find(a.members[0]) == forest.find(b.members[0]):
            continue
        if a.below or b.below:
            if a is b:
                todo += [(x, y) for i, x in enumerate(a.below) for y in a.below[i:]]
            elif a.below and (not b.below or len(a.members) >= len(b.members)):
                todo += [(x, b) for x in a.below]
            else:
                todo += [(a, y) for y in b.below]
            continue
        for i, x in enumerate(a.members):
            for y in (a.members[i + 1:] if a is b else b.members):
                if forest.find(x) == forest.find(y):
                    continue
                most, likely = similarity_bound(rows[x], rows[y], similarity)
                if den * (likely if spanning else most) >= num - 1e-9:
                    if spanning:
                        forest.union(x, y)
                    yield x, y, likely


_FOUND = "a long, b long, likely double"


def _candidates(similarity, mode: str, nth: int):
    """Arrow pass over rows sorted by unit (group, lo, hi): proposed pairs (a,
    b, expected similarity) of classes of different components. Mode ``span``
    gives a spanning tree of the likely ones, ``all`` every pair that the
    bounds allow. ``nth`` changes the order in which likely pairs are met."""
    def propose(part, _, lo, hi):
        codes = mix(np.array([p[1] for p in part], dtype=np.int64).view(np.uint64) + np.uint64(nth))
        part = [part[k] for k in np.argsort(codes).tolist()]
        rows, forest, known = [], Forest(len(part)), {}
        for k, (_, code, n, bits, comp) in enumerate(part):
            rows.append((k, n, int.from_bytes(bits, "little"), 8 * len(bits)))
            forest.union(known.setdefault(comp, k), k)
        if len(known) < 2:
            return
        left = [r for r, p in zip(rows, part) if p[0] == lo]
        right = left if lo == hi else [r for r, p in zip(rows, part) if p[0] == hi]
        if not left or not right:
            return
        a = tree(left)
        b = a if lo == hi else tree(right)
        for x, y, likely in dual_traversal(a, b, rows, forest, similarity, mode == "span"):
            yield *sorted((part[x][1], part[y][1])), likely

    types = (pa.int64(), pa.int64(), pa.float64())
    names = ["a", "b", "likely"]

    def out(found):
        columns = list(zip(*found)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches):
        part, key, found = [], None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for now, row in zip(zip(*columns[:3]), zip(*columns[3:])):
                if now != key:
                    if len(part) > 1:
                        found += propose(part, *key)
                    part, key = [], now
                part.append(row)
            if len(found) > 50_000:
                yield out(found)
                found = []
        if len(part) > 1:
            found += propose(part, *key)
        yield out(found)
    return run


# --- verification -----------------------------------------------------------

def _signatures(words: int):
    """Arrow pass over (code, text): keeps texts of that class, adds size and
    bitmap; the text is compressed, as it may travel to several checks."""
    def run(batches):
        for batch in byte_slices(batches, 1):
            codes = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            rows = [(c, len(s), bitmap(s), pa.compress(t, "zstd", asbytes=True), len(t))
                    for c, s, t in zip(codes, shingle_sets(texts, words), texts) if len(s) and set_code(s) == c]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary()),
                 pa.array([r[4] for r in rows], pa.int64())], names=["code", "n", "bits", "packed", "size"])
    return run


def _verify(words: int, similarity):
    """Arrow pass over (a, b, packed text, its size) sorted by pair, two rows
    each: (a, b, link)."""
    num, den = similarity

    def checked(held):
        sets = shingle_sets([t for _, t in held], words)
        pairs, links = [], []
        for k in range(0, len(held), 2):
            x, y = sets[k], sets[k + 1]
            both = len(np.intersect1d(x, y, assume_unique=True))
            pairs.append(held[k][0])
            links.append(den * both >= num * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()),
             pa.array(links, pa.bool_())], names=["a", "b", "link"])

    def run(batches):
        held, size, waiting = [], 0, None
        for batch in batches:
            for a, b, packed, full in zip(*(batch.column(i).to_pylist() for i in range(4))):
                t = pa.decompress(packed, full, "zstd", asbytes=True)
                if waiting is None or waiting[0] != (a, b):
                    waiting = ((a, b), t)
                    continue
                held += [waiting, ((a, b), t)]
                size += len(t) + len(waiting[1])
                waiting = None
                if size > 1 << 20:
                    yield checked(held)
                    held, size = [], 0
        if held:
            yield checked(held)
    return run


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                       similarity: tuple[int, int] = SIMILARITY, block: int = BLOCK, wide: int = WIDE,
                       hot_share: float = HOT_SHARE) -> DataFrame:
    """(key, n_shingles, component_id) per document."""
    spark = docs.sparkSession
    ins = docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("text"))
    kind = ins.schema["doc_id"].dataType.simpleString()
    facts = stage(ins.mapInArrow(_facts(words), _FACTS.format(id=kind)), "nj_facts")
    members = facts.where("n IS NOT NULL").select("doc_id", "n", "code")
    total = members.where("doc_id IS NOT NULL").agg(F.count("code"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total[1] / 4 / PART_CODES))
    often = max(3, min(hot_share * total[0], HOT_HELD) / SAMPLE)
    hot = (facts.where("part IS NOT NULL").select("part", "codes").repartition(min(parts, COUNT_PARTS), "part")
           .mapInArrow(_often(often), "token long, held long").orderBy(F.desc("held"), "token")
           .limit(HOT_TOKENS).toPandas())
    tokens = hot["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    rank = -np.arange(len(tokens))[order]
    hot_side = spark.sparkContext.broadcast(
        (tokens[order], rank, np.sort(tokens[SAMPLE * hot["held"].to_numpy(np.int64) >= wide])))

    entries = ins.where("doc_id IS NOT NULL").select("text").mapInArrow(
        _prefixes(hot_side, words, 8 * parts, similarity), "part long, codes binary, owners binary")
    groups = stage(entries.repartition(parts, "part").mapInArrow(_groups(hot_side), "group long, code long, held long")
                   .groupBy("group", "code").agg(F.sum("held").alias("held")), "nj_groups")

    classes = stage(members.where("doc_id IS NOT NULL AND code IS NOT NULL").groupBy("code")
                    .agg(F.min("doc_id").alias("least")), "nj_classes")
    wanted = stage(groups.select("code").distinct().join(classes, "code")
                   .select("code", F.col("least").alias("doc_id")), "nj_wanted")
    texts = ins.join(broadcast_if_small(wanted), "doc_id").select("code", "text").mapInArrow(
        _signatures(words), "code long, n long, bits binary, packed binary, size long")
    if members.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        texts = texts.dropDuplicates(["code"])
    texts = stage(texts, "nj_texts")

    release(wanted)
    comp = stage(texts.select("code", F.col("code").alias("comp")), "nj_comp")
    by_size = groups.groupBy("group").agg(F.count("*").alias("size"), F.min(F.xxhash64("code")).alias("unit"))
    of_size = stage(by_size, "nj_sizes")
    wide_groups = of_size.where(F.col("size") > min(SMALL, block)).select("group", "unit")
    joined = stage(groups.join(broadcast_if_small(wide_groups), "group").select(F.col("unit").alias("group"), "code")
                   .distinct(), "nj_joined")
    pairs = groups.join(broadcast_if_small(wide_groups), "group", "left_anti")
    sizes = stage(joined.groupBy("group").agg(F.count("*").alias("size")), "nj_sizes")
    large = stage(sizes.where(F.col("size") > block), "nj_large")
    either = joined.join(broadcast_if_small(sizes), "group").unionByName(
        pairs.join(broadcast_if_small(of_size.drop("unit")), "group").drop("held"))
    largest = stage(either.groupBy("code").agg(F.max(F.struct("size", "group")).alias("m"))
                    .select(F.col("m.group").alias("group"), "code"), "nj_largest")
    release(sizes)
    comp, tried = _sweep(largest, large, texts, comp, None, words, similarity, block, 0)
    release(largest)
    if large.limit(1).count():
        in_large = stage(joined.join(broadcast_if_small(large.select("group")), "group", "left_semi"), "nj_in_large")
        for nth in range(1, SWEEPS + 1):
            stands = in_large.join(broadcast_if_small(comp), "code").groupBy("group", "comp").agg(F.min("code").alias("code"))
            before = comp
            comp, tried = _sweep(stands.select("group", "code"), large, texts, comp, tried, words, similarity, block,
                                 nth)
            if comp is before:
                break
        release(in_large)
    comp = _complete(pairs, joined, texts, comp, tried, words, similarity, block)
    release(large, groups, of_size, joined, texts)
    roots = comp.where("comp != code").select(F.col("code").alias("node"), F.col("comp").alias("root"))

    placed = stage(classes.join(broadcast_if_small(roots.withColumnRenamed("node", "code")), "code", "left")
                   .select("code", "least", F.coalesce("root", "code").alias("root")), "nj_placed")
    least = stage(placed.groupBy("root").agg(F.min("least").alias("component_id")), "nj_least")
    named = stage(placed.join(broadcast_if_small(least), "root").select("code", "component_id"), "nj_named")
    return members.join(broadcast_if_small(named), "code", "left").select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
        .alias("component_id"))


def _propose(units: DataFrame, texts: DataFrame, comp: DataFrame, similarity, mode: str, nth: int = 0) -> DataFrame:
    """Pairs of the units' rows (group, lo, hi, own, code), a staged table. The
    rows are staged without bitmaps first, so that the bitmaps of all classes
    are shuffled only for a pass over many rows."""
    rows = stage(units.join(broadcast_if_small(comp), "code"), "nj_units")
    signed = (texts.select("code", "n", "bits").join(broadcast_if_small(rows), "code")
              .select("group", "lo", "hi", "own", "code", "n", "bits", "comp").repartition("group", "lo", "hi"))
    found = stage(few(signed, rows.count() <= FEW_ROWS).sortWithinPartitions("group", "lo", "hi")
                  .mapInArrow(_candidates(similarity, mode, nth), _FOUND), "nj_found")
    release(rows)
    return found


def _block_of(spread, blocks):
    return F.pmod(F.xxhash64(spread, F.lit("block")), blocks)


def _sweep(rows: DataFrame, large: DataFrame, texts: DataFrame, comp: DataFrame, tried, words: int, similarity,
           block: int, nth: int):
    """One spanning pass over (group, code) rows, each in one block of its
    group (``large`` has the groups over a block and their sizes), and the
    check of its links: (comp, tried); the same ``comp`` when nothing joined."""
    units = rows.join(broadcast_if_small(large), "group", "left").withColumn(
        "own", _block_of("code", F.ceil(F.coalesce("size", F.lit(1)) / block)))
    units = units.select("group", F.col("own").alias("lo"), F.col("own").alias("hi"), "own", "code")
    found = _propose(units, texts, comp, similarity, "span", nth)
    out = _settle(found, texts, comp, tried, words, similarity, True)
    release(found)
    return out


def _shared_pairs(similarity):
    """Arrow pass over (group, code, comp, n, held) sorted by group: (a, b,
    held, need, most) of pairs of one group, of different components and of
    sizes that allow a link. ``held`` is the number of prefix codes the pair
    shares in the groups seen; a linked pair shares ``need`` or more in all:
    of the two prefixes take the one that ends first. A link leaves at most n -
    overlap of its codes outside the other set, and the rest of them are in
    the other prefix too, as that one reaches farther. ``most`` is the length
    of the shorter prefix."""
    num, den = similarity

    def pairs(group, code, comp, n, held):
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(start, len(group)))
        mixed = np.repeat(np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start), size)
        after = np.where(mixed, np.repeat(start + size, size) - np.arange(len(group)) - 1, 0)
        out, waiting = [], 0
        for step in range(1, int(after.max(initial=0)) + 1):
            x = np.flatnonzero(after >= step)
            y = x + step
            ok = (comp[x] != comp[y]) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
            x, y = x[ok], y[ok]
            out.append((np.minimum(code[x], code[y]), np.maximum(code[x], code[y]), held[x], n[x], n[y]))
            waiting += len(x)
            if waiting > 500_000:
                yield summed(out)
                out, waiting = [], 0
        if waiting:
            yield summed(out)

    def summed(out):
        a, b, held, na, nb = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((b, a))
        a, b, held, na, nb = (c[order] for c in (a, b, held, na, nb))
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        held, a, b, na, nb = np.add.reduceat(held, first), *(c[first] for c in (a, b, na, nb))
        pre_a, pre_b = (k - -(-num * k // den) + 1 for k in (na, nb))
        overlap = -(-num * (na + nb) // (num + den))
        need = np.maximum(1, np.minimum(pre_a - na, pre_b - nb) + overlap)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, held, need, np.minimum(pre_a, pre_b))],
                                          names=["a", "b", "held", "need", "most"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))         # the last group may go on
            if cut:
                yield from pairs(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield from pairs(*held)
    return run


def _complete(pairs: DataFrame, joined: DataFrame, texts: DataFrame, comp: DataFrame, tried, words: int, similarity,
              block: int):
    """The completing pass: ``comp`` after every pair between components of a
    group that can be a link was looked at. Pairs of small groups (group, code,
    held) are counted; a pair that shares a wider group too is met in the
    blocks of ``joined`` (group, code)."""
    num, den = similarity
    sized = broadcast_if_small(texts.select("code", "n"))
    placed = stage(joined.join(broadcast_if_small(comp), "code").join(sized, "code")
                   .select("group", "code", "comp", "n"), "nj_placed")
    small = placed.count() <= FEW_ROWS
    per = placed.groupBy("group", "comp").agg(F.count("*").alias("m"))
    several = stage(few(per, small).groupBy("group").agg(
        F.count("*").alias("comps"), F.sum(F.when(F.col("m") < block, F.col("m")).otherwise(0)).alias("mixed"))
        .where("comps > 1").drop("comps"), "nj_several")
    small_pairs = pairs.count() <= FEW_ROWS
    units, kept = None, []
    if several.limit(1).count():
        units, kept = _blocks(placed, several, similarity, block)
        found = _propose(units, texts, comp, similarity, "span", 0)
        comp, tried = _settle(found, texts, comp, tried, words, similarity, True)
        release(found)
    rows = pairs.join(broadcast_if_small(comp), "code").join(sized, "code").select("group", "code", "comp", "n", "held")
    found = (few(rows.repartition("group"), small_pairs).sortWithinPartitions("group")
             .mapInArrow(_shared_pairs(similarity), "a long, b long, held long, need long, most long")
             .groupBy("a", "b").agg(F.sum("held").alias("held"), F.max("need").alias("need"), F.max("most").alias("most"))
             .where("held >= need").select("a", "b", (F.col("held") / F.col("most")).alias("likely")))
    found = stage(few(found, small_pairs), "nj_found")
    if units is not None:
        found = found.unionByName(_propose(units, texts, comp, similarity, "all", 1))
    comp, _ = _settle(found, texts, comp, tried, words, similarity, True)
    release(placed, several, *kept)
    return comp


def _blocks(placed: DataFrame, several: DataFrame, similarity, block: int):
    """Units (group, lo, hi, own, code) of the groups ``several``: every two
    rows of different components whose sizes allow a link meet in one. Also the
    staged tables behind them."""
    num, den = similarity
    # blocks of one component have its code and a number as name, mixed ones a
    # number only; components below a block share mixed blocks
    small = placed.count() <= FEW_ROWS
    wide = placed.join(broadcast_if_small(several), "group")
    wide = wide.join(wide.groupBy("group", "comp").agg(F.count("*").alias("m")), ["group", "comp"])
    one = F.col("m") >= block
    wide = wide.select("group", "code", "n", F.when(one, F.col("comp")).alias("only"), F.when(
        one, F.xxhash64("comp", _block_of("code", F.ceil(F.col("m") / block))))
        .otherwise(_block_of("comp", F.greatest(F.ceil(F.col("mixed") / block), F.lit(1)))).alias("own"))
    wide = stage(few(wide, small), "nj_wide")
    names = stage(few(wide, small).groupBy("group", "own").agg(F.first("only").alias("only"), F.min("n").alias("low"),
                                                   F.max("n").alias("high")), "nj_blocks")
    x, y = (names.select("group", *[F.col(c).alias(f"{c}_{s}") for c in ("own", "only", "low", "high")]) for s in "xy")
    pairs = x.join(broadcast_if_small(y), "group").where(
        (F.col("own_x") <= F.col("own_y")) & (F.col("only_x").isNull() | F.col("only_y").isNull()
                                              | (F.col("only_x") != F.col("only_y")))
        & (den * F.col("high_x") >= num * F.col("low_y")) & (den * F.col("high_y") >= num * F.col("low_x")))
    pairs = pairs.select("group", F.col("own_x").alias("lo"), F.col("own_y").alias("hi"),
                         F.explode(F.array_distinct(F.array("own_x", "own_y"))).alias("own"))
    pairs = stage(pairs, "nj_block_pairs")
    units = wide.join(broadcast_if_small(pairs), ["group", "own"]).select("group", "lo", "hi", "own", "code")
    return units, [wide, names, pairs]


def _moved(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` with the components of their ends after ``roots``."""
    for end in ("ca", "cb"):
        pairs = pairs.join(roots.withColumnRenamed("node", end), end, "left").withColumn(
            end, F.coalesce("root", end)).drop("root")
    return pairs.select("a", "b", "likely", "ca", "cb")


def _settle(found: DataFrame, texts: DataFrame, comp: DataFrame, tried: DataFrame | None, words: int, similarity,
            at_once: bool = False):
    """Checks proposed pairs until none joins two components: (comp, tried).
    ``at_once`` checks them all in one round where they are at most as many as
    the classes. Else, while there are many, only the likeliest pair of each component is checked,
    then of each pair of components; pairs whose ends have met are dropped.
    The rounds move the pairs' own components (ca, cb) and keep the checked
    links; ``comp``, a row per class, is written once at the end."""
    n_found, n_classes = found.count(), comp.count()
    if not n_found:
        return comp, tried
    small, few_classes = n_found <= BROADCAST_ROWS, n_classes <= BROADCAST_ROWS
    pairs = (found.coalesce(1) if small else found).groupBy("a", "b").agg(F.max("likely").alias("likely"))
    likeliest = F.max(F.struct("likely", "a", "b")).alias("m")
    known = F.broadcast(comp) if few_classes else comp
    side = lambda end: known.select(F.col("code").alias(end), F.col("comp").alias(f"c{end}"))
    placed = pairs.join(side("a"), "a").join(side("b"), "b").where("ca != cb").select("a", "b", "likely", "ca", "cb")
    if tried is not None:
        placed = placed.join(broadcast_if_small(tried), ["a", "b"], "left_anti")
    pairs = stage(few(placed, small), "nj_pairs")
    joined, roots = [], None
    for nth in range(1_000):
        n_pairs = pairs.count()
        if not n_pairs:
            break
        if at_once and n_pairs <= n_classes:
            best = None
        elif nth < 3:
            best = pairs.select(F.explode(F.array("ca", "cb")).alias("c"), "a", "b", "likely").groupBy("c").agg(likeliest)
        elif nth < 6:
            best = pairs.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(likeliest)
        else:
            best = None
        now = pairs.select("a", "b")
        if best is not None:
            now = best = stage(few(best.select("m.a", "m.b").distinct(), small), "nj_best")
        n_now = n_pairs if best is None else best.count()
        ends = now.select("a", "b", F.explode(F.array("a", "b")).alias("code"))
        if 2 * n_now <= BROADCAST_ROWS:
            ends = F.broadcast(ends)
        both = (texts.select("code", "packed", "size").join(ends, "code").select("a", "b", "packed", "size")
                .repartition("a", "b"))
        checked = stage(few(both, 2 * n_now <= FEW_ROWS).sortWithinPartitions("a", "b")
                        .mapInArrow(_verify(words, similarity), "a long, b long, link boolean"), "nj_checked")
        tried = checked.select("a", "b") if tried is None else tried.unionByName(checked.select("a", "b"))
        release(best)
        joins = stage(few(checked.where("link").join(pairs, ["a", "b"]).select("ca", "cb").distinct(), small), "nj_joins")
        done = checked.select("a", "b")
        rest = pairs.join(F.broadcast(done) if n_now <= BROADCAST_ROWS else done, ["a", "b"], "left_anti")
        if joins.limit(1).count():
            joined.append(joins)
            roots = stage(connected_components(joins.coalesce(1) if small else joins, "ca", "cb"), "nj_roots")
            rest = _moved(rest, broadcast_if_small(roots)).where("ca != cb")
        if n_now == n_pairs:
            break
        old, pairs = pairs, stage(few(rest, small), "nj_pairs")
        release(old)
    else:
        raise RuntimeError("checks did not settle")
    release(pairs)
    if not joined:
        return comp, tried
    if len(joined) > 1:
        # the name of a later round's component is one of its first components,
        # so the links of all rounds give the components of the first ones
        links = joined[0]
        for joins in joined[1:]:
            links = links.unionByName(joins)
        roots = stage(connected_components(links.coalesce(1) if small else links, "ca", "cb"), "nj_roots")
    after = stage(few(comp.join(broadcast_if_small(roots), F.col("comp") == F.col("node"), "left")
                      .select("code", F.coalesce("root", "comp").alias("comp")), few_classes), "nj_comp")
    release(comp, roots, *joined)
    return after, tried


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` (same columns) with the document of the smallest id of every
    group of near-duplicates; rows with a null id stay."""
    gone = stage(jaccard_components(docs, key, text, **options).where(F.col(key) != F.col("component_id"))
                 .select(F.col(key).alias("__nj_key")).distinct(), "nj_gone")
    return docs.join(broadcast_if_small(gone), F.col(key) == F.col("__nj_key"), "left_anti")
