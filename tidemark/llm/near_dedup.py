"""Near-duplicates by a chosen-path set similarity join.

A document is its set of word shingles. Trees branch documents recursively: a node picks a few minwise coordinates (one
over the threshold on average) and sends each document to the child named by its value there, so similar documents stay
together and others part. Small nodes are compared exhaustively by their sketches. A node too large for that is compared
with a few pivots that are alike; what is like them is joined, and what is not is compared with the whole node if it is
little, and branches on with the node if it is much, so every node ends small or joined. Independent trees are repeated
until a link is missed with a probability below the target. What the sketches join loosely is then confirmed on full
sets, component by component: in blocks of bounded size that share hubs, and for what a large component leaves outside
of its main part by an exact join of rare shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, release, unused
from tidemark.session import landed, ship

COORDS = 128  # minwise values of a sketch
NODE = 256  # documents in a node that is compared exhaustively
LEVELS = 4  # depth for which trees are counted; only nodes that are large and not alike go deeper
STEP = 3  # levels that they go down at once
ROUNDS = 10
MISS = 1e-4  # probability of missing a pair at the threshold, over all trees
ANCHORS = 12  # expected, of a large node
BLOCK = 256  # sets in a block of the exact check
BLOCK_TOKENS = 2_000_000
JOINED = -2  # in place of an anchor's rank: joined with its node's pivots already
HUBS = 24  # expected, of a component of more than one block
SLACK = 4.2  # standard deviations by which sketches may fall below the threshold
SLOT_BITS = 18  # slots of the table of shingle counts that tells rare from common, as a power of two
ALONE = 50_000  # edges that one task unites
TILE = 4096  # rows in a tile of one shingle's list
MAP_BITS = 26  # bits of the map that spares the second reading most sets, as a power of two

_M = np.uint64(0xFF51AFD7ED558CCD)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _M
    x = x ^ (x >> np.uint64(33))
    return x * np.uint64(0x9E3779B97F4A7C15)


_SALTS = mix(np.arange(1, COORDS // 2 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[str | None], words: int, seen: dict) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's word shingles (fewer words: the whole sequence; none: empty)."""
    if len(seen) > 200_000:
        seen.clear()
    out = []
    for t in texts:
        tokens = (t or "").encode().lower().split()
        if not tokens:
            out.append(np.empty(0, np.uint64))
            continue
        for w in set(tokens):
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))
        n = max(1, len(h) - words + 1)
        s = np.zeros(n, np.uint64)
        for k in range(min(words, len(h))):
            s = mix(s ^ h[k : k + n]) + np.uint64(k + 1)
        out.append(np.unique(s))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """COORDS minwise values of each non-empty set, as 32 bits; either half of a mixed hash gives one."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), COORDS), np.uint32)
    for k, salt in enumerate(_SALTS):
        x = (flat ^ salt) * _M
        x ^= x >> np.uint64(32)
        halves = x.view(np.uint32).reshape(-1, 2)
        for side in (0, 1):
            out[:, 2 * k + side] = np.minimum.reduceat(halves[:, side], starts)
    return out


def _read(sketches: pa.Array, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), kind).reshape(-1, COORDS)


def _brief(batches):
    """Sketches by the low byte of each coordinate: what agrees in full agrees here, so comparing these loses no pair, and
    lets a coordinate that differs pass once in 256."""
    for batch in batches:
        low = _read(batch.column("sketch")).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array([x.tobytes() for x in low], pa.binary())], ["v", "sketch"])


def children(node: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes: each node picks one coordinate, or two so often that 1 / threshold are picked on average."""
    rows, out = [], []
    for turn in (0, 1):
        h = mix(node ^ np.uint64(0xA0761D6478BD642F + turn))
        take = np.arange(len(node)) if turn == 0 else np.flatnonzero((mix(node + np.uint64(7)) >> np.uint64(40)).astype(np.float64) / (1 << 24) < 1 / threshold - 1)
        at = (h[take] >> np.uint64(32)).astype(np.int64) % COORDS
        if turn:  # never the first coordinate again
            first = (mix(node[take] ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.int64) % COORDS
            at = np.where(at == first, (at + 1) % COORDS, at)
        rows.append(take)
        out.append(mix(mix(node[take] + at.astype(np.uint64) + np.uint64(1)) ^ sketch[take, at].astype(np.uint64)))
    return np.concatenate(rows), np.concatenate(out)


def loose_for(threshold: float) -> float:
    """The share of agreeing coordinates from which sketches join."""
    return threshold - SLACK * math.sqrt(threshold * (1 - threshold) / COORDS)


def missed(threshold: float, trees: int, levels: int = LEVELS) -> float:
    """Probability that a pair at the threshold is not joined by nodes of that depth: its sketches fall below the loose
    threshold, or it parts in every tree. The trees share the coordinates, so both depend on how many of them agree."""
    out = 0.0
    for agree in range(COORDS + 1):
        share, kept = agree / COORDS, 1.0
        for _ in range(levels):
            one, two = share * kept, 1 - (1 - share * kept) ** 2
            kept = one + (1 / threshold - 1) * (two - one)
        chance = math.comb(COORDS, agree) * threshold**agree * (1 - threshold) ** (COORDS - agree)
        out += chance * ((1 - kept) ** trees if share >= loose_for(threshold) else 1.0)
    return out


def trees_for(threshold: float) -> int:
    """Trees needed so that a pair at the threshold is missed with a probability below MISS."""
    return next(n for n in range(1, 1000) if missed(threshold, n) <= MISS)


def _united(batches):
    """(v, to) of all ends of edges: the smallest vertex reachable, by union-find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array(list(map(root, list(up))), pa.int64())], ["v", "to"])


def components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """(v, label) of all ends of edges (a long, b long): label is the smallest vertex reachable.

    Each round merges every vertex into the first of its neighbours and itself, in the order of ids at first (stars begin
    at their smallest vertex) and in a new random order from then on, so a quarter of what is left goes on average whatever
    the graph; edges inside what has merged are dropped, so only the first round meets them all. What is left when no more
    than alone edges remain is united in one task. Rounds are written to the shared folder, so a lost executor costs at
    most one of them.
    """
    ship(edges.sparkSession)
    left = landed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    merged: list[DataFrame] = []
    while True:
        if left.count() <= alone:
            merged.append(landed(left.coalesce(1).mapInArrow(_united, "v long, to long"), "cc-step"))
            break
        rank = (lambda c: F.lit(0)) if not merged else (lambda c, turn=len(merged): F.xxhash64(c, F.lit(turn)))
        ends = left.select(F.col("a").alias("v"), "b").union(left.select(F.col("b").alias("v"), F.col("a").alias("b")))
        first = ends.groupBy("v").agg(F.min(F.struct(rank("b"), F.col("b").alias("to"))).alias("near")).select("v", F.least("near", F.struct(rank("v"), F.col("v").alias("to")))["to"].alias("to"))
        step = landed(first, "cc-step")
        merged.append(step)
        named = left.join(step.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        left = landed(named.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    roots = merged.pop()
    while merged:
        up = merged.pop()
        roots = up.join(roots.select(F.col("v").alias("to"), F.col("to").alias("root")), "to", "left").select("v", F.coalesce("root", "to").alias("to"))
    roots = landed(roots, "cc-roots")
    return roots.join(roots.groupBy("to").agg(F.min("v").alias("label")), "to").select("v", "label")


def by_group(frame: DataFrame, keys: list[str], join, shape: str = "a long, b long") -> DataFrame:
    """What join finds in each group of rows that agree in keys (longs and ints), as columns of shape (longs); groups
    are of bounded size.

    Rows are dealt by key, sorted by key and vertex and streamed, so the first of a group is its smallest vertex: join
    gets an Arrow batch of whole groups with the place where each begins, and returns an array for each column.
    """
    names = [x.split()[0] for x in shape.split(", ")]
    ship(frame.sparkSession)

    def work(batches):
        def edges(batch, starts):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in join(batch, starts)], names)

        held = None
        for batch in batches:
            whole = batch if held is None else pa.concat_batches([held, batch])
            if not whole.num_rows:
                continue
            change = np.zeros(whole.num_rows, bool)
            change[0] = True
            for k in keys:
                x = np.asarray(whole.column(k))
                change[1:] |= x[1:] != x[:-1]
            starts = np.flatnonzero(change)
            held = whole.slice(int(starts[-1]))
            if len(starts) > 1:
                yield edges(whole.slice(0, int(starts[-1])), starts[:-1])
        if held is not None:
            yield edges(held, np.zeros(1, np.int64))

    return frame.repartition(*keys).sortWithinPartitions(*keys, "v").mapInArrow(work, shape)


def _reached(mine: np.ndarray, todo: np.ndarray, front: list[int], loose: float) -> np.ndarray:
    """Rows that chains of loosely agreeing sketches reach from front; todo loses them."""
    hits = [np.empty(0, np.int64)]
    while front:
        x = front.pop()
        rest = np.flatnonzero(todo)
        hit = rest[(mine[rest] == mine[x]).sum(axis=1) >= loose * COORDS]
        todo[hit] = False
        front.extend(hit.tolist())
        hits.append(hit)
    return np.concatenate(hits)


def _joined(loose: float):
    """Star edges (pivot, vertex, node) within groups. A small node is one group: all that chains of loosely agreeing
    sketches join. A large one (big) comes in blocks: what chains reach from the pivots, and the rest with pivot -1.

    The pivots are the largest set of the node's anchors (anchor >= 0) that chains join. Every block holds all anchors, so
    all blocks choose the same ones; the star begins at the first of them in an order that all nodes share, so nodes of
    the same documents give the same edges. Rows with anchor JOINED are joined already, and one of them speaks for all.
    """

    def join(batch, starts):
        v, node, anchor, big = (np.asarray(batch.column(c)) for c in ("v", "node", "anchor", "big"))
        s = _read(batch.column("sketch"), "u1")
        sizes = np.diff(np.append(starts, len(v)))
        two = starts[(sizes == 2) & (big[starts] == 0)]
        near = two[(s[two] == s[two + 1]).sum(axis=1) >= loose * COORDS]
        out = [[v[near]], [v[near + 1]], [node[near]]]

        def add(pivot, rows):
            out[0].append(np.full(len(rows), pivot))
            out[1].append(v[rows])
            out[2].append(node[rows])

        for start, size in zip(starts, sizes, strict=True):
            mine = s[start : start + size]
            if big[start]:
                todo, best = np.zeros(size, bool), np.empty(0, np.int64)
                anchors = np.flatnonzero(anchor[start : start + size] >= 0)
                todo[anchors] = True
                for i in anchors:
                    if todo[i]:
                        todo[i] = False
                        some = np.append(i, _reached(mine, todo, [i], loose))
                        best = some if len(some) > len(best) else best
                todo[:] = True
                todo[best] = False
                if len(best):
                    add(v[start + best[np.argmin(anchor[start + best])]], start + np.append(best, _reached(mine, todo, best.tolist(), loose)))
                add(-1, start + np.flatnonzero(todo))
            elif size > 2:
                todo = np.ones(size, bool)
                for i in range(size):
                    if todo[i]:
                        todo[i] = False
                        hit = start + _reached(mine, todo, [i], loose)
                        told = anchor[hit] == JOINED
                        add(v[start + i], np.append(hit[~told], hit[told][: int(anchor[start + i] != JOINED)]))
        return [np.concatenate(x) for x in out]

    return join


def _linked(percent: int):
    """Within a block: exact links. A row that is already joined is not compared again, so the edges are a forest."""

    def one(v, sets, out):
        sizes = np.array([len(x) for x in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(int(flat.max()) + 1, np.int32)
        todo = np.ones(len(v), bool)
        for i in range(len(v)):
            if not todo[i]:
                continue
            todo[i] = False
            front = [i]
            while front:
                x = front.pop()
                rest = np.flatnonzero(todo & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])))
                if not len(rest):
                    continue
                mine = flat[starts[x] : starts[x] + sizes[x]]
                mark[mine] = 1
                both = np.add.reduceat(mark[flat], starts)[rest]
                mark[mine] = 0
                hit = rest[100 * both >= percent * (sizes[rest] + sizes[x] - both)]
                todo[hit] = False
                front.extend(hit.tolist())
                out.extend((v[x], v[k]) for k in hit)

    def join(batch, starts):
        v = np.asarray(batch.column("v"))
        tokens = batch.column("tokens")
        out: list = []
        for start, end in zip(starts, np.append(starts[1:], len(v)), strict=True):
            if end - start > 1:
                one(v[start:end], [np.frombuffer(tokens[k].as_buffer(), "<u8") for k in range(start, end)], out)
        return [x[0] for x in out], [x[1] for x in out]

    return join


def _exact_edges(members: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Exact links inside loose components, as edges that give the same components. members: (v, loose)."""
    sized = members.join(tokens.select("v", "n"), "v").groupBy("loose").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("t") / BLOCK_TOKENS)).cast("int")
    placed = landed(members.join(sized.where("m > 1").select("loose", blocks.alias("blocks"), "m"), "loose"), "near-placed")
    of_block = F.pmod(F.xxhash64("v", F.lit(11)), F.col("blocks")).cast("int")
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("v", F.lit(12)), F.lit(1 << 30)) < F.lit(HUBS * float(1 << 30)) / F.col("m"))
    spots = F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(of_block))
    step = placed.select("v", "loose", F.explode(spots).alias("block"))
    edges = landed(by_group(step.join(tokens.select("v", "tokens"), "v"), ["loose", "block"], _linked(percent)), "near-edges")
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return edges
    # what large components leave outside their main part is joined with the rest by rare shingles
    parts = large.join(components(edges), "v", "left").select("v", "loose", of_block.cast("long").alias("block"), F.coalesce("label", "v").alias("part"))
    main = parts.groupBy("loose", "part").agg(F.count("*").alias("k")).groupBy("loose").agg(F.max(F.struct("k", "part")).alias("x")).select("loose", F.col("x.part").alias("main"))
    told = landed(parts.join(main, "loose").select("v", "loose", "block", "part", (F.col("part") != F.col("main")).cast("int").alias("out")), "near-told")
    asked = landed(told.join(told.where("out = 1").select("loose").distinct(), "loose", "left_semi").join(tokens, "v"), "near-asked")
    return edges if asked.isEmpty() else edges.union(_rare_edges(asked, tokens, percent))


def _least(percent: int, sizes):
    """The intersection that two sets of that many shingles together need to be linked."""
    return -(-percent * sizes // (100 + percent))


def _rare_edges(asked: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """All links between different parts of a loose component, one side outside of its main part.
    asked: (v, loose, block, part, out, n, tokens).

    Shingles are ordered from rare to common. Linked sets share one of the first shingles of each, and from the first
    one that they share on enough must be left in both; of two sets the smaller one alone decides what its size allows.
    So a list of a common shingle holds few sets that can still be linked, however many share it. Lists are compared in
    tiles of bounded size; what passes says which blocks an outsider must visit, where it meets the full sets.
    """

    def count(batches):
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for x in batch.column("tokens"):
                counts += np.bincount(np.frombuffer(x.as_buffer(), "<u8") >> np.uint64(64 - SLOT_BITS), minlength=1 << SLOT_BITS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["slot", "c"])

    common = np.zeros(1 << SLOT_BITS, np.int64)
    for r in asked.select("tokens").mapInArrow(count, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).toLocalIterator():
        common[r["slot"]] = r["c"]
    held = asked.sparkSession.sparkContext.broadcast(common.tobytes())

    def first(batches):
        counts = np.frombuffer(held.value, np.int64)
        for batch in batches:
            cols = [np.asarray(batch.column(c)) for c in ("v", "loose", "block", "part", "out")]
            rows = [[] for _ in range(8)]
            for k, x in enumerate(batch.column("tokens")):
                t = np.frombuffer(x.as_buffer(), "<u8")
                t = t[np.lexsort((t, counts[t >> np.uint64(64 - SLOT_BITS)]))]
                n = len(t)
                keep = n - -(-percent * n // 100) + 1
                for out, value in zip(rows, (t[:keep].view(np.int64), *(np.full(keep, c[k]) for c in cols), np.full(keep, n), n - np.arange(keep)), strict=True):
                    out.append(value)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in rows], ["token", "v", "loose", "block", "part", "out", "n", "left"])

    lists = landed(asked.select("v", "loose", "block", "part", F.col("out").cast("long").alias("out"), "tokens").mapInArrow(first, "token long, v long, loose long, block long, part long, out long, n long, left long"), "near-lists")
    need = lambda n: F.ceil(F.lit(percent) * n / F.lit(100 + percent))
    able = (F.col("left") >= need(2 * F.col("n"))).cast("int")
    useful = lists.groupBy("loose", "token").agg(F.count("*").alias("size"), F.max(able).alias("able"), F.max("out").alias("any"), F.min("part").alias("p"), F.max("part").alias("q")).where("size > 1 AND able = 1 AND any = 1 AND p <> q")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("v", F.lit(13)), tiles).cast("int")
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    placed = lists.join(useful.select("loose", "token", "size"), ["loose", "token"]).withColumn("mine", mine).withColumn("other", other)
    placed = placed.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")).drop("size", "other")

    def pairs(batch, starts):
        v, block, part, out, n, left, mine, low, high, loose = (np.asarray(batch.column(c)) for c in ("v", "block", "part", "out", "n", "left", "mine", "low", "high", "loose"))
        asks = [[v[:0]], [v[:0]], [v[:0]]]
        for start, end in zip(starts, np.append(starts[1:], len(v)), strict=True):
            here = slice(start, end)
            cross = low[start] != high[start]
            for i in np.flatnonzero(left[here] >= _least(percent, 2 * n[here])) + start:
                fits = (n[here] >= n[i]) & (100 * n[i] >= percent * n[here]) & (np.minimum(left[here], left[i]) >= _least(percent, n[here] + n[i])) & (part[here] != part[i]) & ((out[here] == 1) | (out[i] == 1))
                hit = np.flatnonzero(fits & (mine[here] != mine[i]) if cross else fits) + start
                goes = (out[i] == 1) & ((out[hit] == 0) | (v[i] < v[hit]))  # of two outsiders one asks
                who, where = np.where(goes, v[i], v[hit]), np.where(goes, block[hit], block[i])
                at = np.unique(np.stack([who, where]), axis=1)
                for have, x in zip(asks, (at[0], np.full(at.shape[1], loose[start]), at[1]), strict=True):
                    have.append(x)
        return [np.concatenate(x) for x in asks]

    asks = landed(by_group(placed, ["loose", "token", "low", "high"], pairs, "v long, loose long, block long").distinct(), "near-asks")

    def answers(batch, starts):
        v, part, guest = (np.asarray(batch.column(c)) for c in ("v", "part", "guest"))
        tokens, a, b = batch.column("tokens"), [v[:0]], [v[:0]]
        for start, end in zip(starts, np.append(starts[1:], len(v)), strict=True):
            sets = [np.frombuffer(tokens[k].as_buffer(), "<u8") for k in range(start, end)]
            sizes = np.array([len(x) for x in sets])
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            at = np.cumsum(sizes) - sizes
            mark, home = np.zeros(int(flat.max()) + 1, np.int32), guest[start:end] == 0
            for x in np.flatnonzero(~home):
                mine = flat[at[x] : at[x] + sizes[x]]
                mark[mine] = 1
                both = np.add.reduceat(mark[flat], at)
                mark[mine] = 0
                hit = np.flatnonzero(home & (part[start:end] != part[start + x]) & (100 * both >= percent * (sizes + sizes[x] - both)))
                hit = hit[np.unique(part[start + hit], return_index=True)[1]]  # one link to a part is enough
                a.append(np.full(len(hit), v[start + x]))
                b.append(v[start + hit])
        return np.concatenate(a), np.concatenate(b)

    rooms = asks.groupBy("loose", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rooms"))
    homes = asked.select("v", "loose", "block", "part").join(rooms, ["loose", "block"]).select("v", "loose", "block", "part", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)).alias("room"), F.lit(0).alias("guest"))
    guests = asks.join(rooms, ["loose", "block"]).join(asked.select("v", "part"), "v").select("v", "loose", "block", "part", F.pmod(F.xxhash64("v", F.lit(14)), F.col("rooms")).cast("int").alias("room"), F.lit(1).alias("guest"))
    return landed(by_group(homes.unionByName(guests).join(tokens.select("v", "tokens"), "v"), ["loose", "block", "room"], answers), "near-edges")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, row, n_shingles, component_id) of each row.

    Documents are linked when 100 * intersection >= percent * union of their sets of `words`-word shingles, ASCII letters
    lower-cased; component_id is the smallest id that links reach, its own included. Null, empty and blank texts have
    empty sets and are linked with nothing. Rows that repeat an id share it; null ids are never the smallest unless all
    are null; other columns are ignored; an empty table gives an empty result. row is a hash of the text that tells rows
    of one id apart.
    """
    spark = docs.sparkSession
    ship(spark)
    threshold = percent / 100
    loose = loose_for(threshold)
    trees = trees_for(threshold)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def sketch(batches):
        release()
        seen: dict = {}
        for whole in batches:
            for batch in cut(whole, "text", 1_000_000):
                sets = shingle_sets(batch.column("text").to_pylist(), words, seen)
                full = [s for s in sets if len(s)]
                made = iter(sketches(full) if full else [])
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                cols = [
                    batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_start, digests), pa.int64()),
                    pa.array(digests, pa.binary()), pa.array([next(made).astype("<u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "n", "h", "digest", "sketch"])

    named = base.select("doc_id", F.xxhash64("text").alias("row"), "text")
    rows = landed(named.mapInArrow(sketch, "doc_id bigint, row bigint, n bigint, h bigint, digest binary, sketch binary"), "near-rows")
    # one class for each distinct set, known by its whole digest; v, a number of its own, names it in edges
    named_sets = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("h").alias("h"))
    classes = landed(named_sets.withColumn("v", F.monotonically_increasing_id()), "near-classes")

    def branch(batches):
        for batch in batches:
            sketch, v = _read(batch.column("sketch")), np.asarray(batch.column("v"))
            if "node" in batch.schema.names:
                at, out = np.arange(len(v)), np.asarray(batch.column("node")).view(np.uint64)
                for _ in range(STEP):
                    rows, out = children(out, sketch[at], threshold)
                    at = at[rows]
                yield pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(out.view(np.int64)), batch.column("hub").take(pa.array(at))], ["v", "node", "hub"])
                continue
            for tree in range(trees):
                root = np.full(len(v), mix(np.array([tree + 1], np.uint64))[0])
                at, out = children(root, sketch, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(out.view(np.int64)), pa.nulls(len(at), pa.int64())], ["v", "node", "hub"])

    drawn = classes.select("v", "sketch")
    brief = drawn.mapInArrow(_brief, "v long, sketch binary")
    found = None
    level = landed(drawn.mapInArrow(branch, "v long, node long, hub long"), "near-level")
    visits = None
    for turn in range(1, ROUNDS + 1):
        # rows that one hub joined already say nothing new among themselves
        sizes = level.groupBy("node").agg(F.count("*").alias("size"), F.count("hub").alias("k"), F.min("hub").alias("p"), F.max("hub").alias("q")).where("size > 1 AND NOT (size = k AND p = q)").select("node", "size")
        held = landed(level.join(sizes, "node"), "near-held")
        big = F.col("size") > NODE
        blocks = F.ceil(F.col("size") / NODE).cast("int")
        every, own = F.sequence(F.lit(0), blocks - 1), F.array(F.pmod(F.xxhash64("v", "node", F.lit(turn)), blocks).cast("int"))
        rank = F.pmod(F.xxhash64("v", F.lit(10)), F.lit(1 << 30))
        anchor = big & (rank < F.lit(ANCHORS * float(1 << 30)) / F.col("size"))
        spread = held.select("v", "node", F.when(anchor, rank).otherwise(-1).cast("int").alias("anchor"), big.cast("int").alias("big"), F.explode(F.when(anchor, every).when(big, own).otherwise(F.array(F.lit(0)))).alias("block"))
        told = landed(by_group((spread if visits is None else spread.unionByName(visits)).join(brief, "v"), ["node", "block"], _joined(loose), "pivot long, v long, node long"), "near-told")
        joined = told.where("pivot >= 0 AND pivot <> v").select(F.col("pivot").alias("a"), F.col("v").alias("b"))
        found = joined if found is None else found.unionByName(joined)
        if told.where("pivot < 0").isEmpty():
            break
        outside = told.where("pivot < 0").select("v", "node").distinct()
        counts = outside.groupBy("node").agg(F.count("*").alias("outs"))
        marked = landed(held.where(big).select("v", "node", "size").join(counts, "node").join(outside.withColumn("out", F.lit(True)), ["v", "node"], "left"), "near-marked")
        # few of a node meet all of it, in the next turn; with many the node branches on
        few = F.lit(True) if turn >= ROUNDS - 1 else F.col("outs") <= NODE
        visits = marked.where(few).select("v", "node", F.when(F.col("out"), -1).otherwise(JOINED).alias("anchor"), F.lit(0).alias("big"), F.explode(F.when(F.col("out"), every).otherwise(own)).alias("block"))
        many = marked.where(~few).select("v", "node", F.when(F.col("out").isNull(), F.col("node")).alias("hub"))
        level = landed(many.join(drawn, "v").mapInArrow(branch, "v long, node long, hub long").distinct(), "near-level")
    members = components(found).withColumnRenamed("label", "loose")

    # the full sets of those classes, from their first documents; a bitmap of fixed size spares most others the way
    wanted = members.join(classes.select("v", "digest", "rep", "n", "h"), "v")
    slot = F.col("h").bitwiseXOR(F.coalesce("rep", F.lit(0))).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    bits = wanted.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(63).cast("int").alias("at")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    bitmap = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in bits.toLocalIterator():
        bitmap[r["word"]] = r["bits"]
    shared = spark.sparkContext.broadcast(bitmap.tobytes())

    def full_sets(batches):
        release()
        seen: dict = {}
        held = np.frombuffer(shared.value, np.uint64)
        for whole in batches:
            for batch in cut(whole, "text", 1_000_000):
                sets = shingle_sets(batch.column("text").to_pylist(), words, seen)
                out = []
                for doc_id, s in zip(batch.column("doc_id").to_pylist(), sets, strict=True):
                    if len(s):
                        digest = xxhash.xxh3_128_digest(s.tobytes())
                        at = (_start(digest) ^ (doc_id or 0)) & ((1 << MAP_BITS) - 1)
                        if int(held[at >> 6]) >> (at & 63) & 1:
                            out.append((doc_id, digest, s.astype("<u8").tobytes()))
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "digest", "tokens"])

    read = base.mapInArrow(full_sets, "doc_id bigint, digest binary, tokens binary")
    found_sets = read.join(wanted.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("v", "n", "tokens")
    tokens = landed(found_sets.groupBy("v").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "near-tokens")
    exact = components(_exact_edges(members, tokens, percent))
    whole = landed(classes.select("v", "digest", "rep").join(exact, "v", "left").select("digest", "rep", F.coalesce("label", "v").alias("part")), "near-parts")
    named_parts = whole.select("digest", "part").join(whole.groupBy("part").agg(F.min("rep").alias("component_id")), "part").select("digest", "component_id")
    return rows.select("doc_id", "row", "n", "digest").join(named_parts, "digest", "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _start(digest: bytes | None) -> int | None:
    return None if digest is None else int.from_bytes(digest[:8], "little", signed=True)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of docs whose id is their component's, with all their columns; rows with a null id all stay.

    The keys of dropped rows are broadcast up to broadcast_rows of them, and joined by shuffle beyond.
    """
    found = near_duplicates(docs, id_col, text_col, words, percent)
    gone, gone_row = unused("gone", docs.columns), unused("gone_row", docs.columns)
    dropped = landed(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone), F.col("row").alias(gone_row)).distinct(), "near-dropped")
    few = F.broadcast(dropped) if dropped.count() <= broadcast_rows else dropped
    return docs.join(few, (F.col(f"`{id_col}`").cast("long") == F.col(gone)) & (F.xxhash64(f"`{text_col}`") == F.col(gone_row)), "left_anti")
