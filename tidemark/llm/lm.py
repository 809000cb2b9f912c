"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and of pairs of neighbours are gathered from the whole training corpus, summed by owners of hash
ranges, and quantised to levels of a geometric scale. A filter holds each n-gram once for every level up to its own;
probing level after level until one is missing gives the count back, never too low and seldom too high. The filter is
broadcast; probabilities mix the pair's relative frequency with the word's, by a weight that depends on the level of the
context and is fitted with each token left out of its own counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, release, trimmed, worker_state
from tidemark.session import landed, ship

BASE = 1.5  # ratio of neighbouring levels
LEVELS = 60  # counts beyond 1.5 ** 60 share the last level
BITS_PER_ENTRY = 8
KEEP_WORDS = 300_000
FLUSH = 1_500_000  # n-grams that a task gathers before it sends them
GRID = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995, 0.9995])
END = b""  # white space cuts no empty word, so the empty word can stand for the end

#: What each level stands for: the geometric middle of the counts that it covers.
_EDGES = np.array([np.ceil(BASE**q) for q in range(LEVELS + 1)])
MEANING = np.concatenate([[0.0], np.sqrt(_EDGES[:-1] * np.maximum(_EDGES[1:] - 1, _EDGES[:-1]))])


def level_of(counts: np.ndarray) -> np.ndarray:
    """0 for none, then 1 + floor(log_BASE(count))."""
    return np.searchsorted(_EDGES, counts, "right").clip(0, LEVELS).astype(np.int64)


def mix(h: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    x = (h ^ (np.uint64(salt) if np.isscalar(salt) else salt)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(29)


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1), right)


def owner_of(h: np.ndarray, owners: int) -> np.ndarray:
    """Ranges of hashes in equal shares; ascending in the hash."""
    return ((h >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _bits(h: np.ndarray) -> np.ndarray:
    """A mask of up to four bits of a 64-bit word."""
    one = np.uint64(1)
    return one << (h & np.uint64(63)) | one << (h >> np.uint64(6) & np.uint64(63)) | one << (h >> np.uint64(12) & np.uint64(63)) | one << (h >> np.uint64(18) & np.uint64(63))


def _place(h: np.ndarray, level: int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(h, (level + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    return ((x >> np.uint64(32)) * (np.uint64(words) if np.isscalar(words) else words) >> np.uint64(32)).astype(np.int64), _bits(x)


def build_filter(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A segment of the filter: n-gram hashes, each entered for every level up to its count's."""
    levels = level_of(counts)
    entries = int(levels.sum())
    words = np.zeros(max(1, -(-entries * BITS_PER_ENTRY // 64)), np.uint64)
    for q in range(1, int(levels.max(initial=0)) + 1):
        at, bits = _place(h[levels >= q], q, len(words))
        order = np.argsort(at, kind="stable")
        at, bits = at[order], bits[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[starts]] |= np.bitwise_or.reduceat(bits, starts)
    return words


class Filter:
    """Segments by owner, one after another; level() probes them."""

    def __init__(self, segments: list[bytes], first: int, owners: int) -> None:
        self.first, self.owners = first, owners
        self.sizes = np.array([len(s) // 8 for s in segments], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes.astype(np.int64))])
        self.data = b"".join(segments)  # bytes travel in a broadcast without a second copy

    @property
    def words(self) -> np.ndarray:
        return np.frombuffer(self.data, "<u8")

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = owner_of(h, self.owners) - self.first
        return (at >= 0) & (at < len(self.sizes))

    def level(self, h: np.ndarray) -> np.ndarray:
        """The level of each hash; all must be of segments held here."""
        at = owner_of(h, self.owners) - self.first
        start, size = self.starts[at], self.sizes[at]
        out = np.zeros(len(h), np.int64)
        live, words = np.arange(len(h)), self.words
        for q in range(1, LEVELS + 1):
            where, bits = _place(h[live], q, size[live])
            live = live[words[start[live] + where] & bits == bits]
            if not len(live):
                break
            out[live] = q
        return out


def _pack(h: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending hashes as transposed gaps, and counts, compressed."""
    gaps = np.diff(h, prepend=np.uint64(0))
    z = zstandard.ZstdCompressor(level=1)
    a = z.compress(np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())
    return len(a).to_bytes(8, "little") + a + z.compress(counts.astype("<u4").tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    z = zstandard.ZstdDecompressor()
    planes = np.frombuffer(z.decompress(blob[8 : 8 + n]), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64), np.frombuffer(z.decompress(blob[8 + n :]), "<u4").astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(h, kind="stable")
    h, counts = h[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[starts], np.add.reduceat(counts, starts) if len(h) else counts


class Words(dict):
    """Word to a number; hashes by number."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []
        self.hashes = np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens, each text's end included, and how many each text has."""
        if len(self) > KEEP_WORDS:
            self.clear()
            self.hashes = np.empty(0, np.uint64)
        cut_up = [(t or "").encode().lower().split() for t in texts]
        for words in cut_up:
            words.append(END)
        lengths = np.fromiter(map(len, cut_up), np.int64, len(cut_up))
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(cut_up)), np.int64, int(lengths.sum()))
        if self.new:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, self.new), np.uint64, len(self.new))])
            self.new = []
        return at, lengths


_END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END))


def _pairs(h: np.ndarray) -> np.ndarray:
    """Each token with the one before it; the end stands before a text's first."""
    return pair(np.concatenate([[_END_HASH], h[:-1]]), h) if len(h) else h


def _gather(owners: int):
    def work(batches):
        release()
        words, held = Words(), ([], [])

        def send():
            edges = None
            rows: dict[int, list] = {}
            for kind in (0, 1):
                if not held[kind]:
                    continue
                h, counts = _summed(held[kind])
                edges = np.searchsorted(owner_of(h, owners), np.arange(owners + 1))
                for o in range(owners):
                    if edges[o] < edges[o + 1]:
                        rows.setdefault(o, [None, None])[kind] = _pack(h[edges[o] : edges[o + 1]], counts[edges[o] : edges[o + 1]])
                held[kind].clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.int32()), *(pa.array([r[k] for r in rows.values()], pa.binary()) for k in (0, 1))], ["owner", "single", "double"])

        size = 0
        for whole in trimmed(batches):
            for batch in cut(whole, "text", 2_000_000):
                at, _ = words.tokens(batch.column("text").to_pylist())
                h = words.hashes[at]
                for kind, x in enumerate((h, _pairs(h))):
                    u, c = np.unique(x, return_counts=True)
                    held[kind].append((u, c.astype(np.int64)))
                    size += len(u)
                if size > FLUSH:
                    yield from send()
                    size = 0
        yield from send()

    return work


def _reduce(top: int):
    def owner(key, pdf: pd.DataFrame) -> pd.DataFrame:
        single = _summed([_unpack(b) for b in pdf["single"] if b is not None] or [(np.empty(0, np.uint64), np.empty(0, np.int64))])
        double = _summed([_unpack(b) for b in pdf["double"] if b is not None] or [(np.empty(0, np.uint64), np.empty(0, np.int64))])
        order = np.argsort(-single[1], kind="stable")
        first, rest = np.sort(order[:top]), np.sort(order[top:])
        return pd.DataFrame(
            {
                "owner": [key[0]], "tokens": [int(single[1].sum())], "words": [len(single[0])],
                "top": [single[0][first].tobytes()], "top_n": [single[1][first].tobytes()], "rest": [single[0][rest].tobytes()], "rest_n": [single[1][rest].tobytes()],
                "single": [build_filter(*single).tobytes()], "double": [build_filter(*double).tobytes()],
            }
        )

    return owner


_MODEL = "owner int, tokens long, words long, top binary, top_n binary, rest binary, rest_n binary, single binary, double binary"


@dataclass(frozen=True)
class Model:
    tokens: int
    words: int
    top: np.ndarray  # ascending hashes of the commonest words
    top_n: np.ndarray
    single: Filter
    double: Filter


class Scorer:
    """Scores texts with what is known of each word kept by its number."""

    def __init__(self, model: Model) -> None:
        self.model, self.words = model, Words()
        self.known = [np.empty(0, np.int64), np.empty(0, np.int64)]  # level in the filter; exact count, or -1 if not among the commonest
        self.total = model.tokens + 0.1 * (model.words + 1)

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, lengths = self.words.tokens(texts)
        have = len(self.known[0])
        if have > len(self.words.hashes):
            self.known, have = [np.empty(0, np.int64), np.empty(0, np.int64)], 0
        if have < len(self.words.hashes) or (have and len(self.words) < have):
            h, m = self.words.hashes[have:], self.model
            where = np.searchsorted(m.top, h).clip(0, max(0, len(m.top) - 1))
            exact = np.where(m.top[where] == h, m.top_n[where], -1) if len(m.top) else np.full(len(h), -1)
            self.known = [np.concatenate([self.known[0], m.single.level(h)]), np.concatenate([self.known[1], exact])]
        return at, lengths, self.words.hashes[at]

    def levels(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens whose pair is held here: where they are, and the levels of the context, the pair and the word."""
        m = self.model
        pairs = _pairs(h)
        held = np.flatnonzero(m.double.holds(pairs)) if m.double.first or len(m.double.sizes) < m.double.owners else np.arange(len(pairs))
        level = self.known[0]
        before = np.concatenate([[int(m.single.level(np.array([_END_HASH]))[0])], level[at[:-1]]])[held] if len(at) else level[:0]
        return held, before, m.double.level(pairs[held]), level[at[held]]

    def mixture(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where the tokens are whose pair is held here, and the shares() of their levels."""
        held, before, both, word = self.levels(at, h)
        return held, *shares(before, both, word, self.total)

    def fit(self, texts: list[str | None]) -> np.ndarray:
        """How often each three levels come together, as counts by (context, pair, word)."""
        at, _, h = self.tokens(texts)
        _, before, both, word = self.levels(at, h)
        return np.bincount((before * (LEVELS + 1) + both) * (LEVELS + 1) + word, minlength=(LEVELS + 1) ** 3)


def shares(before: np.ndarray, both: np.ndarray, word: np.ndarray, total: float, less: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pair's share of its context, the word's share of all tokens, and the level by which they are mixed.

    less is taken from each count (1 leaves a training token out of its own counts).
    """
    context = np.maximum(MEANING[before] - less, 0)
    share = np.minimum(1.0, np.divide(np.maximum(MEANING[both] - less, 0), context, out=np.zeros(len(before)), where=context > 0))
    return share, (np.maximum(MEANING[word] - less, 0) + 0.1) / total, np.where(context > 0, before, 0)


def _scorer(key: str, held) -> Scorer:
    """The worker's scorer; an older one goes before the new model is read."""
    return worker_state(key, lambda: Scorer(held.value))


@dataclass(frozen=True)
class Counts:
    """Counts of a training corpus, by owner, as a table in the shared folder."""

    table: DataFrame
    owners: int
    tokens: int
    words: int
    mixing: np.ndarray  # weight of the single word, by the context's level
    kept: list  # the broadcast model, once made, if the filters fit into one


def train(docs: DataFrame, text_col: str = "text", top_words: int = 400_000, filter_limit: int = 128 << 20) -> Counts:
    """Count words and pairs over all texts of docs (null: empty) and fit the mixing weights on all their tokens.

    top_words bounds the words whose exact counts are broadcast. A token's likelihood depends on three levels only, so
    what the weights are fitted on is a count for each three levels, whose number has a bound, of every training token.
    """
    spark = docs.sparkSession
    ship(spark)
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col(f"`{text_col}`").alias("text"))
    sent = base.mapInArrow(_gather(owners), "owner int, single binary, double binary")
    table = landed(sent.groupBy("owner").applyInPandas(_reduce(-(-top_words // owners)), _MODEL), "lm-counts")
    tokens, words = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    counts = Counts(table, owners, tokens, words, np.ones(LEVELS + 1), [])
    if not tokens:
        return counts
    spots = np.zeros((LEVELS + 1) ** 3, np.int64)
    for key, held in _shards(counts, filter_limit):

        def fit(batches, key=key, held=held):
            scorer, out = _scorer(key, held), np.zeros((LEVELS + 1) ** 3, np.int64)
            for whole in trimmed(batches):
                for batch in cut(whole, "text", 2_000_000):
                    out += scorer.fit(batch.column("text").to_pylist())
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], ["spot", "c"])

        for r in base.mapInArrow(fit, "spot int, c long").groupBy("spot").agg(F.sum("c").alias("c")).toLocalIterator():
            spots[r["spot"]] += r["c"]
        if not counts.kept:
            held.destroy()
    at = np.flatnonzero(spots)
    share, alone, level = shares(at // (LEVELS + 1) ** 2, at // (LEVELS + 1) % (LEVELS + 1), at % (LEVELS + 1), tokens + 0.1 * (words + 1), 1.0)
    gains = np.zeros((LEVELS + 1, len(GRID)))
    for k, w in enumerate(GRID):
        gains[:, k] = np.bincount(level, spots[at] * np.log10((1 - w) * share + w * alone), LEVELS + 1)
    best = GRID[gains.argmax(axis=1)]
    seen = np.flatnonzero(gains.any(axis=1))
    if len(seen):  # a level that no token has takes the weight of the nearest one below
        best = best[seen[np.maximum(np.searchsorted(seen, np.arange(LEVELS + 1), "right") - 1, 0)]]
    best[0] = 1.0
    return replace(counts, mixing=best)


def _shards(counts: Counts, limit: int):
    """Broadcast models whose filters stay within limit bytes; more than one when the pairs' filter is larger."""
    if counts.kept:
        yield counts.kept[0]
        return
    spark = counts.table.sparkSession
    sizes = {r["owner"]: (r["a"], r["b"]) for r in counts.table.select("owner", F.octet_length("single").alias("a"), F.octet_length("double").alias("b")).collect()}
    room = limit - sum(a for a, _ in sizes.values())
    if room < max((b for _, b in sizes.values()), default=0):
        raise ValueError(f"the filter of single words leaves no room within {limit} bytes; raise filter_limit")
    groups, used = [[0, 0]], 0
    for o in range(counts.owners):
        size = sizes.get(o, (8, 8))[1]
        if used and used + size > room:
            groups.append([o, o])
            used = 0
        groups[-1][1] = o + 1
        used += size
    top, top_n, single = {}, {}, {}
    for r in counts.table.select("owner", "top", "top_n", "single").toLocalIterator():
        top[r["owner"]], top_n[r["owner"]], single[r["owner"]] = r["top"], r["top_n"], r["single"]
    empty = np.zeros(1, np.uint64).tobytes()
    whole = Filter([bytes(single.get(o, empty)) for o in range(counts.owners)], 0, counts.owners)
    words = np.frombuffer(b"".join(bytes(top.get(o, b"")) for o in range(counts.owners)), np.uint64)
    numbers = np.frombuffer(b"".join(bytes(top_n.get(o, b"")) for o in range(counts.owners)), np.int64)
    for a, b in groups:
        part = {r["owner"]: bytes(r["double"]) for r in counts.table.where(F.col("owner").between(a, b - 1)).select("owner", "double").toLocalIterator()}
        double = Filter([part.pop(o, empty) for o in range(a, b)], a, counts.owners)
        held = spark.sparkContext.broadcast(Model(counts.tokens, counts.words, words, numbers, whole, double))
        del double, part
        out = (uuid.uuid4().hex, held)
        if len(groups) == 1:
            counts.kept.append(out)
        yield out


def _rest(batches):
    for batch in batches:
        for h, n in zip(batch.column("rest").to_pylist(), batch.column("rest_n").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h, np.int64)), pa.array(np.frombuffer(n, np.int64))], ["h", "c"])


def score(docs: DataFrame, counts: Counts, id_col: str = "doc_id", text_col: str = "text", filter_limit: int = 128 << 20) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10 of the text's probability).

    base_score and n_known use exact counts: those of the commonest words are broadcast, all others are joined, so
    neither is bounded by memory. score uses the filter. When the filter of pairs is larger than filter_limit, the texts
    are scored in several passes, each with a part of it. Null counts as empty (one token, the end); rows that repeat
    id and text are each answered; other columns are ignored; an empty table gives an empty result. With an empty
    training corpus every count is 0.
    """
    spark = docs.sparkSession
    total = counts.tokens + 0.1 * (counts.words + 1)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, row bigint, one int, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>"
    named = base.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")
    passes = None
    shards = 0
    mixing = counts.mixing
    for key, held in _shards(counts, filter_limit):
        first = shards == 0

        def work(batches, key=key, held=held, first=first):
            scorer = _scorer(key, held)
            for whole in trimmed(batches):
                for batch in cut(whole, "text", 2_000_000):
                    at, lengths, h = scorer.tokens(batch.column("text").to_pylist())
                    doc = np.repeat(np.arange(len(lengths)), lengths)
                    where, share, alone, level = scorer.mixture(at, h)
                    w = mixing[level]
                    total_score = np.bincount(doc[where], np.log10((1 - w) * share + w * alone), len(lengths))
                    exact = scorer.known[1][at]
                    top = exact >= 0
                    known = np.bincount(doc[top], minlength=len(lengths)) if first else np.zeros(len(lengths), np.int64)
                    base_score = np.bincount(doc[top], np.log10((exact[top] + 0.1) / total), len(lengths)) if first else np.zeros(len(lengths))
                    rare = h[~top].view(np.int64) if first else np.empty(0, np.int64)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(doc[~top], minlength=len(lengths)))]) if first else np.zeros(len(lengths) + 1, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id"), batch.column("row"), pa.array(np.full(len(lengths), int(first), np.int32)), pa.array(lengths * first), pa.array(known.astype(np.int64)),
                            pa.array(base_score.astype(np.float64)), pa.array(total_score.astype(np.float64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rare)),
                        ],
                        ["doc_id", "row", "one", "n_tokens", "n_known", "base", "score", "rare"],
                    )

        scored = named.mapInArrow(work, shape)
        if not counts.kept:  # one of several parts: its pass ends before the next part is broadcast
            scored = landed(scored, "lm-pass")
            held.destroy()
        passes = scored if passes is None else passes.unionAll(scored)
        shards += 1
    # a row of its own carries each text's sums; its place in the join is spread by the row's hash and never matches
    lines = passes.select(
        "doc_id", "row",
        F.explode(F.concat(F.array(F.struct(F.col("row").alias("h"), F.lit(0).alias("tf"), "one", "n_tokens", "n_known", "base", "score")),
                           F.transform("rare", lambda x: F.struct(x.alias("h"), F.lit(1).alias("tf"), F.lit(0).alias("one"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).cast("bigint").alias("n_known"), F.lit(0.0).alias("base"), F.lit(0.0).alias("score"))))).alias("x"),
    ).select("doc_id", "row", "x.*")
    rest = counts.table.select("rest", "rest_n").mapInArrow(_rest, "h bigint, c bigint")
    joined = lines.join(rest.withColumnRenamed("h", "word"), (F.col("h") == F.col("word")) & (F.col("tf") > 0), "left")
    word_score = F.when(F.col("tf") > 0, F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(total))).otherwise(F.lit(0.0))
    sums = joined.groupBy("doc_id", "row").agg(
        F.sum("one").alias("m"), F.sum("n_tokens").alias("n_tokens"), (F.sum("n_known") + F.count("c")).alias("n_known"), (F.sum("base") + F.sum(word_score)).alias("base_score"), F.sum("score").alias("score")
    )
    each = sums.withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    return each.select(
        "doc_id", (F.col("n_tokens") / F.col("m")).cast("long").alias("n_tokens"), (F.col("n_known") / F.col("m")).cast("long").alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") / F.col("m")).alias("base_score"), (F.col("score") / F.col("m")).alias("score"),
    )
