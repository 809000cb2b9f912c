"""Search channels and their fusion: exact nearest neighbours, full-text match and rank, reciprocal ranks, the exact route."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.values import cosine_distance
from tidemark.session import ship


@dataclass(frozen=True)
class SearchConfig:
    """Constants that are part of the results."""

    rrf_k: int = 60
    topn: int = 50
    weights: dict = field(default_factory=lambda: {"dense": 2.0, "fts": 0.5, "lemma": 0.5})
    reserve: int = 2
    exact_cap: int = 500


def knn(df: DataFrame, vector: str, query: list[float], k: int, tie: str) -> DataFrame:
    """The k nearest by cosine distance, ties by a unique column; a top-k, not a sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("dist", cosine_distance(F.col(vector), q)).orderBy("dist", tie).limit(k)


class _Nearest:
    """The k nearest of each of a group of queries among the vectors given so far, ties by id; distances have 6 digits.

    Tiles of queries and vectors are multiplied at single precision; what may be among the best by then, its error
    counted, is measured at double precision. Memory is the group, k results a query and one tile, which holds fewer rows
    of longer vectors. Vectors of length 0 have no distance and come after all others, null ones after those.
    """

    ROWS, TILE = 512, 8 << 20  # queries of a tile; bytes at double precision of vectors, and of pairs measured at once
    UNDEFINED, NULL = 8.0, 9.0  # in the place of a distance, which is 2 at most

    def __init__(self, queries: np.ndarray, null: np.ndarray, k: int, ids: np.dtype):
        self.k, self.q, self.null, n = k, queries, null, len(queries)
        self.most = max(1, self.TILE // (8 * queries.shape[1]))
        self.q4, self.norm = np.empty(queries.shape, np.float32), np.empty(n)
        for at in range(0, n, self.most):
            tile = slice(at, at + self.most)
            self.q4[tile], self.norm[tile] = self._unit(queries[tile]), np.linalg.norm(queries[tile].astype(np.float64), axis=1)
        self.dist, self.ids, self.n = np.full((n, k), np.inf), np.zeros((n, k), ids), np.zeros(n, np.int64)
        self.margin = np.float32(2e-6 + 2.5e-7 * queries.shape[1])  # twice the error of a product at single precision, and the rounding

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            return v / np.linalg.norm(v, axis=1, keepdims=True)

    def add(self, ids: np.ndarray, vectors: np.ndarray, null: np.ndarray) -> None:
        for at in range(0, len(ids), self.most):
            tile = np.arange(at, min(at + self.most, len(ids)))
            rows = np.ascontiguousarray(vectors[tile])
            same = np.unique(rows.view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_inverse=True)[1]
            tile = tile[self._first(same * 2 + null[tile], ids[tile])]  # of equal vectors, only these can be among the k best
            self._add(ids[tile], self._unit(vectors[tile]), null[tile])

    def _first(self, kind: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which rows have the k smallest ids of their kind."""
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, kind))
        kind, first = kind[order], np.zeros(len(ids), bool)
        first[order[np.arange(len(kind)) - np.searchsorted(kind, kind) < self.k]] = True
        return first

    def _add(self, ids: np.ndarray, v: np.ndarray, null: np.ndarray) -> None:
        v4 = v.astype(np.float32).T
        undefined, first = ~(self.norm > 0), self._first(null, ids)
        for at in range(0, len(self.q), self.ROWS):
            near = self.q4[at : at + self.ROWS] @ v4
            most = self.dist[at : at + self.ROWS, -1]
            may = near >= (1 - most - self.margin).astype(np.float32)[:, None]
            loose = np.nonzero(most > 2.5)[0]  # fewer than k distances so far: the best k of this tile, or all if fewer are defined
            if len(loose):
                last = min(self.k, near.shape[1]) - 1
                least = -np.partition(-near[loose], last, axis=1)[:, last] - self.margin
                may[loose] = (near[loose] >= least[:, None]) | np.isnan(least)[:, None]
            may[undefined[at : at + self.ROWS]] = first  # only ids tell these distances apart
            rows, cols = np.nonzero(may)
            for i in range(0, len(rows), self.most):
                r, c = rows[i : i + self.most] + at, cols[i : i + self.most]
                with np.errstate(invalid="ignore", divide="ignore"):
                    d = np.round(1 - np.einsum("ij,ij->i", self.q[r].astype(np.float64), v[c]) / self.norm[r], 6) + 0.0
                self._merge(r, np.where(np.isnan(d), np.where(self.null[r] | null[c], self.NULL, self.UNDEFINED), d), ids[c])

    def _merge(self, rows: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        full = self.n[rows] == self.k
        enters = ~full
        r = rows[full]
        enters[full] = (dist[full] < self.dist[r, -1]) | ((dist[full] == self.dist[r, -1]) & (ids[full] < self.ids[r, -1]))
        rows, dist, ids = rows[enters], dist[enters], ids[enters]
        if not len(rows):
            return
        touched = np.unique(rows)
        old, slot = np.nonzero(np.arange(self.k) < self.n[touched][:, None])
        rows = np.concatenate([touched[old], rows])
        dist, ids = np.concatenate([self.dist[touched[old], slot], dist]), np.concatenate([self.ids[touched[old], slot], ids])
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, dist, rows))
        rows, dist, ids = rows[order], dist[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        self.dist[rows[kept], place[kept]], self.ids[rows[kept], place[kept]] = dist[kept], ids[kept]
        self.n[touched] = np.minimum(self.k, np.searchsorted(rows, touched, "right") - np.searchsorted(rows, touched))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, id, distance and whether it is null."""
        q, slot = np.nonzero(np.arange(self.k) < self.n[:, None])
        d = self.dist[q, slot]
        return q, self.ids[q, slot], np.where(d >= self.UNDEFINED, np.nan, d), d == self.NULL


def _vectors(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow list column as a matrix, and which rows are null (zeros in the matrix)."""
    null = np.asarray(pc.is_null(column))
    sizes = np.asarray(pc.list_value_length(column).drop_null())
    dim = dim or int(sizes.max(initial=1))
    if (sizes != dim).any():
        raise ValueError(f"vectors of other lengths than {dim}")
    out = np.zeros((len(null), dim), np.float64 if pa.types.is_float64(column.type.value_type) else np.float32)
    out[~null] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out, null


#: Bytes of a group of queries with their results; a worker holds about twice as many.
GROUP = 32 << 20


def knn_join(queries: DataFrame, base: DataFrame, k: int, group: int = 65_536) -> DataFrame:
    """queries (qid, q) against base (id, v): the k nearest of each, ties by id.

    The queries are the small, stated side: they come to the driver as Arrow and go out by broadcast, group at a time (of
    GROUP bytes at most); each group is a pass over base. A task keeps its k best of each query of the group, so what is shuffled is k rows a
    query and task. The product is with every vector: the work grows with queries times base, memory does not.
    """
    spark = queries.sparkSession
    ship(spark)
    table = queries.select("qid", "q").toArrow().combine_chunks()
    qid, id_ = (df.schema[c].dataType.simpleString() for df, c in ((queries, "qid"), (base, "id")))

    def search(part: pa.Table) -> DataFrame:
        q, null = _vectors(part["q"].combine_chunks())
        sent = spark.sparkContext.broadcast((part["qid"].combine_chunks(), q, null))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q, null = sent.value
            best = None
            for batch in batches:
                if len(qids) and batch.num_rows:
                    ids = batch.column("id").to_numpy(zero_copy_only=False)
                    best = best or _Nearest(q, null, k, ids.dtype)
                    best.add(ids, *((np.zeros((len(ids), q.shape[1])), np.ones(len(ids), bool)) if null.all() else _vectors(batch.column("v"), q.shape[1])))
                    kind = batch.column("id").type
            if best:
                at, ids, dist, none = best.found()
                for i in range(0, len(at), 100_000):
                    cut = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(at[cut])), pa.array(ids[cut], kind), pa.array(dist[cut], mask=none[cut], from_pandas=False)], ["qid", "id", "dist"])

        return base.select("id", "v").where("id IS NOT NULL").mapInArrow(work, f"qid {qid}, id {id_}, dist double")

    numbers = pc.max(pc.list_value_length(table["q"])).as_py() or 1
    group = max(1, min(group, GROUP // (8 * numbers + 24 * k)))
    found = None
    for i in range(0, max(1, table.num_rows), group):
        one = search(table.slice(i, group))
        found = one if found is None else found.unionAll(one)
    w = Window.partitionBy("qid").orderBy(F.col("dist").asc_nulls_last(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def parse_websearch(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of (wanted, words) clauses: bare words and "phrases" are all wanted, - negates, or separates."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not sign:
            out.append([])
            continue
        terms = re.findall(r"[^\W_]+|_+", (phrase or word).lower())
        if terms:
            out[-1].append((not sign, terms))
    return [c for c in out if c]


def match(tokens: Column, query: str) -> Column:
    """Do a document's tokens satisfy a websearch query? A phrase needs adjacent places.

    The tokens are bound once: an expression named inside a lambda, or in several clauses, is evaluated each time.
    """
    alternatives = parse_websearch(query)

    def clause(bound: Column, wanted: bool, terms: list[str]) -> Column:
        if len(terms) == 1:
            hit = F.array_contains(bound, terms[0])
        else:
            here = lambda x, i: x.eqNullSafe(terms[0]) & (F.slice(bound, i + 1, len(terms)) == F.array(*map(F.lit, terms)))
            hit = F.exists(F.transform(bound, here), lambda x: x)
        return hit if wanted else ~hit

    def found(bound: Column) -> Column:
        either = F.lit(False)
        for alternative in alternatives:
            both = F.lit(True)
            for wanted, terms in alternative:
                both = both & clause(bound, wanted, terms)
            either = either | both
        return either

    return F.transform(F.array(tokens), found)[0]


def cover_density(tokens: Column, terms: list[str]) -> Column:
    """Sum over minimal spans that hold all terms of 1 / (1 + words of the span that are no match)."""
    wanted = list(dict.fromkeys(terms))

    @F.pandas_udf("double")
    def score(series: pd.Series) -> pd.Series:
        def one(doc) -> float:
            spots = [(i, t) for i, t in enumerate(doc) if t in wanted]
            last: dict[str, int] = {}
            total, previous = 0.0, -1
            for i, t in spots:
                last[t] = i
                if len(last) == len(wanted):
                    start = min(last.values())
                    if start > previous:  # else a shorter span inside was counted already
                        inside = sum(start <= p <= i for p, _ in spots)
                        total += 1.0 / (1 + (i - start + 1) - inside)
                        previous = start
            return total

        return series.map(lambda d: 0.0 if d is None else one(list(d)))

    return score(tokens)


def ranked(hits: DataFrame, channel: str, score: Column, *ties: str) -> DataFrame:
    """A channel's hits with their 1-based rank; hits is a top-k, so one window is small."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(channel)).orderBy(score, *ties))).withColumn("channel", F.lit(channel))


def rrf(channels: DataFrame, key: list[str], config: SearchConfig, order: list[str]) -> DataFrame:
    """Weighted reciprocal-rank fusion of (key, channel, rank): score, and the rank in each channel.

    Ties go to the channel that comes first in order, then to the better rank. A channel without a weight counts 1.
    """
    weight, place = F.lit(1.0), F.lit(len(order))
    for c, w in config.weights.items():
        weight = F.when(F.col("channel") == c, w).otherwise(weight)
    for i, c in enumerate(order):
        place = F.when(F.col("channel") == c, i).otherwise(place)
    fused = channels.groupBy(*key).agg(
        F.round(F.sum(weight / (config.rrf_k + F.col("rank"))), 8).alias("rrf_score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("channels"),
        F.min(F.struct(place.alias("p"), "rank")).alias("first"),
    )
    return fused.orderBy(F.desc("rrf_score"), "first.p", "first.rank", *key).drop("first")


def hybrid(channels: dict, key: list[str], config: SearchConfig, order: list[str]) -> tuple[DataFrame | None, dict]:
    """Run each channel by itself; one that fails is named in degraded and the rest are fused."""
    good, degraded = [], []
    for name in order:
        try:
            hits = channels[name]().limit(config.topn)
            good.append(hits.sparkSession.createDataFrame(hits.collect(), hits.schema))  # at most topn rows; the action shows failures here
        except Exception:  # noqa: BLE001  any failure of a channel degrades the answer instead of ending it
            degraded.append(name)
    fused = None
    for hits in good:
        fused = hits if fused is None else fused.unionByName(hits)
    meta = {"channels_run": [n for n in order if n not in degraded], "degraded": degraded, "weights": config.weights, "rrf_k": config.rrf_k, "topn": config.topn}
    return (rrf(fused, key, config, order) if fused is not None else None), meta


def round_robin(df: DataFrame, lists: str, order: list[Column | str], limit: int) -> DataFrame:
    """Interleave lists: all first members, then all second ones; cut at limit."""
    turn = F.row_number().over(Window.partitionBy(lists).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", lists).limit(limit)


def merge_with_reserve(exact: DataFrame, channel: DataFrame, key: str, k: int, config: SearchConfig) -> DataFrame:
    """Exact hits first, but a few places are kept for channel hits that are not among them. Both have rank.

    Both sides are finalists (a few rows), so the window over them is small.
    """
    rest = channel.join(exact.select(key), key, "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank", key)))
    n = F.least(F.lit(config.reserve), F.coalesce(F.max("rank"), F.lit(0)))
    room = rest.agg(F.greatest(F.lit(1), F.lit(k) - n).alias("room"))
    first = exact.crossJoin(F.broadcast(room)).where(F.col("rank") <= F.col("room")).select(key, F.col("rank"), F.lit(0).alias("part"), F.lit("exact").alias("route"))
    every = first.unionByName(rest.select(key, "rank", F.lit(1).alias("part"), F.lit("channel").alias("route")))
    return every.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part", "rank", key))).where(F.col("pos") <= k).select(key, "route", "pos")


def title_keys(acts: DataFrame) -> DataFrame:
    """(key, act): normalised titles of six characters or more, those of three words or more without the first, and ids."""
    t = tx.norm(F.coalesce("title", F.lit("")))
    parts = F.split(t, " ")
    keys = F.array(F.when(F.length(t) >= 6, t), F.when((F.length(t) >= 6) & (F.size(parts) >= 3), F.array_join(F.slice(parts, 2, 1 << 20), " ")), F.lower("act"))
    return acts.select(F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("key"), "act")


def bind_citations(articles: DataFrame, mentions: DataFrame) -> DataFrame:
    """Each article (qid, apos, article) with the nearest act mention (qid, pos, act, len) at or right of it.

    Equal distances go to the longest key. An article without one takes the act on its left only where the query names
    one article and one act.
    """
    pairs = articles.join(mentions, "qid")
    w = Window.partitionBy("qid", "apos", "article").orderBy("pos", F.desc("len"), "act")
    right = pairs.where("pos >= apos").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("qid", "apos", "article", "act")
    single = articles.groupBy("qid").agg(F.count("*").alias("n")).where("n = 1").join(mentions.groupBy("qid").agg(F.countDistinct("act").alias("m"), F.first("act").alias("act")).where("m = 1"), "qid")
    left = articles.join(right, ["qid", "apos", "article"], "left_anti").join(single.select("qid", "act"), "qid").select("qid", "apos", "article", "act")
    return right.unionByName(left)
