"""Language identification: script ranges narrow the candidates, Viterbi with a switching penalty labels spans.

A word's score for each language is the sum of the log-likelihoods of its letter n-grams, learned from labelled
documents. The scripts of a word's letters rule out languages that were not seen in that script. Over the words of a
text, Viterbi finds the labelling with the best total score, less a penalty for each change of language; runs of one
label are the spans.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, release, trimmed, worker_state
from tidemark.session import ship

# First and last code points of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
OTHER = len(SCRIPTS)  # letters of no listed script
SLOTS_LOG2 = 16  # n-grams are hashed to this many slots
ORDERS = (1, 2, 3, 4)
RULED_OUT = -100.0  # score of a language that was not seen in the word's scripts
KEEP_WORDS = 200_000

_STARTS, _ENDS, _WHICH = (np.array(x) for x in zip(*sorted((a, b, i) for i, r in enumerate(SCRIPTS.values()) for a, b in r), strict=True))
_LETTERS = re.compile(r"[^\W\d_]+")


def scripts_of(letters: np.ndarray) -> np.ndarray:
    """The script of each code point of a letter."""
    at = np.maximum(np.searchsorted(_STARTS, letters, "right") - 1, 0)
    return np.where((letters >= _STARTS[at]) & (letters <= _ENDS[at]), _WHICH[at], OTHER)


def ngram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter n-grams of words with their borders: slots, and the word of each."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    slots, owner, h = [], [], np.zeros(len(points), np.uint64)
    left = np.repeat(ends, lengths) - np.arange(len(points))  # code points of the word from here on
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros_like(points)
        shifted[: len(points) - n + 1] = points[n - 1 :]
        h = (h + shifted + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            ok = left >= n
            slots.append((h[ok] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64))
            owner.append(word[ok])
    return np.concatenate(slots), np.concatenate(owner)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _LETTERS.findall(text.lower())


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # log-likelihood by slot and language
    scripts: np.ndarray  # by script and language: was the language seen in it?
    prior: np.ndarray
    penalty: float


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int = 20_000, penalty: float = 6.0) -> Model | None:
    """Learn from at most max_rows labelled rows, those first by a hash of the id; None without any.

    Rows without text or language teach nothing. The sample bounds what training reads; it is spread over tasks, each
    of which returns counts for the languages that it saw.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    labelled = base.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    edge = labelled.select(F.xxhash64("id").alias("h")).orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    if edge is None:
        return None

    def count(batches):
        release()
        seen: dict[str, list] = {}
        for whole in batches:
            for batch in cut(whole, "text"):
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    have = seen.setdefault(lang, [np.zeros(1 << SLOTS_LOG2, np.int64), np.zeros(OTHER + 1, np.int64), 0])
                    have[2] += 1
                    if words := words_of(text):
                        have[0] += np.bincount(ngram_slots(words)[0], minlength=1 << SLOTS_LOG2)
                        have[1] += np.bincount(scripts_of(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")), minlength=OTHER + 1)
        if seen:
            yield pa.RecordBatch.from_pydict(
                {"lang": list(seen), "slots": [x[0].astype("<f4").tobytes() for x in seen.values()], "scripts": [x[1].tolist() for x in seen.values()], "n": [x[2] for x in seen.values()]}
            )

    # the rows at the edge's hash are one id's rows: a sample of whole ids
    sample = labelled.where(F.xxhash64("id") <= edge).select("text", "lang").repartition(8)
    total: dict[str, list] = {}
    for r in sample.mapInArrow(count, "lang string, slots binary, scripts array<long>, n long").collect():
        have = total.setdefault(r["lang"], [0, 0, 0])
        have[0] = have[0] + np.frombuffer(r["slots"], "<f4").astype(np.float64)
        have[1] = have[1] + np.array(r["scripts"])
        have[2] += r["n"]
    languages = tuple(sorted(total))
    counts = np.stack([total[x][0] for x in languages], axis=1)
    log = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts)))
    letters = np.stack([total[x][1] for x in languages], axis=1)
    seen = letters > 0.005 * letters.sum(axis=0)
    prior = np.array([total[x][2] for x in languages], np.float64)
    return Model(languages, ((log - log.mean(axis=1, keepdims=True)) / len(ORDERS)).astype(np.float32), seen, prior / prior.sum(), penalty)


class Scorer:
    """Scores and labels words; keeps the scores of words seen so far."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int32)

    def learn(self, words: list[str]) -> None:
        n, m = len(self.place), len(words)
        while n + m > len(self.scores):
            self.scores, self.letters = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.letters))
        slots, owner = ngram_slots(words)
        for k in range(len(self.model.languages)):
            self.scores[n : n + m, k] = np.bincount(owner, self.model.weights[slots, k], m)
        lengths = np.fromiter(map(len, words), np.int64, m)
        kinds = scripts_of(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4"))
        present = np.zeros((m, OTHER + 1), bool)
        present[np.repeat(np.arange(m), lengths), kinds] = True
        # a language stands while it was seen in every script of the word; a word that rules out all says nothing
        able = ~(present.astype(np.int32) @ ~self.model.scripts > 0)
        self.scores[n : n + m] = np.where(able.any(axis=1, keepdims=True), np.where(able, self.scores[n : n + m], RULED_OUT), 0)
        self.letters[n : n + m] = lengths
        self.place.update(zip(words, range(n, n + m), strict=True))

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words, the language of each word."""
        new = list(set().union(*texts) - self.place.keys())
        if len(self.place) + len(new) > KEEP_WORDS:
            self.clear()
            new = list(set().union(*texts))
        if new:
            self.learn(new)
        at = [np.fromiter(map(self.place.__getitem__, t), np.int64, len(t)) for t in texts]
        return viterbi([self.scores[a] for a in at], np.log(self.model.prior).astype(np.float32), self.model.penalty)


def viterbi(scores: list[np.ndarray], start: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best labels of each sequence: the sum of scores and start, less penalty for each change.

    All sequences take a step together, longest first, so the work is a few array operations a step; memory is in
    proportion to the sequences given at once.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order], np.int64)
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences longer than the step
    first = np.concatenate([[0], np.cumsum(alive)])
    flat = np.empty((int(first[-1]), len(start)), np.float32)
    for row, i in enumerate(order):
        flat[first[: lengths[row]] + row] = scores[i]
    kind = np.int8 if len(start) <= 127 else np.int32
    stay, best, labels = np.empty(flat.shape, bool), np.empty(len(flat), kind), np.empty(len(flat), kind)
    now = np.empty(len(order), kind)  # the last label of each sequence, then the label at the step reached
    total = np.empty((0, len(start)), np.float32)
    for t in range(steps):
        n, a = alive[t], first[t]
        if t == 0:
            total = start + flat[:n]
            continue
        if n < len(total):
            now[n : len(total)] = total[n:].argmax(axis=1)
            total = total[:n]
        top = total.argmax(axis=1)
        peak = total[np.arange(n), top][:, None]
        kept = total >= peak - np.float32(penalty)
        best[a : a + n], stay[a : a + n] = top, kept
        total = np.where(kept, total - peak, np.float32(-penalty)) + flat[a : a + n]
    now[: len(total)] = total.argmax(axis=1) if len(total) else 0
    for t in range(steps - 1, -1, -1):
        n, a = alive[t], first[t]
        labels[a : a + n] = now[:n]
        if t:
            now[:n] = np.where(stay[a : a + n][np.arange(n), now[:n]], now[:n], best[a : a + n])
    out: list[np.ndarray] = [np.empty(0, kind)] * len(order)
    for row, i in enumerate(order):
        out[i] = labels[first[: lengths[row]] + row]
    return out


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, carry: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) of each row, from its whole text alone; with carry, all columns of docs too.

    lang_pred is the language of the spans with most letters (ties: the first by name), score their share of all
    letters. Texts that are null or have no letter, and any text when nothing could be learned, are 'und' with score 0
    and no spans. spans: array of (lang, start, length) in characters of the lower-cased text, from the first to the
    last letter. Repeated rows are each answered; other columns are ignored, or
    with carry kept except those that have the new names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    key, held = uuid.uuid4().hex, spark.sparkContext.broadcast(model)
    text_name = text_col if carry else "text"
    base = docs.drop("lang_pred", "score", *["spans"] * spans) if carry else docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    through = base.columns if carry else ["doc_id"]

    def work(batches):
        model = held.value
        scorer = worker_state(key, lambda: Scorer(model)) if model else None
        for whole in trimmed(batches):
            for batch in cut(whole, text_name, 1_500_000):
                texts = [(t or "").lower() for t in batch.column(text_name).to_pylist()]
                words = [_LETTERS.findall(t) if scorer else [] for t in texts]
                labels = scorer.label(words) if scorer else [np.empty(0, np.int8)] * len(words)
                lang, score, runs = [], [], []
                for text, w, path in zip(texts, words, labels, strict=True):
                    if not any(c.isalpha() for x in w for c in x):  # other numerals than digits are no letters
                        lang.append("und"), score.append(0.0), runs.append([])
                        continue
                    share = np.bincount(path, scorer.letters[[scorer.place[x] for x in w]] if len(set(path.tolist())) > 1 else None, len(model.languages))
                    top = int(share.argmax())
                    lang.append(model.languages[top]), score.append(float(share[top] / share.sum()))
                    runs.append(_spans(text, path, model.languages) if spans else [])
                cols = [*(batch.column(c) for c in through), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                names = [*through, "lang_pred", "score"]
                if spans:
                    cols.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names)

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in through), "lang_pred string", "score double"])
    return base.mapInArrow(work, shape + ", spans array<struct<lang: string, start: bigint, length: bigint>>" * spans)


def _spans(text: str, path: np.ndarray, languages: tuple[str, ...]) -> list[dict]:
    places = [m.span() for m in _LETTERS.finditer(text)]
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [{"lang": languages[path[a]], "start": places[a][0], "length": places[b - 1][1] - places[a][0]} for a, b in zip(cuts, cuts[1:], strict=False)]
