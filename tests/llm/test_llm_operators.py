"""Each operator against a brute-force version, an exact round trip, SQL or held-out accuracy, and on odd rows."""

import dataclasses
import hashlib
import io
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zstandard
from tokenizers import Tokenizer

from tidemark.llm import bpe, chat, exact_dedup, fingerprint, language, lm, mixing, near_dedup, queries, tokenfile, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1 language


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(50):
        seqs = [rng.normal(size=(n, 3)).astype("f4") * 3 for n in rng.integers(0, 6, 5)]
        start = rng.normal(size=3).astype("f4")
        for s, path in zip(seqs, language.viterbi(seqs, start, 2.0), strict=True):
            def value(p, s=s):
                return start[p[0]] + sum(s[i][p[i]] for i in range(len(p))) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))

            assert len(path) == len(s)
            if len(s):
                assert abs(value(list(path)) - max(map(value, itertools.product(range(3), repeat=len(s))))) < 1e-4


def test_viterbi_of_many_languages():
    start = np.zeros(200, "f4")
    start[150] = 1
    assert [p.tolist() for p in language.viterbi([np.zeros((4, 200), "f4")], start, 2.0)] == [[150] * 4]


def test_language_scripts_and_many_labels(spark):
    """Scripts rule languages out; more labels than a byte holds are told apart; a tie goes to the first by name."""
    rows = [(1, "привет как дела мой друг", "ru"), (2, "hello how are you my friend", "en"), (3, "γειά σου φίλε μου", "el")]
    rows += [(100 + k, " ".join(f"{a}{chr(0x4E00 + k)}{chr(0x4E00 + 7 * k)}" for a in "的是"), f"x{k:03d}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = by_id(language.identify(docs, language.fit(docs, "doc_id", "text", "lang")))
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["ru", "en", "el"]
    assert sum(out[100 + k]["lang_pred"] == f"x{k:03d}" for k in range(200)) >= 195
    twins = spark.createDataFrame([(1, "same words here", "b"), (2, "same words here", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(twins, language.fit(twins, "doc_id", "text", "lang")).collect()} == {"a"}


def test_language_held_out(spark, docs, small):
    out = queries.op1_language(spark, small).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 20 and (out.lang == out.lang_pred).mean() >= 0.95
    assert set(out.lang_pred) <= {"en", "de", "fr", "es"}


def test_language_spans_and_odd_rows(spark, docs, odd):
    model = language.fit(docs, "doc_id", "text", "lang")
    mixed = spark.createDataFrame([(1, "the thing is of the ertion and this. la eauxon le que leau ment. der ung schtz und keit")], "doc_id long, text string")
    assert [s["lang"] for s in language.identify(mixed, model, spans=True).first()["spans"]] == ["en", "fr", "de"]
    out = language.identify(odd, model).toPandas()
    assert len(out) == 9
    assert all(out[out.doc_id.isin([3, 4, 5])].lang_pred == "und")
    assert language.identify(odd, None).where("lang_pred <> 'und'").count() == 0
    assert language.identify(odd.limit(0), model).count() == 0
    assert language.fit(docs.limit(0), "doc_id", "text", "lang") is None
    assert language.identify(odd, model, carry=True).columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "score"]


# 2 language model


def test_filter_never_counts_too_low():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    n = np.maximum(1, rng.pareto(1, 20_000).astype(int))
    f = lm.Filter([lm.build_filter(h, n).tobytes()], 0, 1)
    assert (f.level(h) >= lm.level_of(n)).all()
    assert (f.level(h) > lm.level_of(n)).mean() < 0.06
    assert (f.level(rng.integers(0, 2**63, 20_000).astype(np.uint64)) > 0).mean() < 0.06


def test_lm_base_scores_and_model(spark, docs, small):
    out = queries.op2_lm_score(spark, small).toPandas()
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b""] for r in docs.collect()}
    train = Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, kinds = sum(train.values()), len(train)
    for r in out.itertuples():
        ws = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in train for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), rel_tol=1e-9)
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()
    # the score again from plain counts and the fitted weights; the filter may take a few counts for higher ones
    fitted = lm.train(docs.where(queries.fold("doc_id", 10) != 0))
    pairs = Counter()
    for i, ws in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            pairs.update(zip([b"", *ws], ws, strict=False))
    level = lambda n: int(lm.level_of(np.array([n]))[0])
    gaps = []
    for r in out.itertuples():
        ws, plain = texts[r.doc_id], 0.0
        for a, b in zip([b"", *ws], ws, strict=False):
            share, alone, at = lm.shares(*(np.array([level(n)]) for n in (train[a], pairs[a, b], train[b])), total + 0.1 * (kinds + 1))
            w = fitted.mixing[at[0]]
            plain += math.log10((1 - w) * share[0] + w * alone[0])
        gaps.append((r.score - plain) / r.n_tokens)
    assert abs(np.mean(gaps)) < 0.1 and np.percentile(np.abs(gaps), 90) < 0.3


def test_lm_in_parts_equals_whole_and_odd_rows(spark, docs, odd):
    counts = lm.train(docs)
    from pyspark.sql import functions as F

    limit = int(counts.table.agg(F.sum(F.octet_length("single")) + F.max(F.octet_length("double"))).first()[0])
    parts = dataclasses.replace(counts, kept=[])
    assert len(list(lm._shards(parts, limit))) > 1
    a, b = by_id(lm.score(docs, counts)), by_id(lm.score(docs, dataclasses.replace(counts, kept=[]), filter_limit=limit))
    assert all(math.isclose(a[i]["score"], b[i]["score"]) and math.isclose(a[i]["base_score"], b[i]["base_score"]) and a[i]["n_known"] == b[i]["n_known"] for i in a)
    out = lm.score(odd, counts).toPandas()
    assert len(out) == 9 and out[out.doc_id.isin([3, 4, 5])].n_tokens.tolist() == [1, 1, 1]
    assert lm.score(odd.limit(0), counts).count() == 0
    assert lm.score(odd, lm.train(odd.limit(0))).where("n_known > 0").count() == 0


# 3 fingerprints


def _reference_fingerprint(text):
    """The same definition, one step at a time."""
    words = [w for w in (text or "").encode().split()]
    if not words:
        return ""

    def longs(values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
        return h - (1 << 64) if h >= 1 << 63 else h

    hashes = [(lambda h: h - (1 << 64) if h >= 1 << 63 else h)(xxhash.xxh64_intdigest(w, seed=42)) for w in words]
    shingles = [longs(hashes[i : i + 5]) & ((1 << 63) - 1) for i in range(max(1, len(words) - 4))]
    bins = {}
    for s in shingles:
        bins[s >> 56] = min(bins.get(s >> 56, s), s)

    def mixed(*values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(struct.pack("<i", v), seed=h) if False else _int_hash(v, h)
        return h - (1 << 64) if h >= 1 << 63 else h

    out = []
    for b in range(128):
        tries = [b, *(mixed(b, t) % 128 for t in range(16)), *((b + s * (2 * (mixed(b) % 64) + 1)) % 128 for s in range(1, 129))]
        out.append(next(bins[t] for t in tries if t in bins) & 255)
    return "".join(f"{x:02x}" for x in out)


def _int_hash(v, seed):
    return xxhash.xxh64_intdigest(struct.pack("<i", v), seed=seed)


def test_fingerprint_definition_and_estimate(spark, docs):
    out = fingerprint.fingerprints(docs).toPandas().fingerprint.tolist()
    texts = [r["text"] for r in docs.select("text").collect()]
    assert out[:60] == [_reference_fingerprint(t) for t in texts[:60]]


def test_edited_fingerprints(spark, docs, odd):
    out = fingerprint.edited_fingerprints(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    rows = docs.orderBy("doc_id").toPandas()
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    errors = []
    for i, text in enumerate(rows.text):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows.text[(i + 1) % len(rows)][:half]
        assert out.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and out.n_chars[i] == len(text)
        a, b = shingles(text), shingles(edited)
        errors.append(out.near_edited[i] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06
    odd_out = fingerprint.edited_fingerprints(odd).toPandas()
    assert len(odd_out) == 9 and odd_out[odd_out.doc_id.isin([3, 4, 5])].fingerprint.tolist() == ["", "", ""]
    assert fingerprint.edited_fingerprints(odd.limit(0)).count() == 0


# 4 toxicity


def test_ftrl_learns_what_matters():
    rng = np.random.default_rng(0)
    examples, labels = [], []
    for i in range(800):
        y = i % 4 == 0
        examples.append(np.unique(np.concatenate([rng.integers(100, 50_000, 40), [7] if y else []]).astype(np.int64)))
        labels.append(float(y))
    model = toxicity.ftrl(examples, np.array(labels))
    assert model.slots[model.weights.argmax()] == 7 and len(model.slots) < 200


def test_ftrl_equals_plain_steps():
    """The published per-coordinate steps, one coordinate at a time."""
    rng = np.random.default_rng(1)
    examples = [np.unique(rng.integers(0, 30, 6)).astype(np.int64) + (1 << toxicity.WORD_SLOTS_LOG2) * (i % 2) for i in range(60)]
    labels = rng.integers(0, 2, 60).astype(float)
    alpha, beta, l1, l2 = 1.0, 1.0, 0.3, 0.1
    model = toxicity.ftrl(examples, labels, alpha, beta, l1, l2, 3, 7)
    z, n = Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    value = lambda k: 1.0 if k < 1 << toxicity.WORD_SLOTS_LOG2 else toxicity.PAIR_VALUE
    base = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    bias, bias_n, order = math.log(base / (1 - base)), 1.0, np.random.default_rng(7)
    for _ in range(3):
        for i in order.permutation(60):
            w = {int(k): weight(int(k)) for k in examples[i]}
            error = 1 / (1 + math.exp(-(bias + sum(w[k] * value(k) for k in w)))) - labels[i]
            for k in w:
                g = error * value(k)
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
            bias_n += error * error
            bias -= alpha * error / (beta + math.sqrt(bias_n))
    want = {k: weight(k) * value(k) for k in sorted(z) if weight(k)}
    assert model.slots.tolist() == list(want) and np.allclose(model.weights, list(want.values()), rtol=1e-5) and math.isclose(model.bias, bias, rel_tol=1e-9)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = queries.op4_toxicity(spark, d).join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = out[out.toxic == 1].score, out[out.toxic == 0].score
    assert np.mean([(t > clean).mean() + 0.5 * (t == clean).mean() for t in toxic]) > 0.85
    assert (out[out.toxic == 0].predicted == 0).mean() > 0.97


def test_toxicity_odd_rows(spark, docs, odd, small):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, labels)).count() == 9
    assert toxicity.score(odd.limit(0), toxicity.fit(odd, labels.limit(0))).count() == 0


# 5 chat


def test_chat_equals_sql(spark, small, same):
    out = queries.op5_chat_format(spark, small)
    assert same(out, chat.SQL)
    parts = {r["part"]: r["count"] for r in out.groupBy("part").count().collect()}
    assert parts["prompt"] > 0 and parts["chosen"] > 0 and parts["rejected"] > 0


def test_chat_prefix_and_odd_rows(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 1, "assistant", "bad"),
        (2, "chosen", 0, "user", "only"), (3, "chosen", 0, "user", "x"), (3, "rejected", 0, "user", "x"), (None, "chosen", 0, "user", "x"), (4, None, 0, "user", "x"),
        (5, "chosen", None, None, None), (5, "rejected", 0, "user", ""),
    ]
    turns = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")
    out = {r["pair_id"]: r for r in chat.assemble(chat.preference_segments(turns)).collect()}
    assert out[1]["prompt"] == "<|user|>\nhi<|end|>\n" and out[1]["chosen"] == "<|assistant|>\ngood<|end|>\n" and out[1]["rejected"] == "<|assistant|>\nbad<|end|>\n"
    assert out[2]["prompt"] == "" and not out[2]["paired"]
    assert out[3]["chosen"] == out[3]["rejected"] == "" and set(out) == {1, 2, 3, 5}
    assert chat.preference_segments(turns.limit(0)).count() == 0
    long = "word " * 200_000
    talks = spark.createDataFrame(
        [(2, 0, "user", long, 9), (2, 1, "assistant", "a", 9), (3, 0, "user", "q", 9), (3, 1, "assistant", long, 9), (4, 0, "user", "alone", 9), (6, 0, "user", None, 9), (6, 1, "assistant", "x", 9), (None, 0, "user", "x", 9)],
        "conv_id long, turn long, role string, text string, at long",
    )
    out = {r["pair_id"]: r for r in chat.assemble(chat.preference_segments(chat.exchanged_answers(talks))).collect()}
    assert out[2]["prompt"] == f"<|user|>\n{long}<|end|>\n" and out[2]["rejected"] == f"<|assistant|>\n{long}<|end|>\n" and out[3]["rejected"] == "<|assistant|>\na<|end|>\n"
    assert out[4]["chosen"] == out[4]["rejected"] == "" and out[6]["rejected"] == "<|assistant|>\n<|end|>\n" and set(out) == {2, 3, 4, 6}


# 6 mixing


def test_mixing_equals_sql(spark, small, same):
    assert same(queries.op6_mixing(spark, small), mixing.SQL)


def test_mixing_exponent():
    shares = {"a": 0.7, "b": 0.25, "c": 0.05}
    a = mixing.find_exponent(shares, None, 2.0)
    assert math.isclose(mixing.repetition(shares, a), 2.0, rel_tol=1e-6)
    b = mixing.find_exponent(shares, 0.9, None)
    assert math.isclose(mixing.entropy(mixing.weights(shares, b)), 0.9, rel_tol=1e-6)
    assert mixing.find_exponent(shares, None, 1e9) == 0.0 and mixing.find_exponent(shares, None, 1.0) > 0.999


def test_mixing_entropy_over_sources(spark):
    """The exponent for a target entropy is the one that plain bisection finds, and null is a source apart from ''."""
    words = {"a": 700, "b": 250, "": 30, None: 20}
    docs = spark.createDataFrame([(i, "w " * n, s, 5) for i, (s, n) in enumerate(words.items())], "doc_id long, text string, source string, _key long")
    out = mixing.mix(docs, target_entropy=0.9, repetition_limit=None).toPandas()
    a = mixing.find_exponent({s: n / 1000 for s, n in words.items()}, 0.9, None)
    want = mixing.weights({s: n / 1000 for s, n in words.items()}, a)
    got = {None if s is None or s != s else s: w for s, w in zip(out["_source"], out["_weight"], strict=True)}
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9) for s in want)
    assert set(out["_key"]) == {5}


def test_mixing_keeps_all_and_odd_rows(spark, odd):
    out = mixing.mix(odd).toPandas()
    assert out["_metadata"].nunique() == 9
    assert mixing.mix(odd.limit(0)).count() == 0


# 7 token files


def test_token_file_round_trip_and_frames():
    stream = io.BytesIO()
    writer = tokenfile.TokenWriter(stream, 64)
    told = [(i if i % 9 else None, np.arange(i * 7 % 50, dtype="<u4").tobytes()) for i in range(200)]
    for i, ids in told:
        writer.add(i, ids)
    writer.close()
    data = stream.getvalue()
    reader = tokenfile.TokenReader(stream, len(data))
    assert [(i, ids) for i, _, ids in reader.documents()] == told
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data) == b"".join(x for _, x in told)
    reader.frames_read = 0
    assert [x[2] for x in reader.documents([5, 6])] == [told[5][1], told[6][1]] and reader.frames_read <= 2
    broken = bytearray(data)
    broken[10] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(tokenfile.TokenReader(io.BytesIO(broken), len(broken)).documents())


def test_words_encode_as_the_library():
    plain = Tokenizer.from_file(WORDS)
    definition = open(WORDS, encoding="utf-8").read()
    words = tokenfile._Words(definition)
    for s in ("hello <|endoftext|> world", "a<|startoftext|>b <|ENDOFTEXT|> É<|endoftext|>", "<|EndOfText|> X"):
        assert np.frombuffer(words.encode(s, b""), "<u4").tolist() == plain.encode(s, add_special_tokens=False).ids, s
    assert 49407 in np.frombuffer(words.encode("x <|endoftext|>", b""), "<u4")
    other = tokenfile._Words(definition.replace("\"Lowercase\"", "\"Strip\", \"strip_left\": true, \"strip_right\": true").replace("\"invert\":true", "\"invert\":false").replace("\"invert\": true", "\"invert\": false"))
    assert not other.known  # whole texts then go through the library
    text = "A b  c\n D"
    assert np.frombuffer(other.encode(text, b""), "<u4").tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids
    rnd = random.Random(2)
    letters = "aAbeEiİıΣσςéÉüñß́̈ \n\t\x0b\x0c\x1c\x85  .,!'’漢字🙂ſK0123٣½'s't<|>LL"
    for _ in range(3000):
        s = "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 30)))
        assert np.frombuffer(words.encode(s, b""), "<u4").tolist() == plain.encode(s, add_special_tokens=False).ids, s


def test_token_files(spark, docs, small, odd):
    plain = Tokenizer.from_file(WORDS)
    out = queries.op7_token_files(spark, small).toPandas().sort_values("doc_id")
    before = 0
    for got, row in zip(out.itertuples(), docs.orderBy("doc_id").collect(), strict=True):
        ids = np.array([*plain.encode(row["text"], add_special_tokens=False).ids, 2], "<u4")
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (row["doc_id"], before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)
    manifest = tokenfile.write_tokens(odd, WORDS)
    assert tokenfile.read_tokens(manifest).count() == 9
    assert tokenfile.read_tokens(manifest, [2, 3]).count() == 3
    assert tokenfile.read_tokens(tokenfile.write_tokens(odd.limit(0), WORDS)).count() == 0


# 8 byte-level BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBPE(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


def test_bpe_equals_library(coder):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rnd = random.Random(1)
    letters = "aabcdeeioust  \n\t.,!'  \x1c\x85 éüñßжд漢字🙂́ſK0123٣½'s't"
    for _ in range(4000):
        s = "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 40)))
        assert coder.encode(s) == library.encode_ordinary(s), s
        assert coder.decode(coder.encode(s)) == s.encode()


def test_bpe_appends_and_edits(coder):
    rnd = random.Random(3)
    parts = ["thing", "ation", "schaft", "ment", "élève", "0123", "ungen", "x"]
    for _ in range(200):
        a = bpe.Appendable(coder, "".join(rnd.choice(parts) for _ in range(30)).encode())
        for _ in range(4):
            i = rnd.randrange(0, len(a.data) + 1)
            a.replace(i, min(len(a.data), i + rnd.randrange(0, 6)), rnd.choice(parts).encode()[: rnd.randrange(0, 5)])
            assert a.last == bpe.Appendable(coder, a.data).last
    long = bpe.Appendable(coder, b"thing" * 2000)
    worked = long.worked
    long.replace(5000, 5001, b"z")
    assert long.worked - worked < 500


def test_bpe_round_trip(spark, docs, small, odd):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    out = by_id(queries.op8_bpe(spark, small))
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"])
        assert out[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and out[r["doc_id"]]["n_tokens"] == len(ids)
        assert out[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    encoded = bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN)
    assert encoded.count() == 9 and bpe.round_trip(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    told = bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN, digests=True).collect()
    assert sorted((r["ids_sha256"], r["decoded_sha256"]) for r in told) == sorted(
        (hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest(), hashlib.sha256(r["decoded"]).hexdigest()) for r in encoded.collect())
    again = bpe.decode_ids(encoded.drop("decoded"), RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r["decoded"]) for r in again.collect()) == sorted(bytes(r["decoded"]) for r in encoded.collect())


# 9 exact deduplication


def test_rice_code():
    rng = np.random.default_rng(0)
    for n in (1, 2, 500):
        for k in (0, 3, 9):
            values = np.unique(rng.integers(0, 60 * n, n))
            assert (exact_dedup.rice_decode(*exact_dedup.rice_encode(values, k), k, len(values)) == values).all()


def test_exact_dedup_equals_sql(spark, small, same):
    assert same(queries.op9_exact_dedup(spark, small), exact_dedup.SQL)


def test_exact_dedup_odd_rows_and_groups(spark, odd, docs):
    out = exact_dedup.exact_dedup(odd).toPandas()
    assert len(out) == 9 and out.kept.sum() == out.text_sha256.nunique()
    assert out[(out.doc_id == 3)].kept.tolist() == [True] and out[out.doc_id == 4].keep_id.tolist() == [3]
    assert out[out.doc_id == 2].keep_id.tolist() == [1, 1] and out[out.doc_id.isna()].keep_id.tolist() == [1]
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0
    assert exact_dedup.drop_duplicates(odd).columns == odd.columns
    # few guard bits make false suspects, which the bytes then clear; a small limit takes files in groups
    key = lambda df: sorted(map(tuple, df.collect()))
    spread = docs.repartition(4)
    assert key(exact_dedup.exact_dedup(spread, guard_bits=0, bitmap_limit=9000)) == key(exact_dedup.exact_dedup(docs))


# 10 near duplicates


def _shingles(text, words):
    """The contract's set, from the words themselves."""
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def _components(rows, words, percent):
    sets = {i: _shingles(t, words) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(docs, words, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = near_dedup.near_duplicates(docs, words=words, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == _components(rows, words, percent)
    assert {r["doc_id"]: r["n_shingles"] for r in out} == {i: len(_shingles(t, words)) for i, t in rows}


@pytest.mark.parametrize(("n", "shared", "own", "changes"), [(1500, 100, 16, 2), (5200, 100, 45, 3)])
def test_near_duplicates_of_a_shared_passage(spark, n, shared, own, changes):
    """All texts hold one passage, so sketches join them all (likeness 0.75) or nodes stay large (0.52); only the planted
    pairs are linked, and every one of them is found."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(shared)]
    rows = [base + [f"u{rnd.randrange(10**9)}" for _ in range(own)] for _ in range(n)]
    want = {i: i for i in range(n)}
    for k in range(100):
        w = list(rows[k * 7])
        for i in rnd.sample(range(len(w) // 4), changes):
            w[4 * i] = f"z{rnd.randrange(10**9)}"
        want[len(rows)] = k * 7
        rows.append(w)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(4)
    out = near_dedup.near_duplicates(frame, words=3, percent=85)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == want


def test_near_duplicates_missed_probability():
    for t in (0.8, 0.85):
        n = near_dedup.trees_for(t)
        assert near_dedup.missed(t, n) <= near_dedup.MISS < near_dedup.missed(t, n - 1)


def test_near_duplicates_dense_group(spark):
    """A group larger than a node and than a block, whose members link through some others only."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rnd.randrange(0, 5)):
            w[rnd.randrange(100)] = f"x{rnd.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == _components(rows, 3, 85)


def test_near_duplicates_odd_rows(odd):
    out = near_dedup.near_duplicates(odd).toPandas()
    assert len(out) == 9
    assert out[out.doc_id.isin([3, 4, 5])].n_shingles.tolist() == [0, 0, 0]
    assert out[out.doc_id == 2].component_id.tolist() == [1, 1] and out[out.doc_id.isna()].component_id.tolist() == [1]
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_components_follow_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["label"] for r in near_dedup.components(edges).collect()} == {1, 100}
