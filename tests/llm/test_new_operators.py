"""Suffix array, whitening and phrases against brute force: nulls, ties, repeats, long texts, empty tables, clashing names."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from chartmill.llm import exchange, phrases, suffix_array, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_symmetric_eigen(size):
    a = np.random.default_rng(size).normal(size=(size, size))
    a = a @ a.T
    values, axes = whitening.symmetric_eigen(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * values[0])
    assert np.allclose(axes.T @ axes, np.eye(size), atol=1e-13) and np.allclose(a @ axes, axes * values, atol=1e-12 * values[0])


def test_symmetric_eigen_of_equal_and_no_values():
    assert np.allclose(whitening.symmetric_eigen(np.diag([3.0, 1, 3, 0, 0]))[0], [3, 3, 1, 0, 0])
    assert np.allclose(whitening.symmetric_eigen(np.ones((6, 6)))[0], [6, 0, 0, 0, 0, 0], atol=1e-12)


def test_moments_merge():
    x = np.random.default_rng(3).integers(-500, 500, (301, 5))
    whole, left, right = whitening.Moments(5), whitening.Moments(5), whitening.Moments(5)
    whole.add(x.astype(float))
    left.add(x[:100].astype(float))
    right.add(x[100:].astype(float))
    left.merge(right)
    assert left.n == whole.n == 301 and np.allclose(left.mean, x.mean(axis=0)) and np.allclose(left.scatter, whole.scatter)
    assert np.allclose(whole.scatter / 301, np.cov(x.T, bias=True))


def brute_whitening(vectors, most=16):
    usable = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in usable}))
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    rows = {}
    for i, x in usable:
        apart = [n * a - s for a, s in zip(x, total, strict=True)]
        z = (np.array(apart) / n) @ axes[:, :most] / np.sqrt(values[:most])
        for k in range(min(most, len(values))):
            rows.setdefault((i, k + 1), []).append((n, sum(a * a for a in apart), abs(z[k]), values[k] / values.sum()))
    return rows


def test_whitening(spark):
    rng = np.random.default_rng(5)
    vectors = [(k, rng.normal(size=20).tolist()) for k in range(300)]
    vectors += [(300, vectors[0][1]), (None, vectors[1][1]), (301, None), (302, []), (303, [1.0] * 19 + [None]), (304, [float("nan")] + [0.0] * 19), (305, [float("inf")] + [0.0] * 19), (2**60 + 1, vectors[2][1]), (2**60 + 3, vectors[3][1])]
    df = spark.createDataFrame([(i, v, "x", k) for k, (i, v) in enumerate(vectors)], "vec_id long, embedding array<double>, x string, dim long").repartition(5)
    got = {}
    rows = whitening.whiten(df).collect()
    for r in rows:
        got.setdefault((r["vec_id"], r["component"]), []).append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
    want = brute_whitening(vectors)
    assert got.keys() == want.keys() and len(rows) == 304 * 16
    for key, values in want.items():
        assert np.allclose(sorted(got[key]), sorted(values), rtol=1e-9, atol=1e-9)
        assert [v[1] for v in sorted(got[key])] == [v[1] for v in sorted(values)]
    assert max(r["identity_error"] for r in rows) < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 7")).count() == 0


def test_deviation_beyond_64_bits():
    y = np.array([[2**40, 0], [-(2**40), 5]])
    assert whitening.squares(whitening.centred(y, 2**20, [0, 5])) == [None, None]
    assert whitening.squares(whitening.centred(y, 3, [1, 5])) == [None, None]
    assert whitening.squares(whitening.centred(np.array([[2**20, 1]]), 3, [1, 5])) == [(3 * 2**20 - 1) ** 2 + 4]


def test_lengths_are_fitted_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=3 + k % 2).tolist()) for k in range(60)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 30 * 3 + 30 * 4 and {r["n"] for r in got} == {30}


def test_merging_in_levels(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(200)], "vec_id long, embedding array<double>").repartition(12)
    once = {(r["vec_id"], r["component"]): abs(r["whitened"]) for r in whitening.whiten(df).collect()}
    monkeypatch.setattr(whitening, "FAN", 2)
    levels = {(r["vec_id"], r["component"]): abs(r["whitened"]) for r in whitening.whiten(df).collect()}
    assert once.keys() == levels.keys() and all(abs(once[k] - levels[k]) < 1e-9 for k in once)


def brute_phrases(rows, least, most, share=50):
    out = []
    langs = {}
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        langs.setdefault(lang or "und", []).extend(re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low))
    for lang, pieces in langs.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n = sum(c for w, c in f.items() if len(w) == 1)
        found = []
        for w, a in f.items():
            if len(w) < 2 or a < least:
                continue
            if any(len(v) > len(w) and b >= least and 100 * b >= share * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for v, b in f.items() if len(v) == 3):
                continue
            score, k = min((1_000_000 * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    common = ["Alpha", "beta", "gamma", "Ärger", "delta-x", "日本", "e"]
    rows = [(" ".join(str(x) + ("." if rng.random() < 0.1 else "") for x in rng.choice(common, 80)), "en" if k % 3 else None) for k in range(12)]
    rows += [(None, "en"), ("", None), (" \t\n ", "de"), ("one two", "de"), ("a b c " * 3000, "de"), ("A\tB,c", "de"), ("x" * 5000, "fr"), (rows[0][0], "en"), ("zero\x00byte nul " * 20, "fr")]
    return rows


@pytest.mark.parametrize("block,wide,most", [(1_000, False, 2000), (7, False, 5), (300, True, 2000)])
def test_phrases(spark, texts, block, wide, most):
    df = spark.createDataFrame([(k, t, g, "s", 0, f"w{k}", k) for k, (t, g) in enumerate(texts)], SCHEMA + ", words string, block long")
    got = sorted(tuple(r) for r in phrases.collocations(df, 3, most, block=block, wide=wide).collect())
    assert got == brute_phrases(texts, 3, most)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_phrases_of_a_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 10)
    texts = [("some, words that, go on " * 12 + "averyveryverylongword and more", "en")]
    df = spark.createDataFrame([(1, *texts[0])], "doc_id long, text string, lang string")
    assert b"".join(phrases.slices(b"abc def,ghi" * 9)) == b"abc def,ghi" * 9
    assert sorted(tuple(r) for r in phrases.collocations(df, 3, 50).collect()) == brute_phrases(texts, 3, 50)


@pytest.mark.parametrize("bits", [1, 7, 21, 40])
def test_keys_go_there_and_back(bits):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 1 << bits, 1000).astype(np.uint64) for _ in range(3)]
    words = phrases.pack(*ids, bits)
    assert all((a == b).all() for a, b in zip(phrases.unpack(words, bits), ids, strict=True))
    mix = phrases.Scramble(phrases.key_bits(bits))
    assert (mix.undo(mix(words[0])) == words[0]).all()


@pytest.mark.parametrize("buckets", [1, 8, 512])
def test_a_block_is_sorted_in_parts_of_whole_buckets(buckets):
    keys = [np.random.default_rng(3).integers(0, 1 << 60, 50_000).astype(np.uint64), np.arange(50_000, dtype=np.uint64)]
    shift = np.uint64(60 - (buckets.bit_length() - 1))
    parts = list(phrases.ranges(keys, shift, buckets))
    assert sorted(np.concatenate([p[1] for p in parts]).tolist()) == list(range(50_000))
    assert max(len(p[0]) for p in parts) < 2 * 50_000 / min(phrases.RANGES, buckets) + 1
    seen = [set((p[0] >> shift).tolist()) for p in parts]
    assert sum(map(len, seen)) == len(set().union(*seen)) == buckets


def test_radix_order():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 5, 500).astype(np.uint64), rng.integers(0, 2**63, 500).astype(np.uint64) >> rng.integers(0, 60, 500).astype(np.uint64)]
    assert (exchange.radix_order(words) == np.lexsort(words[::-1])).all()
    assert exchange.radix_order([np.zeros(0, np.uint64)]).size == 0


def brute_spans(rows, size):
    data = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[a : a + size] for _, b in data for a in range(len(b) - size + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - size + 1):
            if counts[b[a : a + size]] > 1:
                gone[a : a + size] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "Ärger", "日本", "x"], n))
    shared, long = prose(60), prose(6000)
    texts = [prose(90), shared, shared[5:] + prose(50), prose(30) + shared[:-7] + prose(20), prose(40) + shared + shared[20:200] + prose(3), None, "", "short", "a" * 900, "b" * 170 + "a" * 300, "ab" * 300, "abc" * 200 + prose(10)]
    texts += [long, long[100:9000] + prose(10) + long[300:800], prose(50) + long[10_000:20_000]]
    base = prose(200)
    for k in range(25):  # near copies, each with an edit of its own
        at = int(rng.integers(0, len(base) - 10))
        texts.append(base[:at] + f"<{k}>" + base[at:])
    return [(2**60 + 1 + 2 * k if k % 3 else k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0]), (7, texts[3])]


@pytest.mark.parametrize("size", [144, 160, 400])
def test_suffix_array(spark, passages, size, monkeypatch):
    monkeypatch.setattr(suffix_array, "BLOCK", 3000)
    df = spark.createDataFrame([(i, t, "en", None, k, f"b{k}") for k, (i, t) in enumerate(passages)], SCHEMA + ", block string").repartition(3)
    assert sorted(map(tuple, suffix_array.removal_digest(df, size).collect()), key=str) == brute_spans(passages, size)


def test_suffix_array_keeps_columns(spark, passages):
    df = spark.createDataFrame([(i, t, "en", "s", None, f"k{k}", k) for k, (i, t) in enumerate(passages)], SCHEMA + ", k1 string, n_bytes long")
    out = suffix_array.remove_repeats(df, 160)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "k1", "kept", "n_bytes", "n_removed"] and out.count() == len(passages)
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in out.collect())


def test_suffix_array_of_nothing(spark):
    assert suffix_array.removal_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    one = suffix_array.removal_digest(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()
    assert tuple(one[0]) == (1, 0, 0, 0, hashlib.sha256(b"").hexdigest())


def test_least_in_pieces(monkeypatch):
    h = np.random.default_rng(0).integers(0, 2**62, 3000).astype(np.uint64) >> np.uint64(22) << np.uint64(24)
    h[100:140] = h[100]
    want = [int(np.argmin(h[a : a + 64])) + a for a in range(3000 - 63)]
    assert suffix_array.least(h, 64).tolist() == want


LARGE = [2**60 + 1, None, 2**60 + 3]


def test_large_ids_beside_a_null(spark):
    """Ids of more than 53 bits stay whole in every operator that runs Python."""
    import public_tokenizers

    from chartmill.llm import fertility, html_text, language_id, near_copies, sentencepiece_bpe, simhash, substring

    said = ["one two three four five six seven eight nine ten", "eins zwei drei vier", "uno dos tres cuatro"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(LARGE, said, strict=True)], SCHEMA).coalesce(1)
    pages = spark.createDataFrame([(i, "u", f"<p>{t}</p>") for i, t in zip(LARGE, said, strict=True)], "page_id long, url string, html string").coalesce(1)
    pieces, ranks = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    model = language_id.learn(docs)
    found = {
        "op1": fertility.quality(docs, pieces, ranks), "op2": substring.removal_digest(docs), "op6": sentencepiece_bpe.encode_digest(docs, pieces), "op6 rows": sentencepiece_bpe.encode_decode(docs, pieces),
        "op7": html_text.extract(pages).withColumnRenamed("page_id", "doc_id"), "op8": language_id.identify_held_out(docs), "op8 rows": language_id.identify(docs, model), "op9": simhash.near_duplicates(docs),
        "op11": suffix_array.removal_digest(docs), "stage": near_copies.prefixes(docs, 5), "kept": near_copies.keep_one_each(docs), "rows": suffix_array.remove_repeats(docs),
    }
    for name, out in found.items():
        assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(LARGE, key=str), name


def test_the_smallest_large_id_stays(spark):
    from chartmill.llm import near_copies

    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(2**60 + 3, text, None, None, None), (None, "other words are here", None, None, None), (2**60 + 1, text, None, None, None)], SCHEMA).coalesce(1)
    assert {r["doc_id"] for r in near_copies.keep_one_each(docs).collect()} == {None, 2**60 + 1}
