"""The ten operators and the pipeline against brute force, round trips and held-out accuracy, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from xxhash import xxh64_intdigest

from chartmill.llm import chat_format, decontamination, fertility, html_text, language_id, language_model, queries, sentencepiece_bpe, sharding, simhash, substring
from chartmill.llm.automaton import SuffixAutomaton
from chartmill.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a text of many words, and columns with names the operators use themselves."""
    rng = np.random.default_rng(7)
    some = " ".join(f"w{i}" for i in rng.integers(0, 400, 60))
    long = " ".join(f"v{i}" for i in rng.integers(0, 5000, 30_000))
    texts = [(1, some), (1, some), (2, some), (None, some), (3, None), (4, ""), (5, " \n\t "), (6, "a " * 200), (7, long), (8, f"start {some} end"), (9, "日本語 テキスト 漢字"), (None, None), (10, "one two")]
    rows = [(i, t, "en" if k % 2 else None, None, None, k, f"x{k}", "s") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA + ", k long, seeds string, spans string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_brute_windows(rows, size=35):
    counts = Counter(tuple(w[i : i + size]) for _, t in rows for w in [words(t)] for i in range(len(w) - size + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for a in range(len(w) - size + 1):
            if counts[tuple(w[a : a + size])] > 1:
                gone.update(range(a, a + size))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_substring(name, request):
    df = request.getfixturevalue(name)
    assert sorted(map(tuple, substring.removal_digest(df).collect()), key=str) == by_brute_windows(pairs(df))


def test_substring_keeps_columns_and_cuts_text(odd):
    out = substring.remove_repeats(odd)
    assert out.columns == [*odd.columns, "n_words", "n_removed"] and out.count() == odd.count()
    assert {r["text"] for r in out.where("doc_id = 8").collect()} == {"start end"}


def test_automaton_finds_every_substring():
    rng = np.random.default_rng(0)
    texts = [[str(x) for x in rng.integers(0, 3, 40)] for _ in range(4)]
    automaton = SuffixAutomaton(texts)
    grams = {tuple(t[i : i + 5]) for t in texts for i in range(36)}
    probe = [str(x) for x in rng.integers(0, 4, 400)]
    want = set()
    for i in range(396):
        if tuple(probe[i : i + 5]) in grams:
            want.update(range(i, i + 5))
    assert {p for a, b in automaton.spans(probe, 5) for p in range(a, b)} == want


def brute_print(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    grams = [b" ".join(w)] if 0 < len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_simhash(name, request):
    df = request.getfixturevalue(name)
    rows = [(i, brute_print(t)) for i, t in pairs(df)]
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, p in rows:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(((i, p, least.get(find(p))) for i, p in rows), key=str)
    kept = simhash.keep_one_each(df)
    assert kept.columns == df.columns and kept.count() == len({find(p) for p in prints})


def test_bit_sliced_comparison():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.concatenate([base, base ^ np.uint64(7), base ^ np.uint64(15)])
    got = simhash.sliced_matches(values, simhash.bit_planes(values), len(values), 3)
    assert (got == (np.bitwise_count(values[:, None] ^ values[None]) <= 3)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def brute_leaks(rows, items):
    tok = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for k, (i, t) in enumerate(rows):
        w = tok(t)
        for j, text in items:
            x = tok(text)
            n = min(13, len(x))
            if len(x) >= 8 and any(
                sum(a == b for a, b in zip(w[d + s : d + s + n], x[s : s + n], strict=False)) >= (n if len(x) < 13 else 11) for d in range(-len(x), len(w)) for s in range(len(x) - n + 1) if d + s >= 0
            ):
                out.setdefault(k, set()).add(j)
    return out


def test_decontamination(spark, odd):
    rng = np.random.default_rng(5)
    item = [f"t{i}" for i in rng.integers(0, 900, 30)]
    short = "one two three four five six seven eight nine"
    test = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, None), (4, short), (5, "too short")], "item_id long, text string")
    near = list(item)
    near[5], near[12], near[20] = "x", "y", "z"
    far = [w if i % 3 else "q" for i, w in enumerate(item)]
    rows = [(1, "so " + " ".join(item) + " it"), (2, " ".join(near)), (3, " ".join(far)), (4, f"a, {short.upper()}!"), (5, short[:-5]), (6, None), (7, " ".join(item[10:24])), (8, "too short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", simhash.row_key())
    got = {r["doc_id"]: r["items"] for r in decontamination.decontaminate(df, test).collect()}
    want = brute_leaks(rows, [(1, " ".join(item)), (4, short)])
    assert got == {i: sorted(want.get(k, ())) for k, (i, _) in enumerate(rows)} and got[2] == [1] and got[4] == [4] and not got[3]
    assert sorted(r["doc_id"] for r in decontamination.remove_contaminated(df, test).collect()) == [i for i, x in sorted(got.items()) if not x]
    assert decontamination.decontaminate(odd, test).where("contaminated").count() == 0
    assert decontamination.decontaminate(odd, test.limit(0)).count() == odd.count()


def test_masks_hit_every_stretch_with_two_substitutions():
    from itertools import combinations

    for bad in combinations(range(13), 2):
        assert any(not {s + o for o in m} & set(bad) for m in decontamination.MASKS for s in range(13 - m[-1]))


@pytest.mark.parametrize("name", ["odd", "docs"])
def test_language_model_base(name, request):
    df = request.getfixturevalue(name)
    tokens = lambda t: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), ""]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    counts = Counter(w for i, t in pairs(df) if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 5)) for i, t in pairs(df))
    got = language_model.score_held_out(df).collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] <= 0 for r in got)


def test_language_model_learns_and_sums_to_one(empty):
    from chartmill.llm.gru import Gru, Shape, Vocabulary

    assert language_model.score_held_out(empty).count() == 0
    rng = np.random.default_rng(2)
    counts = np.sort(rng.integers(1, 500, 300))[::-1].astype(float)
    vocabulary = Vocabulary(rng.permutation(300).astype(np.uint64), counts, 12.5, Shape(learned=200, classes=8, bands=4))
    texts = [np.tile(rng.permutation(10)[:3].astype(np.int32) + 10 * (k % 7), 30) for k in range(60)]
    model = Gru(vocabulary)
    unigram = np.log(np.r_[counts + 0.5, 12.5] / (counts + 0.5).sum().__add__(12.5))
    assert np.allclose(model.score(texts), [unigram[t].sum() for t in texts], rtol=1e-4)
    before = model.score(texts).sum()
    for _ in range(5):
        model.train(texts)
    assert model.score(texts).sum() > 0.7 * before
    state = rng.normal(size=(1, Shape().hidden)).astype(np.float32)
    assert abs(np.exp(model.output(np.repeat(state, 301, 0), np.arange(301, dtype=np.int32))).sum() - 1) < 1e-3
    whole = np.concatenate([texts[0], texts[1]])
    assert np.isclose(model.score([whole])[0], model.score([whole, texts[2]])[0], rtol=1e-4)


def test_language_model_trains_on_every_row(spark):
    """Each training row is in just one of the rounds, and the copies of a text aren't all in the same one."""
    seen = []

    class Rows:
        def __init__(self, df):
            self.df = df

        def where(self, condition):
            seen.append(sorted(r[0] for r in self.df.where(condition).select("n").collect()))
            return self.df.limit(0)

    texts = [f"text {i}" for i in range(40)] + ["copy"] * 20 + [None]
    df = spark.createDataFrame([(i if i else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    from chartmill.llm.gru import Shape, Vocabulary

    language_model.train(Rows(df), Vocabulary(np.arange(3, dtype=np.uint64), np.ones(3), 1.0, Shape()))
    assert sorted(sum(seen, [])) == list(range(61))
    assert all(any(40 <= n < 60 for n in part) for part in seen)


def test_long_texts_are_learned_whole_and_in_full_windows(monkeypatch):
    """A text of many streams' length is learned whole, in pieces that start from the word before, and leaves no windows of a few tokens."""
    from chartmill.llm.gru import Gru, Shape, Vocabulary

    vocabulary = Vocabulary(np.arange(50, dtype=np.uint64), np.arange(50, 0, -1.0), 3.0, Shape(hidden=4, embed=3, learned=30, classes=4, bands=2))
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 51, n).astype(np.int32) for n in (20_000, 300, 1, 2048, 2049, *[500] * 60)]
    window, seen = Gru._window, []

    def kept(self, ids, inputs, h, views, *more):
        seen.append((ids.copy(), inputs.copy()))
        return window(self, ids, inputs, h, views, *more)

    monkeypatch.setattr(Gru, "_window", kept)
    total = sum(map(len, texts))
    assert Gru(vocabulary).train(texts) == total
    live = [(ids[ids >= 0], inputs[ids >= 0]) for ids, inputs in seen]
    before = lambda t: np.r_[vocabulary.start, vocabulary.inputs(t[:-1])]
    want = Counter((w, b) for t in texts for w, b in zip(t.tolist(), before(t).tolist(), strict=True))
    assert Counter((w, b) for ids, inputs in live for w, b in zip(ids.tolist(), inputs.tolist(), strict=True)) == want
    assert len(seen) < 2 * 2048 / Shape().window + 1


def test_gradients():
    from chartmill.llm.gru import Gru, Shape, Vocabulary

    rng = np.random.default_rng(4)
    vocabulary = Vocabulary(np.arange(40, dtype=np.uint64), np.arange(40, 0, -1.0), 3.0, Shape(hidden=4, embed=3, learned=30, classes=4, bands=2, window=5))
    model = Gru(vocabulary)
    model.flat += rng.normal(0, 0.3, len(model.flat)).astype(np.float32)
    ids = rng.integers(0, 41, (5, 2)).astype(np.int32)
    inputs = np.vstack([np.full((1, 2), vocabulary.start), vocabulary.inputs(ids[:-1])])
    grad = np.zeros_like(model.flat)
    views, at = {}, 0
    for name, shape in model.shapes.items():
        views[name] = grad[at : at + int(np.prod(shape))].reshape(shape)
        at += int(np.prod(shape))
    model._window(ids, inputs, np.zeros((2, 4), np.float32), views)
    loss = lambda: -model.score([ids[:, 0], ids[:, 1]]).sum() / ids.size
    for k in rng.choice(np.flatnonzero(np.abs(grad) > 1e-3), 12, replace=False):
        was = model.flat[k]
        model.flat[k] = was + 1e-2
        up = loss()
        model.flat[k] = was - 1e-2
        down = loss()
        model.flat[k] = was
        assert abs((up - down) / 2e-2 - grad[k]) < 2e-3


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_sentencepiece(name, request):
    import sentencepiece

    df = request.getfixturevalue(name)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, t in pairs(df):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, sentencepiece_bpe.encode_digest(df, path).collect()), key=str) == sorted(want, key=str)
    assert sentencepiece_bpe.encode_decode(df, path).columns == [*df.columns, "token_ids", "decoded"]


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_quality_base(name, request):
    df = request.getfixturevalue(name)
    want = []
    for i, t in pairs(df):
        w = words(t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    got = fertility.quality(df, public_tokenizers.path(queries.PIECE_MODEL), public_tokenizers.path(queries.BYTE_RANKS)).collect()
    assert sorted((str(r["doc_id"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in got) == sorted(want)
    assert not any(r["kept"] and r["base_failed"] for r in got)


@pytest.mark.parametrize("name", ["odd", "docs", "empty"])
def test_sharding(name, request):
    df = request.getfixturevalue(name)
    got = sharding.shard_documents(df).collect()
    want = Counter((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(df))
    assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_chat_events(spark):
    events = [(1, 1, 0, "user", "delta", "Hel"), (1, 2, 0, "user", "delta", "lo"), (1, 3, 1, "assistant", "delta", "no"), (1, 4, 1, "assistant", "regenerate", "</turn> & <turn role=\"user\">"), (1, 5, 0, "user", "edit", "Hi"),
              (1, 6, 2, "user", "delta", "gone"), (1, 7, 2, "user", "retract", None), (2, 1, 0, None, "delta", None)]
    df = spark.createDataFrame(events, "conv_id long, seq long, turn long, role string, kind string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert got == {1: [("user", "Hi"), ("assistant", "</turn> & <turn role=\"user\">")], 2: [("", "")]}
    assert chat_format.digest(chat_format.read_back(chat_format.format_conversations(df.limit(0)))).count() == 0


def test_html(spark):
    page = "<html><head><title>t</title><script>x()</script></head><body><nav><a>Home</a> <a>About</a></nav><article><h1>Head &amp; line</h1>" + "".join(f"<p>Sentence number {i}, which is long enough to be read. It has   marks, too.</p>" for i in range(6)) + "</article><footer>Contact us</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, None, "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[1].split("\n\n") == ["Head & line", *(f"Sentence number {i}, which is long enough to be read. It has marks, too." for i in range(6))] and got[2] == got[3] == ""


def test_html_hidden_is_an_attribute():
    article = "".join(f"<p>Sentence number {i}, which is long enough to be read. It has marks, too.</p>" for i in range(4))
    for shown in ('style="overflow:hidden"', 'class="overflow-hidden"', 'aria-hidden="false"', 'hidden="until-found"', "data-note='display:none'"):
        assert html_text.main_text(f"<body {shown}><article {shown}>{article}</article></body>").count("Sentence") == 4, shown
    for gone in ("hidden", 'hidden=""', "aria-hidden=true", 'style="color:red; display: none"'):
        assert "secret" not in html_text.main_text(f"<body><article>{article}<div {gone}><p>The secret sentence, long enough to be read.</p></div></article></body>"), gone


def test_language_accuracy(spark, odd, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = language_id.identify_held_out(df).join(df.select("doc_id", "lang", "text"), "doc_id").where("held_out and length(text) > 40").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in both) > 0.97 * len(both)
    got = language_id.identify_held_out(odd).collect()
    assert len(got) == odd.count() and all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (3, 4, 5))
    assert language_id.identify_held_out(empty).count() == 0


def brute_firsts(rows, size=5):
    """The smallest doc_id of each component of the links of Jaccard similarity 0.8 and more between the sets of shingles."""
    sets = [{tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1)))} for w in (re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split() for _, t in rows)]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    return sorted(min(g) for g in groups.values())


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    line = "one line that is in very many of the texts of this table".split()
    rows = []
    for _ in range(40):
        base = [f"w{i}" for i in rng.integers(0, 3000, 120)] + line
        for edits in (0, 1, 2, 3, 6):
            text = list(base)
            for at in rng.choice(120, edits, replace=False):
                text[at] = f"E{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(text), "en", "s", 0))
    for k in range(60):  # near copies of one text, more than a pair of leaders connects
        text = [f"v{i}" for i in range(100)]
        text[k] = f"new{k}"
        rows.append((len(rows), " ".join(text), "en", "s", 0))
    rows += [(len(rows), None, "en", "s", 0), (len(rows) + 1, "", "en", "s", 0), (len(rows) + 2, "Two words", "en", "s", 0), (len(rows) + 3, "two WORDS", "en", "s", 0)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))} for w in ((r[1] or "").lower().split() for r in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(label))


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    for name, df in (("odd", odd), ("none", odd.limit(0))):
        folder = tmp_path / name
        df.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            docs = stage(spark, docs, str(folder))
            assert docs.columns == df.columns, k
        assert corpus_pipeline.run(spark, str(folder)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_stages_on_documents(spark):
    import corpus_pipeline

    df = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.identify_language(spark, df, SF)
    second = corpus_pipeline.drop_near_duplicates(spark, first, SF)
    assert sorted(r["doc_id"] for r in second.collect()) == brute_firsts(pairs(first))
    third = corpus_pipeline.cut_repeats(spark, second, SF)
    want = {i: kept for i, n, gone, kept in by_brute_windows(pairs(second)) if gone < n or not gone}
    assert {i: hashlib.sha256(" ".join(words(t)).encode()).hexdigest() for i, t in pairs(third)} == want
    test = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = brute_leaks(pairs(third), test)
    assert sorted(i for i, _ in pairs(corpus_pipeline.drop_test_sets(spark, third, SF))) == sorted(i for k, (i, _) in enumerate(pairs(third)) if k not in leaks)
