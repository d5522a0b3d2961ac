"""Further contracts of the operators: names that clash, ties, spans, bands, cut links, odd pages, all against brute force or planted cases."""

import hashlib
import math
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chartmill.llm import chat_format, decontamination, fertility, html_text, language_id, language_model, near_copies, queries, sentencepiece_bpe, sharding, simhash, substring

SENTENCES = "".join(f"<p>Sentence number {i}, which is long enough to be read. It has marks, too.</p>" for i in range(4))


def test_added_columns_take_the_place_of_their_names(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, f"{text} own words", 7, "x", "y", 0.5), (2, text, 8, "x", "y", 0.5), (3, None, 9, None, None, None)], "doc_id long, text string, n_words int, lang_pred string, decoded string, score double")
    kept = substring.cut_repeats(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["n_words"]) for r in kept.collect()) == [(1, "own words", 7), (3, None, 9)]
    removed = substring.remove_repeats(df)
    assert Counter(removed.columns) == Counter({*df.columns, "n_removed"})
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in removed.collect()} == {1: (52, 50), 2: (50, 50), 3: (0, 0)}
    model = language_id.learn(spark.createDataFrame([("some words here", "en")], "text string, lang string"))
    found = language_id.identify(df, model)
    assert Counter(found.columns) == Counter({*df.columns, "spans"}) and {r["lang_pred"] for r in found.collect()} == {"en", "und"}
    encoded = sentencepiece_bpe.encode_decode(df, public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter(encoded.columns) == Counter({*df.columns, "token_ids"}) and {r["doc_id"]: r["decoded"] for r in encoded.collect()}[2] == text


def test_long_repeats_are_cut_into_pieces_and_shards(spark):
    rng = np.random.default_rng(3)
    shared = [f"s{i}" for i in rng.integers(0, 10**6, 5000)]
    own = [[f"d{k}_{i}" for i in range(60)] for k in range(6)]
    rows = [(k, " ".join(own[k] + shared[a:b] + own[k][:5])) for k, (a, b) in enumerate([(0, 5000), (0, 5000), (1000, 4000), (4970, 5000), (2000, 2035), (100, 134)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = substring.mark_repeats(df, 35, shard_words=700).select(F.col("rest")["doc_id"].alias("doc_id"), "spans")
    got = {r["doc_id"]: substring.merged(r["spans"]) for r in marked.collect()}
    assert got == {0: [(60, 5060)], 1: [(60, 5060)], 2: [(60, 3060)], 3: [], 4: [(60, 95)], 5: []}


def test_whole_texts_that_stay_are_written_small(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 400)) for _ in range(30)]
    df = spark.createDataFrame([(k, t + " " + texts[0]) for k, t in enumerate(texts)], "doc_id long, text string")
    made, write = [], substring.written
    monkeypatch.setattr(substring, "written", lambda table, *codec: made.append(write(table, *codec)) or made[-1])
    assert substring.remove_repeats(df).count() == 30
    files = [f for t in made if "text" in t.columns for f in t.inputFiles()]
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_bit_planes_abandon_columns():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    queries_ = values[:5] ^ np.uint64(0b101)
    got = simhash.sliced_matches(queries_, simhash.bit_planes(values), len(values), 3)
    assert (got == (np.bitwise_count(queries_[:, None] ^ values[None]) <= 3)).all() and got.any()
    other = values ^ np.where(rng.random(1000) < 0.1, np.uint64(1 << 63), rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (simhash.sliced_pairs(values, other, 3) == (np.bitwise_count(values ^ other) <= 3)).all()


def test_near_copies_of_rows_alike_in_name(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z"), (None, "other", "z"), (3, None, None), (4, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = near_copies.keep_one_each(df)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(["Row(doc_id=1, text='a b c d e f', k='x')", "Row(doc_id=None, text='other', k='z')", "Row(doc_id=3, text=None, k=None)"])


def test_a_group_of_similar_texts_makes_few_pairs(spark, monkeypatch):
    """Sixty texts of one base, each with words of its own at three places: they share rare shingles, but no two reach the similarity."""
    texts = []
    for i in range(60):
        words = [f"w{k}" for k in range(100)]
        for j in (5, 38, 71):
            words[j + i % 20] = f"own{i}x{j}"
        texts.append(" ".join(words))
    rows, compared = [*enumerate(texts), (100, texts[7] + " more"), (101, texts[9] + " end of it")], near_copies.linked
    made = []
    monkeypatch.setattr(near_copies, "linked", lambda pairs, *rest: made.append(pairs.count()) or compared(pairs, *rest))
    got = near_copies.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(60))
    assert sum(made) < 200


def test_links_that_sketches_leave_open_are_found_without_pairs_as_rows(spark, monkeypatch):
    """Copies of three bases, some just above and some just below the similarity, in blocks of a few nodes and by sketches that tell nothing: the
    components are those of all pairs, and no join makes pairs."""
    rng, texts = np.random.default_rng(6), []
    for base in range(3):
        words = [f"b{base}w{k}" for k in range(120)]
        for i in range(40):
            own = list(words)
            for at in rng.choice(120, 1 + i % 5, replace=False):
                own[at] = f"own{base}x{i}x{at}"
            texts.append(" ".join(own))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = sorted({root(i) for i in range(len(texts))})
    df, met, made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), near_copies.met, []
    monkeypatch.setattr(near_copies, "BLOCK", 7)

    def counted(*args, **kind):
        got = met(*args, **kind)
        made.append(got.count())
        return got

    monkeypatch.setattr(near_copies, "met", counted)
    assert sorted(r["doc_id"] for r in near_copies.keep_one_each(df).collect()) == want and 3 < len(want) < 100
    # the sets decide alone if neither fingerprints nor sketches have linked anything
    monkeypatch.setattr(near_copies, "linked", lambda pairs, *rest: pairs.limit(0))
    made.clear()
    assert sorted(r["doc_id"] for r in near_copies.keep_one_each(df).collect()) == want
    assert made[-1] > 0


def test_folded_sketches_are_those_of_fewer_cells():
    rng = np.random.default_rng(7)
    found = np.unique(rng.integers(0, 2**64, 1500, dtype=np.uint64))
    sketch = near_copies.sketch_of(found)
    other = near_copies.sketch_of(found[5:])
    assert len(near_copies.sketch_of(found[:512])) == 8 and len(near_copies.sketch_of(found[:513])) == 16 and len(sketch) == 32
    assert all(np.bitwise_count((a ^ b).view(np.uint64)).sum() <= 5 for a, b in ((sketch, other), (near_copies.folded(sketch), near_copies.folded(other))))
    assert near_copies.similar(found, found[300:]) and not near_copies.similar(found, found[301:])


def test_language_model_beats_the_base_on_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_model.score_held_out(df).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert r["score"] > 0.98 * r["base"]


def test_listed_words_are_whole_steps_of_counts(spark):
    counts = spark.createDataFrame([(i, c) for i, c in enumerate([1] * 50 + [2] * 20 + [7] * 5 + [1000])], "h long, c long")
    assert len(language_model.listed_words(counts, 100)) == 76
    assert language_model.listed_words(counts, 30)["c"].tolist() == [1000] + [7] * 5 + [2] * 20
    assert language_model.listed_words(counts, 25)["c"].tolist() == [1000] + [7] * 5
    assert len(language_model.listed_words(counts.limit(0), 25)) == 0


def test_quality_bands_by_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = [(-1, "".join(chr(0x10900 + i % 60) for i in range(400)) + " a" * 3 + " bcd efg hij kl mno pq rs", "en"), (-2, " ".join("ab"[i % 2] + "xyz"[i % 3] * 3 for i in range(400)), "en"), (-3, None, None), (-4, "short text of few words", "xx")]
    df = df.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(noise, "doc_id long, text string, lang string"))
    figures = fertility.measure(df, public_tokenizers.path(queries.PIECE_MODEL), public_tokenizers.path(queries.BYTE_RANKS))
    rows = figures.collect()
    bands = fertility.Bands()
    lower = lambda values: sorted(values)[(len(values) + 1) // 2 - 1]
    groups = defaultdict(list)
    for r in rows:
        if r["n_tokens"] >= bands.min_tokens:
            groups[r["lang"] or ""].append(r)
    whole = [r for g in groups.values() for r in g]
    share = lambda c, p: sorted(x[c] for x in whole)[max(0, math.ceil(p * len(whole)) - 1)]
    want = {}
    for r in rows:
        group = groups[r["lang"] or ""]
        wider = math.sqrt(1 + bands.short_tokens / max(1, r["n_tokens"]))
        mid = {c: lower([x[c] for x in group]) for c in fertility.JUDGED} if len(group) >= bands.min_rows else None
        room = lambda c, least: bands.width * max(lower([abs(x[c] - mid[c]) for x in group]), least) * wider  # noqa: B023, E731
        ok = not (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        ok = ok and r["byte_share"] <= (mid["byte_share"] + room("byte_share", bands.least_share) if mid else bands.max_byte_share)
        if ok and r["n_tokens"] >= bands.min_tokens:
            ok = r["entropy"] >= (mid["entropy"] - room("entropy", bands.least_entropy) if mid else bands.min_entropy)
            ok = ok and any(abs(r[c] - mid[c]) <= room(c, bands.least_chars) if mid else share(c, 0.01) / 2 <= r[c] <= 2 * share(c, 0.99) for c in fertility.CHARS)
        want[r["doc_id"]] = ok
    got = {r["doc_id"]: r["kept"] for r in fertility.judge(figures).collect()}
    assert got == want and not got[-1] and not got[-2] and sum(got.values()) > 0.5 * len(got)


def test_sharding_keeps_groups_together(spark):
    rng = np.random.default_rng(2)
    rows = [(k, f"text of its own {k}") for k in range(3000)]
    for g, n in enumerate([2] * 120 + [10] * 30 + [200, 300, 1500]):
        rows += [(len(rows) + i, f"group {g}") for i in range(n)]
    rows += [(5, "group 150")] * 7
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string")
    got = sharding.shard_documents(df).select("text_crc32", "shard", "slot").collect()
    shards = defaultdict(Counter)
    for r in got:
        shards[r["text_crc32"]][r["shard"]] += 1
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len({(r["shard"], r["slot"]) for r in got}) == len(rows)
    groups = [c for c in shards.values() if sum(c.values()) > 1]
    pairs = lambda n: n * (n - 1) // 2
    small = [c for c in groups if sum(c.values()) <= len(rows) // 8]
    cut = sum(pairs(sum(c.values())) - sum(map(pairs, c.values())) for c in small)
    at_random = sum(pairs(sum(c.values())) for c in small) * 7 / 8
    assert cut < 0.1 * at_random and sum(len(c) == 1 for c in small) > 0.9 * len(small)


def test_sharding_moves_hot_groups(spark, monkeypatch):
    rows = [(k, f"text of its own {k}") for k in range(3000)]
    for g, n in enumerate([10] * 100 + [300, 320]):
        rows += [(len(rows) + i, f"group {g}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(sharding.shard_documents(df).collect())  # all groups by join
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    placed, total = sharding._group_parts(df, 8)
    moves = sharding.propagate(placed, total, 8)
    assert moves.where("n > 20").count() and moves.where("n <= 20").count()  # hot ones and others
    assert sorted(sharding.shard_documents(df).collect()) == want


def test_chat_rows_that_tie_stay_turns(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b <turn>"), (1, None, "system", None), (None, 1, None, "x" * 10001), (None, 1, "user", ""), (2, 5, "assistant", "é𝄞")]
    schema = "conv_id long, turn int, role string, text string, kind string, seq long"
    spark.createDataFrame([(*r, "edit", 3) for r in rows], schema).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op5_chat_format(spark, str(tmp_path)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 4, None: 2, 2: 1, -7: 2}
    said = "".join(f"{r}\n{t}\n" for r, t in [("system", ""), ("assistant", "b <turn>"), ("user", "a"), ("user", "a")])
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["loss_chars"] == 8
    assert got[2]["loss_sha256"] == hashlib.sha256("é𝄞".encode()).hexdigest() and got[2]["loss_chars"] == 2
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, copy long")
    assert chat_format.format_conversations(chat_format.streamed(empty)).count() == 0


def test_viterbi_by_brute_force_and_mixed_spans(spark):
    english, german = "the house of the old man and the sea with many boats", "das haus ist sehr groß und der garten liegt hinter dem wald"
    russian = "старый дом стоит у моря и над ним летают птицы"
    model = language_id.learn(spark.createDataFrame([(english, "en"), (german, "de"), (russian, "ru")] * 3, "text string, lang string"))
    labeller = language_id.Labeller(model)
    for text in ("the house das haus the", "und der the garten sea", "дом the дом man", "a", "the 123 haus"):
        words = text.split()
        labels, _, _ = labeller.label([words])
        scores = [labeller.scores[labeller.index[w]] for w in words]
        cost = lambda path: sum(s[p] for s, p in zip(scores, path, strict=True)) - language_id.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max(cost(p) for p in product(range(3), repeat=len(words)))
        assert cost(labels.tolist()) == pytest.approx(best, abs=1e-3), text
    (lang, score, spans), other, thai = labeller.predict([f"{english} {russian} {german}", "123 !?", "ภาษาไทย"])
    assert [s[0] for s in spans] == ["en", "ru", "de"] and [s[1] for s in spans] == [12, 10, 12]
    assert lang in ("de", "en") and 0.3 < score < 0.5 and other == ("und", 0.0, []) and thai[1] == 0.0


def test_html_paths_decide():
    for wrapper in ("<div>{}</div>", '<div class="overflow-hidden">{}</div>', '<div class="has-sidebar">{}</div>', "<form>{}</form>", "<article>{}</article>", "{}"):
        page = "<body><nav><ul><li><a>Home</a><li><a>About</a></ul></nav>" + wrapper.format(f"<h1>The head</h1>{SENTENCES}<p>End.</p>") + "<footer>Contact us. Call, or write.</footer></body>"
        assert html_text.main_text(page).split("\n\n")[::5] == ["The head", "End."], wrapper
    page = f'<body><article><h2 id="market-share">Market share</h2>{SENTENCES}</article><section class="comments"><p>First! I, too, have a comment to make. Yes.</p></section></body>'
    assert html_text.main_text(page).startswith("Market share\n\n") and "comment" not in html_text.main_text(page)
    assert html_text.main_text("<body><nav><ul><li>Home<li>About us, and more.</ul></nav><footer>Call, or write.</footer></body>") == ""


def test_html_ratios_by_brute_force():
    read = html_text.Page(f"<body><div class=ad>Buy now.</div><div>{SENTENCES}<table><tr><td>1<td>2, 3</table></div></body>")
    by_path = defaultdict(list)
    for b in read.blocks:
        path, e = [], b.element
        while e is not None:
            path += [e.tag] * (e.tag not in html_text.INLINE)
            e = e.parent
        by_path[tuple(path), b.element.factor].append(b)
    ratios = html_text.path_ratios(read.blocks)
    for blocks in by_path.values():
        chars, marks = (sum(len(f(b)) for b in blocks) / len(blocks) for f in (lambda b: b.text, lambda b: [c for c in b.text if c in ".,;:!?"]))
        for b in blocks:
            assert ratios[read.blocks.index(b)].tolist() == [chars, marks]
    assert len(by_path) == 3


def test_html_mask_decides(monkeypatch):
    page = f"<body><nav>Menu, home.</nav><div>{SENTENCES}</div></body>"
    before = html_text.main_text(page)
    monkeypatch.setattr(html_text, "content_mask", lambda blocks: np.ones(len(blocks), bool))
    assert html_text.main_text(page) != before


def test_html_odd_pages(spark):
    deep = "<div>" * 10_000 + SENTENCES
    assert html_text.main_text(deep).count("Sentence") == 4
    assert html_text.main_text(f"<p>{'Long text, with marks. ' * 20_000}").count("Long") == 20_000
    assert html_text.main_text(f"<p>unclosed &amp; cut &am {SENTENCES}").startswith("unclosed & cut &am")
    df = spark.createDataFrame([(1, None, deep, "t"), (1, None, deep, "t"), (None, "u", "<!-- ", "t"), (2, "u", "<<<>>> < p", "t")], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == 4 and [r["n_chars"] for r in got if r["page_id"] == 1] == [len(html_text.main_text(deep))] * 2


def test_short_items_are_listed(spark):
    items = spark.createDataFrame([(1, "too short"), (2, " ".join("abcdefghij")), (3, None)], "item_id long, text string")
    assert sorted(map(tuple, decontamination.short_items(items).collect())) == [(1, 2), (3, 0)]


def test_decontamination_of_repeated_words(spark):
    item = ["same"] * 40 + [f"t{i}" for i in range(20)]
    rows = [(1, " ".join(["same"] * 3000)), (2, " ".join(item[45:])), (3, " ".join(item[35:55])), (3, " ".join(item[35:55]))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, off string")
    got = decontamination.decontaminate(df, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["contaminated"], r["overlap"]) for r in got) == [(1, True, 13), (2, True, 13), (3, True, 13), (3, True, 13)]
