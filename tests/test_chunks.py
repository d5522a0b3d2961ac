"""Chunkers against plain loops: nulls, blanks, long lines, long texts; bootstrap means against their draws."""

import random

import pytest
from pyspark.sql import functions as F

from chartmill.operators import chunks as K
from chartmill.operators import runs as R


def loop_lines(text, most, overlap):
    lines, out, a = (text or "").splitlines(), [], 0
    while a < len(lines):
        b, held = a, 0
        while b < len(lines) and (b == a or held + len(lines[b]) + 1 <= most):
            held += len(lines[b]) + 1
            b += 1
        said = "\n".join(lines[a:b]).strip()
        if said:
            out.append((a + 1, b, said))
        if b == len(lines):
            break
        a = max(b - overlap, a + 1)
    return out


def loop_sentences(text, most, least):
    import re

    text = " ".join((text or "").split())
    chunks, now = [], ""
    for part in re.split(K.SENTENCE_END, text) if text else []:
        if now and len(now) + len(part) + 1 <= most:
            now += " " + part
        else:
            chunks.append(now)
            now = part[:most]
    chunks = [c for c in [*chunks, now] if len(c) >= least]
    return chunks or ([text[:most]] if len(text) >= least else [])


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    some = ["\n".join("x" * rnd.choice([0, 3, 9, 20, 70]) for _ in range(rnd.randrange(40))) for _ in range(25)]
    said = [" ".join(rnd.choice(["Ab cd. ", "ef", "Gh. Ij", "kl mno.", "Я. ", "end.\n\nNext"]) for _ in range(rnd.randrange(90))) for _ in range(25)]
    return [None, "", "\n", "\n\n  \n", "a", "a\r\nb\rc\x0bd\n", "z" * 300, " lead\n\n\ntrail \n", *some, *said]


@pytest.mark.parametrize("most,overlap", [(40, 3), (80, 20), (10, 1), (25, 6)])
def test_line_chunks(spark, texts, most, overlap):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    for r in df.select("k", "text", K.line_chunks(F.col("text"), most, overlap).alias("c")).collect():
        assert [tuple(c) for c in r["c"]] == loop_lines(r["text"], most, overlap), r["text"]


@pytest.mark.parametrize("most,least", [(30, 10), (60, 1), (200, 100)])
def test_packed_sentences(spark, texts, most, least):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    for r in df.select("k", "text", K.packed(F.col("text"), most, least).alias("c")).collect():
        assert r["c"] == loop_sentences(r["text"], most, least), r["text"]


def test_sections(spark):
    text = "before\n# One *title*\nfirst `code` line\n[link](http://x) more\n##### deep\n   ## Two  \n\n#### Three\n" + "Sentence here. " * 6
    got = spark.createDataFrame([(text,), (None,)], "text string").select(K.sections(F.col("text"), 40, 5).alias("s")).collect()
    assert got[1]["s"] == [] and [tuple(s) for s in got[0]["s"]] == [("Document overview", "before"), ("One *title*", "first code line link more ##### deep"), *((f"Three #{k}", "Sentence here. Sentence here.") for k in (1, 2, 3))]


def test_a_text_of_ten_megabytes(spark):
    text = "# Head\n" + ("Some words of a sentence that goes on. " * 20 + "\n") * 13_000
    df = spark.createDataFrame([(text,)], "text string")
    sizes = df.select(F.size(K.line_chunks(F.col("text"))).alias("lines"), F.size(K.packed(F.col("text"))).alias("packed"), F.size(K.sections(F.col("text"))).alias("sections")).first()
    assert sizes["lines"] == len(loop_lines(text, K.LINE_MOST, K.OVERLAP)) and sizes["packed"] == len(loop_sentences(text, K.MOST, K.LEAST)) and sizes["sections"] > 8_000


def draw(b, i, n):
    p = R.PRIME
    y = (b * 48271 + i * 40692 + 12345) % p
    for more in (7, b, i):
        y = (y * y + more) % p
    return y % n


def test_bootstrap(spark, monkeypatch):
    values = [0.5, -1.0, 2.25, 3.0, None, 0.125, 7.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    known = [v for v in values if v is not None]
    means = sorted(sum(known[draw(b, i, 6)] for i in range(6)) / 6 for b in range(200))
    want = (round(sum(known) / 6, 6), round(means[int(0.025 * 199)], 6), round(means[int(0.975 * 199)], 6))
    for bound in (R.BROADCAST, 0):
        monkeypatch.setattr(R, "BROADCAST", bound)
        assert tuple(R.bootstrap_interval(df, "v", ["k"], 200).select("mean", "low", "high").first()) == want
    assert tuple(R.bootstrap_interval(df.limit(0), "v", ["k"], 200).first()) == (0, None, None, None)


def test_bootstrap_of_values_in_parts(spark, monkeypatch):
    """Values that no task holds as a whole: rows of two values, parts of three and of four."""
    values = [((7 * k) % 11) / 8 for k in range(23)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double")
    means = sorted(sum(values[draw(b, i, 23)] for i in range(23)) / 23 for b in range(50))
    want = (23, round(sum(values) / 23, 6), round(means[int(0.025 * 49)], 6), round(means[int(0.975 * 49)], 6))
    for part in (3, 4):
        for name, size in (("PACK", 2), ("BROADCAST", part), ("REPLICATES", 7)):
            monkeypatch.setattr(R, name, size)
        assert tuple(R.bootstrap_interval(df, "v", ["k"], 50).first()) == want
