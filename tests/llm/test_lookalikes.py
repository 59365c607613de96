import random
import unicodedata

import pyarrow as pa

from quakeledger.llm.lookalikes import INKED_FORMATS, INKLESS, LATIN_SHAPES, PUNCTUATION_SHAPES, ShapeTables, lookalike_pairs, normalise_arrow, shape_tables, with_one_form


def slow(text):
    """The same form, one character after the other, composed by the standard library."""
    letters = {c: to for to, all_ in (LATIN_SHAPES | PUNCTUATION_SHAPES).items() for c in all_}
    within = lambda cp, ranges: any(a <= cp <= b for a, b in ranges)
    out = []
    for ch in text:
        cp, kind = ord(ch), unicodedata.category(ch)
        if kind in ("Cn", "Cs", "Co"):
            out.append(ch)
        elif kind == "Cf" and not within(cp, INKED_FORMATS) or within(cp, INKLESS):
            pass
        elif kind == "Zs" or cp == 0x2800:
            out.append(" ")
        else:
            out.append("".join(letters.get(c, c) for c in ShapeTables._expanded(ch)))
    return unicodedata.normalize("NFC", "".join(out))


POOL = [0x41, 0x65, 0x300, 0x301, 0x308, 0x323, 0x327, 0x345, 0x1100, 0x1161, 0x11A8, 0xAC00, 0xAC01, 0x30AB, 0x3099, 0xFF76, 0xFF9E, 0x9C7, 0x9BE, 0xFB01, 0x2126, 0x212B, 0x1E69, 0x5D0, 0x5B0, 0x200B, 0xA0, 0x1F600, 0x2F800, 0x430, 0x451, 0x439, 0x1D15E, 0xE0101, 0x344, 0x390, 0x10FFFD, 0x0A]


def test_equals_the_slow_version():
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice(POOL)) for _ in range(rng.randrange(0, 9))) for _ in range(20_000)]
    assert normalise_arrow(pa.array(texts), shape_tables()).to_pylist() == [slow(t) for t in texts]
    assert normalise_arrow(pa.array(texts), shape_tables(), piece_bytes=50).to_pylist() == [slow(t) for t in texts]
    marks = "a" + "̣́" * 3000
    assert normalise_arrow(pa.array([marks, None, "", "​"]), shape_tables()).to_pylist() == [slow(marks), None, "", ""]


def test_form_is_stable():
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice(POOL)) for _ in range(6)) for _ in range(3000)]
    once = normalise_arrow(pa.array(texts), shape_tables())
    assert normalise_arrow(once, shape_tables()).to_pylist() == once.to_pylist()


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["café x", "café x", "cafe x", "ｃａｆé x", "саfé x", "café x", "café  x", "CAFÉ x", "x²", "x2", "", None, "ﬁne", "fine", "fi​ne", "​", "‌"]
    docs = [(i, rng.choice(base)) for i in range(300)]
    form = {i: slow(t) for i, t in docs if t}
    text = dict(docs)
    want = {(a, b) for a in form for b in form if a < b and form[a] == form[b] and text[a] != text[b]}
    df = spark.createDataFrame([(i, t, "z") for i, t in docs] + [(None, "fine", "z"), (0, docs[0][1], "z")], "doc_id long, text string, form string")
    for part in (2_000, 7):
        got = [tuple(r) for r in lookalike_pairs(df, "doc_id", "text", part_rows=part).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0
    assert with_one_form(df.limit(0), "text", "f", ("doc_id",)).count() == 0
