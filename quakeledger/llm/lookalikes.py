"""Text in one form for all that looks the same: widths, ligatures, accents, invisible characters, blanks, look-alike letters.

A batch of Arrow text becomes one array of code points; a lookup table gives each its expansion, marks are put in
canonical order and composed with their letters by array operations, and the result becomes Arrow text again. No text
is handled on its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeledger.operators.skew import split_join
from quakeledger.runtime import checkpoint, written

TABLE_SIZE = 0xE0200
#: Bytes of text worked on at once (about 60 times as many are used for it); a longer text is worked on whole.
PIECE_BYTES = 1_000_000

# Letters of other scripts with the shape of a Latin letter, as drawn in common text faces.
LATIN_SHAPES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ց", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "р", "q": "ԛ",
    "s": "ѕ", "u": "ս", "v": "ѵ", "w": "ԝ", "x": "х", "y": "уү",
}
# Punctuation of one shape.
PUNCTUATION_SHAPES = {"-": "‐‑‒⁃˗−﹣", ".": "․ꓸ", "·": "·∙⋅‧・ᐧ"}
# Characters without ink that are no format characters (variation selectors, fillers, joiners).
INKLESS = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
# Format characters that are drawn.
INKED_FORMATS = [(0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD)]

_S, _L, _V, _T = 0xAC00, 0x1100, 0x1161, 0x11A7  # bases of the composition of Hangul


class ShapeTables:
    """Lookup tables over code points, made by rule from the Unicode database and the fixed values above."""

    def __init__(self):
        letters = {c: to for to, all_ in (LATIN_SHAPES | PUNCTUATION_SHAPES).items() for c in all_}
        within = lambda cp, ranges: any(a <= cp <= b for a, b in ranges)
        self.length = np.ones(TABLE_SIZE, np.uint8)
        self.first = np.arange(TABLE_SIZE, dtype=np.int32)
        self.ccc = np.zeros(TABLE_SIZE, np.uint8)
        self.kept = np.ones(TABLE_SIZE, bool)  # stands for itself
        flat: list[int] = []
        pairs: dict[int, int] = {}
        self.second = np.zeros(TABLE_SIZE, bool)  # without a class, yet composes with what stands before
        for cp in range(TABLE_SIZE):
            ch = chr(cp)
            kind = unicodedata.category(ch)
            if kind in ("Cn", "Cs", "Co"):
                continue
            self.ccc[cp] = unicodedata.combining(ch)
            if kind == "Cf" and not within(cp, INKED_FORMATS) or within(cp, INKLESS):
                to = ""
            elif kind == "Zs" or cp == 0x2800:
                to = " "
            else:
                to = "".join(letters.get(c, c) for c in self._expanded(ch))
            if to != ch:
                self.kept[cp] = False
                self.length[cp], self.first[cp] = len(to), len(flat)
                flat += map(ord, to)
            parts = unicodedata.decomposition(ch)
            if parts and parts[0] != "<" and " " in parts and not 0xAC00 <= cp <= 0xD7A3:
                a, b = (int(x, 16) for x in parts.split())
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == ch:
                    pairs[a << 21 | b] = cp
                    self.second[b] |= unicodedata.combining(chr(b)) == 0
        self.second[_V : _V + 21] = True
        self.second[_T + 1 : _T + 28] = True
        self.flat = np.array(flat, np.int32)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in sorted(pairs)], np.int32)

    @staticmethod
    def _expanded(ch: str) -> str:
        """Width forms, ligature glyphs, roman numerals and the micro sign as plain letters; then all decomposed canonically."""
        parts = unicodedata.decomposition(ch)
        tag = parts.split(" ")[0] if parts.startswith("<") else ""
        name = unicodedata.name(ch, "")
        if tag in ("<wide>", "<narrow>") or tag == "<compat>" and ("LIGATURE" in name or "ROMAN NUMERAL" in name or ch == "µ"):
            return "".join(ShapeTables._expanded(chr(int(x, 16))) for x in parts.split(" ")[1:])
        if "가" <= ch <= "힣":
            return ch
        return unicodedata.normalize("NFD", ch)

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What a followed by b composes to; -1 where nothing."""
        keys = a.astype(np.int64) << 21 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        out = np.where(self.pair_keys[at] == keys, self.pair_values[at], -1)
        lv = (a >= _L) & (a < _L + 19) & (b >= _V) & (b < _V + 21)
        out = np.where(lv, _S + ((a - _L) * 21 + (b - _V)) * 28, out)
        lvt = (a >= _S) & (a <= 0xD7A3) & ((a - _S) % 28 == 0) & (b > _T) & (b < _T + 28)
        return np.where(lvt, a + b - _T, out)


@lru_cache(maxsize=1)
def shape_tables() -> ShapeTables:
    return ShapeTables()


def one_form(cps: np.ndarray, rows: np.ndarray, tables: ShapeTables) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets) in one form, from code points and row offsets (one more than rows)."""
    low = np.minimum(cps, TABLE_SIZE - 1)
    high = cps >= TABLE_SIZE
    length = np.where(high, 1, tables.length[low]).astype(np.int64)
    kept = high | tables.kept[low]
    starts = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(starts[-1], np.int32)
    out[starts[:-1][kept]] = cps[kept]
    changed = np.nonzero(~kept)[0]
    n = length[changed]
    if n.sum():
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(starts[changed], n) + within] = tables.flat[np.repeat(tables.first[cps[changed]], n) + within]
    rows = starts[rows]
    if not len(out):
        return out, rows
    capped = np.minimum(out, TABLE_SIZE - 1)
    ccc = np.where(out >= TABLE_SIZE, 0, tables.ccc[capped])
    tail = (ccc > 0) | (tables.second[capped] & (out < TABLE_SIZE))  # may join what stands before it
    tail[rows[:-1][rows[:-1] < len(out)]] = False
    if not tail.any():
        return out, rows
    # Canonical order: only letters whose marks stand out of order are sorted, with whatever stands between by itself.
    wrong = np.nonzero((ccc[:-1] > ccc[1:]) & (ccc[1:] > 0) & tail[1:])[0]
    if len(wrong):
        block = np.cumsum((ccc == 0) | ~tail)
        hit = np.zeros(block[-1] + 1, bool)
        hit[block[wrong + 1]] = True
        at = np.nonzero(hit[block])[0]
        order = np.lexsort((ccc[at], block[at]))
        out[at], ccc[at] = out[at][order], ccc[at][order]
    heads = np.nonzero(~tail)[0]
    alive = np.ones(len(out), bool)
    sizes = np.diff(np.append(heads, len(out)))
    live = np.nonzero(sizes > 1)[0]
    base, last = heads.copy(), np.where(ccc[heads] > 0, 255, 0).astype(np.int16)
    k = 1
    while len(live):
        i, s = heads[live] + k, base[live]
        c, before = ccc[i].astype(np.int16), last[live]
        made = tables.compose(out[s], out[i])
        joins = (made >= 0) & (ccc[s] == 0) & ((before == 0) | ((before < c) & (before < 255)))
        out[s[joins]] = made[joins]
        alive[i[joins]] = False
        plain = ~joins & (c == 0)
        base[live[plain]] = i[plain]
        last[live[~joins]] = c[~joins]
        k += 1
        live = live[sizes[live] > k]
    gone = np.concatenate([[0], np.cumsum(~alive)])
    return out[alive], rows - gone[rows]


def normalise_arrow(text: pa.Array, tables: ShapeTables, piece_bytes: int = PIECE_BYTES) -> pa.Array:
    """Arrow text in one form; nulls stay null and empty texts empty. Worked through in pieces of whole texts."""
    text = text.cast(pa.large_string())
    if not len(text):
        return text
    ends = np.frombuffer(text.buffers()[1], np.int64, count=len(text) + 1, offset=8 * text.offset)
    if ends[-1] - ends[0] > piece_bytes and len(text) > 1:
        pieces, at = [], 0
        while at < len(text):
            cut = max(at + 1, int(np.searchsorted(ends, ends[at] + piece_bytes, side="right")) - 1)
            pieces.append(_normalise_piece(text.slice(at, cut - at), tables))
            at = cut
        return pa.concat_arrays(pieces)
    return _normalise_piece(text, tables)


def _normalise_piece(text: pa.Array, tables: ShapeTables) -> pa.Array:
    offsets = np.frombuffer(text.buffers()[1], np.int64, count=len(text) + 1, offset=8 * text.offset)
    a, b = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(text.buffers()[2], np.uint8, count=b)[a:b] if text.buffers()[2] is not None and b > a else np.zeros(0, np.uint8)
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.int32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    cps, rows = one_form(cps, before[offsets - a], tables)
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])[rows].astype(np.int64)
    valid = pa.array(~np.asarray(text.is_null())).buffers()[1] if text.null_count else None
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(ends.tobytes()), pa.py_buffer(data), valid, text.null_count)


def with_one_form(docs: DataFrame, text: str, out: str, keep: tuple[str, ...]) -> DataFrame:
    """keep + text + out, the text in one form. Whole texts; nulls stay null. One narrow pass."""
    if out in (text, *keep):
        raise ValueError(f"column {out} is named twice")
    tables = docs.sparkSession.sparkContext.broadcast(shape_tables())  # about 7 MB, whatever the data's size
    got = docs.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form = normalise_arrow(b.column(b.schema.get_field_index(text)), tables.value).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, form], [*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in got.schema) + f", `{out}` string"
    return got.mapInArrow(run, schema)


def lookalike_pairs(docs: DataFrame, key: str, text: str, part_rows: int = 4_000) -> DataFrame:
    """(doc_id_a < doc_id_b) of non-empty texts that differ in their characters but have one form, each pair once.

    Texts are represented by 128-bit digests, which are written once; no text is shuffled. Spellings are paired first:
    only forms with at least two take part, and texts of one spelling, however many, are never compared. Then each
    spelling's texts join its pairs. All joins split what has more than ``part_rows`` rows, so that a spelling with a
    third of all texts spreads over many tasks. Identical texts are no pair; null and empty texts take no part; an empty table gives an empty result.
    """
    form = with_one_form(docs.where((F.col(text) != "") & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")), "text", "form", ("id",))
    rows = written(form.select("id", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("raw")))
    several = rows.groupBy("form").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low < high").select("form")
    members = checkpoint(rows.join(several, "form").dropDuplicates())
    spellings = members.select("form", "raw").distinct()
    other = spellings.select("form", F.col("raw").alias("raw_b"))
    pairs = checkpoint(split_join(spellings, other, ["form"], "raw", part_rows).where("raw < raw_b").select("raw", "raw_b"))
    left = split_join(members.select("raw", "id"), pairs, ["raw"], "id", part_rows).select("id", "raw_b")
    right = members.select(F.col("raw").alias("raw_b"), F.col("id").alias("id_b"))
    near = split_join(left, right, ["raw_b"], "id", part_rows)
    return near.select(F.least("id", "id_b").alias("doc_id_a"), F.greatest("id", "id_b").alias("doc_id_b"))
