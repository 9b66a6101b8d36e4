"""Visually identical text with different characters: one stored form per printed form.

Each token gets the *resolved script set*: the scripts that can spell every one of its printed letter shapes, that is the
intersection over its letters of the scripts in which the shape exists. Scripts are the Unicode script (extension) property, with
the sets that writing systems of several scripts need (Japanese, Korean, Han with Bopomofo). Shapes come from the public table of
confusables that ships with Spark's Unicode library, read as data: letters of one case and one prototype that is a letter of ASCII.
The table also lists letters that are merely similar, so letters of running Greek and Cyrillic text take part only where they are
listed here, and other Latin letters never.

A token whose stored letters come from several scripts although one script could spell it is a mixed-script confusable; a
token that several scripts can spell is a whole-script confusable. The token is rewritten in its only script, or, if several
can spell it, in the script that the document's unambiguous tokens use most (Latin, Greek, Cyrillic, then by name on ties). Where no
script spells the token, each run of letters of one preference keeps its own script. Every choice depends on printed shapes
alone, never on the stored characters, so two texts that print alike get the same form.

The remaining forms are normalised by Unicode rules: canonical composition, full- and half-width forms, no-break and
sized blanks, ligatures and letter numerals, hyphen and apostrophe variants; characters that print nothing are removed.
Superscripts, circled or squared signs and the like print differently and stay.
"""

from __future__ import annotations

import glob
import hashlib
import os
import re
import struct
import unicodedata
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyspark
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.session import cut

# Letters of the three scripts that share a printed shape, in the order Latin, Greek, Cyrillic ("." where
# a script has no such letter). Of the letters of running Greek and Cyrillic text only these print as another script's.
SHAPES = """
AΑА BΒВ C.С EΕЕ HΗН IΙІ J.Ј KΚК MΜМ NΝ. OΟО PΡР S.Ѕ TΤТ XΧХ YΥҮ ZΖ.
a.а c.с e.е i.і j.ј oοо p.р s.ѕ vν. x.х y.у
.ΓГ .ΠП .ΦФ
"""
#: Running Greek and Cyrillic letters. Blocks of the standard.
RUNNING = re.compile("[\u0386-\u03ce\u0400-\u045f]")
#: Letters that the table of confusables lists though they print differently. Fixed values.
UNLIKE = set("ҽѡӏꙇүϱϒϐϰᴦᴨᴩᴧ")
PREFERRED = ("LATIN", "GREEK", "CYRILLIC")
#: Writing systems of several scripts.
SYSTEMS = {"JAPANESE": ("HAN", "HIRAGANA", "KATAKANA"), "KOREAN": ("HAN", "HANGUL"), "HAN WITH BOPOMOFO": ("HAN", "BOPOMOFO")}


def confusables(jar: str | None = None) -> dict[str, str]:
    """Character -> prototype, from the table in Spark's Unicode library (its binary form: sorted keys, per key a character or a place in a string table)."""
    homes = [os.path.join(os.path.dirname(pyspark.__file__), "jars"), os.path.join(os.environ.get("SPARK_HOME", ""), "jars")]
    found = [jar] if jar else [f for h in homes for f in sorted(glob.glob(os.path.join(h, "icu4j-*.jar")))]
    if not found:
        raise FileNotFoundError("no icu4j-*.jar beside Spark, which holds the table of confusables")
    with zipfile.ZipFile(found[0]) as z:
        data = z.read(next(n for n in z.namelist() if n.endswith("/confusables.cfu")))
    data = data[struct.unpack_from(">H", data)[0] :]
    keys_at, n, index_at, _, text_at, _ = struct.unpack_from(">6i", data, 12)
    out = {}
    for key, where in zip(struct.unpack_from(f">{n}i", data, keys_at), struct.unpack_from(f">{n}H", data, index_at)):
        long = (key >> 24 & 0xFF) + 1
        units = data[text_at + 2 * where : text_at + 2 * (where + long)] if long > 1 else struct.pack(">H", where)
        out[chr(key & 0xFFFFFF)] = units.decode("utf-16-be", "surrogatepass")
    return out


def _script_names() -> list[str]:
    """Long names (codes have four letters)."""
    names: dict[int, list[str]] = {}
    for name, i in regex._regex_core.PROPERTIES["SCRIPT"][1].items():
        names.setdefault(i, []).append(name)
    return sorted({min(x, key=lambda k: (len(k) == 4, -len(k), k)) for x in names.values()} - {"UNKNOWN"})


_NAMES = _script_names()
_SCRIPT = regex.compile("|".join(f"(?P<{n}>\\p{{Script={n}}})" for n in _NAMES))


def _property(ch: str) -> frozenset[str]:
    """Scripts of a letter by its script (extension) property, with the writing systems these belong to; empty for letters of all scripts."""
    m = _SCRIPT.match(ch)
    own = {m.lastgroup} if m else set()
    if own & {"COMMON", "INHERITED"}:
        own = {n for n in _NAMES if regex.match(f"\\p{{Script_Extensions={n}}}", ch)} - {"COMMON", "INHERITED"}
    return frozenset(own | {k for k, v in SYSTEMS.items() if own & set(v)})


@lru_cache(maxsize=1)
def shapes() -> dict[str, dict[str, str]]:
    """Character -> its shape: script -> the letter by which that script spells it."""
    out: dict[str, dict[str, str]] = {}
    for row in SHAPES.split():
        shape = {s: c for s, c in zip(PREFERRED, row) if c != "."}
        out |= dict.fromkeys(shape.values(), shape)
    for ch, proto in sorted(confusables().items()):
        kind = unicodedata.category(ch)
        upper = kind == "Lu" or (kind == "Lo" and "A" <= proto <= "Z")
        if not (upper or kind == "Ll") or ch in UNLIKE or RUNNING.match(ch) or unicodedata.decomposition(ch)[:1] not in ("", "<"):
            continue
        latin = "I" if upper and proto == "l" else proto
        if not (len(latin) == 1 and latin.isascii() and latin.isalpha() and latin.isupper() == upper):
            continue
        own = _property(ch)
        if not own or "LATIN" in own:
            continue
        shape = out.setdefault(latin, {"LATIN": latin})
        if own & {"GREEK", "CYRILLIC"}:
            out[ch] = shape  # no running text spells words with it: read as what it looks like
        elif (name := min(own)) not in shape:
            shape[name] = ch
            out[ch] = shape
    return out


INVISIBLE = {"Cf", "Cc", "Cs", "Co", "Cn"}
LINE_BREAKS = re.compile("\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
#: Hyphen variants that print as the hyphen-minus, and the letter that prints as the closing quotation mark. Fixed values.
HYPHENS = {"\u2010": "-", "\u2011": "-", "\ufe63": "-", "\u00ad": "", "\u02bc": "\u2019"}
#: Marks without a shape of their own. Grapheme joiner, Hangul fillers, variation selectors.
UNPRINTED = {*"\u034f\u115f\u1160\u3164\uffa0\u17b4\u17b5", *map(chr, range(0xFE00, 0xFE10)), *map(chr, range(0x180B, 0x1810))}
TAGS = ("<wide>", "<narrow>", "<noBreak>")


def _plain(ch: str) -> str:
    """Printed equivalent of one character, decomposed; '' if it prints nothing, ' ' for any blank."""
    if ch == "\n":
        return ch
    if ch in HYPHENS:
        return HYPHENS[ch]
    cat = unicodedata.category(ch)
    if ch == "\t" or cat == "Zs":
        return " "
    if cat in INVISIBLE or ch in UNPRINTED:
        return ""
    rule = unicodedata.decomposition(ch)
    if rule.startswith("<") and ch in shapes():
        return ch
    if rule.startswith("<"):
        tag, *codes = rule.split()
        to = "".join(chr(int(c, 16)) for c in codes)
        letters = tag == "<compat>" and all(unicodedata.category(c)[0] == "L" for c in to)
        if tag in TAGS or letters:
            return "".join(map(_plain, to))
        return ch
    return "".join(c if c == ch else _plain(c) for c in unicodedata.normalize("NFD", ch))


class _Memo(dict):
    """Values of single characters, found once."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key):
        value = self[key] = self.of(key)
        return value


#: Printed equivalents by code point, for ``str.translate``.
_PLAIN = _Memo(lambda code: _plain(chr(code)))


def _letter(ch: str) -> frozenset[str] | None:
    """Scripts that have a letter of this shape; None for what belongs to no script, or to all."""
    if not ch.isalpha():
        return None
    shape = shapes().get(ch)
    return frozenset(shape) if shape else _property(ch) or None


_LETTER = _Memo(_letter)
#: Whether a letter is of a script other than Latin that shares shapes with it: without any, every token is spelled as it is stored.
_FOREIGN = _Memo(lambda ch: ord(ch) > 127 and bool((_LETTER[ch] or frozenset()) & _sharing()))


@lru_cache(maxsize=1)
def _sharing() -> frozenset[str]:
    return frozenset(s for shape in shapes().values() for s in shape) - {"LATIN"}


WORD = re.compile("\\w(?:\\w|[\u0300-\u036f])*")
ASCII = re.compile(r"[\n -~]*\Z")
BLANKS = re.compile(" +")


def _rank(script: str) -> tuple[int, str]:
    return (PREFERRED.index(script) if script in PREFERRED else len(PREFERRED), script)


@lru_cache(maxsize=1 << 18)
def resolved(token: str) -> tuple[str, ...] | None:
    """Resolved script set of a decomposed token, in preference order; () if no script spells it; None without letters of a script."""
    left: frozenset[str] | None = None
    for ch in token:
        s = _LETTER[ch]
        if s is not None:
            left = s if left is None else left & s
    return None if left is None else tuple(sorted(left, key=_rank))


@lru_cache(maxsize=1 << 18)
def _spell(token: str, script: str) -> str:
    """The token's shapes in one script; per letter the first script in preference order where that fails."""
    out = []
    for c in token:
        shape = shapes().get(c)
        out.append(c if shape is None else shape.get(script) or shape[min(shape, key=_rank)])
    return "".join(out)


def _kinds(plain: str) -> dict[str, int]:
    n = {"mixed": 0, "whole": 0, "unspellable": 0}
    for w in WORD.findall(plain):
        if w.isascii():
            continue
        s = resolved(w)
        if s == ():
            n["unspellable"] += 1
        elif s:
            stored = frozenset().union(*(_property(c) for c in w if c.isalpha()))
            if not any(all(k in _property(c) for c in w if c.isalpha() and _property(c)) for k in stored):
                n["mixed"] += 1
            elif "LATIN" in s and "LATIN" not in stored:
                n["whole"] += 1
    return n


def _formed(text: str) -> tuple[str, str | None]:
    """The form, and the decomposed text if it has letters of scripts that share shapes."""
    plain = None
    if not ASCII.match(text):
        text = LINE_BREAKS.sub("\n", text).translate(_PLAIN)
        if any(map(_FOREIGN.__getitem__, set(text))):
            plain = text
            words = WORD.findall(text)
            sets = {w: resolved(w) for w in set(words)}
            votes: dict[str, int] = {}
            for w in words:
                s = sets[w]
                if s and len(s) == 1:
                    votes[s[0]] = votes.get(s[0], 0) + 1

            def best(s: tuple[str, ...]) -> str:
                return min(s, key=lambda x: (-votes.get(x, 0), _rank(x)))

            spelled = {w: w if s is None else _spell(w, best(s) if s else "LATIN") for w, s in sets.items()}
            text = WORD.sub(lambda m: spelled[m.group()], text)
        text = unicodedata.normalize("NFC", text)
    text = BLANKS.sub(" ", text)
    text = text.replace(" \n", "\n").replace("\n ", "\n")
    return (text.strip(" ") if text.strip() else ""), plain


def canonical(text: str | None) -> str | None:
    """The one stored form of a printed text. Null gives null; a text that prints nothing gives ''.

    Blanks next to a line's end print nothing, so they go; runs of blanks inside a line differ only in width and become
    one. Line breaks, case, accents, digits and marks are kept.
    """
    return None if text is None else _formed(text)[0]


def token_kinds(text: str | None) -> dict[str, int]:
    """Counts of tokens by finding: mixed (stored in several scripts, one would do), whole (several scripts could spell it and it is stored in another than Latin though that could), unspellable."""
    return _kinds((text or "").translate(_PLAIN))


def _map(keep: str, text: str, fn, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fn(t) for t in b.column(text).to_pylist()]
            cols = [b.column(keep), *[pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(len(schema) - 1)]]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def canonical_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, changed, n_mixed, n_whole, n_unspellable)``: every text in its one form, one row per input row.

    Null stays null (``changed`` false); repeated rows stay repeated; other columns are not read.
    """

    def fn(t):
        if t is None:
            return None, False, 0, 0, 0
        c, plain = _formed(t)
        k = _kinds(plain or "")
        return c, c != t, k["mixed"], k["whole"], k["unspellable"]

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("changed", pa.bool_()), ("n_mixed", pa.int32()), ("n_whole", pa.int32()), ("n_unspellable", pa.int32())])
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_map("doc_id", "text", fn, schema), "doc_id long, text string, changed boolean, n_mixed int, n_whole int, n_unspellable int")


def lookalike_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, form, stored)``: 128-bit digests of the canonical form and of the stored text, of texts that show something."""

    def fn(t):
        c = canonical(t)
        if not c or c.isspace():
            return None, None
        return hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=16).digest(), hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.binary()), ("stored", pa.binary())])
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null and text != ''")
    return src.mapInArrow(_map("doc_id", "text", fn, schema), "doc_id long, form binary, stored binary").filter("form is not null")


def lookalike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id_1, doc_id_2)``, smaller first: documents that print alike and are stored differently.

    Stored variants of one form are paired first, then expanded to their documents, so exact copies never meet each
    other. The digests are materialised once, in the shared folder, as the texts are far larger. Only forms with two variants or more pass the first aggregation, whose partial step absorbs hot copies.
    """
    m = cut(lookalike_members(docs, id_col, text_col))
    variants = m.groupBy("form", "stored").agg(F.lit(1).alias("one")).drop("one")
    several = variants.groupBy("form").count().filter("count > 1").select("form")
    m = m.join(several, "form", "left_semi")
    v = m.select("form", "stored").distinct()
    pairs = v.alias("a").join(v.alias("b"), "form").filter("a.stored < b.stored").select(F.col("a.stored").alias("s1"), F.col("b.stored").alias("s2"))
    ids = m.select("doc_id", "stored").distinct()
    out = pairs.join(ids.select(F.col("doc_id").alias("d1"), F.col("stored").alias("s1")), "s1").join(ids.select(F.col("doc_id").alias("d2"), F.col("stored").alias("s2")), "s2")
    return out.filter("d1 != d2").select(F.least("d1", "d2").alias("doc_id_1"), F.greatest("d1", "d2").alias("doc_id_2")).distinct()
