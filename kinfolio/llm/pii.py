"""Personal data, also where it is disguised, with offsets in the source text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain as chained

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
#: Letters of other alphabets that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ԁ": "d", "с": "c", "ɡ": "g", "ı": "i",
    "А": "A", "В": "B", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "。": ".", "․": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
#: Characters without width.
UNSEEN = "­​‌‍⁠﻿"
#: Digits in words, in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def _one_to_one() -> dict[int, str | None]:
    """What a character stands for: lookalikes, then full-width forms, letters
    and digits of mathematics, Roman numerals of one letter and digits in circles by their
    compatibility forms, and the decimal digits of all scripts by their value."""
    ranges = (range(0x2160, 0x2180), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), range(0x2460, 0x2469), range(0x2070, 0x208A), range(0x24B6, 0x24EA), range(0xFE50, 0xFE6C), (0xB2, 0xB3, 0xB9))
    found: dict[int, str | None] = {}
    for c in chained(*ranges):
        form = unicodedata.normalize("NFKC", chr(c))
        if len(form) == 1 and " " < form < "\x7f":
            found[c] = form
    found |= {c: str(d) for c in range(0x80, 0x20000) if (d := unicodedata.decimal(chr(c), None)) is not None}
    return found | {ord(k): v for k, v in LOOKALIKES.items()} | {ord(c): None for c in UNSEEN}


STANDS_FOR = _one_to_one()
_ODD = frozenset(map(chr, STANDS_FOR))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_OPEN, _CLOSE = r"(?:(?<!\s)\s+)?[\[({<]\s*", r"\s*[\])}>]\s*"
_AT, _DOT = r"(?:at|arroba|chez)", r"(?:dot|punkt|punto|point)"
_DIGITS = "(?:" + "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w))) + ")"
#: A domain up to its first dot that is said, in brackets or not; dots that are written may come before.
_SAID = rf"[a-z0-9-]++(?:\.[a-z0-9-]++)*+(?:\s+{_DOT}\s+|{_OPEN}{_DOT}{_CLOSE})"
#: Bracketed and spaced-out forms, bare words where an address follows, and runs of spelled digits.
#: Bare words for a dot that aren't English are common words too: they count within an address alone.
_DISGUISED = re.compile(
    rf"(?P<at>{_OPEN}(?:{_AT}|@){_CLOSE}|(?<=[a-z0-9])\s+@\s+(?=[a-z0-9])|(?<=[a-z0-9])\s+{_AT}\s+(?={_SAID}[a-z]))"
    rf"|(?P<dot>{_OPEN}(?:{_DOT}|\.){_CLOSE}|(?<=[a-z0-9])\s+(?:dot|\.)\s+(?=[a-z0-9]))"
    rf"|(?P<word>(?<=[a-z0-9])\s+(?:punkt|punto|point)\s+(?=[a-z0-9]))"
    rf"|(?P<run>(?<!\w)(?:plus\s+)?{_DIGITS}(?!\w)(?:[\s,-]+(?:(?:dot|punkt|punto|point)\s+)?(?:{_DIGITS}|[0-9]+)(?!\w))*)",
    re.I,
)
_RUN_PART = re.compile(rf"(?<!\w)(?:(?P<plus>plus)|(?P<point>dot|punkt|punto|point)|(?P<word>{_DIGITS})|(?P<digits>[0-9]+))(?!\w)", re.I)
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|dot|@|\.|arroba|chez|punkt|punto|point)", re.I)
_BARE = re.compile(r"\s(?:dot|@|\.)\s", re.I)
_FOREIGN = re.compile(r"\s(?:punkt|punto|point)\s", re.I)
#: At in words before a domain with a dot in words; and what may follow at and stand before it, with dots in words.
_ADDRESS = re.compile(rf"(?:(?<=[a-z0-9])\s+{_AT}\s+|{_OPEN}(?:{_AT}|@){_CLOSE})(?={_SAID}[a-z])", re.I)
_DOMAIN_SAID = re.compile(rf"[a-z0-9-]++(?:(?:\.|\s+{_DOT}\s+|{_OPEN}{_DOT}{_CLOSE})[a-z0-9-]++)*", re.I)
_LOCAL_SAID = re.compile(rf"[a-z0-9._%+-]++(?:\s+{_DOT}\s+[a-z0-9._%+-]++)*", re.I)
_SPELLED = re.compile(rf"(?<!\w){_DIGITS}(?!\w)", re.I)
#: Numbers, spelled digits, plus and dot, with all that may stand between the parts of one identifier.
_CHAIN = re.compile(rf"\+?(?:(?<!\w)(?:{_DIGITS}|plus|{_DOT})(?!\w)|[0-9]++)(?:[\s,().%+-]*+(?:(?<!\w)(?:{_DIGITS}|plus|{_DOT})(?!\w)|[0-9]++))*", re.I)
_PLUS, _POINT = re.compile(r"\+|(?<!\w)plus(?!\w)", re.I), re.compile(rf"\.|(?<!\w){_DOT}(?!\w)", re.I)
_NUMBERS = frozenset(("plus", "dot", "punkt", "punto", "point", *DIGIT_WORDS))
_WORD, _GLUED = re.compile(r"\w+"), re.compile(r"\S*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start: leftmost matches that don't overlap
    others of their kind, without those that fail their kind's test.

    Each search walks the text once. A mail address is found from its @, an
    address of numbers from the whole dotted run it stands in, so that long runs
    of letters or digits don't cost their square."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            found.append((0, start, last))
        at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return found
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, m.start(), m.end())]
            for i in range(0, len(groups) - 3, 4):
                four = groups[i : i + 4]
                if all(len(d := text[s:e].lstrip("0")) < 4 and int(d or 0) <= 255 for s, e in four):
                    found.append((1, four[0][0], four[3][1]))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = re.sub("[^0-9]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def _spaced_out(text: str) -> bool:
    """Whether an at or dot may stand in brackets or between blanks."""
    if any(c in text for c in "[({<") and _BRACKETED.search(text) or _BARE.search(text):
        return True
    return bool(_FOREIGN.search(text) and _ADDRESS.search(text))


def _in_company(text: str) -> bool:
    """Whether a spelled digit has a number beside it or an @ anywhere in its text; without, it counts for nothing."""
    words = _WORD.findall(text.replace("İ", "i").replace("ſ", "s").lower())  # as re.I reads these two
    at = [i for i, w in enumerate(words) if w in DIGIT_WORDS]
    return bool(at) and ("@" in text or any(w in _NUMBERS or _DIGIT.search(w) for i in at for w in (*words[max(i - 1, 0) : i], *words[i + 1 : i + 2])))


def _counting(text: str) -> Iterator[tuple[int, int]]:
    """Chains with spelled digits that an identifier could lie in: digits enough for
    a card, for a telephone number after a plus or for an address with three points,
    or a chain grown together with an @. Any other chain holds no identifier, however it is read."""
    if not _in_company(text):
        return
    for m in _CHAIN.finditer(text):
        chain = m.group()
        spelled = sum(1 for _ in _SPELLED.finditer(chain))
        if not spelled:
            continue
        digits = spelled + sum(1 for _ in _DIGIT.finditer(chain))
        enough = digits >= 13 or digits >= 9 and _PLUS.search(chain) or digits >= 4 and sum(1 for _ in _POINT.finditer(chain)) >= 3
        if enough or "@" in text and _grown(text, m.start(), m.end()):
            yield m.start(), m.end()


def _grown(text: str, start: int, end: int) -> bool:
    """Whether an @ is reached from the chain without a blank between."""
    while start and not text[start - 1].isspace():
        start -= 1
        if text[start] == "@":
            return True
    return "@" in _GLUED.match(text, end).group()


def disguised(text: str) -> bool:
    """Whether the transducers could change ``text``; cheap, and never wrongly False."""
    if not text.isascii() and not _ODD.isdisjoint(text):
        return True
    return _spaced_out(text) or next(_counting(text), None) is not None


def normalised(text: str) -> tuple[str, list[int], list[int]]:
    """``text`` in plain form, and for each of its characters where the source of
    that character starts and ends: first characters one by one, then words. Spelled
    digits become digits in chains that can hold an identifier (``_counting``), and
    everywhere if an at or dot is spaced out."""
    if text.isascii() or _ODD.isdisjoint(text):
        plain, source = text, range(len(text))
    else:
        kept = [(i, STANDS_FOR.get(ord(c), c)) for i, c in enumerate(text)]
        kept = [(i, c) for i, c in kept if c is not None]
        plain, source = "".join(c for _, c in kept), [i for i, _ in kept]
    out, starts, ends, at = [], [], [], 0

    def copy(to: int) -> None:
        out.append(plain[at:to])
        starts.extend(source[at:to])
        ends.extend(i + 1 for i in source[at:to])

    def put(c: str, a: int, b: int) -> None:
        out.append(c)
        starts.extend([source[a]] * len(c))
        ends.extend([source[b - 1] + 1] * len(c))

    chains = iter([(0, len(plain))] if _spaced_out(plain) else _counting(plain))
    chain = next(chains, None)
    inside, outside = 0, 0  # dots in words count before the one, and don't before the other
    for m in _DISGUISED.finditer(plain):
        if m.lastgroup == "run":
            while chain and chain[1] <= m.start():
                chain = next(chains, None)
            if not chain or m.start() < chain[0]:
                continue
            copy(m.start())
            for p in _RUN_PART.finditer(plain, m.start(), m.end()):
                if p.lastgroup == "digits":
                    for k in range(p.start(), p.end()):
                        put(plain[k], k, k + 1)
                else:
                    put({"plus": "+", "point": ".", "word": DIGIT_WORDS.get(p.group().lower(), "")}[p.lastgroup], p.start(), p.end())
        elif m.lastgroup == "word" and m.start() >= inside:
            if m.start() >= outside:
                local = _LOCAL_SAID.match(plain, m.end())
                if _ADDRESS.match(plain, local.end()):
                    inside = local.end()
                else:
                    outside = local.end()
            if m.start() >= inside:
                continue
            copy(m.start())
            put(".", m.start(), m.end())
        else:
            if m.lastgroup == "at" and (domain := _DOMAIN_SAID.match(plain, m.end())):
                inside = max(inside, domain.end())
            copy(m.start())
            put("@" if m.lastgroup == "at" else ".", m.start(), m.end())
        at = m.end()
    copy(len(plain))
    return "".join(out), starts, ends


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, plain) of all personal data. Plain spans are those of
    ``plain_spans``; the others come from the normalised text, are mapped back
    to the source, and lie within no plain span of their kind; they can hold one."""
    base = plain_spans(text)
    found = [(*s, True) for s in base]
    if disguised(text):
        plain, starts, ends = normalised(text)
        if plain != text:
            for kind, a, b in plain_spans(plain):
                s, e = starts[a], ends[b - 1]
                if plain[a:b] != text[s:e] and not any(k == kind and x <= s and e <= y for k, x, y in base):
                    found.append((kind, s, e, False))
    return sorted(found)


_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())]))


def find(documents: DataFrame) -> DataFrame:
    """Adds pii: an array of (kind, start, end, plain) for each text, sorted, in
    code points with the end exclusive; kind is the place in KINDS.

    Null and empty texts have none. Each row is searched on its own, whole, and
    keeps its other columns but one named pii.
    """

    @F.arrow_udf("array<struct<kind:int,start:int,end:int,plain:boolean>>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "plain"), s, strict=True)) for s in spans(t)] if t else [] for t in texts.to_pylist()], _TYPE)

    return documents.withColumn("pii", found(F.col("text")))


def digest(pii: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(pii, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with every span of its text replaced by its kind in brackets;
    of spans that overlap, all is replaced by the kind of the first."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        def one(t: str | None) -> str | None:
            if not t:
                return t
            out, at = [], 0
            for kind, s, e, _ in sorted(spans(t), key=lambda x: (x[1], -x[2])):
                if s >= at:
                    out += [t[at:s], f"[{KINDS[kind]}]"]
                at = max(at, e)
            return "".join([*out, t[at:]])

        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return documents.withColumn("text", clean(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = F.filter("pii", lambda s: s["plain"])
    counts = [_count(plain, i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return d.select("doc_id", *counts, F.sha2(digest(plain), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"))


def _count(pii: Column, kind: int) -> Column:
    return F.size(F.filter(pii, lambda s: s["kind"] == kind)).cast("long")


QUERIES, ORACLES = {"op7_pii_spans": query}, {}
