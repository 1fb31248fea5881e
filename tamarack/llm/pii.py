"""Personal data in disguised text, with spans in the source text.

Plain identifiers are found as they stand. Then small transducers rewrite disguises -
look-alike letters and digits, invisible characters, letters for digits, dots between
numbers, spelled digits, "at" and "dot" - and keep for every character they write the source characters it came from. Identifiers that
touch a rewritten place are mapped back to source spans (in code points) and added; a
plain match is never moved or removed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each @ outward in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


_FIND = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def plain(text: str) -> list[tuple[str, int, int]]:
    return [(k, *s) for k in KINDS for s in _FIND[k](text)]


@dataclass
class Mapped:
    """A text, the source range of each of its characters, and which were rewritten."""

    text: str
    start: list[int]
    end: list[int]
    new: list[bool]

    @classmethod
    def of(cls, text: str) -> Mapped:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Apply ordered edits (start, end, output); an output character stands for its whole edit."""
        out, at = Mapped("", [], [], []), 0
        parts, gone = [], []
        for s, e, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:s], new]
            out.start += self.start[at:s] + [self.start[s]] * len(new) if new else self.start[at:s]
            out.end += self.end[at:s] + [self.end[e - 1]] * len(new) if new else self.end[at:s]
            out.new += self.new[at:s] + [True] * len(new)
            if e > s and not new:
                gone.append(len(out.new))  # what follows a removed character counts as rewritten
            at = e
        for i in gone:
            if i < len(out.new):
                out.new[i] = True
        out.text = "".join(parts)
        return out


# Letters that look like ASCII ones (Cyrillic, then Greek).
LOOK_ALIKE = dict(
    zip(
        "аеорсхуіјѕкмтвнАВЕКМНОРСТХУІЈЅ" + "αοριντκυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcxyijskmtbhABEKMHOPCTXYIJS" + "aopivtkuxABEZHIKMNOPTYX",
        strict=True,
    )
)
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e\u034f"


@cache
def _fold(c: str) -> str:
    """The ASCII character that ``c`` imitates, or itself; invisible characters vanish."""
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() and wide.isprintable() and wide != " " and c != wide and unicodedata.category(c)[0] in "LNPS" and unicodedata.category(c) != "Lm" else c


@cache
def _disguised() -> frozenset[str]:
    """Every character that ``_fold`` changes."""
    return frozenset(c for c in map(chr, range(0x80, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and _fold(c) != c and c not in "ªº²³¹")


@cache
def _disguises() -> re.Pattern[str]:
    odd = sorted(_disguised())
    runs, i = [], 0
    while i < len(odd):
        j = i
        while j + 1 < len(odd) and ord(odd[j + 1]) == ord(odd[j]) + 1:
            j += 1
        runs.append(re.escape(odd[i]) + ("-" + re.escape(odd[j]) if j > i else ""))
        i = j + 1
    return re.compile("[" + "".join(runs) + "]")


def fold_look_alikes(m: Mapped) -> Mapped:
    edits = [(h.start(), h.end(), _fold(h[0])) for h in _disguises().finditer(m.text)]
    return m.rewrite(edits) if edits else m


#: ASCII letters written for digits.
_LETTER_DIGITS = str.maketrans("OolI", "0011")
_LETTER_DIGIT = re.compile("[OolI]")
_NUMERAL = re.compile("[0-9OolI]+")
_NUMERALS = re.compile(r"(?<!\w)[0-9OolI]++(?!\w)(?:[ .-][0-9OolI]++(?!\w))*+")
_LETTER_HINT = re.compile(r"[0-9](?:[OolI]|\.[OolI](?!\w)|(?<=[OolI][0-9])|(?<=[OolI]\.[0-9]))")


def undo_letter_digits(m: Mapped) -> Mapped:
    """Write the letters O, o, l and I as 0 and 1 inside numerals that hold a digit, and where a dot joins one alone to such a numeral.

    A word "I" beside a number stays, as a blank parts them.
    """
    edits = []
    for run in _NUMERALS.finditer(m.text) if _LETTER_HINT.search(m.text) else ():
        items = list(_NUMERAL.finditer(m.text, *run.span()))
        digit = [any(c.isdigit() for c in i[0]) for i in items]
        for n, item in enumerate(items):
            before = n and digit[n - 1] and m.text[item.start() - 1] == "."
            after = n + 1 < len(items) and digit[n + 1] and m.text[item.end()] == "."
            if digit[n] or before or after:
                edits += [(c.start(), c.end(), c[0].translate(_LETTER_DIGITS)) for c in _LETTER_DIGIT.finditer(m.text, *item.span())]
    return m.rewrite(edits) if edits else m


_DIGIT_WORDS = {
    w: str(i)
    for i, ws in enumerate(
        (
            "zero oh null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro",
            "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
        )
    )
    for w in ws.split()
}
_SPELLED = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_MARK = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-"}
_ITEM = rf"(?:(?:{_SPELLED}|{'|'.join(_MARK)}|[0-9]++)(?!\w)|[+.])"
_RUN = re.compile(rf"(?<!\w)(?<!\w-)(?:{_ITEM}[\s,_-]*+){{2,}}+", re.I)
_ITEMS = re.compile(rf"(?<!\w)({_SPELLED}|{'|'.join(_MARK)})(?!\w)|[0-9]+|[+.]", re.I)


def join_spelled_digits(m: Mapped) -> Mapped:
    """Write spelled digits as digits where they stand beside numerals or a plus sign, or four or more in a run.

    The checks of the identifiers (length, Luhn, range) reject runs that are none. Blanks
    between numerals of several digits stay as they are.
    """
    edits = []
    for run in _RUN.finditer(m.text):
        found = list(_ITEMS.finditer(run[0]))
        spelled = [f for f in found if f[0].lower() in _DIGIT_WORDS]
        if not spelled or len(spelled) < 4 and not any(f[0].isdigit() or _MARK.get(f[0].lower(), f[0]) == "+" for f in found):
            continue
        at = run.start()
        for i, f in enumerate(found):
            w = f[0].lower()
            if w in _DIGIT_WORDS or w in _MARK:
                edits.append((run.start() + f.start(), run.start() + f.end(), _DIGIT_WORDS.get(w) or _MARK[w]))
            at = run.start() + f.end()
            if i + 1 < len(found) and w.isdigit() and found[i + 1][0].isdigit() and len(w + found[i + 1][0]) > 2:
                continue
            if i + 1 < len(found) and (gap := run.start() + found[i + 1].start()) > at:
                edits.append((at, gap, ""))
    return m.rewrite(edits) if edits else m


_DOT_WORD = r"(?:dot|punkt|point|punto)"
_OCTET = rf"(?:(?<![0-9])[0-9]++|(?<!\w)(?<!\w-)(?:{_SPELLED})(?:[\s,_-]{{1,3}}(?:{_SPELLED})){{0,2}}(?![^\W_]))"
_NUMBER_DOT = rf"(?:\.|\s*[\[({{<]\s*(?:{_DOT_WORD}|\.)\s*[\])}}>]\s*|[\s,]+{_DOT_WORD}[\s,]+|_dot_)"
_QUAD = re.compile(rf"{_OCTET}(?:{_NUMBER_DOT}{_OCTET}){{3,}}", re.I)
_NUMBER_DOTS = re.compile(_NUMBER_DOT, re.I)
_DIGITS = re.compile(rf"(?:{_SPELLED})(?![^\W_])", re.I)
_NUMBER_HINT = re.compile(rf"[0-9](?:\s*[\[({{<]\s*(?:{_DOT_WORD}|\.)|[\s,]+{_DOT_WORD}(?!\w)|_dot_)|(?<!\w){_DOT_WORD}[\s,]+[0-9]", re.I)


def undo_number_dots(m: Mapped) -> Mapped:
    """Write four or more numbers with dot words or bracketed dots between them as digits and dots."""
    edits = []
    for quad in _QUAD.finditer(m.text):
        at = quad.start()
        dots = [*_NUMBER_DOTS.finditer(m.text, at, quad.end()), None]
        for dot in dots:
            end = dot.start() if dot else quad.end()
            octet = m.text[at:end]
            if not octet.isdigit():
                edits.append((at, end, "".join(_DIGIT_WORDS[w[0].lower()] for w in _DIGITS.finditer(octet))))
            if dot:
                if dot[0] != ".":
                    edits.append((end, dot.end(), "."))
                at = dot.end()
    return m.rewrite(edits) if edits else m


_AT = r"(?:\s*[\[({<]\s*(?:at|arroba|arobase|klammeraffe|@)\s*[\])}>]\s*|\s+at\s+|\s*_at_\s*|\s+(?:arroba|arobase|klammeraffe)\s+)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*|\s+(?:dot|punkt|point|punto)\s+|\s*_dot_\s*)"
_AT_ANY = re.compile(rf"{_AT}|@", re.I)
_LOCAL_CHAIN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:(?:\.|{_DOT})[A-Za-z0-9_%+-]+)*", re.I)
_DOMAIN_CHAIN = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*(?:\.|{_DOT})[A-Za-z][A-Za-z0-9-]+", re.I)
_BRACKET_AT = re.compile(r"\s*[\[({<]\s*(?:at|arroba|arobase|klammeraffe|@)\s*[\])}>]\s*", re.I)
_DOTS = re.compile(_DOT, re.I)
_HINT = re.compile(r"[\[({<]\s*(?:at|arroba|arobase|klammeraffe|@|dot|punkt|point|punto|\.)\s*[\])}>]|_at_|_dot_|(?<!\w)(?:dot|arroba|arobase|klammeraffe)(?!\w)|(?:@|(?<!\w)at\s)\s*[A-Za-z0-9.-]++\s+(?:punkt|point|punto)(?!\w)", re.I)
_ARROBA = re.compile(r"\s+(?:arroba|arobase|klammeraffe)\s+", re.I)
_BARE = re.compile(r"\s+(?:punkt|point|punto)\s+", re.I)
_POINT = re.compile(r"\s+point\s+", re.I)
#: What "at" and a bare "point" must lead to, as English prose has both ("look at this point of view").
_POINT_ENDS = ("com", "org", "fr", "ch", "eu")


def _addresses(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Start, at sign's start and end, and end of what may be a disguised address, left to right.

    A chain of names joined by dots before an at sign reaches back to the at sign (or the
    address) before it at most, so that texts are read in linear time, however long names are.
    """
    low = 0
    for at in _AT_ANY.finditer(text):
        if at.start() < low:
            continue
        name = None
        for name in _LOCAL_CHAIN.finditer(text, low, at.start()):
            pass
        domain = _DOMAIN_CHAIN.match(text, at.end()) if name and name.end() == at.start() else None
        low = at.end()
        if domain:
            yield name.start(), at.start(), at.end(), domain.end()
            low = domain.end()


def undo_at_dot(m: Mapped) -> Mapped:
    """Write at/dot disguises of an address as @ and dots.

    Bare words count only with each other ("a at b dot c"); one bracketed form or a bare
    "arroba", "arobase" or "Klammeraffe" is enough. A bare "point", "punkt" or "punto" after a plain dot of
    the domain ends the address.
    """
    edits: list[tuple[int, int, str]] = []
    for start, at, domain, end in _addresses(m.text) if _HINT.search(m.text) else ():
        inner = m.text[start:end]
        sign = m.text[at:domain]
        bracketed = bool(_BRACKET_AT.search(inner) or _ARROBA.search(inner))
        dots = [(start + d.start(), start + d.end()) for d in _DOTS.finditer(inner)]
        for s, e in dots:
            if s >= domain and _BARE.fullmatch(m.text, s, e) and "." in _DOTS.sub("", m.text[domain:s]):
                dots = [d for d in dots if d[0] < s]
                break
        else:
            if not bracketed and sign != "@" and dots and _POINT.fullmatch(m.text, *dots[-1]) and m.text[dots[-1][1] : end].lower() not in _POINT_ENDS:
                continue
        if bracketed or dots:
            edits += [] if sign == "@" else [(at, domain, "@")]
            edits += [(s, e, ".") for s, e in dots]
    edits.sort()
    return m.rewrite(edits) if edits else m


_HYPHENED = re.compile(r"[A-Za-z0-9._%+-]++")
_HYPHEN_DOT = re.compile("-dot-", re.I)


def undo_hyphens(m: Mapped) -> Mapped:
    """Write "-at-" and "-dot-" of one unbroken word as @ and dots: the last "-at-", if a "-dot-" follows it before letters alone."""
    edits = []
    for word in _HYPHENED.finditer(m.text) if _HYPHEN_DOT.search(m.text) else ():
        low = word[0].lower()
        at = low.rfind("-at-")
        name, domain = low[: max(at, 0)].split("-dot-"), low[at + 4 :].rstrip(".-").split("-dot-")
        if at > 0 and len(domain) > 1 and all(name) and all(domain) and domain[-1].isalpha() and len(domain[-1]) > 1:
            stop = word.start() + at + 4 + len("-dot-".join(domain))
            edits += [(d.start(), d.end(), ".") for d in _HYPHEN_DOT.finditer(m.text, word.start(), stop)]
            edits.append((word.start() + at, word.start() + at + 4, "@"))
    return m.rewrite(sorted(edits)) if edits else m


#: Ends of a domain written with blanks around its dots, as blanks also part sentences.
_SPACED_ENDS = "com|org|net|edu|gov|info|io|eu|de|fr|es|it|ch|uk"
_SPACED = re.compile(rf"(?<=[A-Za-z0-9_%+-])\s{{1,3}}@\s{{1,3}}[A-Za-z0-9-]++(?:\s{{0,3}}\.\s{{0,3}}[A-Za-z0-9-]++)*?\s{{0,3}}\.\s{{0,3}}(?:{_SPACED_ENDS})(?![\w-])")
_SPACED_MARK = re.compile(r"\s*[@.]\s*")
_SPACED_HINT = re.compile(r"@(?<=\s@)\s")


def undo_blanks(m: Mapped) -> Mapped:
    """Take out the blanks around the @ and the dots of an address ("jane @ example . com") that ends in a common domain."""
    edits = []
    for address in _SPACED.finditer(m.text) if _SPACED_HINT.search(m.text) else ():
        marks = _SPACED_MARK.finditer(m.text, *address.span())
        edits += [(k.start(), k.end(), k[0].strip()) for k in marks if len(k[0]) > 1]
    return m.rewrite(edits) if edits else m


_SPELLED_HINT = re.compile(rf"(?<!\w)(?:(?:{_SPELLED})[\s,_-]+(?:(?:{_SPELLED}|{_DOT_WORD})(?!\w)|[0-9])|plus[\s,_-]+(?:{_SPELLED})(?!\w))|[0-9+][\s,_-]*+(?<!\w)(?:{_SPELLED})(?!\w)", re.I)

_WORD = re.compile(r"[^\W_]+")
_DOTS_AND_ATS = frozenset("dot punkt point punto arroba arobase klammeraffe".split())
_SPELLED_WORDS = frozenset(_DIGIT_WORDS)
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|arroba|arobase|klammeraffe|@|dot|punkt|point|punto|\.)\s*[\])}>]|[0-9]\s*[\[({<]\s*(?:dot|punkt|point|punto|\.)")


def _hinted(text: str) -> bool:
    """Whether a step that undoes a disguise can find anything; the set of words is looked at first, as most texts lack them."""
    low = text.lower()
    words = set(_WORD.findall(low))
    if not words.isdisjoint(_DOTS_AND_ATS) and (_HINT.search(text) or _NUMBER_HINT.search(text)):
        return True
    if not words.isdisjoint(_SPELLED_WORDS) and _SPELLED_HINT.search(text):
        return True
    return "_at_" in low or "-dot-" in low or any(h.search(low) for h in (_BRACKETED, _SPACED_HINT)) or bool(_LETTER_HINT.search(text))


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and the spans that deobfuscation adds, as (kind, start, end)."""
    if not text:
        return [], []
    base = plain(text)
    odd = not text.isascii() and not _disguised().isdisjoint(text)
    if not odd and not _hinted(text):
        return base, []
    m = Mapped.of(text)
    for step in (fold_look_alikes, undo_letter_digits, undo_number_dots, join_spelled_digits, undo_hyphens, undo_blanks, undo_at_dot):
        m = step(m)
    if not any(m.new):
        return base, []
    known = set(base)
    extra = [
        span
        for kind, s, e in plain(m.text)
        if any(m.new[s:e]) and (span := (kind, m.start[s], m.end[e - 1])) not in known
    ]
    return base, sorted(set(extra), key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, all``: plain spans and all spans of every whole text, as joined strings,
    and ``found``, an array of structs ``kind, start, end, disguised``.

    Spans count code points, ends exclusive. Null and empty texts have none; extra columns
    are ignored; an empty table gives an empty result; equal texts give equal spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = [spans(t.as_py()) for t in part["text"]]
                found = [[dict(zip(("kind", "start", "end", "disguised"), (*s, extra), strict=True)) for extra, ss in ((False, base), (True, more)) for s in ss] for base, more in got]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([joined(x) for x, _ in got], pa.string()), pa.array([joined(x + y) for x, y in got], pa.string()), pa.array(found, pa.list_(SPAN))],
                    ["doc_id", "base", "all", "found"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, base string, all string, found array<struct<kind:string,start:long,end:long,disguised:boolean>>")
