"""Noise in text from scanned pages: line kinds, and repair into continuous paragraphs.

A record is read as pages: furniture stands at page edges, that is where a line interrupts the text,
carries or adjoins a page number, stands alone or is set as a heading is. The lines there are grouped into
families by fuzzy repetition, the record's title being a member too; a family of two or more is a
running header. The numbers at the edges are put into one rising sequence: what belongs to it is a
page number, and a line numbered by it a header even where its family has no other line. Words divided
at line ends are joined or kept by the corpus vocabulary: the joined word against the compound, by
corpus counts. A word is misread if it holds stray marks, figures or capitals, or if it is rare and one
edit away from a far more frequent word of the corpus, found in an index of deletions. The vocabulary
keeps words of at least ``min_share`` of their language's words, hence at most 1 / min_share a language.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import checkpointed
from .instruct import languages_of
from .language import LanguageModel

ROMAN = re.compile(r"^(?=[ivxlcdm])(?:m{0,3})(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
NUMBERISH = re.compile(r"^(?=.*\d)[0-9lIoOSBiz|!]{1,4}$|^[lIoO]{2,3}$")
HEADING = re.compile(r"^(?:section|letter|chapter|chap|art|article|part|book|proposition|prop|lecture|canto|act|scene|appendix|problem|theorem|note|essay|volume|vol)\W*(?:[ivxlcdm]+|\d+)?\W*$", re.IGNORECASE)
#: Letters that scanners write for figures (fixed values), and the values of roman numerals.
SCAN_DIGITS = str.maketrans("lI|!iOoSBz", "1111100582")
ROMAN_VALUE = dict(zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)))
STOP = re.compile(r"[.!?:;][\"'”’)\]]*\s*$")
HYPHENS = frozenset("-¬­‐‑=⸗")
SMALL = re.compile(r"\s[a-zß-öø-ÿ]")
STRAY = re.compile(r"[■□¦^~*|•§¶\d]")
LETTER = re.compile(r"[^\W\d_]")
DIVIDED = re.compile(r"([^\W\d_]+)(\s?[-¬­‐‑=⸗])\s*$")
EDGE = "\"'“”‘’«»„()[]{}.,;:!?—–-¬…"
WORD_PART = re.compile(r"^[^\W\d_]+$")
ORDINAL = re.compile(r"^\d+(?:st|nd|rd|th|d|s|mo|vo|to|ly)$", re.IGNORECASE)
ABBREVIATION = re.compile(r"^(?:[^\W\d_]{1,3}\.)+[^\W\d_]{0,3}$")
COMPOUND = re.compile(r"^[^\W\d_]+(?:-[^\W\d_]+)+$")
#: Spellings that vary without being misread: either side may stand for the other (fixed values).
VARIANTS = (("our", "or"), ("ise", "ize"), ("isi", "izi"), ("isa", "iza"), ("yse", "yze"), ("re", "er"), ("ll", "l"), ("ck", "c"), ("ction", "xion"), ("ae", "e"), ("oe", "e"), ("ence", "ense"), ("gue", "g"), ("ks", "x"))
#: Common function words, which are never taken for misreadings of one another (fixed values).
FUNCTION_WORDS = frozenset(
    "a about above after again against all also although am among an and any are as at be because been before being below between both but by can cannot could did do does down during each either ever every few for from further had has have having he hence her here hers him his how however i if in into is it its itself lest many may me might mine more most much must my neither never no nor not now of off often on once one only or other our out over own perhaps shall she should since so some soon still such than that the thee their them then thence there these they thine this those thou though through thus thy till to too under until unless unto up upon us very was we were what when whence where whether which while who whom whose why will with within without would ye yet you your".split()
)
#: Letter groups that scanners take for one another (fixed values).
CONFUSED = (("rn", "m"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("ni", "m"), ("in", "m"), ("ci", "a"), ("lc", "k"), ("fi", "h"), ("nn", "m"), ("iu", "m"))


@dataclass
class Vocabulary:
    """Counts of folded running words, of their capitalised forms inside sentences, and of compounds."""

    words: dict[str, int]
    capital: dict[str, int]
    compound: dict[str, int]
    rare: int  # count that an unlisted word may have at most
    ratio: float = 25.0
    listed_ratio: float = 200.0
    top: int = 0  # count of the most frequent word
    by_lang: dict[str, dict[str, int]] = field(default_factory=dict)
    rare_in: dict[str, int] = field(default_factory=dict)  # as rare, for a language's own words
    lang: str = ""  # language of the text at hand; neighbours come from its words
    verdicts: dict[tuple[str, str], tuple[str, str | None]] = field(default_factory=dict)
    sound: dict[str, set[str]] = field(default_factory=dict)  # tokens found to be in order, by language
    deleted: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    def index(self) -> dict[str, list[str]]:
        """Deletions of the words of the text's language that are frequent enough to correct another, made once a process."""
        if self.lang not in self.deleted:
            table, least = self.by_lang.get(self.lang, self.words), self.ratio * self.rare_in.get(self.lang, self.rare)
            out: dict[str, list[str]] = defaultdict(list)
            for word, n in table.items():
                if n >= least:
                    for d in deletions(word):
                        out[d].append(word)
            self.deleted[self.lang] = dict(out)
        return self.deleted[self.lang]


def is_page_number(line: str) -> bool:
    """A number alone on its line: arabic or roman, bare, dotted, between dashes, in brackets, after Page."""
    u = line.strip()
    if not u or len(u) > 14:
        return False
    core = u.strip("—–-[](){}. *·•_'")
    parts = core.split()
    if len(parts) == 2 and len(parts[0]) in (2, 3, 4, 5) and SequenceMatcher(None, parts[0].lower().strip("."), "page").ratio() >= 0.7:
        core = parts[1]
    elif len(parts) == 2 and parts[0].lower().strip(".") in ("p", "pag", "pp", "no"):
        core = parts[1]
    elif len(parts) != 1:
        return False
    return number_token(core)


def number_token(core: str) -> bool:
    if not core:
        return False
    if core.isdigit():
        return len(core) <= 4
    bare = re.sub(r"[^0-9A-Za-z]", "", core)
    if len(core) - len(bare) > 1 or not bare:
        return False
    return bool(NUMBERISH.match(bare)) or bool(ROMAN.match(bare.lower()) and (bare.islower() or bare.isupper()))


def letters(s: str) -> str:
    return "".join(c for c in s.lower() if c.isalpha())


def split_number(u: str) -> tuple[str, bool]:
    """The line without a page number at its start or end, and whether it had one."""
    parts = u.split()
    if len(parts) >= 2:
        tail, head = parts[-1].strip(".[]()—–-"), parts[0].strip(".[]()—–-")
        wide_tail = re.search(r"\s{2,}\S+\s*$", u) is not None
        wide_head = re.match(r"\s*\S+\s{2,}", u) is not None
        spaced = all(len(p) == 1 for p in parts[:3])
        if number_token(tail) and (any(c.isdigit() for c in tail) or wide_tail) and not (spaced and len(tail) == 1 and not tail.isdigit()):
            return u.rstrip()[: -len(parts[-1])].rstrip(), True
        if number_token(head) and (any(c.isdigit() for c in head) or wide_head) and not (len(head) == 1 and not head.isdigit() and not wide_head):
            return u.lstrip()[len(parts[0]) :].lstrip(), True
    return u, False


def number_value(tok: str) -> int | None:
    """Value of a page number, arabic or roman, with letters that scanners write for figures."""
    bare = re.sub(r"[^0-9A-Za-z|!]", "", tok)
    low = bare.lower()
    if low and not bare.isdigit() and ROMAN.match(low) and (bare.islower() or bare.isupper()):
        v = [ROMAN_VALUE[c] for c in low]
        return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))
    digits = bare.translate(SCAN_DIGITS)
    return int(digits) if digits.isdecimal() else None


def rising(values: list[int], reach: int = 3) -> set[int]:
    """Positions of the longest chain of values each 1 to ``reach`` above the one before: a page or two may lack its number."""
    length: list[int] = []
    back: list[int] = []
    last: dict[int, int] = {}
    for k, v in enumerate(values):
        n, to = max(((length[last[v - step]], last[v - step]) for step in range(reach, 0, -1) if v - step in last), default=(0, -1))
        length.append(n + 1)
        back.append(to)
        if v not in last or length[last[v]] <= n + 1:
            last[v] = k
    at = max(range(len(values)), key=lambda k: (length[k], -k), default=-1)
    out: set[int] = set()
    while at >= 0:
        out.add(at)
        at = back[at]
    return out


def _alike(a: str, b: str, floor: float) -> bool:
    if not a or not b or abs(len(a) - len(b)) > 0.35 * max(len(a), len(b)):
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= floor and m.quick_ratio() >= floor and m.ratio() >= floor


def families(keys: list[str], floor: float = 0.8) -> list[int]:
    """Family of each key: keys join, the most frequent first, the first family whose leader is alike enough.

    Leaders are looked up by the letter groups they share with the key, as many as a likeness of ``floor``
    leaves whole, so the work grows with the keys and not with their pairs.
    """
    count = Counter(keys)
    posted: dict[str, list[int]] = defaultdict(list)
    leaders: list[str] = []
    of: dict[str, int] = {}

    def groups(key: str, n: int) -> set[str]:
        return {key[i : i + n] for i in range(len(key) - n + 1)}

    for key in sorted(count, key=lambda k: (-count[k], k)):
        n = 3 if len(key) >= 8 else 2
        need = max(1.0, 0.4 * len(key) - 2 if n == 3 else 0.6 * len(key) - 1)
        met = Counter(x for g in groups(key, n) for x in posted.get(g, ()))
        home = next((x for x, c in sorted(met.items(), key=lambda m: (-m[1], m[0])) if c >= need and _alike(key, leaders[x], floor)), None)
        if home is None:
            home = len(leaders)
            leaders.append(key)
            for g in groups(key, 2) | groups(key, 3):
                posted[g].append(home)
        of[key] = home
    return [of[k] for k in keys]


def _caps_near(lines: list[str], i: int) -> bool:
    """The line right before ends, or the one right after begins, in capitals too: a passage in capitals."""
    near = [lines[i - 1].split()[-2:]] if i else []
    if i + 1 < len(lines):
        near.append(lines[i + 1].split()[:2])
    return any(sum(w.isupper() and len(w) > 1 for w in part) >= min(2, len(part)) for part in near if part)


@dataclass
class Edge:
    """A line at a page edge that may be furniture."""

    line: int
    core: str  # without a page number
    norm: str  # letters of the core
    numbered: bool
    alone: bool  # blank lines around it
    breaks: bool  # stands inside a sentence
    first: bool  # nothing but blank lines before it
    styled: bool  # set as a heading is: most words begin with capitals
    heading: bool


def page_edges(lines: list[str]) -> tuple[list[str], list[Edge], list[tuple[int, int]]]:
    """(kinds so far: blank, page_number or text; edges; (line, page number) in order)."""
    bare = [x.strip() for x in lines]
    kinds = ["text" if x else "blank" for x in bare]
    solid = [i for i, x in enumerate(bare) if x]
    edges: list[Edge] = []
    numbers: list[tuple[int, int]] = []
    for at, i in enumerate(solid):
        u = bare[i]
        words = u.split()
        if len(u) <= 14 and is_page_number(u):
            kinds[i] = "page_number"
            value = number_value(words[-1] if len(words) > 1 and not words[-1].strip("—–-[](){}. *·•_'") == "" else u)
            if value is not None:
                numbers.append((i, value))
            continue
        # most words of a line of running text begin with small letters; such a line is a header only if it comes again, and stands alone
        alone = (i == 0 or not bare[i - 1]) and (i + 1 == len(bare) or not bare[i + 1])
        if 2 * len(SMALL.findall(" " + u)) > len(words) + 2 and not (alone and len(words) <= 14):
            continue
        core, numbered = split_number(u)
        kept = core.split()
        styled = bool(kept) and 2 * sum(w[0].islower() for w in kept) <= len(kept)
        if not kept or not styled and not alone:
            continue
        norm = letters(core)
        if not norm:
            continue
        before, after = bare[solid[at - 1]] if at else "", bare[solid[at + 1]] if at + 1 < len(solid) else ""
        breaks = bool(before) and not STOP.search(before) and after[:1].islower() and not kept[0][0].islower()
        if numbered:
            tail = words[-1] if u.startswith(core) else words[0]
            value = number_value(tail.strip(".[]()—–-"))
            if value is not None:
                numbers.append((i, value))
        edges.append(Edge(i, core.strip(), norm, numbered, alone, breaks, at == 0, styled, HEADING.match(core.strip()) is not None and core.strip()[:1].isupper()))
    return kinds, edges, numbers


def line_kinds(lines: list[str], title: str | None) -> list[str]:
    """blank, page_number, header, heading or text for every line."""
    kinds, edges, numbers = page_edges(lines)
    if len(lines) == 1:
        return kinds
    chain = rising([v for _, v in numbers])
    paged = {numbers[k][0] for k in chain} if len(chain) > 1 else set()
    for i, _ in numbers:
        # a bare number beside a sequence to which it does not belong is one only where it interrupts the text
        if kinds[i] == "page_number" and paged and i not in paged and lines[i].strip().isdecimal():
            if i and i + 1 < len(lines) and lines[i - 1].strip() and lines[i + 1].strip():
                kinds[i] = "text"
    solid = [i for i, k in enumerate(kinds) if k != "blank"]
    place = {i: n for n, i in enumerate(solid)}
    name = letters((title or "").split(":")[0])
    family = families([e.norm for e in edges if not e.heading])
    of = dict(zip((e.line for e in edges if not e.heading), family))
    size = Counter(family)
    same = Counter(e.norm for e in edges if e.heading)
    for e in edges:
        i, at = e.line, place[e.line]
        beside = any(kinds[solid[j]] == "page_number" for j in (at - 1, at + 1) if 0 <= j < len(solid))
        if e.heading:
            again = same[e.norm] > 1 and (e.breaks or beside)
            kinds[i] = "header" if i in paged or e.numbered and (e.breaks or e.first) or again else "heading"
            continue
        parts = e.core.split()
        n_words = len(parts) if sum(len(w) == 1 for w in parts) * 2 < len(parts) else len(re.split(r"\s{2,}", e.core))
        titled = len(e.norm) >= 5 and len(name) >= 5 and (_alike(e.norm, name[: len(e.norm) + 1], 0.75) or _alike(e.norm, name, 0.75))
        recurs = size[of[i]] > 1 or titled
        if n_words > 40 or not recurs and (not e.styled or len(e.norm) < 4 or "," in e.core):
            continue
        if recurs:
            kinds[i] = "header"
        elif _caps_near(lines, i) or not e.numbered and e.core.isupper() and (n_words > 14 or parts[-1].lower().strip(".") in FUNCTION_WORDS):
            continue
        elif i in paged or e.numbered and n_words <= 14 and (e.breaks or e.first or e.alone):
            kinds[i] = "header"
        elif len(e.norm) <= 45 and not e.core.endswith(".") and (e.breaks and n_words <= 4 or beside and (e.breaks or e.core.isupper())):
            kinds[i] = "header"
        elif e.alone and n_words <= 8 and not e.core.endswith("."):
            kinds[i] = "heading"
    return kinds


def deletions(w: str) -> set[str]:
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def near_words(w: str, table: dict[str, int], index: dict[str, list[str]]) -> set[str]:
    """Indexed words one letter or one confused letter group away from w."""
    less = deletions(w)
    out = {t for d in less for t in index.get(d, ()) if len(t) == len(w) and sum(a != b for a, b in zip(t, w)) == 1}
    out.update(index.get(w, ()))
    out.update(d for d in less if d in table)
    for a, b in CONFUSED:
        for x, y in ((a, b), (b, a)):
            at = w.find(x)
            while at >= 0:
                out.add(w[:at] + y + w[at + len(x) :])
                at = w.find(x, at + 1)
    out.discard(w)
    return out


def is_variant(a: str, b: str) -> bool:
    """The words differ by a varying spelling alone."""
    for x, y in VARIANTS:
        for p, q in ((x, y), (y, x)):
            if p:
                at = a.find(p)
                while at >= 0:
                    if a[:at] + q + a[at + len(p) :] == b:
                        return True
                    at = a.find(p, at + 1)
    return False


def spelling(w: str, v: Vocabulary) -> str | None:
    """The frequent word that the rare word w is a misreading of, if there is one. w is folded."""
    if len(w) < 3 or w in FUNCTION_WORDS:
        return None
    table, rare = v.by_lang.get(v.lang, v.words), v.rare_in.get(v.lang, v.rare)
    own = v.words[w] if w in table else max(v.words.get(w, 0), rare)
    need = own * (v.ratio if own <= rare else v.listed_ratio)
    able = ((-table.get(e, 0), e) for e in near_words(w, table, v.index()) if len(e) >= 3)
    best = min((x for x in able if -x[0] >= need and -x[0] > 0 and not is_variant(w, x[1])), default=None)
    return best[1] if best else None


def verdict(tok: str, v: Vocabulary) -> tuple[str, str | None]:
    """('ok' | 'misread' | 'capital', correction) of a token; 'capital' depends on its place."""
    key = (v.lang, tok)
    got = v.verdicts.get(key)
    if got is None:
        if len(v.verdicts) > 300_000:
            v.verdicts.clear()
        got = v.verdicts[key] = _verdict(tok, v)
    return got


def _verdict(tok: str, v: Vocabulary) -> tuple[str, str | None]:
    core = tok.strip(EDGE)
    if not core:
        return ("ok", None)
    if not any(c.isalpha() for c in core):
        return ("misread", None) if any(not c.isdigit() and c in "■□¦^~*|•§¶" for c in core) and len(core) > 1 and any(c.isdigit() for c in core) else ("ok", None)
    edge = tok.strip("\"'“”‘’«»„()[]{}.,;:!?—–-¬…_*")
    if core != edge and any(c in "*_" for c in tok.strip(EDGE[:-1])) and edge and len(edge) > 1:
        inner = tok.strip(EDGE)
        if inner.strip("*_") != inner and inner.count("*") + inner.count("_") == 1:
            return ("misread", spelling(edge.lower(), v) or edge)
    parts = [p for p in re.split(r"[-‐‑—–'’/]", core) if p]
    for p in parts:
        if WORD_PART.match(p):
            continue
        if p.isdigit() or ORDINAL.match(p) or ABBREVIATION.match(p) or ABBREVIATION.match(core):
            continue
        has_letters = any(c.isalpha() for c in p)
        if has_letters:
            plain = "".join(c for c in p.lower() if c.isalpha())
            fix = plain if plain in v.words else spelling(plain, v)
            return ("misread", fix)
    for p in parts:
        if len(p) >= 2 and p != p.lower() and p != p.upper() and not p[0:1].isupper():
            return ("misread", p.lower())
        if len(p) >= 2 and p[1:] != p[1:].lower() and p != p.upper() and not re.match(r"^(?:Mac|Mc|O|D|L|De|La|Van)[A-Z]", p):
            return ("misread", p[0] + p[1:].lower())
    folded = core.lower().replace("’", "'")
    if len(parts) == 1 and WORD_PART.match(core):
        if v.words.get(folded, 0) * v.listed_ratio < v.top:
            fix = spelling(folded, v)
            if fix is not None and not core.isupper():
                return ("misread", fix if core.islower() else fix.capitalize())
        if core[0].isupper() and core[1:].islower() and len(core) > 1 and v.words.get(folded, 0) >= 40 * max(1, v.capital.get(folded, v.rare)):
            return ("capital", folded)
    elif len(parts) > 1 and folded not in v.compound:
        for p in parts:
            low = p.lower()
            if WORD_PART.match(p) and len(p) >= 4 and low not in v.words and not p[0].isupper():
                fix = spelling(low, v)
                if fix is not None:
                    return ("misread", folded.replace(low, fix))
    return ("ok", None)


def joins(head: str, tail: str, v: Vocabulary, mark: str) -> bool:
    """The divided word is written without a hyphen."""
    a, b = head.lower(), tail.lower()
    whole, kept = v.words.get(a + b, 0), v.compound.get(f"{a}-{b}", 0)
    if whole or kept:
        return whole > kept
    if v.words.get(a, 0) > v.rare * 3 and v.words.get(b, 0) > v.rare * 3 and len(a) > 2 and len(b) > 2 and mark not in "¬­":
        # two words of their own, never seen joined: unless a misread joined word is near
        return spelling(a + b, v) is not None
    return True


def ends_sentence(line: str) -> bool:
    return line.rstrip().rstrip("\"'”’)]")[-1:] in (".", "!", "?", ":")


def analyse(text: str, title: str | None, v: Vocabulary, lang: str = "") -> tuple[list[tuple[int, str]], str, int]:
    """((line number, kind) rows, repaired text, lines of running text)."""
    v.lang = lang
    sound = v.sound.setdefault(lang, set())
    if len(sound) > 300_000:
        sound.clear()
    lines = text.split("\n")
    kinds = line_kinds(lines, title)
    out: list[tuple[int, str]] = [(i + 1, k) for i, k in enumerate(kinds) if k in ("header", "page_number")]
    running = [i for i, k in enumerate(kinds) if k == "text"]
    paragraphs: list[str] = []
    parts: list[str] = []
    carry: str | None = None  # first half of a word that the next line ends
    last_stop = True
    last = -1
    for at, i in enumerate(running):
        line = lines[i]
        indent = len(line) - len(line.lstrip())
        gap = any(kinds[j] in ("blank", "heading") for j in range(last + 1, i)) if last >= 0 else False
        furniture = any(kinds[j] in ("header", "page_number") for j in range(last + 1, i)) if last >= 0 else False
        new = last >= 0 and carry is None and ((gap and not (furniture and not last_stop)) or (indent >= 2 and last_stop))
        if new and parts:
            paragraphs.append(" ".join(parts))
            parts = []
        toks = line.split()
        closed = line.rstrip()
        if carry is None and closed[-1] not in HYPHENS and sound.issuperset(toks):
            parts.append(" ".join(toks))
            last_stop, last = ends_sentence(closed), i
            continue
        bad = False
        divided = DIVIDED.search(line) if closed[-1] in HYPHENS else None
        tail = None
        if divided and at + 1 < len(running):
            nxt = lines[running[at + 1]].split()
            first = nxt[0].strip("\"'“”‘’«»„()[]{}.,;:!?—–…") if nxt else ""
            m = re.match(r"[^\W\d_]+", first)
            if m and first[:1].islower():
                tail = m.group()
                odd = len(divided.group(2)) > 1 or line.rstrip()[-1] in "=⸗"
                if odd and not v.words.get((divided.group(1) + tail).lower()):
                    tail = None
        fixed: list[str] = []
        for n, tok in enumerate(toks):
            if n == 0 and carry is not None:
                # the second half was judged with the first; only marks of its own count here
                if STRAY.search(tok) and LETTER.search(tok) and not ORDINAL.match(tok.strip(EDGE)):
                    bad = True
                parts.append(carry + tok)
                carry = None
                continue
            if divided and n == len(toks) - 1 and tail is not None:
                head = divided.group(1)
                loose = len(divided.group(2)) > 1
                if loose:  # the mark stands apart: the half word before it was taken for a word
                    fixed = fixed[:-1]
                    tok = toks[n - 1]
                if joins(head, tail, v, line.rstrip()[-1]):
                    out.append((i + 1, "hyphen"))
                    carry = tok.rstrip("-¬­‐‑=⸗")
                else:
                    carry = tok.rstrip("¬­-‐‑=⸗") + "-"
                if STRAY.search(tok) and LETTER.search(tok) or re.search(r"[^\W\d_A-Z][A-Z]", head):
                    bad = True
                continue
            if tail is not None and n == len(toks) - 2 and len(divided.group(2)) > 1:
                fixed.append(tok)
                continue
            if tok in sound:
                fixed.append(tok)
                continue
            what, fix = verdict(tok, v)
            if what == "ok":
                sound.add(tok)
            if what == "capital":
                prev = toks[n - 1] if n else (lines[last].split() or [""])[-1] if last >= 0 and not new else "."
                if n == 0 and (last < 0 or new):
                    what = "ok"
                elif re.search(r"[.!?:][\"'”’)\]]*$", prev) or prev in "—–-" or re.search(r"[“\"‘«(]", tok[:1]) or (prev[:1].isupper() and n > 0 and len(prev) > 1 and verdict(prev, v)[0] != "ok"):
                    what = "ok"
                else:
                    what = "misread"
            if what == "misread":
                bad = True
                if fix:
                    core = tok.strip(EDGE)
                    fixed.append(tok.replace(core, fix, 1) if core else tok)
                    continue
            fixed.append(tok)
        if bad:
            out.append((i + 1, "misread"))
        if fixed:
            parts.append(" ".join(fixed))
        last_stop = ends_sentence(closed)
        last = i
    if carry is not None:
        parts.append(carry)
    if parts:
        paragraphs.append(" ".join(parts))
    return sorted(out), "\n\n".join(paragraphs), len(running)


def count_words(texts: list[tuple[str, str]]) -> Counter:
    """Counts by (kind, word) of (text, language): folded running words by language ('w:xx'),
    capitalised inside a sentence ('c'), compounds ('h')."""
    toks: dict[str, Counter] = {}
    inside: Counter = Counter()
    for text, lang in texts:
        words = text.split()
        toks.setdefault(lang, Counter()).update(words)
        inside.update(b for a, b in zip(words, words[1:]) if b[:1].isupper() and a[-1:] not in ".!?:\"”’)—–")
    out: Counter = Counter()
    for lang, counts in toks.items():
        for tok, n in counts.items():
            core = tok.strip(EDGE)
            if WORD_PART.match(core):
                if tok[-1] not in "-¬­=":
                    out[f"w:{lang}", core.lower()] += n
            elif COMPOUND.match(core):
                out["h", core.lower()] += n
                for half in core.lower().split("-"):
                    out[f"w:{lang}", half] += n
    for tok, n in inside.items():
        core = tok.strip(EDGE)
        if WORD_PART.match(core) and core[1:].islower():
            out["c", core.lower()] += n
    return out


def known(counts, floor: int, floors: dict[str, int] | None = None) -> Vocabulary:
    """Vocabulary of (kind, word, count) rows of at least ``floor``, or for words that of their language in ``floors``."""
    v = Vocabulary({}, {}, {}, floor - 1, rare_in={lang: n - 1 for lang, n in (floors or {}).items()})
    for kind, word, n in counts:
        if kind == "c":
            v.capital[word] = n
        elif kind == "h":
            v.compound[word] = n
        else:
            v.by_lang.setdefault(kind[2:], {})[word] = n
            v.words[word] = v.words.get(word, 0) + n
    v.top = max(v.words.values(), default=0)
    return v


def text_languages(texts: list[str], model: LanguageModel | None) -> list[str]:
    """Main language of each text; '' without a model or a clear lead."""
    return [x or "" for x in languages_of(texts, model)] if model is not None else [""] * len(texts)


def word_counts(df: DataFrame, text_col: str = "text", model: LanguageModel | None = None) -> DataFrame:
    """kind, word, n over all texts, as ``count_words`` has them."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in tv.split_by_size(((t,) for t in batch.column(0).to_pylist()), lambda r: len(r[0])):
                texts = [t for (t,) in part]
                out = count_words(list(zip(texts, text_languages(texts, shared.value))))
                if out:
                    keys = list(out)
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys]), pa.array([w for _, w in keys]), pa.array([out[k] for k in keys], pa.int64())], names=["kind", "word", "n"])

    src = df.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(run, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def vocabulary(df: DataFrame, text_col: str = "text", model: LanguageModel | None = None, min_share: float = 2e-6, least: int = 3) -> Vocabulary:
    """Words of at least ``min_share`` of their language's counts, others of all: about 1 / min_share rows of each kind at most reach the driver."""
    counts = checkpointed(word_counts(df, text_col, model))
    totals = {r["kind"]: r["n"] for r in counts.where("kind like 'w:%'").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    floor_of = lambda n: max(least, int(n * min_share))
    floor, floors = floor_of(sum(totals.values())), {kind: floor_of(n) for kind, n in totals.items()}
    needed = F.lit(floor)
    for kind, n in floors.items():
        needed = F.when(F.col("kind") == kind, n).otherwise(needed)
    return known(counts.where(F.col("n") >= needed).collect(), floor, {kind[2:]: n for kind, n in floors.items()})


SCHEMA = "rows array<struct<line_no:int, kind:string>>, repaired string, n_running int"


def scanned(df: DataFrame, v: Vocabulary, id_cols: list[str], title_col: str = "title", text_col: str = "text", model: LanguageModel | None = None) -> DataFrame:
    """Per row: id_cols, line rows, repaired text, number of lines of running text.

    A null text has no rows and a null repair; an empty one an empty repair.
    """
    shared = df.sparkSession.sparkContext.broadcast((v, model))
    src = df.select(*[F.col(f"`{c}`") for c in id_cols], F.col(f"`{title_col}`").alias("__title"), F.col(f"`{text_col}`").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-2])

    def run(batches):
        for batch in batches:
            n = batch.num_columns
            at = 0
            for part in tv.split_by_size(zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()), lambda r: len(r[1] or "")):
                offs, numbers, kinds, fixed, running = [0], [], [], [], []
                langs = text_languages([x or "" for _, x in part], shared.value[1])
                for (title, text), lang in zip(part, langs):
                    r, t, k = analyse(text, title, shared.value[0], lang) if text is not None else ([], None, 0)
                    numbers.extend(i for i, _ in r)
                    kinds.extend(what for _, what in r)
                    offs.append(len(numbers))
                    fixed.append(t)
                    running.append(k)
                ids = [batch.column(i).slice(at, len(part)) for i in range(n - 2)]
                each = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(kinds, pa.string())], names=["line_no", "kind"])
                rows = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), each)
                yield pa.RecordBatch.from_arrays([*ids, rows, pa.array(fixed, pa.string()), pa.array(running, pa.int32())], names=[*id_cols, "rows", "repaired", "n_running"])
                at += len(part)

    return src.mapInArrow(run, f"{fields}, {SCHEMA}")


def line_rows(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return done.select(id_col, F.explode("rows").alias("r")).select(id_col, "r.line_no", "r.kind").distinct()


def repairs(done: DataFrame, id_col: str = "doc_id", score_col: str = "ocr_score") -> DataFrame:
    """Repaired text with counts by kind, the score on a 0-1 scale (null if missing) and whether it fits the noise found."""
    count = lambda kind: F.size(F.filter("rows", lambda r: r["kind"] == kind))
    score = F.when(F.col(score_col) < 0, None).when(F.col(score_col) > 1, F.col(score_col) / 100).otherwise(F.col(score_col))
    out = done.select(
        id_col, "repaired", count("header").alias("n_headers"), count("page_number").alias("n_page_numbers"), count("hyphen").alias("n_hyphens"),
        count("misread").alias("n_misread"), "n_running", score.alias("score"),
    )
    share = F.col("n_misread") / F.greatest("n_running", F.lit(1))
    return out.withColumn("misread_share", share).withColumn("score_fits", F.when(F.col("score").isNull(), None).otherwise((F.col("score") >= 0.9) == (share <= 0.1)))
