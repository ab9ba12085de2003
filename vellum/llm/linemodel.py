"""Labelled lines and the fitted hidden Markov model of ``quality``.

The labelled rows at hand are running text (``lang_refs``). Lines of the other three labels are made from
their words by rule, with a fixed seed: entries, cells and unreadable matter in many layouts. Whole
documents of a few blocks are made, so that the changes from line to line are counted too. Emissions are a
softmax regression over line statistics, divided by the label shares; transitions are smoothed counts.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

import numpy as np

PROSE, LIST, TABLE, JUNK = range(4)
SYMBOLS = "#@%^&*~|<>{}[]=+_/\\■□¦§¶"
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XVII", "XX")


@dataclass
class LineModel:
    weights: np.ndarray  # features x labels
    prior: np.ndarray  # log share of each label among the labelled lines
    start: np.ndarray  # log probability of a document's first label
    trans: np.ndarray  # log probability of each change of label


class Maker:
    """Lines of each label from the words and sentences of labelled running text."""

    def __init__(self, samples: list[tuple[str, str]], seed: int):
        self.rnd = random.Random(seed)
        self.texts = [t for _, t in samples if len(t.split()) >= 8] or ["a few words of the text that is at hand"]
        self.vocab = sorted({w.strip(".,;:!?\"'()").lower() for t in self.texts for w in t.split() if w.strip(".,;:!?\"'()").isalpha()}) or ["word"]
        self.long = [w for w in self.vocab if len(w) > 4] or self.vocab

    def pick(self, seq):
        return seq[int(self.rnd.random() * len(seq))]

    def chance(self, p: float) -> bool:
        return self.rnd.random() < p

    def n(self, lo: int, hi: int) -> int:
        return lo + int(self.rnd.random() * (hi - lo + 1))

    def phrase(self, lo: int, hi: int) -> str:
        """A few words as they stand together in a text, or single words."""
        k = self.n(lo, hi)
        if self.chance(0.5):
            return " ".join(self.pick(self.long) for _ in range(k))
        ws = [w.strip(".,;:!?\"'()") for w in self.pick(self.texts).split()]
        at = self.n(0, max(0, len(ws) - k))
        return " ".join(ws[at : at + k])

    def name(self) -> str:
        return self.pick(self.long).capitalize()

    def figure(self) -> str:
        return self.pick((str(self.n(1, 9)), str(self.n(10, 999)), f"{self.n(1, 400)}.{self.n(1, 99)}", str(self.n(1700, 1899)), f"{self.n(1, 9)},{self.n(100, 999)}"))

    # running text
    def prose(self) -> list[str]:
        text = " ".join(self.pick(self.texts) for _ in range(self.n(1, 4)))
        how = self.n(0, 9)
        if how == 0:
            text = text.upper()
        elif how == 1:
            text = text.lower().translate(str.maketrans("", "", ".,;:!?"))
        elif how == 2:
            text = "".join(self.pick("oeainrtl") if c.isalpha() and self.chance(0.03) else c for c in text)
        elif how == 3:
            ws = text.split()
            for i in range(len(ws)):
                if self.chance(0.12):
                    ws[i] = self.figure()
            text = " ".join(ws)
        elif how == 4:  # verse
            ws, out = text.split(), []
            while ws:
                k = self.n(5, 8)
                out.append(" ".join(ws[:k]).capitalize() + self.pick((",", "", ";", ".")))
                ws = ws[k:]
            return out
        elif how == 5:  # a play
            return [f"{self.name().upper()}. {self.pick(self.texts)}" for _ in range(self.n(2, 6))]
        if self.chance(0.4):
            return [text]
        width, out = self.n(45, 90), [""]
        for w in text.split():
            if len(out[-1]) + len(w) > width:
                out.append("")
            out[-1] += (" " if out[-1] else "") + w
        return out

    # entries
    def listing(self) -> list[str]:
        how, k = self.n(0, 10), self.n(4, 18)
        if how == 0:
            mark = self.pick(("-", "*", "•", "—", "·"))
            return [f"{mark} {self.phrase(1, 9)}" for _ in range(k)]
        if how == 1:
            form = self.pick(("{}. ", "({}) ", "{}) "))
            return [form.format(i + 1 if self.chance(0.9) else self.pick("abcdefgh")) + self.phrase(1, 10) + self.pick(("", ".", ";")) for i in range(k)]
        if how == 2:
            return [f"{self.phrase(1, 6).capitalize()} {'.' * self.n(3, 20)} {self.n(1, 400)}" for _ in range(k)]
        if how == 3:
            return [f"{self.phrase(1, 3).capitalize()}, " + ", ".join(str(self.n(1, 500)) for _ in range(self.n(1, 4))) for _ in range(k)]
        if how == 4:
            return [f"{self.name()}, {self.pick('ABCDEFGHJ')}.{self.pick((', ', ' '))}{self.phrase(2, 7).capitalize()}{self.pick(('. ', ', '))}{self.name()}, {self.n(1700, 1899)}{self.pick(('', '.'))}" for _ in range(k)]
        if how == 5:
            return ["; ".join(self.phrase(1, 5) + (f", {self.n(2, 400)} {self.pick(self.long)}" if self.chance(0.2) else "") for _ in range(self.n(8, 60))) + self.pick((".", ""))]
        if how == 6:
            head = self.pick(("CHAP. {}. ", "SECT. {}. ", "{}. ", "LETTER {}. "))
            return [head.format(self.pick(ROMAN)) + self.pick((" — ", " - ", ". — ")).join(self.phrase(2, 5).capitalize() for _ in range(self.n(2, 4))) for _ in range(k)]
        if how == 7:
            return [self.phrase(1, 4).capitalize() for _ in range(k)]
        if how == 8:
            return [f"{self.name()} — {self.phrase(2, 6)}{self.pick(('', '.'))}" for _ in range(k)]
        if how == 9:
            return [f"{self.name()}, {self.phrase(1, 3)}; {self.phrase(1, 3)}, {self.n(1, 400)}{self.pick((';', '.', ''))}" for _ in range(k)]
        return [f"{self.phrase(1, 4).capitalize()}, see {self.phrase(1, 2).capitalize()}." if self.chance(0.3) else f"{self.phrase(1, 4).capitalize()}, p. {self.n(1, 400)}" for _ in range(k)]

    # cells
    def table(self) -> list[str]:
        how, k, c = self.n(0, 7), self.n(4, 16), self.n(2, 7)
        worded = self.chance(0.4)
        cell = lambda: self.pick((self.figure(), self.figure(), "do.", "—", "ditto")) if not worded or self.chance(0.3) else self.phrase(1, 2)
        if how == 0:
            return ["| " + " | ".join([self.name(), *(cell() for _ in range(c))]) + " |" for _ in range(k)]
        if how == 1:
            w = self.n(8, 18)
            return ["".join(x[: w - 2].ljust(w) for x in [self.name(), *(cell() for _ in range(c))]).rstrip() for _ in range(k)]
        if how == 2:
            return ["\t".join([self.name(), *(cell() for _ in range(c))]) for _ in range(k)]
        if how == 3:
            return [";".join([self.name(), *(cell() for _ in range(c))]) for _ in range(k)]
        if how == 4:
            keys = [self.name()[:4] + "." for _ in range(c)]
            return [f"{self.name()}: " + " ; ".join(f"{x} {cell()}" for x in keys) for _ in range(k)]
        if how == 5:
            return [" ".join([self.name(), *(self.figure() for _ in range(c + 1))]) for _ in range(k)]
        if how == 6:
            return ["  ".join(self.figure() for _ in range(c + 1)) for _ in range(k)]
        return [f"{self.phrase(1, 2).capitalize()} {'.' * self.n(3, 9)} " + "  ".join(self.figure() for _ in range(c)) for _ in range(k)]

    # unreadable matter
    def junk(self) -> list[str]:
        how, k = self.n(0, 9), self.n(2, 10)
        some = lambda chars, lo, hi: "".join(self.pick(chars) for _ in range(self.n(lo, hi)))
        if how == 0:
            return [" ".join(some(string.ascii_lowercase, 2, 11) for _ in range(self.n(6, 30))) for _ in range(k)]
        if how == 1:
            return [some(string.ascii_letters + string.digits + "+/", 40, 90) for _ in range(k)]
        if how == 2:
            return [some(SYMBOLS + string.digits + string.ascii_letters + "  ", 30, 90) for _ in range(k)]
        if how == 3:
            return [" ".join("".join(self.pick("bcdfglmnprstvz") + self.pick("aeiou") for _ in range(self.n(1, 4))) + self.pick(("", "", "#", "x", "q", str(self.n(1, 9)))) for _ in range(self.n(20, 60)))]
        if how == 4:
            tag = self.pick(self.long)
            return [f'<div class="{tag}"><a href="/{some(string.ascii_lowercase, 4, 9)}?id={self.n(1, 9999)}">{tag}</a></div>' for _ in range(k)]
        if how == 5:
            return [f"{self.n(10, 23)}:{self.n(10, 59)}:{self.n(10, 59)} [{some(string.hexdigits, 6, 8)}] {self.pick(self.long)}={self.n(0, 999)} {some(string.ascii_lowercase, 3, 7)}_{some(string.ascii_lowercase, 3, 7)}={some(string.hexdigits, 8, 16)}" for _ in range(k)]
        if how == 6:
            return [" ".join([self.phrase(1, 5) + self.pick((".", "!", "", ","))] * self.n(12, 50))]
        if how == 7:
            return [f"{self.phrase(1, 5).capitalize()}{self.pick(('', '.', '!'))}"] * self.n(12, 40)
        if how == 8:
            keys = self.pick(("asdfjkl;ewioruqp  ", "qwertyuiop[] asdf ghj", "zxcvbnm,./ lkjhg ", "fjdksla;  "))
            return [some(keys, 15, 90).strip() for _ in range(k)]
        marks, rate = self.pick((SYMBOLS + string.digits, ";:'|.,-~1 ", SYMBOLS + ";:',.-" + string.ascii_lowercase)), self.rnd.uniform(0.2, 0.5)
        return [" ".join("".join(self.pick(marks) if self.chance(rate) else c for c in w) for w in self.pick(self.texts).split()) for _ in range(k)]

    def document(self) -> list[tuple[str, int]]:
        """Lines with labels: mostly one label; else blocks of prose and of another, with a title now and then."""
        make = (self.prose, self.listing, self.table, self.junk)
        titles = {LIST: ("INDEX.", "CONTENTS.", "A LIST.", "LIST OF PLATES."), TABLE: (f"TABLE {self.pick(ROMAN)}.",), JUNK: (), PROSE: (f"CHAPTER {self.pick(ROMAN)}.",)}
        main = self.pick((PROSE, PROSE, LIST, TABLE, JUNK))
        plan = [main] * self.n(1, 3) if self.chance(0.6) else [self.pick((PROSE, main)) for _ in range(self.n(2, 4))]
        out: list[tuple[str, int]] = []
        for kind in plan:
            if titles[kind] and self.chance(0.3):
                out.append((self.pick(titles[kind]), kind))
            out += [(line, kind) for line in make[kind]() if line.strip()]
        return out


def labelled_documents(samples: list[tuple[str, str]], n_docs: int, seed: int = 11) -> list[list[tuple[str, int]]]:
    maker = Maker(samples, seed)
    return [d for d in (maker.document() for _ in range(n_docs)) if d]


def softmax_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int, ridge: float = 1e-3, rounds: int = 200) -> np.ndarray:
    """Weights of a softmax regression, by accelerated gradient steps."""
    w = np.zeros((x.shape[1], k))
    target = np.eye(k)[y]
    share = (weight / weight.sum())[:, None]
    step = 1.0 / (0.5 * np.linalg.norm(x * np.sqrt(share), 2) ** 2 + ridge)
    ahead, t = w, 1.0
    for _ in range(rounds):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * (x.T @ (share * (p - target)) + ridge * ahead)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, ahead, t = new, new + (t - 1) / t2 * (new - w), t2
    return w


def counted(documents: list[list[int]], k: int, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the first label and of each change of label."""
    start, trans = np.full(k, smooth), np.full((k, k), smooth)
    for labels in documents:
        start[labels[0]] += 1
        np.add.at(trans, (labels[:-1], labels[1:]), 1)
    return np.log(start / start.sum()), np.log(trans / trans.sum(axis=1, keepdims=True))
