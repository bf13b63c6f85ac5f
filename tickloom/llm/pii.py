"""Personal data: rules, and a semi-Markov conditional random field that adds to them.

The rules find e-mail addresses, IP addresses, card and phone numbers in one pass a kind. The field scores
whole candidate segments (shape, digit count, check digit, words before and the like), and a dynamic
program over segments of bounded length chooses boundaries and types together. It is trained here, on a
bounded sample of the corpus that the rules label, with disguised copies of what they found
("name [at] host [dot] org", a phone number without its plus) as further entities. A segment without a
trigger (a digit, an @, a bracketed "at") can be no entity, so the program runs over the surroundings of
triggers only, which changes no result. Decoded segments are added where their posterior probability is
high and no rule's span lies; the rules' spans always stay.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import slices, texts_of
from .common import trimmed

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the contract.
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Tokens and characters a segment has at most.
SEGMENT_TOKENS, SEGMENT_CHARS = 20, 80
TRIGGER = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]", re.I)
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
LETTER = re.compile(r"[^\W\d_]")
CUES = frozenset("tel telephone phone call fax mobile cell card visa credit ip host address mail email contact e".split())
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done, "email"
        at = text.find("@", max(at + 1, done))


def rule_spans(text: str) -> list[Span]:
    """The rules' spans, by start, then kind."""
    found: list[Span] = []
    if "@" in text:
        found += emails(text)
    if DIGIT.search(text):
        if text.count(".") >= 3:
            found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def windows(text: str) -> list[tuple[int, int]]:
    """Surroundings of triggers that hold every possible entity; runs of letters and digits stay whole."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - SEGMENT_CHARS), min(len(text), m.end() + SEGMENT_CHARS)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def features(s: str, before: str, cue: str, after: str) -> list[str]:
    """Features of a whole segment in its surroundings."""
    d = only_digits(s)
    shape = re.sub(r"a+", "a", re.sub(r"9+", "9", "".join("9" if c in "0123456789" else "a" if c.isalnum() else " " if c.isspace() else c for c in s)))
    loose = re.sub(r"x+", "x", shape.replace("9", "x").replace("a", "x"))
    low = s.lower()
    out = ["bias", f"digits{min(len(d), 20)}", f"shape {shape}" if len(shape) <= 24 else "shape long", f"loose {loose}" if len(loose) <= 24 else "loose long", f"words{min(len(s.split()), 6)}"]
    if "@" in s:
        out.append(f"at{s.count('@')}{'.' in s[s.index('@'):]}")
    if m := re.search(r"[\[(]\s?at\s?[\])]", low):
        host = bool(re.fullmatch(r"\s?[\w-]+(\s?([\[(]\s?dot\s?[\])]|\.)\s?[\w-]+)+", low[m.end() :]))
        out.append(f"at in words {min(len(low[: m.start()].split()), 3)} {host} {bool(re.match(r' ?[\[(] ?dot|[.][a-z]', after.lower()))}")
    if s[0] == "+":
        out.append("plus")
    if 12 <= len(d) <= 19 and not re.search(r"[^\W\d_]", s):
        out.append("luhn" if luhn(d) else "no luhn")
    groups = re.findall(r"[0-9]+", s)
    if len(groups) == 4 and not re.search(r"[^0-9.\[\]() ]", s):
        out.append("quad" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "large quad")
    if re.search(r"[^\W\d_]", s):
        out.append("letters")
    if before.isalnum() or before in "+@#_.":
        out.append("glued left")
    if after[:1].isalnum() or after[:1] in ("@", "_"):
        out.append("glued right")
    if cue in CUES:
        out.append(f"cue {cue}")
    return out


def candidates(text: str, a: int, b: int) -> tuple[list[re.Match], list[tuple[int, int, list[str]]]]:
    """Tokens of a window and its segments (first token, token after the last, features)."""
    tokens = list(TOKEN.finditer(text, a, b))
    trigger = [bool(TRIGGER.match(text, t.start())) for t in tokens]
    out = []
    for i, t in enumerate(tokens):
        if not (t[0][0].isalnum() or t[0] in "+("):
            continue
        seen, cue = False, tokens[i - 1][0].lower() if i else ""
        if cue in ":.(" and i > 1:
            cue = tokens[i - 2][0].lower()
        for j in range(i, min(i + SEGMENT_TOKENS, len(tokens))):
            seen = seen or trigger[j]
            end = tokens[j].end()
            if end - t.start() > SEGMENT_CHARS:
                break
            if seen and tokens[j][0][0].isalnum():
                out.append((i, j + 1, features(text[t.start() : end], text[t.start() - 1 : t.start()] if t.start() else "", cue, text[end : end + 6])))
    return tokens, out


@dataclass
class SemiCRF:
    """Weights by (kind, feature) and by (kind before, kind); kind "" is a token outside."""

    weights: dict[tuple[str, str], float] = field(default_factory=dict)
    moves: dict[tuple[str, str], float] = field(default_factory=dict)

    def scored(self, segments: list[tuple[int, int, list[str]]]) -> list[tuple[int, int, str, float]]:
        get = self.weights.get
        return [(i, j, y, sum(get((y, f), 0.0) for f in fs)) for i, j, fs in segments for y in KINDS]

    def lattice(self, n: int, scored: list[tuple[int, int, str, float]]) -> tuple[list[dict[str, float]], list[list[tuple[int, int, str, float]]]]:
        by_end: list[list[tuple[int, int, str, float]]] = [[] for _ in range(n + 1)]
        for k in range(n):
            by_end[k + 1].append((k, k + 1, "", 0.0))
        for s in scored:
            by_end[s[1]].append(s)
        return [{} for _ in range(n + 1)], by_end

    def decode(self, n: int, scored: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
        """Best segmentation into entities of bounded length and single outside tokens."""
        best, by_end = self.lattice(n, scored)
        best[0] = {"": 0.0}
        back: list[dict[str, tuple[int, str]]] = [{} for _ in range(n + 1)]
        move = self.moves.get
        for k in range(1, n + 1):
            for i, _, y, s in by_end[k]:
                for p, v in best[i].items():
                    total = v + s + move((p, y), 0.0)
                    if total > best[k].get(y, -math.inf):
                        best[k][y], back[k][y] = total, (i, p)
        k, y, out = n, max(best[n], key=best[n].get) if n else "", []
        while k:
            i, p = back[k][y]
            if y:
                out.append((i, k, y))
            k, y = i, p
        return out[::-1]

    def marginals(self, n: int, scored: list[tuple[int, int, str, float]]) -> tuple[dict[tuple[int, int, str], float], dict[tuple[str, str], float]]:
        """Posterior probability of each segment, and expected moves (forward-backward, scaled by position)."""
        forward, by_end = self.lattice(n, scored)
        forward[0] = {"": 0.0}
        move = self.moves.get

        def total(xs: list[float]) -> float:
            top = max(xs)
            return top + math.log(sum(math.exp(x - top) for x in xs))

        into: dict[tuple[int, str], float] = {}
        for k in range(1, n + 1):
            parts: dict[str, list[float]] = {}
            for i, _, y, s in by_end[k]:
                if (i, y) not in into:
                    into[i, y] = total([v + move((p, y), 0.0) for p, v in forward[i].items()])
                parts.setdefault(y, []).append(into[i, y] + s)
            forward[k] = {y: total(v) for y, v in parts.items()}
        z = total(list(forward[n].values()))
        backward: list[dict[str, list[float]]] = [{} for _ in range(n + 1)]
        backward[n] = {y: [0.0] for y in forward[n]}
        segments: dict[tuple[int, int, str], float] = {}
        moves: dict[tuple[str, str], float] = {}
        for k in range(n, 0, -1):
            rest = {y: total(v) for y, v in backward[k].items()}
            for i, _, y, s in by_end[k]:
                if y not in rest:
                    continue
                if y:
                    segments[i, k, y] = math.exp(into[i, y] + s + rest[y] - z)
                for p, v in forward[i].items():
                    step = move((p, y), 0.0) + s + rest[y]
                    backward[i].setdefault(p, []).append(step)
                    if p or y:
                        moves[p, y] = moves.get((p, y), 0.0) + math.exp(v + step - z)
        return segments, moves

    def train(self, examples: list[tuple[int, list[tuple[int, int, list[str]]], list[tuple[int, int, str]]]], epochs: int = 4, rate: float = 0.5, decay: float = 0.002) -> None:
        """Stochastic gradient ascent (a step per weight, by its past gradients) on the log-likelihood of
        whole segmentations."""
        past: dict[tuple[str, str], float] = {}

        def moved(w: float, key: tuple[str, str], g: float) -> float:
            g -= decay * w
            past[key] = past.get(key, 0.0) + g * g
            return w + rate * g / math.sqrt(past[key] + 1e-8)

        order = random.Random(11)
        examples = list(examples)
        for _ in range(epochs):
            order.shuffle(examples)
            for n, segments, gold in examples:
                expected, moves = self.marginals(n, self.scored(segments))
                named = {(i, j): fs for i, j, fs in segments}
                change: dict[tuple[str, str], float] = {}
                for (i, j, y), p in expected.items():
                    if p > 1e-4:
                        for f in named[i, j]:
                            change[y, f] = change.get((y, f), 0.0) - p
                for i, j, y in gold:
                    for f in named[i, j]:
                        change[y, f] = change.get((y, f), 0.0) + 1
                for key, g in change.items():
                    self.weights[key] = moved(self.weights.get(key, 0.0), key, g)
                last, at = "", 0
                for i, j, y in gold:
                    if i > at:
                        if last:
                            moves[last, ""] = moves.get((last, ""), 0.0) - 1
                        last = ""
                    moves[last, y] = moves.get((last, y), 0.0) - 1
                    last, at = y, j
                if last and at < n:
                    moves[last, ""] = moves.get((last, ""), 0.0) - 1
                for key, g in moves.items():
                    self.moves[key] = moved(self.moves.get(key, 0.0), ("move", *key), -g)


def example(text: str, a: int, b: int, spans: list[Span]):
    """A training window with its gold segments, or None if a span is no segment here."""
    tokens, segments = candidates(text, a, b)
    starts, ends = {t.start(): k for k, t in enumerate(tokens)}, {t.end(): k + 1 for k, t in enumerate(tokens)}
    known, gold, at = {(i, j) for i, j, _ in segments}, [], 0
    for s, e, kind in spans:
        if not (a <= s and e <= b):
            if s < b and e > a:
                return None
            continue
        i, j = starts.get(s), ends.get(e)
        if (i, j) not in known:
            return None
        if i >= at:  # of overlapping rule spans the first is the entity
            gold.append((i, j, kind))
            at = j
    return len(tokens), segments, gold


def disguised(kind: str, said: str, r: random.Random) -> str:
    """The same datum in a form that the rules miss."""
    d = only_digits(said)
    if kind == "email":
        at, dot = r.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" (at) ", ".")])
        name, _, host = said.partition("@")
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return said.replace(".", r.choice(["[.]", "(.)"]))
    if kind == "card":
        return r.choice([".", " - "]).join(d[k : k + 4] for k in range(0, len(d), 4))
    return r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(d[-10:-7] or "212", d[-7:-4], d[-4:])


#: Numbers that are no personal data, so that the field meets them whatever the sample holds.
PLAIN_NUMBERS = ("2024-01-31", "31.12.1999", "12:30", "1,234,567.89", "version 2.0.1", "v10.4.2-rc1", "3.14159", "page 12-14", "1999-2004", "$19.99", "(42)", "2 x 4", "chapter 3.2.1", "10000000", "978-3-16-148410-0", "room 404", "50%", "1/2", "A4")


def train_field(texts: list[str], examples_at_most: int = 150) -> SemiCRF:
    """A field from sample texts that the rules label, disguised copies, and plain numbers."""
    r, examples = random.Random(7), []
    found: list[tuple[str, str]] = [("email", "jo.doe34@mail7.example.com"), ("ip", "97.51.17.173"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0100")]
    for text in texts:
        spans = rule_spans(text)
        found += [(k, text[a:b]) for a, b, k in spans]
        for a, b in windows(text):
            if b - a <= 4 * SEGMENT_CHARS and (x := example(text, a, b, [s for s in spans if a <= s[0] < b])):
                examples.append(x)
    r.shuffle(examples)
    examples = examples[:examples_at_most]
    frames = ["write to {} or", "the {} of", "is {}, and", "Contact: {}", "({})", "see {}. The"]
    for kind, said in (found[k % len(found)] for k in range(80)):
        for s in (said, disguised(kind, said, r)):
            frame = r.choice(frames)
            text, a = frame.format(s), frame.index("{")
            if x := example(text, 0, len(text), [(a, a + len(s), kind)]):
                examples.append(x)
    for plain in PLAIN_NUMBERS:
        for frame in frames[:3]:
            text = frame.format(plain)
            if x := example(text, 0, len(text), []):
                examples.append(x)
    crf = SemiCRF()
    crf.train(examples)
    return crf


class Window:
    """A window of a text for decoding: tokens and segments as flat arrays of numbers, so that a window may be as long as a text.

    What `features` says of a segment follows from a few properties that grow token by token; segments with equal
    properties share a line of scores, one a kind, that `Scores` keeps."""

    def __init__(self, text: str, a: int, b: int, scores: Scores):
        self.starts, self.ends = array("q"), array("q")
        pieces, plain, trigger, opens, closes, low = [], [], bytearray(), bytearray(), bytearray(), []
        for m in TOKEN.finditer(text, a, b):
            said = m[0]
            self.starts.append(m.start())
            self.ends.append(m.end())
            digit, letter = "0" <= said[0] <= "9", bool(LETTER.match(said))
            pieces.append("9" if digit else "a" if said[0].isalnum() else said)
            plain.append(digit or said in ".[]()")
            trigger.append(bool(TRIGGER.match(text, m.start())))
            opens.append(said[0].isalnum() or said in "+(")
            closes.append(said[0].isalnum())
            low.append(said.lower() if letter and len(said) <= 12 else "" if letter else said)
        self.first, self.to, self.line = array("q", [0]), array("i"), array("i")
        n = len(self.starts)
        for i in range(n):
            if opens[i]:
                self._from(text, i, n, pieces, plain, trigger, closes, low, scores)
            self.first.append(len(self.to))

    def _from(self, text, i, n, pieces, plain, trigger, closes, low, scores) -> None:
        starts, ends = self.starts, self.ends
        start = starts[i]
        before = text[start - 1 : start] if start else ""
        glued = before.isalnum() or before in "+@#_."  # a text's start too
        cue = low[i - 1] if i else ""
        if cue and cue in ":.(" and i > 1:
            cue = low[i - 2]
        cue = cue if cue in CUES else ""
        seen = letters = worded = False
        plus = text[start] == "+"
        shape = loose = ""
        digits, words, ats, dotted, quads, bare, large = 0, 1, 0, False, 0, True, False
        for j in range(i, min(i + SEGMENT_TOKENS, n)):
            end, at = ends[j], starts[j]
            if end - start > SEGMENT_CHARS:
                break
            piece = pieces[j]
            if j > i and (gap := at - ends[j - 1]):
                shape, loose, words = shape + " " * gap, loose + " " * gap, words + 1
                bare = bare and text[ends[j - 1] : at].count(" ") == gap
            if not (piece in "9a" and shape.endswith(piece)):
                shape += piece
            wide = "x" if piece in "9ax" else piece
            if not (wide == "x" and loose.endswith("x")):
                loose += wide
            bare = bare and plain[j]
            if piece == "9":
                quads, digits = quads + 1, digits + end - at
                large = large or end - at > 3 or int(text[at:end]) > 255
            elif piece == "a":
                letters = letters or bool(low[j] == "" or LETTER.match(low[j]))
                worded = worded or low[j] == "at"
            elif piece == "@":
                ats += 1
            elif piece == "." and ats:
                dotted = True
            seen = seen or bool(trigger[j])
            if not (seen and closes[j]):
                continue
            after = text[end : end + 1]
            right = after.isalnum() or (after != "" and after in "@_")
            if worded:  # an "at" in words: rare, and its surroundings count
                found = tuple(features(text[start:end], before, cue, text[end : end + 6]))
                line = scores.line(found, found)
            else:
                check = (1 if luhn(only_digits(text[start:end])) else 2) if 12 <= digits <= 19 and not letters else 0
                quad = (2 if large else 1) if quads == 4 and bare else 0
                short, wide = shape if len(shape) <= 24 else None, loose if len(loose) <= 24 else None
                line = scores.line((min(digits, 20), short, wide, min(words, 6), ats, dotted, plus, check, quad, letters, glued, right, cue))
            self.to.append(j + 1)
            self.line.append(line)


class Scores:
    """Scores of segments by their properties: a line of one score a kind, and the number of each line."""

    def __init__(self, crf: SemiCRF):
        self.get, self.lines, self.numbers = crf.weights.get, [], {}

    def line(self, key: tuple, found: tuple[str, ...] | None = None) -> int:
        at = self.numbers.get(key)
        if at is None:
            names = found or self.names(*key)
            at = self.numbers[key] = len(self.lines)
            self.lines.append(tuple(sum(self.get((y, f), 0.0) for f in names) for y in KINDS))
        return at

    @staticmethod
    def names(digits, shape, loose, words, ats, dotted, plus, check, quad, letters, glued, right, cue) -> list[str]:
        """The features, in the order of `features`."""
        out = ["bias", f"digits{digits}", "shape long" if shape is None else f"shape {shape}", "loose long" if loose is None else f"loose {loose}", f"words{words}"]
        out += [f"at{ats}{dotted}"] * bool(ats) + ["plus"] * plus + [("", "luhn", "no luhn")[check]] * bool(check) + [("", "quad", "large quad")[quad]] * bool(quad)
        return out + ["letters"] * letters + ["glued left"] * glued + ["glued right"] * right + [f"cue {cue}"] * bool(cue)


STATES = ("", *KINDS)


def decoded(window: Window, crf: SemiCRF, lines: list[tuple[float, ...]]) -> list[tuple[int, int, str]]:
    """The best segmentation of a window, as `SemiCRF.decode` gives it, with two small numbers a token and state to walk back by."""
    n, first, to, line = len(window.starts), window.first, window.to, window.line
    move = [[crf.moves.get((p, y), 0.0) for p in STATES] for y in STATES]
    none = -math.inf
    ring = [[none] * 5 for _ in range(SEGMENT_TOKENS + 1)]  # best scores of the places that segments can still reach
    ring[0][0] = 0.0
    length, came = bytearray(5 * (n + 1)), bytearray(5 * (n + 1))
    for i in range(n):
        here = ring[i % (SEGMENT_TOKENS + 1)]
        enter = []
        for y in range(5):
            m = move[y]
            totals = [here[p] + m[p] for p in range(5)]
            top = max(totals)
            enter.append((top, totals.index(top)))
        out = ring[(i + 1) % (SEGMENT_TOKENS + 1)]
        if enter[0][0] > out[0]:
            out[0], length[5 * (i + 1)], came[5 * (i + 1)] = enter[0][0], 1, enter[0][1]
        for k in range(first[i], first[i + 1]):
            j, score = to[k], lines[line[k]]
            out = ring[j % (SEGMENT_TOKENS + 1)]
            for y in (1, 2, 3, 4):
                total = enter[y][0] + score[y - 1]
                if total > out[y]:
                    out[y], length[5 * j + y], came[5 * j + y] = total, j - i, enter[y][1]
        if i + 1 < n:
            ring[i % (SEGMENT_TOKENS + 1)] = [none] * 5
    last = ring[n % (SEGMENT_TOKENS + 1)]
    k, y, found = n, last.index(max(last)), []
    while k:
        i, p = k - length[5 * k + y], came[5 * k + y]
        if y:
            found.append((i, k, STATES[y]))
        k, y = i, p
    return found[::-1]


def posteriors(window: Window, crf: SemiCRF, lines: list[tuple[float, ...]], asked: list[tuple[int, int, str]]) -> list[float]:
    """The posterior probability of each asked segment, as `SemiCRF.marginals` gives it, with one number a token and state."""
    n, first, to, line = len(window.starts), window.first, window.to, window.line
    move = [[crf.moves.get((p, y), 0.0) for p in STATES] for y in STATES]
    none = -math.inf

    def both(a: float, b: float) -> float:
        if a < b:
            a, b = b, a
        return a if b == none else a + math.log1p(math.exp(b - a))

    def into(y: int, i: int) -> float:
        total, m = none, move[y]
        for p in range(5):
            if forward[5 * i + p] > none:
                total = both(total, forward[5 * i + p] + m[p])
        return total

    forward = array("d", [none]) * (5 * (n + 1))
    forward[0] = 0.0
    for i in range(n):
        enter = [into(y, i) for y in range(5)]
        forward[5 * i + 5] = both(forward[5 * i + 5], enter[0])
        for k in range(first[i], first[i + 1]):
            at, score = 5 * to[k], lines[line[k]]
            for y in (1, 2, 3, 4):
                forward[at + y] = both(forward[at + y], enter[y] + score[y - 1])
    z = none
    for v in forward[5 * n :]:
        z = both(z, v)
    backward = array("d", [none]) * (5 * (n + 1))
    for y in range(5):
        backward[5 * n + y] = 0.0
    for i in range(n - 1, -1, -1):
        rest = [backward[5 * i + 5], none, none, none, none]
        for k in range(first[i], first[i + 1]):
            at, score = 5 * to[k], lines[line[k]]
            for y in (1, 2, 3, 4):
                rest[y] = both(rest[y], score[y - 1] + backward[at + y])
        for p in range(5):
            total = none
            for y in range(5):
                if rest[y] > none:
                    total = both(total, move[y][p] + rest[y])
            backward[5 * i + p] = total
    out = []
    for i, j, kind in asked:
        y = STATES.index(kind)
        score = next((lines[line[k]][y - 1] for k in range(first[i], first[i + 1]) if to[k] == j), none)
        out.append(math.exp(min(0.0, into(y, i) + score + backward[5 * j + y] - z)))
    return out


def field_spans(text: str, crf: SemiCRF, taken: list[Span], least: float = 0.5) -> list[Span]:
    """Decoded segments with a posterior of `least` or more (the likeliest reading by far, as rivals share the rest) that no span in
    `taken` (sorted by start) overlaps. Time and memory grow in proportion to a window's tokens."""
    out, begins, reach = [], [s for s, _, _ in taken], []
    for _, e, _ in taken:
        reach.append(max(e, reach[-1]) if reach else e)
    scores = Scores(crf)
    for a, b in windows(text):
        window = Window(text, a, b, scores)
        fresh = []
        for i, j, y in decoded(window, crf, scores.lines):
            before = bisect_left(begins, window.ends[j - 1])  # spans that start before the segment ends
            if not before or reach[before - 1] <= window.starts[i]:
                fresh.append((i, j, y))
        if fresh:
            sure = posteriors(window, crf, scores.lines, fresh)
            out += [(window.starts[i], window.ends[j - 1], y) for (i, j, y), p in zip(fresh, sure, strict=True) if p >= least]
    return out


def all_spans(text: str, crf: SemiCRF) -> tuple[list[Span], list[Span]]:
    """(the rules' spans, all spans)."""
    base = rule_spans(text)
    if not TRIGGER.search(text):
        return base, base
    return base, sorted(base + field_spans(text, crf, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def sample_field(docs: DataFrame, sample: int = 300, text: str = "text") -> SemiCRF:
    """Trains on the `sample` texts with a trigger whose hashes are smallest: a bounded, repeatable sample.

    Of each text only its triggers' surroundings come to the driver, at most 4000 characters a text.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = ["\n".join(t[a:b] for a, b in windows(t))[:4000] for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], names=["t"])
        trimmed()

    chosen = docs.select(F.col(text).alias("t")).filter(F.col("t").rlike("[0-9@]")).select(F.xxhash64("t").alias("h"), "t").orderBy("h", "t").limit(sample)
    return train_field(sorted(r.t for r in chosen.select("t").mapInArrow(cut, "t string").collect()))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame, crf: SemiCRF | None = None) -> DataFrame:
    """Counts and places of personal data in every whole text (null: empty).

    n_* count the rules' spans, `spans` lists all, `n_added` counts the field's. Defined cases: repeated rows
    give a row each; an empty table gives none; other columns are not read.
    """
    crf = crf or sample_field(docs)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [all_spans(t, crf) for t in texts_of(batch.column(1))]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(listed(base).encode("ascii")).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([listed(s) for _, s in rows], pa.string()), pa.array([len(s) - len(base) for base, s in rows], pa.int64())], names=names)
        trimmed()

    schema = docs.select("doc_id").schema
    for name in names[1:]:
        schema = schema.add(name, "string" if name in ("base_sha256", "spans") else "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, crf: SemiCRF | None = None) -> DataFrame:
    """The same rows and columns, with personal data replaced in `text` and `n_chars` counted anew.

    Defined cases: texts without any (null and empty ones too) stay as they are, with their n_chars; repeated rows
    change alike; an empty table stays empty; a table may lack `n_chars`; other columns of any name stay as they are.
    """
    crf = crf or sample_field(docs)
    names = docs.columns
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = list(batch.columns)
            old = columns[text].to_pylist()
            new = [t and redacted(t, all_spans(t, crf)[1]) for t in old]
            columns[text] = pa.array(new, columns[text].type)
            if chars is not None:
                kept = columns[chars].to_pylist()
                columns[chars] = pa.array([n if a == b else len(b) for n, a, b in zip(kept, old, new, strict=True)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)
        trimmed()

    return docs.mapInArrow(run, docs.schema)
