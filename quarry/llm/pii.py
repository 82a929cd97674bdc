"""Personal data: base patterns, and spans that boosted trees add from a wide choice of candidates.

Generators propose overlapping candidates with high recall: cards inside longer runs of digits, phone numbers in national or
unmarked form, addresses with blanks around the dots, e-mail addresses that are spelled out. Gradient-boosted trees score each
candidate by its format and what stands around it; a threshold for each kind, calibrated for precision on cases of other making,
selects those that are added. The trees are fitted on a fixed number of generated examples (EXAMPLES) and on filled-in sentences of
office prose, whose negatives are what candidates in such text mostly are: section, book and part numbers, totals, scores. Sentences
of other forms give the thresholds.

Patterns take time in proportion to a text's length, whatever is in it: they start at separators or at the first digit of a run.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

KINDS = ("email", "ip", "card", "phone")
#: Generated examples of each kind and side that the trees see, and sentences of each form that calibrate the thresholds.
EXAMPLES, CASES = 400, 40
#: Share of added spans that must be right on the calibration sentences.
PRECISION = 0.995
#: Candidates that are scored at a time.
BLOCK = 4096

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # from a run's first digit: what fails there fails at its others
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def is_byte(digits: str) -> bool:
    """Whether a number of any length is at most 255; int() refuses very long ones."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four patterns, leftmost and not overlapping within a kind; a match that fails its test is dropped."""
    found = []
    if "@" in text:
        found += [(0, *m.span()) for m in _addresses(text)]
    if _DIGIT.search(text) is None:
        return found
    if "." in text:
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(is_byte, m[0].split(".")))]
    found += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


_RUN_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+")


def _addresses(text: str):
    """The same matches as finditer gives, but starting from each @, so that a long word without one isn't tried at each character."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _RUN_BEFORE.match(text[start - 1]):
            start -= 1
        m = _LOCAL.match(text, start) if start < at else None
        if m:
            done = m.end()
            yield m
        at = text.find("@", max(at + 1, done))


# --- candidates ---

_SEPARATED = re.compile(r"[+(]?[0-9](?:[\x20().\-/_ ]{0,3}[0-9])+")
_GROUP = re.compile(r"[0-9]+")
_NATIONAL = re.compile(r"(?:(?:\+[0-9]{1,3}|00[0-9]{1,3})[\x20.\-/]{0,2})?\(?[0-9]{3}\)?[\x20.\-/]{1,2}[0-9]{3}[\x20.\-/]{1,2}[0-9]{4}(?![0-9])")
_SPACED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\x20?[.]\x20?|\x20?\[\.\]\x20?|\(\.\))[0-9]{1,3}){3}(?![0-9.])")
_AT = re.compile(r"\s?(?:\(at\)|\[at\]|\{at\}|(?<=\s)at(?=\s)|\(@\)|\[@\])\s?", re.I)
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s|\.)\s?[A-Za-z0-9-]++)+", re.I)
_SPELLED_HINT = re.compile(r"[(\[{](?:at|@|dot)[)\]}]|\sdot\s", re.I)
_HINTS = {
    0: re.compile(r"mail|contact|write|@", re.I),
    1: re.compile(r"\bip\b|host|server|address|addr|from", re.I),
    2: re.compile(r"card|visa|credit|pay|pan\b", re.I),
    3: re.compile(r"tel|phone|call|mobile|fax|cell", re.I),
}
_AGAINST = re.compile(r"order|invoice|version|ver\b|v\.|ref|id\b|isbn|serial|token|hash|sku|total|no\.|build|tracking", re.I)


def _spelled(text: str):
    """Addresses that are spelled out, from each `at`: the word before it, and the domain after it."""
    for m in _AT.finditer(text):
        start = m.start()
        while start and _RUN_BEFORE.match(text[start - 1]):
            start -= 1
        if start < m.start() and (end := _DOMAIN.match(text, m.end())):
            yield 0, start, end.end()


def candidates(text: str) -> list[tuple[int, int, int]]:
    found = set(_spelled(text)) if _SPELLED_HINT.search(text) else set()
    if _DIGIT.search(text) is None:
        return sorted(found)
    found |= {(1, *m.span()) for m in _SPACED_IP.finditer(text)}
    found |= {(3, *m.span()) for m in _NATIONAL.finditer(text) if 9 <= len(digits_of(m[0])) <= 15}
    for m in _SEPARATED.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        for i, (s, _) in enumerate(groups):  # runs of groups that have a card's number of digits and its check digit; the sum of digits bounds them
            digits, j = "", i
            while j < len(groups) and len(digits) + groups[j][1] - groups[j][0] <= 19:
                digits += text[slice(*groups[j])]
                if len(digits) >= 13 and luhn(digits):
                    found.add((2, s, groups[j][1]))
                j += 1
    return sorted(found)


#: Ends of e-mail addresses that are common enough to tell one that is spelled out with plain words.
TAILS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk")
NAMES = ("email", "ip", "card", "phone", "digits", "letters", "length", "groups", "longest", "shortest", "blanks", "hyphens", "dots", "luhn", "parts_fit", "plus", "brackets", "known_part", "glued_before", "glued_after", "hint", "against", "digits_near", "same_digit")


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits, groups = digits_of(span), [len(g) for g in _GROUP.findall(span)]
    before, after = text[max(0, start - 40) : start], text[end : end + 12]
    return [
        *(float(kind == k) for k in range(4)), len(digits), sum(c.isalpha() for c in span), end - start, len(groups), max(groups, default=0), min(groups, default=0),
        span.count(" "), span.count("-"), span.count("."), float(bool(digits) and luhn(digits)), float(all(int(g) <= 255 for g in _GROUP.findall(span) if len(g) < 10) and max(groups, default=0) <= 3),
        float(span[0] == "+" or span[:2] == "00"), float("(" in span), float(span.rpartition(" ")[2].rpartition(".")[2].strip(")]}").lower() in TAILS if kind == 0 else digits[:1] in ("3", "4", "5", "6")),
        float(bool(before) and (before[-1].isalnum() or before[-1] in "-._+")), float(bool(after) and (after[0].isalnum() or after[0] in "-_")),
        float(_HINTS[kind].search(before) is not None), float(_AGAINST.search(before) is not None), sum(c.isdigit() for c in before[-8:] + after[:8]), max((digits.count(c) for c in set(digits)), default=0),
    ]


# --- boosted trees ---


class Boosted:
    """Gradient boosting of depth-3 trees for log loss, on exact splits between the values seen."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3, depth: int = 3, least: float = 4.0):
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.rate, self.trees = rate, []
        cuts = [(np.unique(c)[:-1] + np.unique(c)[1:]) / 2 for c in x.T]
        cuts = [c if len(c) <= 32 else np.unique(np.quantile(c, np.linspace(0, 1, 32))) for c in cuts]
        f = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, depth, least)
            self.trees.append(tree)
            f += rate * self._one(tree, x)

    def _grow(self, x, g, h, at, cuts, depth, least):
        value = float(g[at].sum() / (h[at].sum() + 1))
        if not depth:
            return value
        best, total, weight = (1e-6, None, None), g[at].sum(), h[at].sum()
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = np.searchsorted(c, x[at, j])
            gl, hl = (np.cumsum(np.bincount(b, v[at], len(c) + 1))[:-1] for v in (g, h))
            gain = gl**2 / (hl + 1) + (total - gl) ** 2 / (weight - hl + 1) - total**2 / (weight + 1)
            n = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gain[(n < least) | (len(at) - n < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], j, c[k])
        if best[1] is None:
            return value
        left = x[at, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, at[left], cuts, depth - 1, least), self._grow(x, g, h, at[~left], cuts, depth - 1, least)

    def _one(self, tree, x) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, c, low, high = tree
        return np.where(x[:, j] <= c, self._one(low, x), self._one(high, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = self.start + self.rate * sum(self._one(t, x) for t in self.trees)
        return 1 / (1 + np.exp(-f))


def examples(rng: np.random.Generator, n: int):
    """Generated (text, kind, start, end, is personal): n of each kind and side."""
    pick = lambda *v: v[int(rng.integers(len(v)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 9))))

    def card(good):  # one that isn't has a check digit too, by chance or as book, device and tracking numbers do
        d = (pick("4", "5", "37", "6") if good else pick("0", "1", "2", "7", "8", "9", "4")) + num(int(pick(13, 14, 14)))
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if rng.random() < 0.6 else pick(" ", "-", ".").join(d[i : i + 4] for i in range(0, len(d), 4))

    def make(kind, good):
        lead = " ".join(word() for _ in range(int(rng.integers(0, 5)))) + " "
        tail = pick(" ", ", ", ". ", "\n", " ") + word()
        cue = {0: pick("mail ", "contact ", "", ""), 1: pick("ip ", "host ", "", ""), 2: pick("card ", "", ""), 3: pick("call ", "tel ", "phone ", "", "")}[kind] if good else pick("order ", "ref ", "version ", "token ", "", "id ", "total ")
        if kind == 0:
            at, dot = pick(("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."))
            if not good:
                at, dot = pick((" at ", ". "), (" at ", " dot "), (" at ", " dot "))
            end = pick(*TAILS) if good and (at == " at " or rng.random() < 0.7) else word()
            span = f"{word()}{pick('', '.' + num(2), '.' + word()) if good else ''}{at}{word()}{dot}{end}"
        elif kind == 1:
            parts = [str(int(v)) for v in rng.integers(0, 256, 4)]
            span = pick(" . ", "[.]", ". ", ".").join(parts) if good else pick(".", ". ").join(str(int(v)) for v in rng.integers(200, 999, 4))
        elif kind == 2:
            span = card(good)
            side = num(int(rng.integers(6, 17)))
            if good and rng.random() < 0.4:
                tail = " " + card(True) + tail
            elif not good and rng.random() < 0.5:
                lead += side + pick("", " ")
        else:
            a, b, c = str(int(rng.integers(200, 999))), num(3), num(4)
            if good:
                span = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"+1 ({a}) {b}-{c}")
            else:
                span, lead, tail = f"{a}{pick('-', '.', ' ')}{b}{pick('-', '.', ' ')}{c}", lead + num(4) + pick("-", ".", ""), pick("-", "") + num(3) + tail
        text = lead + cue + span + tail
        return text, kind, len(lead + cue), len(lead + cue + span), good

    return [make(k, bool(g)) for k in range(4) for g in (0, 1) for _ in range(n)]


#: Sentences with a candidate in <>, by kind: those in which it is personal data, then the others. w is a word, W a capitalised one, d a
#: digit, t an end of a domain, p a number up to 255, C a card number, # a check digit. The trees see the first, third ... of each list,
#: the thresholds come from the second, fourth ...
FORMS = {
    0: (
        ["Please send the minutes to <w.w (at) w (dot) t> by Friday.", "For questions: <w [at] w.t>", "Mail <w_dd at w dot t> when the parcel is there.", "<w-w(at)w-w.t> answers within a day.", "Our desk <w {at} w {dot} t> is closed.", "Write to <w.w at w dot w dot t>, not to me (dot)."],
        ["We met <w at w dot> w and left. (dot)", "The train was <late at w. W> said so, dot by dot (at) last.", "The mark <w at w. W> was a [dot].", "She looked <up at w dot w> on the map.", "The value <f(at)w.w> is printed; see [dot].", "They arrived <early at w. There> was a dot on the wall. Mark (dot)."],
    ),
    1: (
        ["The host at <p . p . p . p> does not answer.", "Blocked: <p[.]p[.]p[.]p>, reported twice.", "Gateway <p. p. p. p> was moved to the new rack.", "log from <p(.)p(.)p(.)p> follows", "ssh to <p .p .p .p> fails", "The address <p. p. p. p> is taken."],
        ["See sections <d. d. d. d> of the manual.", "Order of the day <dd. dd. ddd. ddd> as printed.", "Version <d. d. d. dd> is out.", "Sections <d. d. dd. d> were cut.", "Scores were <ddd. ddd. ddd. 9dd> in the end.", "Points <d . d . d . dd> were agreed."],
    ),
    2: (
        ["Charge it to <C>.C and send a receipt.", "card no. <4ddd.dddd.dddd.ddd#> exp 12/29", "Paid with visa <C> C today.", "Number on the card: <5ddd_dddd_dddd_ddd#>", "Pay by <4ddd/dddd/dddd/ddd#> now", "Credit <C> C was refused."],
        ["ISBN <978-d-dddd-dddd-#> is out of print.", "Tracking <9dddddddddddddddd#> left the depot.", "Totals <dd ddd ddd ddd dd#> as of June.", "Started <2024ddddddddd#>dd, ended later.", "Account <ddddddddddddddd#>dddd was opened in 1998.", "Serial <8ddddddddddddd#>-dd-dd on the lid", "Rows: <dd dd dd dd dd dd d#> dd dd dd", "Sizes <d dd d dd ddd d dd d#> in all"],
    ),
    3: (
        ["Phone <(2dd) 555-dddd> after six.", "Call <4dd-5dd-dddd> for a table.", "Tel. <001 3dd 5dd dddd> (office)", "Reach the shop at <6dd.5dd.dddd>, or write.", "My mobile is <7dd 5dd dddd>.", "Fax: <(8dd) 4dd-dddd>"],
        ["Order ref dddd-<ddd-ddd-dddd>-dd is late.", "Part no. <ddd-ddd-dddd>-ddd fits both.", "Totals <ddd ddd dddd>.dd were booked.", "Invoice <ddd.ddd.dddd> was paid.", "Serial <ddd-ddd-dddd> is on the lid.", "Build <ddd.ddd.dddd>.d came out."],
    ),
}


def cases(rng: np.random.Generator, n: int, first: int) -> list[tuple]:
    """Every second of FORMS filled in n times: (text, kind, start, end, is personal)."""
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(3, 9))))
    made = {"w": word, "W": lambda: word().capitalize(), "t": lambda: TAILS[int(rng.integers(len(TAILS)))], "p": lambda: str(rng.integers(0, 256)), "C": lambda: "4ddddddddddddddd"[:-1] + "#"}
    check = lambda m: m[0][:-1] + next(c for c in "0123456789" if luhn(digits_of(m[0]) + c))

    def part(p: str) -> str:
        p = re.sub(r"(?<![A-Za-z])[wWtpC](?![A-Za-z])", lambda m: made[m[0]](), p)
        p = re.sub(r"(?<![a-ce-z])d+(?![a-ce-z])", lambda m: "".join(str(c) for c in rng.integers(0, 10, len(m[0]))), p)
        return re.sub(r"[0-9][0-9 ._/-]*#", check, p)

    out = []
    for kind, sides in FORMS.items():
        for good, forms in zip((True, False), sides, strict=True):
            for form in forms[first::2]:
                cut = re.split("[<>]", form)
                for _ in range(n):
                    before, inside, after = map(part, cut)
                    out.append((before + inside + after, kind, len(before), len(before + inside), good))
    return out


def threshold(p: np.ndarray, right: np.ndarray) -> float:
    """The least score from which on at least PRECISION of the cases are right, half-way to the next one below; 2 if there is none."""
    order = np.argsort(-p, kind="stable")
    p, right = p[order], right[order]
    last = np.append(p[1:] < p[:-1], True)  # of equal scores all are taken, or none
    ok = np.flatnonzero(last & (np.cumsum(right) >= PRECISION * np.arange(1, len(p) + 1)))
    if not len(ok):
        return 2.0
    k = ok[-1]
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else float(p[k])


class Chooser:
    """The fitted trees and each kind's threshold."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        xy = lambda v: (np.array([features(*e[:4]) for e in v], float), np.array([e[4] for e in v], float))
        self.trees = Boosted(*xy(examples(rng, EXAMPLES) + cases(rng, CASES, 0)))
        x, y = xy(cases(rng, CASES, 1))
        p = self.trees.predict(x)
        self.threshold = [threshold(p[x[:, k] == 1], y[x[:, k] == 1]) for k in range(4)]

    def spans(self, text: str) -> tuple[list, list]:
        """Base spans, and all spans: the base ones and the selected candidates that overlap none of their kind, best first."""
        base = base_spans(text)
        taken: list[list] = [[] for _ in KINDS]  # by kind in order, none overlapping another
        for k, s, e in base:
            taken[k].append((s, e))
        good = []
        proposed = [c for c in candidates(text) if free(taken[c[0]], c[1], c[2])]
        for at in range(0, len(proposed), BLOCK):
            part = proposed[at : at + BLOCK]
            p = self.trees.predict(np.array([features(text, *c) for c in part], float))
            good += [(-q, s, k, e) for q, (k, s, e) in zip(p.tolist(), part, strict=True) if q >= self.threshold[k]]
        for _, s, k, e in sorted(good):
            if free(taken[k], s, e):
                insort(taken[k], (s, e))
        return base, [(k, s, e) for k, spans in enumerate(taken) for s, e in spans]


def free(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether none of the spans, which are in order and don't overlap, overlaps this one."""
    at = bisect_left(spans, (start, end))
    return (at == len(spans) or spans[at][0] >= end) and (at == 0 or spans[at - 1][1] <= start)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added, for every whole text.

    Positions are code points, ends exclusive. Null and empty texts have no spans. Rows are independent of each other: equal rows give
    equal results, null keys stay null, an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(Chooser())

    def run(batches):
        choose = known.value
        for b in slices(batches):
            cols = [[] for _ in range(7)]
            for t in b.column(1).to_pylist():
                base, spans = choose.spans(t or "")
                row = [sum(k == i for k, _, _ in base) for i in range(4)]
                for c, v in zip(cols, (*row, hashlib.sha256(joined(sorted(base)).encode()).hexdigest(), joined(spans), len(spans) - len(base)), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long").withColumnRenamed("key", key)


def redact(text: str, spans: list) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first in (start, longest) order counts."""
    out, done = [], 0
    for k, s, e in sorted(spans, key=lambda v: (v[1], -v[2])):
        if s >= done:
            out += text[done:s], f"[{KINDS[k]}]"
            done = e
    return "".join(out) + text[done:]
