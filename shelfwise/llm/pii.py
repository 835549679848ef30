"""Personal data by boosted trees over candidate spans.

*Base* spans follow fixed rules per kind (e-mail, IP address, card number, phone number) and always stay.

*Candidates* come from generators with high recall that may overlap: e-mail forms with written-out or bracketed "at" and
"dot", dotted numbers, and every run of 7 to 19 digits in consecutive groups, phone numbers without a plus sign among them.
Boosted regression trees score each candidate from its format and the characters and words around it; a threshold per kind,
set on held-out candidates so that at least ``PRECISION`` of the accepted ones are right, selects the added spans. An added
span never overlaps a base span or a better one; of equal ones the longer stays.

Nobody labels spans here, so the labels are made. Right: rule-conforming spans, and reformatted copies of them, alone and side
by side. Wrong: candidates that fail a check of their kind or are of another kind, cut-outs of right spans, random digits.
Candidates that no check decides are not used. All documents are searched for both; of each kind, right and wrong, the
``SAMPLE_SPANS`` / 8 with the smallest hashes are used. A kind without enough held-out proof adds nothing; it is logged and in
``Detector.silent``.

Null and empty texts have no spans. Offsets are code points, the end exclusive. Rows with equal ids are independent.
"""

from __future__ import annotations

import hashlib
import logging
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import fresh, pick, quoted, stored

KINDS = ("email", "ip", "card", "phone")
SAMPLE_SPANS = 12_000
PRECISION = 0.99
#: Characters that features read before and after a span.
BEFORE, AFTER = 24, 12
#: Longer spans are not used for training.
LONGEST = 400
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Only from the start of a digit run: the match is the same, and long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# generators; every one starts at a character that text seldom holds, so that scanning stays linear
_AT = re.compile(r"\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?|\s(?:at|AT)\s(?=[A-Za-z0-9-]{1,63}\s(?:dot|DOT)\s)|\s?@\s?")
_WORDS_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({]\s?(?:dot|DOT|\.)\s?[\])}]|\s(?:dot|DOT)\s)\s?[A-Za-z0-9-]{1,63}){1,5}")
_GROUP = re.compile(r"[0-9]+")
_JOINING = re.compile(r"[\x20()./-]{1,2}")
_DOTTED = re.compile(r"[0-9]{1,5}(?:\s?\.\s?[0-9]{1,5}){3,5}")
_HINTS = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login", re.I),
    "card": re.compile(r"card|visa|pay|credit|account", re.I),
    "phone": re.compile(r"\btel|phone|call|fax|mobile", re.I),
}
_DIGIT_BEFORE = re.compile(r"[0-9][\x20()./-]{0,2}\Z")
_DIGIT_AFTER = re.compile(r"[\x20()./-]{0,2}\+?[0-9]")
_LETTERS_LAST = re.compile(r"[A-Za-z]{2,}\Z")
_AGAINST = re.compile(r"version|isbn|order|invoice|section|\bno\.|=|#|\bid\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_emails(text: str) -> Iterator[tuple[int, int]]:
    """The e-mail rule, from each ``@`` outwards: linear where scanning from every letter would be quadratic."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind: leftmost, not overlapping within a kind; matches that fail the kind's check are dropped."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = list(base_emails(text))
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-12:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of every run of consecutive digit groups with 7 to 19 digits, overlaps included."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    for i, (start, _) in enumerate(groups):
        count, last = 0, None
        for a, b in groups[i : i + 19]:
            if last is not None and not (a - last <= 2 and _JOINING.fullmatch(text, last, a)):
                break
            count, last = count + b - a, b
            if count > 19:
                break
            if count >= 7:
                first = start - (text[start - 1 : start] == "+")
                yield first - (text[first - 1 : first] == "("), b, count


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data, overlaps included."""
    found = []
    if "@" in text or " at " in text or " AT " in text or "at]" in text or "at)" in text or "AT" in text:
        for m in _AT.finditer(text):
            before = _WORDS_BEFORE.search(text, max(0, m.start() - 64), m.start())
            after = _HOST.match(text, m.end())
            if before and after:
                found.append(("email", before.start(), after.end()))
    for m in _DOTTED.finditer(text):
        found.append(("ip", *m.span()))
    for a, b, count in numbers(text):
        if count <= 15:
            found.append(("phone", a, b))
        if count >= 13:
            found.append(("card", a, b))
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one span."""
    span, digits = text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    groups = re.findall(r"[0-9]+", span)
    parts = span.replace(" ", "").split(".")
    hint, against = _HINTS[kind], _AGAINST
    last, first = before[-1:], after[:1]
    return [
        float(KINDS.index(kind)), float(len(span)), float(len(digits)), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(span.count(" ")), float(span.count("-")), float(span.count(".")), float(span.count("(") == span.count(")")),
        float(span.count("(")), float("+" in span), float(span.count("@")), float(len(set(digits))),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(len(parts) == 4 and all(p.isdigit() and int(p[-9:]) <= 255 for p in parts)),
        float(bool(hint.search(before))), float(bool(against.search(before))),
        float(last.isalnum()), float(last in ".-/=#" and last != ""), float(first.isalnum()), float(first in "-/%" and first != ""),
        float(len(span.rsplit(".", 1)[-1]) if kind == "email" else 0),
        float(bool(re.search(r"[\[({\s](?:at|AT|@)[\])}\s]", span))), float(bool(re.search(r"(?:19|20)[0-9]{2}[./-]", span))),
        float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0), float(len(set(re.findall(r"[^0-9]+", span.lstrip("(+"))))),
        float(bool(_DIGIT_BEFORE.search(before))), float(bool(_DIGIT_AFTER.match(after))),
        float(bool(_LETTERS_LAST.search(span))), float(bool(re.search(r"\.\s", span))),
    ]


@dataclass
class Boosted:
    """Gradient-boosted regression trees for a yes/no outcome; trees as arrays of equal depth."""

    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per tree: feature and bar of inner nodes, leaf values
    start: float
    depth: int

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32) -> Boosted:
        bars = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        start = float(np.log(share / (1 - share)))
        score, splits = np.full(len(y), start), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            slope, bend = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, bar = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                for at in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = np.flatnonzero(node == at)
                    best = 1e-9
                    for f in range(x.shape[1]) if len(own) > 1 else ():
                        if not len(bars[f]):
                            continue
                        bucket = np.searchsorted(bars[f], x[own, f], "left")
                        g = np.cumsum(np.bincount(bucket, slope[own], len(bars[f]) + 1))
                        h = np.cumsum(np.bincount(bucket, bend[own], len(bars[f]) + 1))
                        gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, feature[at], bar[at] = gain[k], f, bars[f][k]
                    node[own] = 2 * at + 1 + (x[own, feature[at]] > bar[at])
            leaf = node - (2**depth - 1)
            values = rate * np.bincount(leaf, slope, 2**depth) / (np.bincount(leaf, bend, 2**depth) + 1)
            score += values[leaf]
            splits.append((feature, bar, values))
        return cls(splits, start, depth)

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, bar, values in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > bar[node])
            score += values[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))


@dataclass
class Detector:
    trees: Boosted | None
    thresholds: dict[str, float]

    @property
    def silent(self) -> list[str]:
        """Kinds that add no span anywhere."""
        return [kind for kind in KINDS if self.trees is None or self.thresholds[kind] > 1]

    def spans(self, text: str | None) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
        """(base spans by kind, all spans ordered by kind and start)."""
        text = text or ""
        base = base_spans(text)
        every = [(kind, *span) for kind in KINDS for span in base[kind]]
        added = self._added(text, [(a, b) for _, a, b in every])
        return base, sorted(every + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))

    def _added(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        if self.trees is None:
            return []
        taken = sorted(taken)
        starts = np.array([a for a, _ in taken])
        ends = np.maximum.accumulate([b for _, b in taken]) if taken else starts
        silent = self.silent
        free = [c for c in candidates(text) if c[0] not in silent and not (len(starts) and (i := np.searchsorted(starts, c[2])) and ends[i - 1] > c[1])]
        if not free:
            return []
        p = self.trees.probability(np.array([features(text, *c) for c in free]))
        chosen: list[tuple[str, int, int]] = []
        used: dict[int, int] = {}
        for i in sorted(range(len(free)), key=lambda i: (-p[i], free[i][1] - free[i][2], free[i][1])):
            kind, a, b = free[i]
            if p[i] >= self.thresholds[kind] and not any(k in used for k in range(a, b)):
                used.update(dict.fromkeys(range(a, b), 1))
                chosen.append(free[i])
        return chosen


def _reformatted(kind: str, span: str, draw: random.Random) -> str:
    """A rule-conforming value as people also write it."""
    if kind == "email":
        user, _, host = span.partition("@")
        at, dot = draw.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "[dot]"), (" @ ", ".")])
        return user + at + dot.join(host.split("."))
    if kind == "card":
        digits = _digits(span)
        return draw.choice([".", "/", " - ", " "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "ip":
        return draw.choice([" . ", ". "]).join(span.split("."))
    digits = _digits(span)[-10:]
    return draw.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}) {} {}"]).format(digits[:3], digits[3:6], digits[6:])


def _meaningless(kind: str, span: str, draw: random.Random) -> str:
    """What looks like the kind and is not."""
    if kind == "email":
        user, _, host = span.partition("@")
        if draw.random() < 0.5:
            return f"{user} @ {draw.randint(1, 99)}.{draw.randint(10, 99)}"
        first, second, *_ = host.split(".")
        return f"{user} @ {first}. {second.capitalize()}"
    if kind == "ip":
        return ".".join(str(draw.randint(256, 10 ** draw.randint(3, 5) - 1)) for _ in range(draw.choice([4, 4, 5])))
    return "".join(draw.choice("0123456789") for _ in range(draw.choice([8, 12, 13, 14, 17, 18])))


def _wrong(text: str, kind: str, a: int, b: int) -> bool:
    """Whether a candidate fails a check of its kind; False where no check decides."""
    span, digits = text[a:b], _digits(text[a:b])
    if kind == "email":
        return not _LETTERS_LAST.search(span)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        return len(parts) != 4 or any(int(part) > 255 for part in parts)
    if kind == "card":
        return not luhn(digits)
    return bool(re.match(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]", span)) or (len(digits) >= 13 and luhn(digits))


def examples(text: str | None) -> Iterator[tuple[str, bool, int, int]]:
    """(kind, right, start, end): base spans, and candidates that are known to be wrong."""
    text = text or ""
    base = base_spans(text)
    every = sorted((a, b, kind) for kind in KINDS for a, b in base[kind])
    yield from ((kind, True, a, b) for a, b, kind in every)
    starts = np.array([a for a, _, _ in every])
    ends = np.maximum.accumulate([b for _, b, _ in every]) if every else starts
    for kind, a, b in candidates(text):
        # the last base spans that start before the end; most candidates meet none
        i = int(np.searchsorted(starts, b)) if every else 0
        met = set()
        while i and ends[i - 1] > a:
            i -= 1
            if every[i][1] > a:
                met.add(every[i][2])
        if (kind not in met) if met else _wrong(text, kind, a, b):
            yield kind, False, a, b


class Sample:
    """Of each kind, right and wrong, the examples with the smallest hashes, each content once: (hash, text around, start, end)."""

    def __init__(self, size: int = SAMPLE_SPANS // (2 * len(KINDS))) -> None:
        self.size, self.kept, self.bar = size, {}, {}

    def add(self, text: str | None) -> None:
        for kind, right, a, b in examples(text):
            if b - a > LONGEST:
                continue
            low = max(0, a - BEFORE)
            near = text[low : b + AFTER]
            digest = hashlib.blake2b(f"{kind}:{a - low}:{b - low}:{near}".encode("utf-8", "replace"), digest_size=8).digest()
            place = int.from_bytes(digest, "big") >> 1
            own = self.kept.setdefault((kind, right), {})
            if place <= self.bar.get((kind, right), 1 << 63):
                own[place] = (near, a - low, b - low)
                if len(own) > 2 * self.size:
                    own = self.kept[kind, right] = dict(sorted(own.items())[: self.size])
                    self.bar[kind, right] = max(own)

    def rows(self) -> list[tuple[str, bool, int, str, int, int]]:
        return [(*key, place, *own[place]) for key, own in sorted(self.kept.items()) for place in sorted(own)[: self.size]]


def train(texts: list[str], seed: int = 5) -> Detector:
    """Fit trees and thresholds on the examples of texts (no trees without positives or negatives)."""
    sample = Sample()
    for text in texts:
        sample.add(text)
    return fit(sample.rows(), seed)


def fit(sample: list[tuple[str, bool, int, str, int, int]], seed: int = 5) -> Detector:
    """Fit trees and thresholds on the rows of a sample."""
    draw = random.Random(seed)
    rows, labels, kinds = [], [], []

    def add(text: str, kind: str, a: int, b: int, right: bool) -> None:
        rows.append(features(text, kind, a, b))
        labels.append(float(right))
        kinds.append(kind)

    def copies(kind: str, left: str, values: list[str], right: str) -> None:
        """Values side by side: what covers one of them is right, what cuts or joins them is wrong."""
        at, wanted, text = len(left), [], left
        for value in values:
            text += " " * (text != left) + value
            wanted.append((len(text) - len(value), len(text)))
        text += right
        for found, a, b in candidates(text):
            if found in (kind, "phone", "card") and b > at and a < wanted[-1][1]:
                whole = found == kind and any(a <= start and b == end and _digits(text[a:start]) == "" for start, end in wanted)
                if whole or draw.random() < 0.3:
                    add(text, found, a, b, whole)

    sample = sorted(sample)
    right_spans = {kind: [near[a:b] for k, right, _, near, a, b in sample if right and k == kind] for kind in KINDS}
    for kind, right, _, near, a, b in sample:
        add(near, kind, a, b, right)
        if not right:
            continue
        before, after = near[:a], near[b:]
        value = _reformatted(kind, near[a:b], draw)
        copies(kind, before, [value], after)
        if kind in ("card", "phone"):
            copies(kind, before, [value, _reformatted(kind, draw.choice(right_spans[kind]), draw)], after)
        noise = _meaningless(kind, near[a:b], draw)
        text = before + noise + after
        for found, start, end in candidates(text):
            if start < len(before) + len(noise) and end > len(before) and not (kind in ("card", "phone") and len(noise) >= 13 and luhn(noise)):
                add(text, found, start, end, False)
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return Detector(None, dict.fromkeys(KINDS, 2.0))
    x = np.array(rows)
    held = np.array([draw.random() < 0.25 for _ in rows])
    trees = Boosted.fit(x[~held], y[~held])
    p = trees.probability(x[held])
    thresholds = {}
    for kind in KINDS:
        own = np.array([k == kind for k in np.array(kinds)[held]], bool)
        order = np.argsort(-p[own], kind="stable")
        score, right = p[own][order], y[held][own][order]
        precision = np.cumsum(right) / np.arange(1, len(right) + 1)
        # only where the score changes: equal scores are accepted together
        last = np.append(score[1:] != score[:-1], True) if len(score) else np.array([], bool)
        good = np.flatnonzero((precision >= PRECISION) & last)
        # at least even odds; a kind without held-out proof adds nothing
        thresholds[kind] = max(0.5, float(score[good[-1]])) if len(good) and good[-1] >= 19 else 2.0
    return Detector(trees, thresholds)


def sampled(docs: DataFrame, text_col: str) -> list[tuple[str, bool, int, str, int, int]]:
    """The sample of all texts. Each task keeps its own smallest hashes; counts by the size of the hash then give the bar above
    which no row of a kind is needed, so a tenth more than the sample at most reaches the driver."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = Sample()
        for batch in batches:
            for text in batch["text"]:
                sample.add(text)
        yield pd.DataFrame(sample.rows(), columns=["kind", "right", "place", "near", "a", "b"])

    size = Sample().size
    rows = pick(docs, text=text_col).mapInPandas(own, "kind string, right boolean, place long, near string, a int, b int")
    rows = stored(rows.dropDuplicates(["kind", "right", "place"]))
    step = F.floor(F.log2(F.col("place") + F.lit(1)) * 8).cast("int")
    counts: dict[tuple[str, bool], list[tuple[int, int]]] = {}
    for kind, right, at, n in rows.groupBy("kind", "right", step.alias("at")).count().collect():
        counts.setdefault((kind, right), []).append((at, n))
    needed = F.lit(False)
    for (kind, right), steps in counts.items():
        total, bar = 0, 0
        for at, n in sorted(steps):
            total, bar = total + n, at
            if total >= size:
                break
        needed = needed | ((F.col("kind") == kind) & (F.col("right") == F.lit(right)) & (step <= bar))
    kept: dict[tuple[str, bool], int] = {}
    result = []
    for row in sorted(tuple(row) for row in rows.filter(needed).collect()):
        kept[row[:2]] = kept.get(row[:2], 0) + 1
        if kept[row[:2]] <= size:
            result.append(row)
    return result


def trained(docs: DataFrame, text_col: str) -> Detector:
    detector = fit(sampled(docs, text_col))
    if detector.silent:
        logging.getLogger(__name__).warning("personal data: no proof on held-out spans, so only base spans for %s", ", ".join(detector.silent))
    return detector


def _finder(detector: Detector, redacting: bool):
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] + ["redacted"] * redacting

    @F.pandas_udf(", ".join(f"{name} {'long' if name.startswith('n_') else 'string'}" for name in names))
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                base, every = detector.spans(text)
                told = ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in base[kind])
                rows.append((
                    *[len(base[kind]) for kind in KINDS], hashlib.sha256(told.encode()).hexdigest(),
                    ",".join(f"{kind}:{a}:{b}" for kind, a, b in every), *([redact(text, every)] if redacting else []),
                ))
            yield pd.DataFrame(rows, columns=names)

    return find


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans as one, under the first's kind."""
    if text is None or not spans:
        return text
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of base spans, base_sha256, spans (base and added)."""
    detector = trained(docs, text_col)
    found = pick(docs, doc_id=id_col, text=text_col).select("doc_id", _finder(detector, False)("text").alias("f"))
    return found.select("doc_id", "f.*")


def with_redaction(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their texts redacted."""
    detector = trained(docs, text_col)
    name = fresh(docs, "_found")
    marked = docs.withColumn(name, _finder(detector, True)(quoted(text_col)))
    return marked.select(*[quoted(name)["redacted"].alias(c) if c == text_col else quoted(c) for c in docs.columns])
