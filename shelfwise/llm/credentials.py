"""Secrets by grammar inference.

*Base* spans follow fixed rules per kind (assignments, access keys, long hexadecimal runs) and always stay.

*Inference*: the credentials inside base spans are labelled examples of their kind. Per kind they form a prefix tree with
counts; states are merged, most frequent first, with the already kept state whose ending and next-symbol frequencies (and those
of all common continuations) differ least, if no difference exceeds its Hoeffding bound at ``ALPHA``; otherwise the state
is kept. The result is a probabilistic automaton of the kind's format. The remaining candidates of the corpus train one more
automaton in the same way, the ordinary tokens.

*Scoring*: every candidate, that is each run of ``LEAST_LENGTH`` or more token characters and each of its parts between dots
and slashes, is scored under all automata. It is added under the kind that explains it best if its odds against an ordinary
token, at a prior share of ``PRIOR``, leave no more than ``DOUBT``, and if it is no less typical of the kind than credentials
that the automaton was not trained on, less ``SLACK`` nats a symbol. An added span never overlaps a base span or a better one.

Texts are read once; examples and candidates wait in a narrow stored table. Trained on at most ``SAMPLE`` different strings
per kind and ``ORDINARY`` ordinary tokens, of up to ``LONGEST`` characters, those with the smallest hashes of the whole corpus. A kind with fewer than two
different examples has no format to learn; it is logged, and adds nothing.

Null and empty texts have no spans. Offsets are code points, the end exclusive. Rows with equal ids are independent.
"""

from __future__ import annotations

import hashlib
import logging
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.llm.frames import fresh, pick, quoted, stored
from shelfwise.llm.pii import redact

KINDS = ("assign", "access", "hex")
OTHER = "other"
SAMPLE, ORDINARY, LONGEST, LEAST_LENGTH = 800, 6000, 160, 16
ALPHA, PRIOR, DOUBT, SLACK, FOLDS = 0.01, 1e-5, 0.01, 0.8, 5
#: A string of fewer different characters, or of digits or letters alone, is no credential, whatever its format.
VARIETY = 6
#: Share of unseen credentials of a kind that may be less typical than the limit before the slack.
UNTYPICAL = 0.02

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{{{LEAST_LENGTH},}}={{0,2}}")
_PART = re.compile(rf"[A-Za-z0-9+_-]{{{LEAST_LENGTH},}}={{0,2}}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_SYMBOLS = 68  # the token characters and the end


Span = tuple[str, int, int]


def base_spans(text: str) -> tuple[list[Span], list[tuple[str, str]]]:
    """Base spans by start and kind, and the credentials in them with their kinds."""
    found, values = [], []
    if ":" in text or "=" in text:
        for match in _ASSIGN.finditer(text):
            if len(match[1]) >= 6:
                found.append(("assign", *match.span()))
                values.append(("assign", match[1]))
    if "AKIA" in text:
        for match in _ACCESS.finditer(text):
            if len(match[0]) >= 20:
                found.append(("access", *match.span()))
                values.append(("access", match[0]))
    for match in _HEX.finditer(text):
        found.append(("hex", *match.span()))
        values.append(("hex", match[0]))
    return sorted(found, key=_place), values


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Token runs and their parts, outside of base spans."""
    found = {}
    for run in _RUN.finditer(text):
        low, high = run.span()
        spans = [(low, high), *((low + part.start(), low + part.end()) for part in _PART.finditer(run[0]))]
        for a, b in spans:
            while b > a and text[b - 1] in ".-/":
                b -= 1
            while b > a and text[a] in ".-/":
                a += 1
            if b - a >= LEAST_LENGTH:
                found[a, b] = None
    if not base or not found:
        return sorted(found)
    taken = sorted((low, high) for _, low, high in base)
    free, at, reach = [], 0, -1
    for a, b in sorted(found):
        while at < len(taken) and taken[at][0] <= a:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= a and (at == len(taken) or taken[at][0] >= b):
            free.append((a, b))
    return free


def _place(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{low}:{high}" for kind, low, high in sorted(spans, key=_place))


# ---- automata -----------------------------------------------------------------


class Tree:
    """A prefix tree with counts, whose states are merged into an automaton."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.ends, self.passes = [0], [0]
        for word in words:
            state = 0
            self.passes[0] += 1
            for symbol in word:
                self.count[state][symbol] += 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.ends.append(0)
                    self.passes.append(0)
                state = self.next[state][symbol]
                self.passes[state] += 1
            self.ends[state] += 1

    def difference(self, kept: int, state: int, best: float = 1.0) -> float:
        """The largest difference of frequencies over its bound, in the two states and all common continuations;
        above ``best`` as soon as one is.
        """
        worst, waiting = 0.0, [(kept, state)]
        while waiting:
            a, b = waiting.pop()
            n, m = self.passes[a], self.passes[b]
            if not n or not m:
                continue
            gap = abs(self.ends[a] / n - self.ends[b] / m)
            first, second = self.count[a], self.count[b]
            for symbol in first.keys() | second.keys():
                gap = max(gap, abs(first.get(symbol, 0) / n - second.get(symbol, 0) / m))
            worst = max(worst, gap / (_WIDTH * (n**-0.5 + m**-0.5)))
            if worst > best:
                return worst
            above = self.next[a]
            waiting += [(above[symbol], child) for symbol, child in self.next[b].items() if symbol in above]
        return worst

    def fold(self, kept: int, state: int) -> None:
        """Everything that passed ``state``, a tree, now passes ``kept``."""
        waiting = [(kept, state)]
        while waiting:
            a, b = waiting.pop()
            self.passes[a] += self.passes[b]
            self.ends[a] += self.ends[b]
            self.count[a].update(self.count[b])
            for symbol, child in self.next[b].items():
                if symbol in self.next[a]:
                    waiting.append((self.next[a][symbol], child))
                else:
                    self.next[a][symbol] = child

    def merge(self) -> list[int]:
        """Merges compatible states; the states that are kept, the start first."""
        kept, known = [0], {0}
        while True:
            fringe = [(-self.passes[child], state, symbol) for state in kept for symbol, child in self.next[state].items() if child not in known]
            if not fringe:
                return kept
            _, parent, symbol = min(fringe)
            state = self.next[parent][symbol]
            choice, least = None, 1.0
            for other in kept:
                gap = self.difference(other, state, least)
                if gap <= least and (choice is None or gap < least):
                    choice, least = other, gap
            if choice is None:
                kept.append(state)
                known.add(state)
            else:
                self.next[parent][symbol] = choice
                self.fold(choice, state)


_WIDTH = math.sqrt(0.5 * math.log(2 / ALPHA))


@dataclass
class Automaton:
    """Log probabilities and successors per state. A symbol that a state never saw leads where its most frequent one leads."""

    steps: list[dict[str, tuple[float, int]]]
    #: Per state: log of the share left for unseen symbols, log probability of an end, successor on an unseen symbol.
    rest: list[tuple[float, float, int]]
    #: Log frequencies of symbols over all states, and of a symbol that occurs nowhere.
    common: dict[str, float]
    never: float
    limit: float = -math.inf

    def score(self, word: str) -> float:
        total, state = 0.0, 0
        for symbol in word:
            step = self.steps[state].get(symbol)
            if step is None:
                share, _, after = self.rest[state]
                total += share + self.common.get(symbol, self.never)
                state = after
            else:
                total += step[0]
                state = step[1]
        return total + self.rest[state][1]


def infer(words: list[str]) -> Automaton:
    tree = Tree(sorted(words))
    kept = tree.merge()
    number = {state: i for i, state in enumerate(kept)}
    everywhere: Counter = Counter()
    for word in words:
        everywhere.update(word)
    size = sum(everywhere.values()) + len(words) + _SYMBOLS
    share = {symbol: (count + 1) / size for symbol, count in everywhere.items()}
    steps, rest = [], []
    for state in kept:
        weight = tree.passes[state] + 1
        steps.append({s: (math.log((tree.count[state][s] + share[s]) / weight), number[to]) for s, to in tree.next[state].items()})
        likely = max(tree.next[state], key=lambda s, state=state: (tree.count[state][s], s), default=None)
        after = number[state] if likely is None else number[tree.next[state][likely]]
        rest.append((-math.log(weight), math.log((tree.ends[state] + (len(words) + 1) / size) / weight), after))
    return Automaton(steps, rest, {s: math.log(p) for s, p in share.items()}, -math.log(size))


def _typical(words: list[str]) -> float:
    """How typical, in nats a symbol, all but a share ``UNTYPICAL`` of unseen words are."""
    folds = min(FOLDS, len(words))
    order = sorted(words, key=lambda word: hashlib.sha256(word.encode()).digest())
    scores = []
    for fold in range(folds):
        automaton = infer([word for i, word in enumerate(order) if i % folds != fold])
        scores += [automaton.score(word) / (len(word) + 1) for word in order[fold::folds]]
    return sorted(scores)[int(UNTYPICAL * len(scores))]


@dataclass
class Detector:
    automata: dict[str, Automaton]
    ordinary: Automaton
    silent: list[str] = field(default_factory=list)

    def judge(self, word: str) -> tuple[float, str] | None:
        """Log odds and kind of a candidate that is accepted."""
        if len(set(word)) < VARIETY or not (_DIGIT.search(word) and _LETTER.search(word)):
            return None
        usual, best = self.ordinary.score(word), None
        for kind, automaton in self.automata.items():
            score = automaton.score(word)
            odds = score - usual
            if odds >= _ODDS and score / (len(word) + 1) >= automaton.limit and (best is None or odds > best[0]):
                best = odds, kind
        return best

    def added(self, spans: list[tuple[int, int, str]]) -> list[Span]:
        """The accepted ones of candidates (start, end, string), best first where they overlap."""
        judged = [(*found, low, high) for low, high, word in spans if (found := self.judge(word))]
        chosen: list[Span] = []
        reach = -1
        # candidates overlap within one run only, so the best of each group of overlapping ones is taken in turn
        group: list[tuple[float, str, int, int]] = []
        for item in sorted(judged, key=lambda j: (j[2], j[3])):
            if group and item[2] >= reach:
                chosen += _apart(group)
                group = []
            group.append(item)
            reach = max(reach, item[3])
        return chosen + _apart(group)

    def spans(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """Base and added spans of a text."""
        base, _ = base_spans(text or "")
        return base, self.added([(a, b, text[a:b]) for a, b in candidates(text or "", base)])


def _apart(group: list[tuple[float, str, int, int]]) -> list[Span]:
    taken: list[Span] = []
    for _, kind, low, high in sorted(group, key=lambda j: (-j[0], j[2] - j[3], j[2])):
        if all(high <= a or low >= b for _, a, b in taken):
            taken.append((kind, low, high))
    return taken


_ODDS = math.log((1 - DOUBT) / DOUBT) - math.log(PRIOR)


def train(examples: dict[str, list[str]]) -> Detector:
    """Automata from different strings per kind (``OTHER``: ordinary tokens)."""
    automata, silent = {}, []
    for kind in KINDS:
        words = sorted(set(examples.get(kind, [])))
        if len(words) < 2:
            silent.append(kind)
            continue
        automata[kind] = infer(words)
        automata[kind].limit = _typical(words) - SLACK
    if silent:
        logging.getLogger(__name__).warning("no format learned from fewer than two examples: %s", ", ".join(silent))
    return Detector(automata, infer(sorted(set(examples.get(OTHER, [])))), silent)


# ---- jobs ---------------------------------------------------------------------

_FOUND = (
    f"{', '.join(f'n_{kind} long' for kind in KINDS)}, base string, "
    "examples array<struct<kind:string,value:string>>, candidates array<struct<low:int,high:int,value:string>>"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans, examples and candidates of every row."""
    table = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([table.schema["doc_id"], *StructType.fromDDL(_FOUND).fields])
    strings = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
    places = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("value", pa.string())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bases, examples, found = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base, values = base_spans(text)
                counts.append([sum(kind == name for kind, _, _ in base) for name in KINDS])
                bases.append(told(base))
                examples.append([{"kind": kind, "value": value} for kind, value in values])
                found.append([{"low": a, "high": b, "value": text[a:b]} for a, b in candidates(text, base)])
            numbers = [pa.array([row[i] for row in counts], pa.int64()) for i in range(len(KINDS))]
            columns = [batch.column("doc_id"), *numbers, pa.array(bases, pa.string()), pa.array(examples, strings), pa.array(found, places)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return table.mapInArrow(rows, schema)


def examples_of(scanned: DataFrame) -> dict[str, list[str]]:
    """At most ``SAMPLE`` different strings per kind, those with the smallest hashes."""
    ordinary = F.transform("candidates", lambda c: F.struct(F.lit(OTHER).alias("kind"), c["value"].alias("value")))
    strings = scanned.select(F.explode(F.concat("examples", ordinary)).alias("s")).select("s.kind", "s.value")
    strings = stored(strings.filter(F.length("value") <= LONGEST).distinct())
    drawn = None
    for kind in (*KINDS, OTHER):
        part = strings.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(ORDINARY if kind == OTHER else SAMPLE)
        drawn = part if drawn is None else drawn.union(part)
    found: dict[str, list[str]] = {}
    for row in drawn.collect():
        found.setdefault(row["kind"], []).append(row["value"])
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added."""
    scanned = stored(scan(docs, id_col, text_col))
    detector = train(examples_of(scanned))
    shared = docs.sparkSession.sparkContext.broadcast(detector)
    schema = StructType(scanned.schema.fields[:4]).add("base_sha256", "string").add("spans", "string").add("n_added", "long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, spans, added = [], [], []
            for base, found in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                more = shared.value.added([(c["low"], c["high"], c["value"]) for c in found]) if found else []
                known = [(kind, int(low), int(high)) for kind, low, high in (s.split(":") for s in base.split(",") if s)]
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(told(known + more) if more else base)
                added.append(len(more))
            columns = [*batch.columns[:4], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return scanned.select("doc_id", *(f"n_{name}" for name in KINDS), "base", "candidates").mapInArrow(rows, schema)


def with_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked_col: str = "masked") -> DataFrame:
    """``docs`` with one more column: the text with every secret replaced by its kind in brackets (null stays null)."""
    detector = docs.sparkSession.sparkContext.broadcast(train(examples_of(stored(scan(docs, id_col, text_col)))))

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: redact(text, sum(detector.value.spans(text), [])))

    return docs.withColumn(fresh(docs, masked_col), mask(quoted(text_col)))
