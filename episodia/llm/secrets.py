"""Secret scans: fixed formats, and probabilistic automata learned from the credentials those find.

Candidates for the automata are runs of ``CHARACTERS`` less the base spans in them, as long as the shortest learned
credential (6 to 20) or longer, that hold both a letter and a digit. Where a span was cut off, joining marks go too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import worker_cache

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
CHARACTERS = r"[A-Za-z0-9+/_.=-]"
MARKS = "+/_.=-"
SHORTEST, BASE_RUN = 6, 20  # least length of an assigned value, and of an access key or hex run
RUN = re.compile(CHARACTERS + "{%d,}" % BASE_RUN)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.DOTALL)

SAMPLE = 400  # labelled credentials per kind that an automaton is learned from
ALPHA = 0.01  # significance of the test that keeps two states apart
QUANTILE = 0.02  # share of the learned credentials that may score below the threshold
FOUND = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, "
         "best_score double")

# character classes: an automaton reads classes, so formats and not single values are learned
CLASS_OF = {c: "0" for c in "0123456789"} | {c: "a" for c in "abcdef"} | {c: "g" for c in "ghijklmnopqrstuvwxyz"} | {
    c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


# --- grammar inference ------------------------------------------------------------------------------------------

class Automaton:
    """Deterministic probabilistic automaton. State 0 starts; ``ends[s]`` strings end in s of ``visits[s]``."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.taken: list[dict[str, int]] = [{}]
        self.ends, self.visits = [0], [0]

    def add(self, word: str) -> None:
        state = 0
        self.visits[0] += 1
        for symbol in word:
            self.taken[state][symbol] = self.taken[state].get(symbol, 0) + 1
            if symbol not in self.next[state]:
                self.next[state][symbol] = len(self.ends)
                self.next.append({})
                self.taken.append({})
                self.ends.append(0)
                self.visits.append(0)
            state = self.next[state][symbol]
            self.visits[state] += 1
        self.ends[state] += 1

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether no Hoeffding test tells the two states, or those they lead to, apart."""
        factor, todo = math.sqrt(0.5 * math.log(2 / alpha)), [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.visits[x], self.visits[y]
            bound = factor * (n ** -0.5 + m ** -0.5)
            if abs(self.ends[x] / n - self.ends[y] / m) > bound:
                return False
            for symbol in self.taken[x].keys() | self.taken[y].keys():
                if abs(self.taken[x].get(symbol, 0) / n - self.taken[y].get(symbol, 0) / m) > bound:
                    return False
                if symbol in self.next[x] and symbol in self.next[y]:
                    todo.append((self.next[x][symbol], self.next[y][symbol]))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Add the counts of a subtree that hangs below no other state to ``into`` and where that leads."""
        todo = [(into, tree)]
        while todo:
            x, y = todo.pop()
            self.ends[x] += self.ends[y]
            self.visits[x] += self.visits[y]
            for symbol, n in self.taken[y].items():
                self.taken[x][symbol] = self.taken[x].get(symbol, 0) + n
                if symbol in self.next[x]:
                    todo.append((self.next[x][symbol], self.next[y][symbol]))
                else:
                    self.next[x][symbol] = self.next[y][symbol]

    def log2(self, word: str) -> float:
        """Log2 probability of the word as a whole; minus infinity for one that no path spells."""
        state, total = 0, 0.0
        for symbol in word:
            n = self.taken[state].get(symbol)
            if not n:
                return -math.inf
            total += math.log2(n / self.visits[state])
            state = self.next[state][symbol]
        return total + math.log2(self.ends[state] / self.visits[state]) if self.ends[state] else -math.inf


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge the compatible states of the prefix tree of ``words``, from the start outwards."""
    machine = Automaton()
    for word in words:
        machine.add(word)
    kept, frontier = [0], [(0, symbol) for symbol in sorted(machine.next[0])]
    while frontier:
        parent, symbol = frontier.pop(0)
        state = machine.next[parent][symbol]
        if state in kept:
            continue
        for other in kept:
            if machine.compatible(other, state, alpha):
                machine.next[parent][symbol] = other
                machine.fold(other, state)
                break
        else:
            kept.append(state)
        seen = set(kept)
        frontier = [(k, s) for k in kept for s in sorted(machine.next[k]) if machine.next[k][s] not in seen]
    return machine


def shape(value: str) -> str:
    return "".join(CLASS_OF.get(c, c) for c in value)


class Formats:
    """One automaton per labelled kind, and the score per character that a credential of it reaches."""

    def __init__(self, labelled: dict[str, list[str]], alpha: float = ALPHA, quantile: float = QUANTILE):
        self.machines = []
        for kind in sorted(labelled):
            shapes = [shape(v) for v in labelled[kind]]
            machine = infer(shapes, alpha)
            scores = sorted(self.per_character(machine, s) for s in shapes)
            self.machines.append((machine, scores[int(quantile * (len(scores) - 1))]))
        least = min((len(v) for values in labelled.values() for v in values), default=BASE_RUN)
        self.shortest = min(BASE_RUN, max(SHORTEST, least))
        self.run = re.compile(CHARACTERS + "{%d,}" % self.shortest)

    @staticmethod
    def per_character(machine: Automaton, word: str) -> float:
        return machine.log2(word) / (len(word) + 1)

    def score(self, value: str) -> tuple[bool, float]:
        """Whether some automaton gives ``value`` what its own credentials get, and the best score."""
        word = shape(value)
        scores = [(self.per_character(m, word), least) for m, least in self.machines]
        return any(s >= least for s, least in scores), max((s for s, _ in scores), default=-math.inf)


# --- scanning -----------------------------------------------------------------------------------------------------

def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the fixed formats, and (start, end) of all runs long enough to hold a credential.

    An access key or hex run of the required length lies within such a run, so only those are searched.
    """
    spans, low = [], text.lower()
    if any(name in low for name in NAMES):
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = [m.span() for m in RUN.finditer(text)]
    for start, end in runs:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, start, end)]
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text, start, end)]
    return sorted(spans), runs


def candidates(text: str, base: list[tuple[int, int, int]], formats: Formats) -> Iterator[tuple[int, int]]:
    """(start, end) of what is left of runs after the base spans are cut out, if long enough and mixed."""
    at = 0  # base spans before this one end before the run
    taken: list[list[int]] = []
    for start, _, end in base:  # by start; overlapping ones become one
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    for run in formats.run.finditer(text):
        start, last = run.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        k, pieces = at, []
        while k < len(taken) and taken[k][0] < last:
            pieces.append((start, taken[k][0]))
            start, k = taken[k][1], k + 1
        pieces.append((start, last))
        for s, e in pieces:
            if s > run.start():
                while s < e and text[s] in MARKS:
                    s += 1
            if e < last:
                while s < e and text[e - 1] in MARKS:
                    e -= 1
            if e - s >= formats.shortest and MIXED.match(text[s:e]):
                yield s, e


def all_spans(text: str, formats: Formats) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """Base spans, all spans and the best score of a candidate."""
    base, _ = base_spans(text)
    more, best = [], -math.inf
    for start, end in candidates(text, base, formats):
        found, score = formats.score(text[start:end])
        best = max(best, score)
        if found:
            more.append((start, 3, end))
    return base, sorted(base + more), best


def labelled_credentials(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[str]]:
    """Distinct credentials that the fixed formats find, ``sample`` of each kind at most, by hash."""
    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for text in batch["text"]:
                if text:
                    for start, kind, end in base_spans(text)[0]:
                        rows.add((KINDS[kind], ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]))
            yield pd.DataFrame(sorted(rows), columns=["kind", "value"])

    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    rows = (docs.select("text").mapInPandas(values, "kind string, value string").distinct()
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).collect())
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["kind"], r["place"])):
        out.setdefault(r["kind"], []).append(r["value"])
    return out


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_scan(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """Per row the counts and spans of credentials: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model,
    best_score.

    Spans are kind:start:end in code points, by start and then kind; ``model`` spans are candidates that a
    learned automaton scores like its own credentials. Formats are learned from ``docs`` unless given. A null text is
    empty; without any labelled credential there are no automata and so no ``model`` spans.
    """
    formats = formats or Formats(labelled_credentials(docs))

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                base, spans, best = all_spans(text or "", formats)
                n = [sum(kind == k for _, kind, _ in spans) for k in range(4)]
                rows.append((doc_id, *n[:3], hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(spans),
                             n[3], best if best > -math.inf else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans",
                                              "n_model", "best_score"])

    return docs.select("doc_id", "text").mapInPandas(scanned, FOUND)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``secret_scan`` replaced by ``mark``, overlapping ones by one; nulls stay."""
    formats = Formats(labelled_credentials(docs.select(F.col(text).alias("text"))))

    def cleaned(texts: pd.Series) -> pd.Series:
        worker_cache("secrets", dict)  # nothing to remember, but what others did goes

        def clean(value):
            if not value:
                return value
            out, at = [], 0
            for start, _, end in all_spans(value, formats)[1]:
                if start >= at:
                    out += [value[at:start], mark]
                at = max(at, end)
            return "".join(out) + value[at:]

        return texts.map(clean, na_action="ignore")

    return docs.withColumn(text, F.pandas_udf(cleaned, "string")(text))
