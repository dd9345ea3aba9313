"""Secret scans: base patterns, and probabilistic automata inferred from labelled credentials.

Grammar inference: for each labelled kind a prefix tree of its strings is built with counts,
and statistically compatible states are merged (ALERGIA, with Hoeffding's bound), states
nearest the root and most used first, a state's own parent before other states. Each
candidate of a text (a run of credential characters, and each stretch of its dotted parts) is
scored under every automaton; it is a secret if one accepts it with a mean log likelihood per
character of at least the least that its labelled strings have (less MARGIN). Where a format
fixes the length, that is the length; else there is a least one only. The labelled strings are made from
the public formats of FORMATS, PER_FORMAT each with a fixed seed, or come from a table of
labelled credentials (models_of): a bounded sample and the only thing that is bounded. Automata are small and go along with the function.

Base spans stay as they are; a learned span is added where no base span holds it. Spans are
those of whole matches in code points, end exclusive.

There is no shuffle. A null or empty text has no spans. Repeated rows give repeated results,
null ids stay null; redact() passes other columns through.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from math import inf, log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, worker_cache

# The base patterns, with the least length that counts (of group 2 or of the match).
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
BASE = ("assign", "access", "hex")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CANDIDATE = re.compile(r"[A-Za-z0-9_.-]{16,}")
LEAST_CANDIDATE = 16

_DIGIT, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = _DIGIT + _UPPER + _LOWER
# Public formats of credentials, as parts (literal) or (alphabet, least, most).
FORMATS: dict[str, list] = {
    "aws_access_key": ["AKIA", (_UPPER + "234567", 16, 16)],
    "github_token": ["ghp_", (_ALNUM, 36, 36)],
    "gitlab_token": ["glpat-", (_ALNUM + "-_", 20, 20)],
    "google_api_key": ["AIza", (_ALNUM + "-_", 35, 35)],
    "slack_bot_token": ["xoxb-", (_DIGIT, 11, 13), "-", (_DIGIT, 11, 13), "-", (_ALNUM, 24, 24)],
    "stripe_secret_key": ["sk_live_", (_ALNUM, 24, 24)],
    "sendgrid_key": ["SG.", (_ALNUM + "-_", 22, 22), ".", (_ALNUM + "-_", 43, 43)],
    "json_web_token": ["eyJ", (_ALNUM + "-_", 15, 160), ".eyJ", (_ALNUM + "-_", 10, 400), ".", (_ALNUM + "-_", 43, 342)],
}
PER_FORMAT, ALPHA, SEED, KINDS = 120, 0.05, 7, 64
#: A state with so many different characters reads a random part of a format.
VARIED = 20
#: How far below the least likely labelled string another of its kind may be.
MARGIN = 0.3


def labelled(per_format: int = PER_FORMAT, seed: int = SEED) -> list[tuple[str, str]]:
    """(kind, credential), made up by the formats."""
    r = random.Random(seed)
    part = lambda p: p if isinstance(p, str) else "".join(r.choices(p[0], k=r.randint(p[1], p[2])))
    return [(kind, "".join(map(part, parts))) for kind, parts in FORMATS.items() for _ in range(per_format)]


class _State:
    __slots__ = ("count", "ends", "edges")

    def __init__(self) -> None:
        self.count, self.ends = 0, 0
        self.edges: dict[str, list] = {}  # character: [state, count]


def prefix_tree(strings: list[str]) -> _State:
    root = _State()
    for s in strings:
        at = root
        at.count += 1
        for c in s:
            edge = at.edges.setdefault(c, [_State(), 0])
            edge[1] += 1
            at = edge[0]
            at.count += 1
        at.ends += 1
    return root


def compatible(a: _State, b: _State, alpha: float) -> bool:
    """Whether the shares of ends and of each character differ by no more than Hoeffding's bound, here and below."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if a is b or not (a.count and b.count):
            continue
        bound = sqrt(0.5 * log(2 / alpha)) * (1 / sqrt(a.count) + 1 / sqrt(b.count))
        if abs(a.ends / a.count - b.ends / b.count) > bound:
            return False
        for c in a.edges.keys() | b.edges.keys():
            x, y = a.edges.get(c), b.edges.get(c)
            if abs((x[1] if x else 0) / a.count - (y[1] if y else 0) / b.count) > bound:
                return False
            if x and y:
                stack.append((x[0], y[0]))
    return True


def _fold(into: _State, tree: _State) -> None:
    """Adds a tree's counts to a state that it is merged with."""
    stack = [(into, tree)]
    while stack:
        a, b = stack.pop()
        a.count += b.count
        a.ends += b.ends
        for c, (child, n) in b.edges.items():
            if c in a.edges:
                a.edges[c][1] += n
                stack.append((a.edges[c][0], child))
            else:
                a.edges[c] = [child, n]


def infer(strings: list[str], alpha: float = ALPHA) -> _State:
    """The automaton left when compatible states of the prefix tree are merged."""
    root = prefix_tree(strings)
    settled = [root]
    while True:
        known = set(map(id, settled))
        open_ = [(edge[0].count, -i, c, state, edge) for i, state in enumerate(settled) for c, edge in state.edges.items() if id(edge[0]) not in known]
        if not open_:
            return root
        _, _, _, parent, edge = max(open_, key=lambda x: x[:3])
        for state in [parent, *(s for s in reversed(settled) if s is not parent)]:
            if compatible(state, edge[0], alpha):
                tree, edge[0] = edge[0], state
                _fold(state, tree)
                break
        else:
            settled.append(edge[0])


class Automaton:
    """Log probabilities of the merged states, and the bounds that the labelled strings and the format's lengths set."""

    def __init__(self, strings: list[str], shortest: int, longest: int, alpha: float = ALPHA) -> None:
        root = infer(strings, alpha)
        number, order = {id(root): 0}, [root]
        for state in order:
            for child, _ in state.edges.values():
                if id(child) not in number:
                    number[id(child)] = len(order)
                    order.append(child)
        self.steps = [{c: (number[id(t)], log(n / s.count)) for c, (t, n) in s.edges.items()} for s in order]
        letters = {c for s in strings for c in s} - {"."}
        for state, step in zip(order, self.steps, strict=True):
            if len(step) >= VARIED:  # a character not met here goes where most go
                to = number[id(max(state.edges.values(), key=lambda e: e[1])[0])]
                step |= {c: (to, -log(state.count + 1)) for c in letters - step.keys()}
        self.ends = [log(s.ends / s.count) if s.ends else -log(s.count + 1) if len(s.edges) >= VARIED else -inf for s in order]
        self.shortest, self.longest = shortest, longest if longest == shortest else inf
        self.dots = max(s.count(".") for s in strings)
        self.least = min(map(self.score, strings)) - MARGIN

    def score(self, s: str) -> float:
        """Mean log likelihood per character; -inf if it isn't accepted."""
        at, total = 0, 0.0
        for c in s:
            step = self.steps[at].get(c)
            if step is None:
                return -inf
            at, p = step
            total += p
        return (total + self.ends[at]) / (len(s) + 1)

    def accepts(self, s: str) -> bool:
        return self.shortest <= len(s) <= self.longest and self.score(s) >= self.least


@lru_cache(1)
def automata() -> dict[str, Automaton]:
    """One of each labelled kind."""
    by_kind: dict[str, list[str]] = {}
    for kind, s in labelled():
        by_kind.setdefault(kind, []).append(s)
    size = lambda kind, at: sum(len(p) if isinstance(p, str) else p[at] for p in FORMATS[kind])
    return {kind: Automaton(strings, size(kind, 1), size(kind, 2)) for kind, strings in by_kind.items()}


def models_of(credentials: DataFrame, per_kind: int = PER_FORMAT) -> dict[str, Automaton]:
    """Automata of labelled credentials (kind, credential): of each kind at most per_kind distinct ones, those of the least hash.

    Lengths are those of the strings taken: one length if they all have it, else the shortest
    is the least. Rows with a null are left out; over KINDS kinds are an error.
    """
    rows = credentials.select(F.col("kind").cast("string"), F.col("credential").cast("string")).filter("kind is not null and credential != ''").distinct()
    at = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("credential"), "credential"))
    by_kind: dict[str, list[str]] = {}
    for kind, s in rows.withColumn("at", at).filter(F.col("at") <= per_kind).select("kind", "credential").orderBy("kind", "at").limit(KINDS * per_kind + 1).toLocalIterator():
        by_kind.setdefault(kind, []).append(s)
    if len(by_kind) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of credentials")
    return {kind: Automaton(strings, min(map(len, strings)), max(map(len, strings))) for kind, strings in by_kind.items()}


Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, by start and then kind as listed."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], BASE.index(x[2])))


def learned_spans(text: str, models: dict[str, Automaton]) -> list[Span]:
    """Candidates that an automaton accepts, with the kind of the likeliest; of stretches that overlap, the first and longest."""
    found = []
    most = 1 + max((a.dots for a in models.values()), default=0)
    for m in _CANDIDATE.finditer(text):
        parts = m[0].split(".")
        starts = [m.start()]
        for x in parts:
            starts.append(starts[-1] + len(x) + 1)
        i = 0
        while i < len(parts):
            for j in range(min(i + most, len(parts)), i, -1):
                start, end = starts[i], starts[j] - 1
                if end - start < LEAST_CANDIDATE:
                    break
                s = text[start:end]
                if scored := [(a.score(s), kind) for kind, a in models.items() if a.accepts(s)]:
                    found.append((start, end, max(scored)[1]))
                    i = j - 1
                    break
            i += 1
    return found


def all_spans(text: str, models: dict[str, Automaton]) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and learned spans together."""
    base = base_spans(text)
    new = [s for s in learned_spans(text, models) if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)]
    order = {k: i for i, k in enumerate((*BASE, *models))}
    return base, sorted(base + new, key=lambda x: (x[0], order[x[2]])) if new else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, models: dict[str, Automaton] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; models: of models_of(), or those of the public formats."""
    small_batches(docs.sparkSession)
    models = automata() if models is None else models

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("secret_scan")
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text or "", models)
                kinds = [kind for _, _, kind in base]
                counts.append([kinds.count(k) for k in BASE])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def without(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, models: dict[str, Automaton] | None = None) -> DataFrame:
    """The rows of docs without the secrets in their texts; n_chars, where there is one, follows the text."""
    small_batches(docs.sparkSession)
    models, at = automata() if models is None else models, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("secret_scan")
        for batch in batches:
            clean = [t and without(t, all_spans(t, models)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    made = docs.mapInArrow(run, docs.schema)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made
