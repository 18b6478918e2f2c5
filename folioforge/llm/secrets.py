"""Secret scans with one deterministic automaton for all rules.

Rule expressions are compiled to one automaton over bytes: their syntax trees become an NFA, the subset construction
makes it deterministic (a set always holds the start of every rule, so matches may begin anywhere), and partition
refinement minimises it. Bytes that no rule tells apart share a class. The result is one array of transitions and one
of rule masks. Documents are scanned side by side: at each step one gather moves all documents of a slice on by one
byte, so a byte is read once for all rules together. Documents in which a rule accepted are then resolved to spans: the
automaton of the reversed rule, run backwards once, marks every byte at which a match begins, and the rule's own anchored
automaton gives the longest end of the first mark behind the match before. So each byte of such a document is read three
times for a rule at most, whatever the text. Per kind the spans are the leftmost non-overlapping ones; those that fail the
kind's length are dropped after matching.

A rule must die with the first byte behind its match, as all of ``RULES`` do; else that scan reads bytes again.

Defined results: null and empty texts have no spans; an empty table gives no rows; spans are in code points, the end
exclusive; spans of several kinds may overlap, and equal starts stand in the order of the rules; very long texts are
scanned whole, in time linear in their length; repeated rows are scanned each for itself, whatever their ids; extra
columns are ignored, whatever their names (``redact`` keeps them).
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

SCAN_BYTES = 8 << 20
#: With fewer documents than this left in a slice, each is finished by itself.
FEW = 48


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what matches, and how many characters a match (or the run that ends it) must have at least."""

    kind: str
    pattern: str
    least: int = 0
    #: The least length counts this trailing class of characters only (empty: the whole match).
    tail: str = ""


#: The base kinds in their order, then the added ones.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, "value"),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
ADDED_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + ADDED_RULES
_ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""


class Nfa:
    """Thompson's construction over bytes: ``edges[state]`` are (set of bytes, target), ``skips[state]`` targets without a byte."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.skips: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        """Adds a parsed expression that begins in state ``at``; returns the state where it ends."""
        for op, arg in tree:
            if op in (ops.LITERAL, ops.IN, ops.NOT_LITERAL, ops.ANY):
                to = self.state()
                self.edges[at].append((frozenset(self._bytes(op, arg, fold)), to))
                at = to
            elif op is ops.SUBPATTERN:
                _, plus, minus, inner = arg
                at = self.add(inner, at, bool((fold or plus & 2) and not minus & 2))
            elif op is ops.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    begin = self.state()
                    self.skips[at].append(begin)
                    self.skips[self.add(branch, begin, fold)].append(end)
                at = end
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
                least, most, inner = arg
                for _ in range(least):
                    at = self.add(inner, at, fold)
                if most is ops.MAXREPEAT:
                    loop = self.state()
                    self.skips[at].append(loop)
                    self.skips[self.add(inner, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(most - least):
                        self.skips[at].append(end)
                        at = self.add(inner, at, fold)
                    self.skips[at].append(end)
                    at = end
            else:
                raise ValueError(f"unsupported in a rule: {op}")
        return at

    @staticmethod
    def _bytes(op, arg, fold: bool) -> set[int]:
        if op is ops.ANY:
            return set(range(256)) - {10}
        if op is ops.NOT_LITERAL:
            return set(range(256)) - {arg}
        out: set[int] = set()
        items = [(op, arg)] if op is ops.LITERAL else arg
        for kind, value in items:
            if kind is ops.LITERAL:
                out.add(value)
            elif kind is ops.RANGE:
                out.update(range(value[0], value[1] + 1))
            elif kind is not ops.NEGATE:
                raise ValueError(f"unsupported in a class: {kind}")
        if fold:
            out |= {ord(chr(b).swapcase()) for b in out if b < 128 and chr(b).isalpha()}
        return set(range(256)) - out if items[0][0] is ops.NEGATE else out


@dataclass
class Automaton:
    """A minimal automaton as arrays (and, for single documents, as lists).

    ``step[state * classes + class_of[byte]]`` is the next state times ``classes``; ``accepts`` has the rule mask of each state."""

    step: np.ndarray
    class_of: np.ndarray
    accepts: np.ndarray
    classes: int
    dead: int = -1
    steps: list[int] | None = None
    masks: list[int] | None = None


def reversed_tree(tree) -> list:
    """A parsed expression that matches the same texts read from their end."""
    out = []
    for op, arg in reversed(list(tree)):
        if op is ops.SUBPATTERN:
            arg = (*arg[:3], reversed_tree(arg[3]))
        elif op is ops.BRANCH:
            arg = (arg[0], [reversed_tree(branch) for branch in arg[1]])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            arg = (*arg[:2], reversed_tree(arg[2]))
        out.append((op, arg))
    return out


def compile_rules(rules: tuple[Rule, ...], anywhere: bool, backward: bool = False) -> Automaton:
    """The minimal automaton of all rules; ``anywhere``: matches may begin at each byte, else only at the first; ``backward``: of texts read from their end."""
    nfa = Nfa()
    begins, ends = [], {}
    for k, rule in enumerate(rules):
        begins.append(nfa.state())
        tree = list(parser.parse(rule.pattern))
        loops = [i for i, (op, arg) in enumerate(tree) if op is ops.MAX_REPEAT and arg[1] is ops.MAXREPEAT and arg[2][0][0] is ops.IN]
        if backward:
            tree = reversed_tree(tree)
        elif anywhere and loops:
            # A match shows with the least of its first run of a class of bytes; the rule's own automaton finds its end.
            least, _, inner = tree[loops[0]][1]
            tree = [*tree[: loops[0]], (ops.MAX_REPEAT, (least, least, inner))]
        ends[nfa.add(tree, begins[-1], False)] = 1 << k
    closures: dict[int, frozenset[int]] = {}

    def closure(state: int) -> frozenset[int]:
        if state not in closures:
            seen, todo = {state}, [state]
            while todo:
                for to in nfa.skips[todo.pop()]:
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
            closures[state] = frozenset(seen)
        return closures[state]

    # Bytes that every edge treats alike are one class.
    sets = sorted({s for edges in nfa.edges for s, _ in edges}, key=sorted)
    groups: dict[tuple[bool, ...], int] = {}
    class_of = np.array([groups.setdefault(tuple(b in s for s in sets), len(groups)) for b in range(256)], dtype=np.uint8)
    example = [int(np.flatnonzero(class_of == c)[0]) for c in range(len(groups))]
    start = frozenset().union(*(closure(b) for b in begins))
    always = start if anywhere else frozenset()
    numbers, todo, rows, masks = {start: 0}, [start], [], []
    for now in todo:  # grows while it is read
        masks.append(sum({ends[s] for s in now if s in ends}))
        row = []
        for b in example:
            to = always.union(*(closure(t) for s in now for chars, t in nfa.edges[s] if b in chars))
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
        rows.append(row)
    table, mask = np.array(rows), np.array(masks)
    # Refinement: states stay together while their masks and the groups of their successors agree.
    group = np.unique(mask, return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    first = np.unique(group, return_index=True)[1]
    order = np.argsort(first)  # the start state's group comes first
    number = np.empty(len(first), dtype=np.int64)
    number[order] = np.arange(len(first))
    group, first = number[group], first[order]
    n = len(groups)
    accepts = np.zeros(len(first) * n, dtype=np.uint8)
    accepts[::n] = mask[first]
    step = group[table[first]] * n
    lost = np.flatnonzero((step == (np.arange(len(step)) * n)[:, None]).all(axis=1) & (mask[first] == 0))
    return Automaton(step.astype(np.int32).reshape(-1), class_of, accepts, n, int(lost[0]) * n if len(lost) else -1)


class Scanner:
    """All rules compiled together, and each by itself for the beginnings and the ends of its matches."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = compile_rules(rules, True)
        self.each = [compile_rules((r,), False) for r in rules]
        self.back = [compile_rules((r,), True, True) for r in rules]
        self.head = compile_rules((Rule("head", _ASSIGN_HEAD),), False)
        for a in (self.all, *self.each, *self.back, self.head):
            a.steps, a.masks = a.step.tolist(), a.accepts.tolist()

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rules that accept somewhere in each document, as masks: one pass over the bytes of all documents side by side."""
        a = self.all
        classes = a.class_of[data]
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        at, left = offsets[:-1][order].copy(), lengths[order]
        state = np.zeros(len(order), dtype=np.int32)
        seen = np.zeros(len(order), dtype=np.uint8)
        active = len(order) - np.searchsorted(left[::-1], np.arange(int(left[0]) + 1 if len(left) else 1), side="right")
        t = 0
        while t < len(active) and (k := int(active[t])) >= FEW:
            now, places = state[:k], at[:k]
            np.take(a.step, now + classes[places], out=now)
            seen[:k] |= a.accepts[now]
            places += 1
            t += 1
        step, accepts = a.steps, a.masks
        for i in range(int(active[t]) if t < len(active) else 0):
            s, m = int(state[i]), int(seen[i])
            for c in classes[at[i] : at[i] + left[i] - t].tobytes():
                s = step[s + c]
                m |= accepts[s]
            seen[i] = m
        out = np.zeros(len(order), dtype=np.uint8)
        out[order] = seen
        return out

    def spans(self, text: bytes, mask: int = -1) -> list[tuple[str, int, int]]:
        """All spans of a document in bytes, by start, then kind in the order of the rules; only rules of the mask are looked for."""
        data, out = np.frombuffer(text, dtype=np.uint8), []
        for k, (rule, own, back) in enumerate(zip(self.rules, self.each, self.back)):
            if not mask >> k & 1:
                continue
            begins, done, mine = self._begins(back, data), 0, own.class_of[data].tobytes()
            at = 0
            while at < len(begins):
                begin = int(begins[at])
                done = self._longest(own, mine, begin)
                if self._long_enough(rule, text, begin, done):
                    out.append((begin, k, done))
                at = int(np.searchsorted(begins, done))
        return [(self.rules[k].kind, b, e) for b, k, e in sorted(out)]

    @staticmethod
    def _begins(a: Automaton, data: np.ndarray) -> np.ndarray:
        """The bytes at which a match begins, by one pass from the text's end."""
        step, accepts, s = a.steps, a.masks, 0
        marks = bytearray(len(data))
        at = len(data)
        for c in a.class_of[data[::-1]].tobytes():
            at -= 1
            s = step[s + c]
            if accepts[s]:
                marks[at] = 1
        return np.flatnonzero(np.frombuffer(marks, dtype=np.uint8))

    def _longest(self, a: Automaton, classes: bytes, at: int) -> int:
        step, accepts, s, end = a.steps, a.masks, 0, -1
        for i in range(at, len(classes)):
            s = step[s + classes[i]]
            if s == a.dead:
                break
            if accepts[s]:
                end = i + 1
        return end

    def _long_enough(self, rule: Rule, text: bytes, begin: int, end: int) -> bool:
        if rule.tail:
            head = self.head.class_of[np.frombuffer(text[begin:end], dtype=np.uint8)].tobytes()
            begin += self._longest_head(head)
        return end - begin >= rule.least

    def _longest_head(self, classes: bytes) -> int:
        return max(self._longest(self.head, classes, 0), 0)


def _code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[dict]:
    if text.isascii():
        return [{"kind": k, "start": b, "end": e} for k, b, e in spans]
    # Code points begin at all bytes but 0x80 to 0xBF; they are counted once.
    before = np.concatenate([[0], np.cumsum(np.frombuffer(text, dtype=np.int8) >= -64)])
    return [{"kind": k, "start": int(before[b]), "end": int(before[e])} for k, b, e in spans]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch], scanner: Scanner) -> Iterator[tuple[pa.RecordBatch, list[list[dict]]]]:
    for batch in batches:
        for rows, texts in slices(batch, "text", SCAN_BYTES):
            found: list[list[dict]] = [[]] * texts.n
            masks = scanner.hits(texts.data, texts.offsets)
            for i in np.flatnonzero(masks).tolist():
                text = texts.text(i)
                found[i] = _code_points(text, scanner.spans(text, int(masks[i])))
            yield rows, found


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): the spans of every text by start, then kind in the order of the rules."""
    scanner = Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _scan(batches, scanner):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, _ARROW_SPANS)], ["doc_id", "spans"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The same rows and columns, with each secret (overlapping spans as one) replaced by the mark and ``n_chars`` counted anew; a null text stays null."""
    scanner = Scanner(rules)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            for rows, texts in slices(batch, text_col, SCAN_BYTES):
                masks = scanner.hits(texts.data, texts.offsets)
                hit = np.flatnonzero(masks).tolist()
                columns = list(rows.columns)
                if len(hit):
                    values = columns[at].to_pylist()
                    for i in hit:
                        text = texts.text(i)
                        out, done = [], 0
                        for _, b, e in scanner.spans(text, int(masks[i])):
                            if b >= done:
                                out += [text[done:b], mark.encode()]
                            done = max(done, e)
                        values[i] = b"".join([*out, text[done:]]).decode()
                    columns[at] = pa.array(values, columns[at].type)
                    if "n_chars" in names:
                        n = names.index("n_chars")
                        counts = columns[n].to_pylist()
                        for i in hit:
                            counts[i] = len(values[i])
                        columns[n] = pa.array(counts, columns[n].type)
                yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return docs.mapInArrow(run, schema)


def secret_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans as text) of every document."""

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return secret_spans(docs, rules).select(
        "doc_id",
        *map(count, kinds),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
