"""Where the passages of books end: a stream over each book's blocks, and a prefix scan over those of large ones.

A number ends a passage, and whether it does depends on what was read before: the passage that is open and the last number
that was accepted. Read as a function, a run of blocks turns one such state into another, and runs compose. So a book is
cut into chunks of pages. Each chunk is read once for its function: what it makes of an open passage or none, and of a last
number that is unknown, with the few numbers for which it acts otherwise as exceptions. The functions of a book's chunks
are applied in order (a row for each chunk), and then each chunk is read with the state that it begins in. A book of bounded
size needs none of that: it is read once, in order, with its state in the stream.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scripts as s
from ..sources.shared import dealt, materialize

#: Pages of a chunk.
PAGES = 64
#: The size up to which a book is read as one stream: characters, and ``BLOCK`` more for each block.
WHOLE, BLOCK = 1 << 22, 100
_DANDA = "(?:॥|।।)"
_NUMBER = re.compile(f"({_DANDA})\\s*([{''.join(f'{d[0]}-{d[9]}' for d in s.DIGITS.values())}]+)\\s*{_DANDA}")
_SCRIPT_OF = {c: (k, v) for k, digits in s.DIGITS.items() for v, c in enumerate(digits)}
LARGEST = (1 << 53) - 1

#: The passage that was open, or the last number, where a chunk began: not known while its function is found.
INHERITED = "inherited"


class State(NamedTuple):
    """The place (page, pos, k) at which the open passage began, or none, and the last accepted number, or none."""

    start: tuple[int, int, int] | str | None = None
    number: int | str | None = None


class Fragment(NamedTuple):
    """A piece of a block: its place among the block's pieces, its text, where its passage began, and the number that ends the passage with it."""

    k: int
    text: str
    start: tuple[int, int, int] | str
    value: int | None
    recovered: bool


@lru_cache(1 << 12)
def numeral(digits: str) -> tuple[str, int] | None:
    """Script and value of a run of digits of one script, up to 2**53 - 1."""
    known = [_SCRIPT_OF[c] for c in digits]
    value = int("".join(str(v) for _, v in known)) if len({k for k, _ in known}) == 1 and len(known) < 400 else LARGEST + 1
    return (known[0][0], value) if value <= LARGEST else None


def read_block(page: int, pos: int, kind: str, text: str, state: State, script: str, asked: set[int]) -> tuple[list[Fragment], State]:
    """A block's pieces and the state behind it. A heading or an end closes what is open.

    A number of the book's script ends a passage. A refused one is passed by one character, as the next may begin with its
    danda. A number in another script directly behind a refused one ends a passage if it is the last number's successor;
    numbers for which that hangs on an unknown last number are noted in ``asked``, and the answer is no.
    """
    start, last = state
    if kind != "text":
        return [], State(None, last)
    out: list[Fragment] = []
    done, at, refused = 0, 0, None
    while (m := _NUMBER.search(text, at)) is not None:
        found = numeral(m[2])
        ends = found is not None and found[0] == script
        recovered = False
        if found is not None and not ends and refused is not None and not text[refused : m.start()].strip():
            if last == INHERITED:
                asked.add(found[1] - 1)
            else:
                ends = recovered = last is not None and found[1] == last + 1
        if not ends:
            refused, at = m.end(), m.start() + 1
            continue
        before = text[done : m.start()]
        if before.strip() or start is not None:
            out.append(Fragment(len(out), (before + m[1]).strip(), start or (page, pos, len(out)), found[1], recovered))
            start, last = None, found[1]
        refused, done, at = None, m.end(), m.end()
    rest = text[done:].strip()
    if rest:
        start = start or (page, pos, len(out))
        out.append(Fragment(len(out), rest, start, None, False))
    return out, State(start, last)


class Function:
    """What a run of blocks makes of a state: for an open passage and none, of any last number and of the exceptions."""

    def __init__(self, script: str):
        self.script = script
        self.of: dict[tuple[bool, int | str], State] = {(False, INHERITED): State(None, INHERITED), (True, INHERITED): State(INHERITED, INHERITED)}
        self.breaks = 0

    def read(self, page: int, pos: int, kind: str, text: str) -> None:
        self.breaks += kind != "text"
        known: dict[State, tuple[State, set[int]]] = {}
        new: dict[tuple[bool, int | str], State] = {}

        def behind(state: State) -> tuple[State, set[int]]:
            if state not in known:
                asked: set[int] = set()
                known[state] = (read_block(page, pos, kind, text, state, self.script, asked)[1], asked)
            return known[state]

        for (is_open, number), state in self.of.items():
            new[is_open, number], asked = behind(state)
            for c in asked:
                if (is_open, c) not in self.of:
                    new[is_open, c], _ = behind(State(state.start, c))
        # An exception that ends like all other numbers is none.
        self.of = {(o, n): x for (o, n), x in new.items() if n == INHERITED or x != State(new[o, INHERITED].start, n if new[o, INHERITED].number == INHERITED else new[o, INHERITED].number)}

    def __call__(self, state: State) -> State:
        is_open = state.start is not None
        start, number = self.of.get((is_open, state.number), self.of[is_open, INHERITED])
        return State(state.start if start == INHERITED else start, state.number if number == INHERITED else number)


_PLACE = "struct<page:long,pos:long,k:long>"
_FUNCTION = f"array<struct<is_open:boolean,number:long,any:boolean,start:{_PLACE},keeps_start:boolean,last:long,keeps_last:boolean>>"


def _to_rows(f: Function) -> list[dict]:
    return [
        {
            "is_open": o, "number": None if n == INHERITED else n, "any": n == INHERITED,
            "start": dict(zip(("page", "pos", "k"), x.start)) if isinstance(x.start, tuple) else None, "keeps_start": x.start == INHERITED,
            "last": None if x.number == INHERITED else x.number, "keeps_last": x.number == INHERITED,
        }
        for (o, n), x in f.of.items()
    ]


def _from_rows(rows: list[dict]) -> Function:
    f = Function("")
    place = lambda x: (x["page"], x["pos"], x["k"]) if x else None
    f.of = {(r["is_open"], INHERITED if r["any"] else r["number"]): State(INHERITED if r["keeps_start"] else place(r["start"]), INHERITED if r["keeps_last"] else r["last"]) for r in rows}
    return f


def _rows_of(batches: Iterator[pa.RecordBatch], size: int = 2000) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, size).columns))


def scan(blocks: DataFrame, script: str, pages: int = PAGES, whole: int = WHOLE) -> DataFrame:
    """Pieces of blocks (book, page, pos, kind, text): (book, page, pos, kind, k, section, text, start, value, recovered).

    ``kind`` is text, heading or end; places are unique and not null in a book. ``section`` counts the headings and ends
    before a piece (a heading itself stands in the section that it opens, an end in the one that it closes), ``start`` is the
    place of the first piece of the passage, and ``value`` the number that ends it with this piece. Null texts are empty.
    Books beyond the size ``whole`` are cut into chunks of ``pages``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = blocks.select("book", F.floor(F.col("page") / pages).alias("chunk"), F.col("page").cast("long").alias("page"), F.col("pos").cast("long").alias("pos"), "kind", text.alias("text"))
    rows = materialize(rows, "blocks")  # read for the sizes of books, for functions and for pieces
    book = rows.schema["book"]

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, f = None, None
        for batch in batches:
            done = []
            for of, chunk, page, pos, kind, body in _rows_of([batch]):
                if own != (of, chunk):
                    if f is not None:
                        done.append((*own, f.breaks, _to_rows(f)))
                    own, f = (of, chunk), Function(script)
                f.read(page, pos, kind, body)
            yield batch_of(done, batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if f is not None:
            yield batch_of([(*own, f.breaks, _to_rows(f))], last)

    def batch_of(done: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (of, pa.int64(), pa.int64(), _LISTS))], ["book", "chunk", "breaks", "function"])

    def begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state in which each chunk of a book begins."""
        own, state, section = None, State(), 0
        for batch in batches:
            starts, numbers, sections = [], [], []
            for of, _, breaks, rows in _rows_of([batch], 500):
                if own != (of,):
                    own, state, section = (of,), State(), 0
                starts.append(state.start)
                numbers.append(state.number)
                sections.append(section)
                state, section = _from_rows(rows)(state), section + breaks
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _places(starts), pa.array(numbers, pa.int64()), pa.array(sections, pa.int64())], ["book", "chunk", "begin", "last", "before"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, section = None, State(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                out = []
                for of, chunk, page, pos, kind, body, *begun in _rows_of([batch.slice(at, 2000)]):
                    if own != (of, chunk):
                        own, state, section = (of, chunk), State(), 0
                        if begun:
                            begin, last, before = begun
                            state, section = State((begin["page"], begin["pos"], begin["k"]) if begin else None, last), before or 0
                    section += kind == "heading"
                    if kind == "text":
                        found, state = read_block(page, pos, kind, body, state, script, set())
                        out += [(of, page, pos, kind, k, section, piece, start, value, recovered) for k, piece, start, value, recovered in found]
                    else:
                        state = State(None, state.number)
                        out.append((of, page, pos, kind, 0, section, body.strip(), None, None, False))
                        section += kind == "end"
                columns = list(zip(*out)) or [()] * 10
                types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), None, pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if t else _places(c) for c, t in zip(columns, types)], ["book", "page", "pos", "kind", "k", "section", "text", "start", "value", "recovered"])

    def fields(ddl: str) -> T.StructType:
        return T.StructType([book, *T._parse_datatype_string(ddl).fields])

    size = F.sum(F.length("text") + F.lit(BLOCK))
    large = rows.groupBy("book").agg((size > whole).alias("large")).where("large").select("book")
    found = fields(f"page long, pos long, kind string, k long, section long, text string, start {_PLACE}, value long, recovered boolean")
    streams = dealt(rows, rows.count(), "book").join(large, "book", "left_anti").withColumn("chunk", F.lit(0).cast("long"))
    streams = streams.sortWithinPartitions("book", "page", "pos").mapInArrow(pieces, found)
    order = ["book", "chunk", "page", "pos"]
    cut = rows.join(large, "book", "left_semi")
    read = cut.repartition("book", "chunk").sortWithinPartitions(*order).mapInArrow(functions, fields(f"chunk long, breaks long, function {_FUNCTION}"))
    # A row for each chunk: as many tasks as there are partitions, as a row costs more than its bytes tell.
    states = dealt(read, 0, "book").sortWithinPartitions("book", "chunk").mapInArrow(begins, fields(f"chunk long, begin {_PLACE}, last long, before long"))
    return streams.unionByName(cut.join(states, ["book", "chunk"], "left").repartition("book", "chunk").sortWithinPartitions(*order).mapInArrow(pieces, found))


_PLACES = pa.struct([("page", pa.int64()), ("pos", pa.int64()), ("k", pa.int64())])
_LISTS = pa.list_(
    pa.struct([("is_open", pa.bool_()), ("number", pa.int64()), ("any", pa.bool_()), ("start", _PLACES), ("keeps_start", pa.bool_()), ("last", pa.int64()), ("keeps_last", pa.bool_())])
)


def _places(starts: list[tuple[int, int, int] | None]) -> pa.StructArray:
    """Places as an array, column by column."""
    none = [x is None for x in starts]
    columns = zip(*((x or (0, 0, 0) for x in starts) if any(none) else starts)) if starts else [()] * 3
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_PLACES), mask=pa.array(none, pa.bool_()) if any(none) else None)
