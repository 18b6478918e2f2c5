"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit where over half of the shingle hashes have it. Equal fingerprints are one class before anything
is compared. Classes are laid out in cells by the population counts of the fingerprint's four quarters and cells are
split into tiles of about ``tile`` fingerprints. Two fingerprints differ in at least as many bits as their quarters'
population counts do, so only tiles of cells at most ``radius`` apart are compared: every pair of them by exclusive-or
and bit count in numpy, block by block. No pair within the radius is lost. A pair of tiles hands on a spanning forest of
its links, not all of them, and the links become components in distributed rounds.

Work is quadratic in the number of distinct fingerprints (about 1/20 of all pairs are compared). A fingerprint is sent to
the tiles of the cells around its own, of which there are at most 65; a tile of a cell is a join key of its own, so the
fullest cell is no single task, and no task holds more than two tiles. In the wide form (near copies by resemblance) the
tiles of a cell form stripes of about the square root of their number, and a tile is sent once to each stripe that it
meets: the copies of a row grow with the square root of the number of rows.

Defined results: a null text is empty; a text without words has fingerprint zero; fewer words than a shingle make one
shingle of all; rows with equal ids are one document with several texts: its rows are one component with all that any
of them reaches; a null id never names a component and links nothing; repeated rows are kept; very long texts are read
whole; an empty table gives no rows; extra columns are ignored by ``fingerprints`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import product
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Texts, gram_hashes, materialize, mix, slices, string_views
from .components import components

BLOCKS = 4
TILE = 8192
#: Pairs of fingerprints that are compared at once, and links of them from which only a spanning forest is kept.
PAIRS, STRIP = 1 << 19, 256


def simhash(text: bytes, size: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text (UTF-8) as an unsigned 64-bit value."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = [digest(whole, seed)]
    else:
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - size + 1].tolist()
        hashes = [digest(whole[s:e], seed) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist())]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t.as_py().encode() if t.is_valid else b"", size, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Indices of links (i, j) between nodes below n that connect what all of them connect: at most n - 1."""
    label, kept = np.arange(n), []
    left = np.arange(len(i))
    while len(left):
        a, b = label[i[left]], label[j[left]]
        left = left[a != b]
        if not len(left):
            break
        a, b = label[i[left]], label[j[left]]
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        first = order[np.append(True, high[order][1:] != high[order][:-1])]
        kept.append(left[first])
        label_of = np.arange(n)
        label_of[high[first]] = low[first]  # each label hangs on a lesser one: no cycles
        while (label_of[label_of] != label_of).any():
            label_of = label_of[label_of]
        label = label_of[label]
    return np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or within one): positions in a and in b."""
    offset = 0 if same else len(a)
    found_i, found_j = [], []
    rows = max(1, PAIRS // max(1, len(b)))
    for at in range(0, len(a), rows):
        strip = a[at : at + rows]
        near = np.bitwise_count(strip[:, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        if len(i) > STRIP:
            keep = forest(i, j + offset, offset + len(b))
            i, j = i[keep], j[keep]
        found_i.append(i)
        found_j.append(j)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    if len(i) > 1:
        keep = forest(i, j + offset, offset + len(b))
        i, j = i[keep], j[keep]
    return i, j


def links(classes: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b): ids of classes (fp, rep) that connect all pairs within the radius."""
    width = 64 // BLOCKS
    quarters = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit((1 << width) - 1))) for k in range(BLOCKS)]
    base = width + 1
    cell = sum((q * base**k for k, q in enumerate(quarters)), F.lit(0)).cast("int")
    placed = materialize(classes.where("rep IS NOT NULL").withColumn("cell", cell), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = (
        placed.join(F.broadcast(sizes), "cell")  # at most 17**4 cells
        .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list("fp").alias("fps"), F.collect_list("rep").alias("reps"))
    )
    tiles = materialize(tiles, "tiles")
    # Each tile goes to the tiles of the cells at most the radius below its own in the order of steps; at step 0 a cell meets itself.
    steps = [d for d in product(range(-radius, radius + 1), repeat=BLOCKS) if sum(map(abs, d)) <= radius and d >= (0,) * BLOCKS]
    offsets = F.array(*(F.array(*map(F.lit, d)) for d in steps))
    counts = [F.pmod(F.floor(F.col("cell") / base**k), F.lit(base)).cast("int") for k in range(BLOCKS)]
    to = [counts[k] - F.col("step")[k] for k in range(BLOCKS)]
    right = (
        tiles.withColumn("step", F.explode(offsets))
        .where(reduce(and_, (t.between(0, width) for t in to)))
        .select(
            sum((t * base**k for k, t in enumerate(to)), F.lit(0)).alias("cell"),
            *(F.col(c).alias(f"{c}_b") for c in ("cell", "part", "fps", "reps")),
        )
        .join(F.broadcast(sizes), "cell")  # at most 17**4 cells; those without rows drop out
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("cell") == F.col("cell_b"), F.col("part_b")).otherwise(F.col("parts") - 1))))
    )
    pairs = tiles.join(right, ["cell", "part"])
    pairs = pairs.select("fps", "reps", "fps_b", "reps_b", F.expr("cell = cell_b AND part = part_b").alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [list_views(batch.column(k)) for k in range(4)]
            same = batch.column(4).to_pylist()
            out_a, out_b = [], []
            for r in range(batch.num_rows):
                fps, reps, fps_b, reps_b = (v[o[r] : o[r + 1]] for v, o in columns)
                i, j = compare_tiles(fps.view(np.uint64), fps_b.view(np.uint64), radius, same[r])
                if len(i):
                    out_a.append(reps[i])
                    out_b.append(reps_b[j])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def list_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists of longs."""
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def shared_ids(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): ids of classes (fp, rep) that rows of one document id (doc_id, fp) connect."""
    several = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most").select("doc_id")
    of = prints.join(several, "doc_id").join(classes, "fp").select("doc_id", "rep")
    return of.join(of.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b")


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row; the component's id is the smallest doc_id reachable over links and shared ids."""
    prints = materialize(fingerprints(docs, size, seed), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(links(classes, radius).unionByName(shared_ids(prints, classes)))
    named = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Wide fingerprints: 64-bit words of one, those that are compared first, and the margin of candidates in standard deviations.
WIDE_WORDS, FIRST_WORDS, SIGMAS = 8, 2, 5.0
WIDE_TILE, WIDE_STRIP = 16_384, 64
#: Sets below this size have radii of their own; shingles that a block of exact comparison holds.
FEW, BLOCK_SHINGLES = 128, 1 << 19


def wide_share(similarity: float, n: int, m: int) -> float:
    """The chance that a bit differs between sets of n and m hashes with the least overlap of this resemblance (0: there is none)."""
    common = math.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
    if common > min(n, m):
        return 0.0

    def coins(k: int) -> np.ndarray:
        return np.array([math.comb(k, x) / 2**k for x in range(k + 1)])

    def above(k: int, half: int) -> np.ndarray:
        """For each number of common hashes with the bit: the chance that, with k others, over half have it."""
        tail = np.append(np.cumsum(coins(k)[::-1])[::-1], 0.0)
        return tail[np.clip(half + 1 - np.arange(common + 1), 0, k + 1)]

    a, b = above(n - common, n // 2), above(m - common, m // 2)
    return float((coins(common) * (a * (1 - b) + b * (1 - a))).sum())


@cache
def wide_radii(similarity: float, bits: int) -> np.ndarray:
    """By the lesser of two sets' sizes (the last entry: ``FEW`` and more), bits that fingerprints of this resemblance may differ in."""
    shares = [max((wide_share(similarity, n, m) for m in range(n, int(n / similarity + 1e-9) + 1)), default=0.0) for n in range(FEW)]
    shares.append(max(math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi, *shares[FEW // 2 :]))
    return np.array([int(bits * p + SIGMAS * math.sqrt(bits * p * (1 - p))) for p in shares])


def wide_simhash(hashes: np.ndarray, words: int = WIDE_WORDS) -> bytes:
    """The fingerprint of a set of hashes: for each bit of ``words`` further hashes of them whether over half have it."""
    n = len(hashes)
    if not n:
        return bytes(8 * words)
    lanes = np.empty((n, words), dtype=np.uint64)
    for k in range(words):
        lanes[:, k] = mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    total = np.zeros(64 * words, dtype=np.int64)
    bits = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")
    for at in range(0, n, 255):  # sums of up to 255 rows fit into bytes
        total += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > n, bitorder="little").tobytes()


def shingle_sets(texts: Texts, size: int) -> list[np.ndarray]:
    """Each text's set of shingle hashes, in order; fewer words than a shingle make one of all."""
    starts, ends, first = texts.words()
    words = texts.word_hashes(starts, ends)
    grams, out = gram_hashes(words, size), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(np.unique(grams[a : b - size + 1] if b - a >= size else gram_hashes(words[a:b], b - a) if b > a else words[:0]))
    return out


def set_key(own: np.ndarray) -> int:
    """A set of hashes as a signed 64-bit value."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def row_hash(docs: DataFrame) -> F.Column:
    """A hash of a whole row, which tells apart in which columns and fields it is null."""
    parts = []
    for field in docs.schema.fields:
        col = F.col("`" + field.name.replace("`", "``") + "`")
        plain = isinstance(field.dataType, T.AtomicType) and not isinstance(field.dataType, T.VariantType)
        parts += [col.isNull(), col if plain else F.to_json(F.struct(col), {"ignoreNullFields": "false"})]
    return F.xxhash64(*parts)


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with underscores until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def wide_fingerprints(docs: DataFrame, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, node, fp, n): a hash of every row, the key of its set of shingles (lower-case words), the wide fingerprint and the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                sets = shingle_sets(texts, size)
                columns = [pa.array([set_key(x) for x in sets], pa.int64()), pa.array([wide_simhash(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *columns], ["doc_id", "row", "node", "fp", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(docs).alias("row"), F.lower(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, node long, fp binary, n long")


def compare_wide(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the candidate links between two tiles of wide fingerprints: positions in a and in b."""
    offset = 0 if same else len(a)
    first, radii = wide_radii(similarity, 64 * FIRST_WORDS).max(), wide_radii(similarity, 64 * a.shape[1])
    columns = [np.ascontiguousarray(b[:, k]) for k in range(FIRST_WORDS)]
    found_i, found_j = [], []
    for at in range(0, len(a), WIDE_STRIP):
        strip = a[at : at + WIDE_STRIP]
        apart = np.bitwise_count(strip[:, 0, None] ^ columns[0][None, :])
        for k in range(1, FIRST_WORDS):
            apart += np.bitwise_count(strip[:, k, None] ^ columns[k][None, :])
        i, j = np.nonzero(apart <= first)
        i += at
        ok = (np.minimum(na[i], nb[j]) >= similarity * np.maximum(na[i], nb[j])) & ((i < j) | (not same))
        i, j = i[ok], j[ok]
        for s in range(0, len(i), 1 << 18):
            p, q = i[s : s + (1 << 18)], j[s : s + (1 << 18)]
            near = np.bitwise_count(a[p] ^ b[q]).sum(axis=1, dtype=np.int64) <= radii[np.minimum(np.minimum(na[p], nb[q]), FEW)]
            p, q = p[near], q[near]
            if len(p) > STRIP:
                keep = forest(p, q + offset, offset + len(b))
                p, q = p[keep], q[keep]
            found_i.append(p)
            found_j.append(q)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))
    if len(i) > 1:
        keep = forest(i, j + offset, offset + len(b))
        i, j = i[keep], j[keep]
    return i, j


def similar_links(classes: DataFrame, similarity: float, tile: int = WIDE_TILE) -> DataFrame:
    """(a, b): ids of classes (fp, n, rep) that connect all candidates, pairs that may have at least this similarity.

    Sets of a resemblance have sizes in that ratio at least, so a cell of sizes is compared with itself and the next one.
    The tiles of a cell form stripes; a tile is sent once to each stripe that it is compared with, and meets its tiles there
    one by one.
    """
    cell = F.when(F.col("n") > 0, F.floor(F.ln(F.col("n").cast("double")) / -math.log(similarity) + 1e-9) + 1).otherwise(0).cast("int")
    placed = materialize(classes.where("rep IS NOT NULL").withColumn("cell", cell), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = (
        placed.join(F.broadcast(sizes), "cell")  # a row for each power of 1 / similarity
        .groupBy("cell", "parts", F.pmod(F.xxhash64("fp", "n"), F.col("parts")).cast("int").alias("part"))
        .agg(F.collect_list(F.struct("fp", "n", "rep")).alias("rows"))
    )
    tiles = materialize(tiles, "tiles")

    def stripe(part: F.Column, parts: F.Column) -> F.Column:
        return F.floor(part / F.ceil(F.sqrt(parts))).cast("int")

    home = tiles.select("cell", stripe(F.col("part"), F.col("parts")).alias("stripe"), F.col("part").alias("part_a"), "rows")
    visits = [F.struct(F.col("cell").alias("cell"), F.col("parts").alias("parts"), F.col("part").alias("last")), F.struct((F.col("cell") - 1).alias("cell"), F.col("below").alias("parts"), (F.col("below") - 1).alias("last"))]
    lower = sizes.select((F.col("cell") + 1).alias("cell"), F.col("parts").alias("below"))
    guests = (
        tiles.join(F.broadcast(lower), "cell", "left")  # a row for each power of 1 / similarity
        .select(F.col("cell").alias("cell_b"), F.col("part").alias("part_b"), F.col("rows").alias("rows_b"), F.explode(F.filter(F.array(*visits), lambda v: v["parts"].isNotNull())).alias("v"))
        .select("cell_b", "part_b", "rows_b", F.col("v.cell").alias("cell"), F.explode(F.sequence(F.lit(0), stripe(F.col("v.last"), F.col("v.parts")))).alias("stripe"))
    )
    pairs = guests.join(home, ["cell", "stripe"]).where("cell <> cell_b OR part_a <= part_b").select("rows", "rows_b", F.expr("cell = cell_b AND part_a = part_b").alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in range(2):
                column = batch.column(c)
                fps, ns, reps = column.values.flatten()
                body, _ = string_views(fps)
                sides.append((body.view(np.uint64).reshape(-1, WIDE_WORDS) if len(body) else np.zeros((0, WIDE_WORDS), np.uint64), ns.to_numpy(), reps.to_numpy(), column.offsets.to_numpy()))
            for r, same in enumerate(batch.column(2).to_pylist()):
                (a, na, ra), (b, nb, rb) = ((f[o[r] : o[r + 1]], n[o[r] : o[r + 1]], p[o[r] : o[r + 1]]) for f, n, p, o in sides)
                i, j = compare_wide(a, b, na, nb, similarity, same)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ra[i]), pa.array(rb[j])], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def resembling(a: list[np.ndarray], b: list[np.ndarray], fa: np.ndarray, fb: np.ndarray, similarity: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets of at least this resemblance between two blocks (or within one): positions in a and in b.

    A set is compared with all candidates that no link has joined to it yet, so copies of each other cost a comparison each.
    """
    offset, radii = 0 if same else len(a), wide_radii(similarity, 64 * WIDE_WORDS)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    label = np.arange(offset + len(b))
    found_i, found_j = [], []
    for i, own in enumerate(a):
        lo = i + 1 if same else 0
        least, most = np.minimum(na[i], nb[lo:]), np.maximum(na[i], nb[lo:])
        near = np.bitwise_count(fa[i] ^ fb[lo:]).sum(axis=1, dtype=np.int64) <= radii[np.minimum(least, FEW)]
        j = np.flatnonzero(near & (least >= similarity * most) & (label[offset + lo :] != label[i])) + lo
        if not len(j) or not len(own):
            continue
        others = np.concatenate([b[k] for k in j.tolist()])
        hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(nb[j]) - nb[j])
        for k in j[common >= similarity * (na[i] + nb[j] - common) - 1e-9].tolist():
            if label[offset + k] != label[i]:
                label[label == label[offset + k]] = label[i]
                found_i.append(i)
                found_j.append(k)
    return np.array(found_i, dtype=np.int64), np.array(found_j, dtype=np.int64)


def verified_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, similarity: float, size: int) -> DataFrame:
    """(a, b): nodes of classes (node, fp, n, rep) that connect all pairs of at least this similarity, by their sets of shingles.

    Each such pair lies in one group (node, component), as ``components`` lists candidates. The sets of a group are dealt to blocks of about
    ``BLOCK_SHINGLES``, and each block meets itself and the group's other blocks.
    """
    whole = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())  # the least nodes too
    wanted = materialize(classes.join(whole, "node"), "candidates")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                own = shingle_sets(texts, size)
                yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.lower(F.col("text")).alias("text")).join(wanted.select("rep").distinct(), "rep", "left_semi").select("text")
    own = texts.mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"])
    parts = wanted.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    placed = wanted.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(own, "node")
    blocks = materialize(placed.groupBy("component", "parts", "part").agg(F.collect_list(F.struct("fp", "node", "shingles")).alias("rows")), "blocks")
    within = blocks.select("rows", F.expr("slice(rows, 1, 0)").alias("rows_b"))
    several = blocks.where("parts > 1")
    left = several.select("component", F.col("part").alias("to"), "rows")
    right = several.where("part > 0").select("component", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("to"), F.col("rows").alias("rows_b"))
    pairs = within.unionByName(left.join(right, ["component", "to"]).select("rows", "rows_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for r in range(batch.num_rows):
                sides = []
                for c in range(2):
                    fps, nodes, shingles = batch.column(c).slice(r, 1).flatten().flatten()
                    body, _ = string_views(fps)
                    data, at = string_views(shingles)
                    sides.append((np.frombuffer(body.tobytes(), np.uint64).reshape(-1, WIDE_WORDS), nodes.to_numpy(), [np.frombuffer(data[s:e].tobytes(), np.uint64) for s, e in zip(at[:-1], at[1:])]))
                (fa, ra, a), (fb, rb, b) = sides
                same = not len(rb)
                i, j = resembling(a, a, fa, fa, similarity, True) if same else resembling(a, b, fa, fb, similarity, False)
                out_a.append(ra[i])
                out_b.append((ra if same else rb)[j])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The rows and columns of docs with one row of each component of near copies: the one with the least id (then hash of the row), once.

    Near copies have shingles of this resemblance. Wide fingerprints find candidates, with ``SIGMAS`` standard deviations of
    margin; the sets of shingles decide. Rows with a null id are kept as they are.
    """
    named, row = docs.where("doc_id IS NOT NULL"), free_name(docs, "_row")
    prints = wide_fingerprints(named, size)
    classes = materialize(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.min(F.struct("doc_id", "row")).alias("least")).select("node", "fp", "n", "least.*").withColumnRenamed("doc_id", "rep"), "classes")
    groups = components(similar_links(classes.select("fp", "n", F.col("node").alias("rep")), similarity))
    found = components(verified_links(named, classes, groups, similarity, size)).select("node", "component")
    of = classes.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component"))
    keep = materialize(of.agg(F.min(F.struct("rep", "row")).alias("least")).select(F.col("least.rep").alias("doc_id"), F.col("least.row").alias(row)), "kept")
    once = named.withColumn(row, row_hash(named)).join(keep, ["doc_id", row], "left_semi").dropDuplicates(["doc_id", row])
    return once.drop(row).unionByName(docs.where("doc_id IS NULL"))
