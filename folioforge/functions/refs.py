"""Refs (book/path/path#leaf), versions and content hashes as Column expressions."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = "[a-z0-9]+(?:-[a-z0-9]+)*"
#: FNV-1a of 64 bits, and the separators of a hashed verse.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
FIELD, RECORD, GLOSS = "\u001f", "\u001e", "\u001d"


def is_ref(ref: Column) -> Column:
    return F.regexp_like(ref, F.lit(f"^{SEGMENT}(?:/{SEGMENT})*(?:#{SEGMENT})?$"))


def parse_ref(ref: Column) -> Column:
    """(book_id, path, leaf) of a legal ref, else null."""
    base = F.split(F.split(ref, "#")[0], "/")
    leaf = F.get(F.split(ref, "#"), F.lit(1))
    return F.when(is_ref(ref), F.struct(base[0].alias("book_id"), F.slice(base, F.lit(2), F.greatest(F.size(base) - 1, F.lit(0))).alias("path"), leaf.alias("leaf")))


def format_ref(book_id: Column, path: Column, leaf: Column) -> Column:
    base = F.concat_ws("/", book_id, path)
    return F.when(leaf.isNull(), base).otherwise(F.concat(base, F.lit("#"), leaf))


def parent_ref(ref: Column) -> Column:
    """The container of a verse or division; null for a book."""
    return F.when(F.contains(ref, F.lit("#")), F.regexp_replace(ref, "#.*$", "")).when(F.contains(ref, F.lit("/")), F.regexp_replace(ref, "/[^/]*$", ""))


def ref_contains(ancestor: Column, descendant: Column) -> Column:
    """Whether a ref is another one or lies below it; a verse contains itself only."""
    return (ancestor == descendant) | (~F.contains(ancestor, F.lit("#")) & (F.startswith(descendant, F.concat(ancestor, F.lit("/"))) | F.startswith(descendant, F.concat(ancestor, F.lit("#")))))


def version_key(version: Column) -> Column:
    """An array that sorts versions by number; null for what is no version."""
    return F.when(F.regexp_like(version, F.lit("^\\d+\\.\\d+\\.\\d+$")), F.transform(F.split(version, "\\."), lambda x: x.cast("long")))


def bump_between(before: Column, after: Column) -> Column:
    """Which part of the version rose; null if it isn't newer or one of both is no version."""
    a, b = version_key(before), version_key(after)
    return F.when(a.isNull() | b.isNull() | ~(b > a), F.lit(None).cast("string")).when(b[0] != a[0], "major").when(b[1] != a[1], "minor").otherwise("patch")


def bump_rank(bump: Column) -> Column:
    return F.when(bump == "patch", 0).when(bump == "minor", 1).when(bump == "major", 2)


def _fnv1a64(texts: pa.Array) -> pa.Array:
    """The hashes of a batch of texts, all of them byte by byte side by side; the few that are longer than all others one by one."""
    data = texts.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    if not len(data) or data.buffers()[2] is None:
        return pa.array([f"{FNV_OFFSET:016x}" if ok else None for ok in texts.is_valid().to_pylist()], pa.string())
    bytes_ = np.frombuffer(data.buffers()[2], np.uint8)
    order = np.argsort(ends[:-1] - ends[1:], kind="stable")  # the longest first
    starts, sizes = ends[:-1][order], (ends[1:] - ends[:-1])[order]
    h, prime = np.full(len(order), FNV_OFFSET, np.uint64), np.uint64(FNV_PRIME)
    # A text is done byte by byte alone behind the size of the 16th longest.
    common = int(sizes[15]) if len(sizes) > 15 else 0
    active = np.searchsorted(-sizes, -np.arange(common), "left")
    for i, n in enumerate(active):
        h[:n] = (h[:n] ^ bytes_[starts[:n] + i]) * prime
    for k in range(min(15, len(order))):
        x = int(h[k])
        for b in bytes_[starts[k] + common : starts[k] + sizes[k]].tobytes():
            x = (x ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        h[k] = x
    out = np.empty_like(h)
    out[order] = h
    return pa.array([f"{x:016x}" for x in out.tolist()], pa.string(), mask=np.asarray(texts.is_null()))


def fnv1a64(text: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes as 16 hexadecimal digits.

    Spark has no function for it, and folding an array of bytes by an expression takes some microseconds a byte, so batches go to Arrow.
    """
    return F.arrow_udf(_fnv1a64, "string")(text)


def verse_hash(layers: Column) -> Column:
    """The content hash of a map of layers: entries by id, joined and hashed (texts must be in normal form C)."""
    entries = F.array_sort(F.map_entries(layers))
    return F.concat(F.lit("f1a64:"), fnv1a64(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(FIELD), e["value"])), RECORD)))


def _normal_fnv1a64(texts: pa.Array, maps: pa.Array) -> pa.Array:
    """The hashes of a batch of joined layers in normal form C; of those whose ids also need it, the maps as JSON."""
    data = texts.buffers()[2]
    if data is not None and data.size and np.frombuffer(data, np.int8).min() < 0:
        texts = pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())
    if maps.null_count < len(maps):
        joined = lambda m: RECORD.join(f"{k}{FIELD}{v}" for k, v in sorted(json.loads(unicodedata.normalize("NFC", m)).items()))
        texts = pa.array([t if m is None else joined(m) for t, m in zip(texts.to_pylist(), maps.to_pylist(), strict=True)], pa.string())
    return _fnv1a64(texts)


def normal_verse_hash(layers: Column) -> Column:
    """``verse_hash`` of a map of layers in any normal form, in one step."""
    # The separators compose with nothing, so the joined text is brought to normal form as a whole; ids that aren't ASCII may change their order.
    entries, ids = F.array_sort(F.map_entries(layers)), F.array_join(F.map_keys(layers), "")
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(FIELD), e["value"])), RECORD)
    return F.concat(F.lit("f1a64:"), F.arrow_udf(_normal_fnv1a64, "string")(text, F.when(F.octet_length(ids) != F.length(ids), F.to_json(layers))))
