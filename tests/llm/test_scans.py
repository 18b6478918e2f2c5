"""Secrets, token counts, sketches, shards and packing: against brute force and round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from folioforge.llm import bottomk, packing, secrets, sharding, token_counts
from folioforge.llm.queries import tokenizer_path

from .fixtures import documents, make, words

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for k, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32), ("github", "gh[pousr]_[A-Za-z0-9]+", 40)), 1):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_secrets_agree_with_expressions(spark):
    rng = random.Random(3)
    pieces = ["password", "SECRET", "token", "api_key", "apikey", " ", "  ", ":", "=", "'", '"', "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMN", "1", "é", "\n", "x", "ghp_", "A" * 36, "a"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 24)))) for k in range(1500)] + [(9000, None), (9001, "z" * 50000 + " token=abcdefgh1")]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.secret_spans(make(spark, rows)).collect()}
    assert got == {k: brute_spans(t or "") for k, t in rows}
    digest = {r["doc_id"]: r for r in secrets.secret_digest(make(spark, rows[:50] + rows[-2:])).collect()}
    for k, t in rows[:50] + rows[-2:]:
        base = [s for s in brute_spans(t or "") if s[0] != "github"]
        assert digest[k]["base_sha256"] == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base).encode()).hexdigest()
        assert digest[k]["n_hex"] == sum(s[0] == "hex" for s in base)
    assert secrets.secret_spans(make(spark, [])).count() == 0


def test_a_dropped_match_still_uses_up_its_text(spark):
    got = secrets.secret_spans(make(spark, [(1, 'secret=token="abcdefgh"')])).first()["spans"]
    assert [tuple(s) for s in got] == brute_spans('secret=token="abcdefgh"')


def rest_spans(text):
    """The spans of the kinds that ``brute_spans`` leaves out."""
    out = []
    for k, rule in enumerate(secrets.RULES):
        if rule.kind in ("slack", "jwt", "private_key"):
            out += [(m.start(), k, rule.kind, m.end()) for m in re.finditer(rule.pattern, text) if len(m[0]) >= rule.least]
    return sorted(out)


def test_added_rules_agree_with_expressions():
    rng = random.Random(12)
    pieces = ["eyJ", ".", "a", "Zz0", "_", " ", "xoxb-", "xox", "-----BEGIN ", "PRIVATE KEY", "-----", "RSA ", "é", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"]
    scanner = secrets.Scanner()
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))
        got = [(s["kind"], s["start"], s["end"]) for s in secrets._code_points(text.encode(), scanner.spans(text.encode())) if s["kind"] in ("slack", "jwt", "private_key")]
        assert got == [(kind, a, b) for a, _, kind, b in rest_spans(text)]


@pytest.mark.parametrize("piece", ["eyJ", "-----BEGIN ", "secret=", "0123456789abcdef", "eyJa.", "AKIAAKI", "password : é ", "xoxb-"])
def test_long_hostile_texts_take_seconds(piece):
    import time

    scanner, text = secrets.Scanner(), piece * (1_000_000 // len(piece))
    start = time.process_time()
    got = secrets._code_points(text.encode(), scanner.spans(text.encode()))
    assert time.process_time() - start < 20
    want = sorted([*((a, kind, b) for kind, a, b in brute_spans(text)), *((m.start(), "slack", m.end()) for m in re.finditer("xox[abprs]-[A-Za-z0-9-]+", text) if len(m[0]) >= 15)])
    assert [(s["start"], s["kind"], s["end"]) for s in got if s["kind"] not in ("jwt", "private_key")] == want
    assert not [s for s in got if s["kind"] in ("jwt", "private_key")]


def test_rows_of_one_id_and_clashing_columns_are_scanned_each(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh1", "x", 1), (1, "token=abcdefgh1", "x", 1), (1, "clean", "x", 1), (None, "secret: 12345678", None, None)], "doc_id long, text string, spans string, n_hex int")
    out = secrets.secret_digest(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_assign"]) for r in out) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    kept = secrets.redact(df)
    assert kept.columns == df.columns and sorted(r["text"] for r in kept.collect()) == ["[SECRET]", "[SECRET]", "[SECRET]", "clean"]
    assert secrets.redact(df.limit(0)).count() == 0


def test_redaction(spark):
    df = make(spark, [(1, "é password: hunter2hunter2 end"), (2, None), (3, "clean")])
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(df).collect()}
    assert out == {1: ("é [SECRET] end", 14), 2: (None, None), 3: ("clean", None)}
    assert secrets.redact(df).columns == df.columns


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(1)
    pieces = ["a", "ab", "aa", "  ", " ", "\n", "the", "1", "11", "é", "中", "🙂", "\x00", "▁", "=", "==", "----", "er", "in", "\t", "<s>"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for k in range(3000)] + [(9000, "a" * 5000), (9001, " " * 300), (9002, None)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(make(spark, rows), tokenizer_path("piece_bpe_32k.model"), limit=20).collect()}
    for k, t in rows:
        n = len(library.encode(t or ""))
        assert got[k] == (len((t or "").encode()), n, n > 20)
    assert token_counts.token_counts(make(spark, []), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    df, rows = documents(spark)
    rows = [r for r in rows if r[0] not in (3, None)] + [(500, "<|endoftext|> It's 12 <|"), (501, "ΑΣ İ ﬁ ́x")]
    out = packing.pack(make(spark, rows), tokenizer_path("word_bpe_49k.json"), length=64, shard_bytes=2000).collect()
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in out if r["doc_id"] == d), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == np.array(ids, "<u4").tobytes()
        assert [r["start"] for r in own] == np.cumsum([0, *(len(r["ids"]) // 4 for r in own)])[:-1].tolist()
        assert all(r["doc_tokens"] == len(ids) for r in own)
    short = 0
    for s in {r["sequence_id"] for r in out}:
        own = sorted((r["offset"], len(r["ids"]) // 4) for r in out if r["sequence_id"] == s)
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
        short += sum(n for _, n in own) < 64
    assert short <= 4  # the last sequence of each task
    assert packing.pack(make(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0
    repeated = packing.packing_digest(df.where("doc_id = 3"), tokenizer_path("word_bpe_49k.json"))
    assert repeated.where("start = 0").count() == 2


def test_sequences_are_full_with_more_tasks_than_sequences(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(f"word{rng.randrange(300)}" for _ in range(rng.randint(1, 60)))) for k in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        out = packing.pack(make(spark, rows).repartition(9), tokenizer_path("word_bpe_49k.json"), length=256, shard_bytes=500).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    used, of_doc = {}, {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], len(r["ids"]) // 4))
        of_doc.setdefault(r["doc_id"], []).append((r["start"], len(r["ids"]) // 4, r["doc_tokens"]))
    for spans in used.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256
    assert sum(sum(n for _, n in spans) < 256 for spans in used.values()) <= 1
    for spans in of_doc.values():
        at = 0
        for start, n, total in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at == total


def shard_of(bodies):
    return packing.Words(packing.Texts(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)])))


def test_full_tables_change_no_id(monkeypatch):
    monkeypatch.setattr(packing, "WORD_ENTRIES", 40)
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 30)
    encoder = packing.WordEncoder(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(5)
    for _ in range(12):
        bodies = [" ".join(rng.choice(["a", "Bee's", "x" * 90, "é́", f"w{rng.randrange(60)},", "<|endoftext|>", "1234"]) for _ in range(rng.randint(0, 30))) for _ in range(9)]
        ids, begin = encoder.encode(shard_of([b.encode() for b in bodies]), 1)
        for k, b in enumerate(bodies):
            assert ids[begin[k] : begin[k + 1]].tolist() == [*encoder.tokenizer.encode(b, add_special_tokens=False).ids, 1]


def test_neighbours_share_rare_words():
    index = packing.Bm25(shard_of([b"alpha beta gamma", b"one two three", b"gamma delta alpha", b"two four one", b"", b"lonely"]))
    assert index.neighbours(0, np.array([True, False, False, False, False, False])).tolist() == [2]
    assert list(packing.reading_order(index, np.array([5, 5, 5, 5, 1, 1]), 10, 0)) == [0, 2, 1, 3, 4, 5]


def brute_bm25(bodies, seed):
    docs = [b.split() for b in bodies]
    mean, n = sum(map(len, docs)) / len(docs), len(docs)
    out = []
    for d in docs:
        s = 0.0
        for w in set(docs[seed]):
            df, tf = sum(w in x for x in docs), d.count(w)
            if df > 1:
                s += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf else 0.0
        out.append(s)
    return out


def test_scores_are_those_of_all_words():
    rng = random.Random(9)
    bodies = [" ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(0, 120))).encode() for _ in range(90)]
    index = packing.Bm25(shard_of(bodies))
    assert len(index.rows) and len(index.doc)
    for seed in range(0, 90, 7):
        assert index.scores(seed) == pytest.approx(brute_bm25(bodies, seed), rel=1e-4, abs=1e-4)
        used = np.zeros(90, dtype=bool)
        order = index.neighbours(seed, used).tolist()
        assert index.scores(seed)[order].tolist() == sorted(index.scores(seed)[order].tolist(), reverse=True) and len(order) >= min(64, (index.scores(seed) > 0).sum())


def test_related_texts_are_routed_together(spark):
    rng = random.Random(2)
    vocabulary = [f"r{k}" for k in range(5000)]
    rows = []
    for k in range(300):
        words = [rng.choice(vocabulary) for _ in range(80)]
        near = [*words[:20], "edit", *words[21:]]
        rows += [(k, " ".join(words)), (1000 + k, " ".join(near))]
    rows += [(5000 + k, "the same words in every copy") for k in range(400)] + [(7, None), (None, "x"), (None, "")]
    out = packing.routed(make(spark, rows).repartition(3)).rdd.mapPartitionsWithIndex(lambda i, rs: ((i, r["doc_id"]) for r in rs)).collect()
    assert sorted(str(d) for _, d in out) == sorted(str(d) for d, _ in rows)
    place = {d: i for i, (_, d) in enumerate(out)}
    beside = [abs(place[k] - place[1000 + k]) == 1 for k in range(300)]
    assert np.mean(beside) > 0.9
    sizes = np.bincount([i for i, _ in out])
    assert len(sizes) == 4 and sizes.max() < 2 * sizes.min()  # 400 copies have one key


def test_shards(spark):
    df, rows = documents(spark)
    for n in (16, 3):
        out = sharding.shard_table(df, n).collect()
        assert len(out) == len(rows)
        total = sum(r["size"] for r in out)
        sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(n)]
        assert all(abs(x - total / n) <= max(r["size"] for r in out) for x in sizes)
        for s in range(n):
            assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
        ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
        assert ids == sorted(ids)
    texts = dict((k, t) for k, t in rows if k is not None)
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["size"] == len((texts[r["doc_id"]] or "").encode()) + 1 for r in out if r["doc_id"] is not None)
    assert sharding.shard_table(df.limit(0)).count() == 0


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def resemblance(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_sketches_of_texts_and_edits(spark):
    df, rows = documents(spark)
    rows = [r for r in rows if r[0] not in (3, None)]
    got = {r["doc_id"]: r for r in bottomk.edited_digest(make(spark, rows)).collect()}
    ordered = sorted(((d, t or "") for d, t in rows), reverse=True)
    for (d, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d]["near_edited"] == pytest.approx(resemblance(shingles(t), shingles(edited)), abs=0.15)
        assert got[d]["near_next"] == pytest.approx(resemblance(shingles(t), shingles(after)), abs=0.15)
    assert bottomk.edited_digest(df).count() == len(rows) + 3
    assert bottomk.edited_digest(df.limit(0)).count() == 0
    one = bottomk.edited_digest(make(spark, [(1, "ab")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"aa").hexdigest()


def test_sketches_merge(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    b[:2000] = a[:2000]
    whole = bottomk.least_distinct(np.concatenate([a, b]), 256)
    sa, sb = bottomk.least_distinct(a, 256), bottomk.least_distinct(b, 256)
    assert (bottomk.merge(sa, sb, 256) == whole).all()
    assert bottomk.resemblance(sa, sb, 256) == pytest.approx(2000 / 6000, abs=0.1)
    assert bottomk.containment(sb, sa, 256) == pytest.approx(2 / 3, abs=0.2)
    df, rows = documents(spark)
    out = bottomk.group_sketches(df.withColumn("source", df["doc_id"] % 2), "source", k=64).collect()
    for r in out:
        own = set().union(*(shingles(t) for d, t in rows if (None if d is None else str(d % 2)) == r["grp"]))
        assert r["n_distinct"] == pytest.approx(len(own), rel=0.4)
