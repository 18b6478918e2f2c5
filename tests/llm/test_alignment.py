"""Alignment of two vocabularies, against both libraries on whole texts and all links counted one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from folioforge.llm import alignment
from folioforge.llm.queries import tokenizer_path

from .fixtures import documents, make

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def _libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def _bytes_a(tokenizer, i):
    return bytes(alignment._byte_alphabet()[c] for c in tokenizer.id_to_token(i))


def _bytes_b(model, i):
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def _groups(a, b, text):
    """Groups of one text by whole encodings, or none."""
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a, bytes_b = [_bytes_a(a, i) for i in ids_a], [_bytes_b(b, i) for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []

    def ends(parts):
        out, at = [], 0
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    cuts = sorted(set(ends_a) & set(ends_b))
    before = lambda e, lo, hi: [k for k, x in enumerate(e) if lo < x <= hi]
    return [([ids_a[k] for k in before(ends_a, lo, hi)], [ids_b[k] for k in before(ends_b, lo, hi)]) for lo, hi in zip([0, *cuts], cuts)]


def _expected(rows):
    a, b = _libraries()
    cached = {t: _groups(a, b, t) for t in {t for _, t in rows}}
    count, best = Counter(), defaultdict(int)
    links = {t: Counter((x, y) for ga, gb in g for x in ga for y in gb) for t, g in cached.items()}
    for _, t in rows:
        count.update(links[t].keys())
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for d, t in rows:
        g = cached[t]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((
            d, sum(len(ga) for ga, _ in g), sum(len(gb) for _, gb in g), len(g), sum(links[t].values()),
            sum(n for p, n in links[t].items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links[t].items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return Counter(out)


def _got(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


HOSTILE = [
    "plain words only", " leading", "  two leading", "trailing ", "trailing  ", "\nline", "a\n b", "a \nb", "a\n\n\nb", "a\r\nb\tc\x0bd\x0ce", "\t", "\n", " ", "   ", " x   y", "a　 b",
    "mark ▁ inside", "▁", "<|endoftext|> and </s> <s> <unk> <0x41>", "A\x00B \x01", "\x1c \x1d\n\x85 z", "naïve façade ﬁ Ⅳ ①", "日本語のテキスト 日本", "🙂🙃 👩‍👩‍👧", "can't we'll I'M 123456 3.14", "é ́", "a᠎  b​  c﻿ \n d",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "(){}[]<>///***   \t  \n\n  --==", "x" * 5000, "0123456789" * 300, "ab" * 2000 + " end",
]


def _random_texts(n=150):
    rng = random.Random(11)
    pieces = [" ", " ", "  ", "\n", "\t", "\r", "▁", " ", "a", "the", "ing", "Ünter", "é", "x1", "42", "'s", "!", "...", "🙂", "日", "\x1f", "​", "<s>", "ation", "er"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_whole_texts_equal_both_libraries(spark, monkeypatch):
    docs, rows = documents(spark)
    rows = rows + [(2000 + k, t) for k, t in enumerate(HOSTILE + _random_texts())] + [(2000, HOSTILE[0]), (2000, "another text of this id")]
    docs = make(spark, rows).repartition(6)
    assert _got(alignment.align(docs, A, B)) == _expected(rows)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 300)  # many blocks: pairs meet again through the join
    monkeypatch.setattr(alignment, "CACHE_CHUNKS", 50)
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", 5)
    assert _got(alignment.align(docs.coalesce(2), A, B)) == _expected(rows)


def test_irregular_and_exact_groups_of_one_pair_count_a_document_once(spark):
    rows = [(1, "a a a"), (2, "a"), (3, None), (4, ""), (5, "▁")]
    out = {r["doc_id"]: r for r in alignment.align(make(spark, rows), A, B).collect()}
    assert (out[2]["n_links"], out[2]["count_sum"], out[2]["n_best"]) == (1, 2, 1)
    assert out[1]["count_sum"] == 6
    assert all(tuple(out[k])[1:] == (0, 0, 0, 0, 0, 0, "") for k in (3, 4, 5))


def test_empty_table(spark):
    assert alignment.align(make(spark, []), A, B).count() == 0


def test_a_vocabulary_that_cannot_be_cut_is_refused(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "of▁the")
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "is_byte", lambda self, i: False)
    with pytest.raises(ValueError, match="mark"):
        alignment.Vocabularies(A, B)
