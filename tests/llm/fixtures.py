"""Documents with the cases that every operator must bear."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, k string, ids string, size string, _part string, bucket string, _folded string"


def texts(seed=1, n=40):
    """Texts over a small vocabulary, with copies, near copies and a passage that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    out = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        if k % 4 == 1:
            words[5:5] = passage.split()
        if k % 7 == 3:
            words = out[-1].split()[:-2] + ["fresh", "end"]
        out.append(out[-3] if k % 9 == 8 else rng.choice([" ", "\n", "  "]).join(words))
    return [*out, "", "   ", "Été über ñ\tx\u000by", "a", "same same same same same same same same same same same same same same"]


def make(spark, rows, schema=SCHEMA):
    """A table of (doc_id, text) rows with further columns, whose names clash with what operators use inside."""
    n = len(schema.split(",")) - 2
    return spark.createDataFrame([(i, t, *[None] * n) for i, t in rows], schema)


def documents(spark, seed=1):
    rows = list(enumerate(texts(seed)))
    rows += [(1000, None), (1001, "x " * 3000 + "end"), (3, texts(seed)[3]), (None, "a text without an id")]
    return make(spark, rows), rows


def words(text):
    return WORD.findall(text or "")
