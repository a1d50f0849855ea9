"""Small documents with every awkward case: nulls, empty, long, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def rows(seed=0, n=40):
    draw = random.Random(seed)
    passage = words(draw, 90)
    out = []
    for i in range(n):
        kind = draw.randrange(6)
        text = words(draw, draw.randrange(60, 200), 5000)
        if kind == 1 and out:
            text = draw.choice(out)[1] or ""
        elif kind == 2 and out:
            w = (draw.choice(out)[1] or "x").split(" ")
            w[draw.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = text + "\n" + passage + "\n" + words(draw, 20)
        elif kind == 4:
            text = "\n".join([text, " Shared LINE here \t", words(draw, 60), "shared line here"])
        out.append((i, text, draw.choice(["en", "de"]), draw.choice(["a", "b", None]), len(text)))
    long = words(draw, 30_000, 20_000)
    out += [
        (n, None, None, None, None),
        (n + 1, "", "en", "a", 0),
        (n + 2, " \t\n ", "en", "b", 4),
        (n + 3, long, "en", "a", len(long)),
        (n + 4, long[:5000] + " é😀ß " + long[5000:9000], None, "c", 1),
        (n + 5, "one two", "en", "a", 7),
        (n + 6, "One TWO", "en", "a", 7),
        out[0],
        out[0],
        (None, "one two", "en", "a", 7),
        (n + 7, "a" * 3000, "en", "z", 3000),
    ]
    return out


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
