"""Shared small tables of the corpus operator tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, block string, n string"


def words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    rnd = random.Random(seed)
    return ["w" + format(rnd.randrange(vocabulary), "x") + "abc"[rnd.randrange(3)] for _ in range(n)]


def rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, copies, near copies, repeated rows, a long text."""
    base = words(1, 120)
    near = base[:]
    near[60] = "changed"
    long_text = " ".join(words(2, 30_000, 5_000))
    texts = [" ".join(base), " ".join(base), " ".join(near), None, "", " \n\t ", "one two", long_text,
             "ABC " * 60, "aaaaaaa" * 40, "Zeile eins.\nZeile zwei ist länger als eins.\nZeile eins.", " ".join(words(3, 200)) + "\n" + " ".join(base)]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, None if t is None else len(t), "x", "y", "z", "q")
           for i, t in enumerate(texts)]
    out += [out[2], out[7]]                                  # repeated rows
    out += [(None, " ".join(base), None, None, None, None, None, None, None), (None, "lonely text without an id", None, None, None, None, None, None, None)]
    return out


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
