"""Small documents with what operators must cope with: nulls, empty texts, ties, repeats, long texts, extra columns."""

import random

LETTERS = "abcdefghij klmnopqrstuvwxyz éüß"


def word(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnoé") for _ in range(r.randint(1, 8)))


def prose(r: random.Random, n: int) -> str:
    return "".join(word(r) + r.choice([" ", " ", " ", ", ", ".\n", "  ", "\n"]) for _ in range(n))


def texts(seed: int = 1, n: int = 120) -> list:
    r = random.Random(seed)
    base = [prose(r, r.choice([1, 3, 20, 60, 150])) for _ in range(n // 3)]
    passage = prose(r, 40)
    out: list = [None, "", " ", "\n\n", "a", "A", "a a a a", "x" * 500, "x" * 450, "日本語 " * 30]
    while len(out) < n:
        t = r.choice(base)
        kind = r.randint(0, 5)
        if kind == 1:
            words = t.split(" ")
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = word(r)
            t = " ".join(words)
        elif kind == 2:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        elif kind == 3:
            t = t.upper() if r.random() < 0.3 else t + " "
        elif kind == 4:
            t = "\n".join([*t.split("\n"), "a line that comes again and again", "a line that comes agan and again"])
        elif kind == 5:
            t = prose(r, r.randint(0, 80))
        out.append(t)
    return out


def frame(spark, found, extra=True):
    """documents of these texts; doc_id in shuffled order, a row without doc_id, and columns with clashing names."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x", i, 1) for i, t in enumerate(found)]
    random.Random(3).shuffle(rows)
    rows.append((None, "no document", None, None, None, None, None, None))
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n long, rank int"
    return spark.createDataFrame(rows, schema).repartition(5)
