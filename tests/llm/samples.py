"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed: int = 1, count: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghilmnorstué") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = some(60)
    base = some(120)
    rows = []
    for i in range(count):
        kind = i % 10
        if kind == 0:
            text = base
        elif kind == 1:
            own = base.split()
            own[rnd.randrange(len(own))] = "changed"
            text = " ".join(own)
        elif kind == 2:
            text = f"{some(30)}\n{passage}\n{some(30)}"
        elif kind == 3:
            text = f"{some(20)} {rnd.choice(words)}.{i}@mail.example.com {some(5)} 10.20.30.{i} +1 (743) 555-38{i:02d} 4845168114407329 {some(10)}"
        elif kind == 4:
            text = "Ab " * rnd.randint(50, 90)
        else:
            text = some(rnd.randint(1, 200)) + rnd.choice(["", ".\n", "  \n\n", "!"])
        rows.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", None]), len(text)))
    rows += [(1000, None, "en", "src0", None), (1001, "", None, None, 0), (1002, " \n\t ", "en", "src0", 4), (1003, "word", "en", "src0", 4), (1004, some(6000), "en", "src1", 1)]
    rows += [rows[0], rows[2], (2, "a text of its own under an id that is taken already, " * 4, "en", "src1", 0), (None, base, "en", "src0", 0), (1005, "x" * 5000, "en", "src0", 5000), (1006, "日本語 and é — \U0001f600 text", "en", "src0", 1)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, COLUMNS)
