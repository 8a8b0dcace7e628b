import random

import pytest

ODD = [None, "", " \n\t", "word", "é" * 300, "a" * 400, "x y " * 400, "one two three four", "one  two THREE four", "<|endoftext|> a\x1cb"]


@pytest.fixture(scope="session")
def small(spark, data):
    """(rows, frame): documents of the smallest table, odd texts, near and exact copies, and columns that clash with inner names."""
    rnd = random.Random(7)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    long = [r for r in rows if len(r[1]) > 900]
    extra = [(10_000 + i, t, None if i % 2 else "en", None if i % 3 else "src0", None) for i, t in enumerate(ODD)]
    for i in range(40):
        words = long[i % 4][1].split(" ")
        words[rnd.randrange(len(words))] = "changed"
        extra.append((11_000 + i, " ".join(words), "en", "src0", 1))
        passage = long[5][1][100 : 100 + rnd.randint(150, 500)]
        extra.append((12_000 + i, "".join(rnd.choice("abcdef gh") for _ in range(rnd.randint(0, 300))) + passage + " end", "en", "src1", 1))
    rows += extra
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, span string, part int")
    return rows, frame.repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
