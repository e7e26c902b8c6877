import random

import pytest

#: Columns that clash with names that operators use inside.
CLASH = "score double, id string, n long, h long, row long, text_crc32 long, bucket long, component string, label int, rank int"


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents with nulls, empty and long texts, copies, repeated rows and clashing columns."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + CLASH if extra else "")
        tail = (1.0, "x", 1, 1, 1, 1, 1, "c", 1, 1) if extra else ()
        full = [(i, t, lang, src, None if t is None else len(t), *tail) for i, t, lang, src in rows]
        return spark.createDataFrame(full, schema)

    return make


def sample_rows(n=60, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "Zürich", "ÉTÉ", "x,y", "end."]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) + (str(rng.randrange(30)) if rng.random() < 0.4 else "") for _ in range(rng.randrange(1, 60)))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src9", None])))
    base = rows[3][1] + " one two three four five six seven eight nine ten"
    rows += [(n, base, "en", "src0"), (n + 1, base + " tail", "en", "src0"), (n + 2, base.upper(), "en", "src1"), (n + 3, None, "en", "src0"), (n + 4, "", "en", "src0"), (n + 5, " \n ", None, None), (n + 6, "one two", "en", "src0"), (n + 7, "ONE\ttwo", "en", "src0")]
    rows += [(n + 8, "long " + " ".join(f"w{i % 977}" for i in range(40000)), "en", "src0"), (n + 9, "y" * 700000, "fr", "src2")]
    rows += [rows[5], rows[5], (None, rows[7][1], "en", "src0")]
    return rows
