import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, word string"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names clash with inner ones."""
    def build(rows):
        return spark.createDataFrame(
            [(d, t, "en" if (d or 0) % 2 else None, f"src{(d or 0) % 3}" if d else None, len(t or ""), 7, "x")
             for d, t in rows], SCHEMA)
    return build


@pytest.fixture(scope="session")
def corpus():
    """Ids and texts with copies, near copies, shared passages and odd rows; ids are distinct."""
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi", "hu", "lo", "ma") for b in
                  ("n", "r", "s", "t", "l", "m", "x", "z", "k", "p")]
    prose = lambda n: " ".join(rng.choice(vocabulary) + ("." if i % 9 == 8 else "") for i in range(n))
    passage, line = prose(70), prose(14)
    rows = []
    for i in range(30):
        rows.append(prose(rng.choice((3, 12, 60, 130))))
    rows.append(rows[3])
    rows += [rows[2], rows[2] + " one more"]
    long_ = prose(200)
    rows += [long_, long_.replace(" ba", " bo", 2), long_ + " " + prose(4), long_]
    rows += [prose(30) + " " + passage + " " + prose(20) for _ in range(3)]
    rows += [passage[5:] + " " + prose(40), prose(9) + "\n" + line + "\n" + prose(11),
             prose(8) + "\n" + line + ".\n\n  \n" + prose(10), line + "\n" + line, "la la " * 90, "x" * 3000]
    rows += [None, "", " \t\n ", "é ü \x0b ß.", " ".join([prose(50)] * 2), prose(3000)]
    ids = list(range(1, len(rows) + 1))
    rng.shuffle(ids)
    return [(i * 3, t) for i, t in zip(ids, rows)]
