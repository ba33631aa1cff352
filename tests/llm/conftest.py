import random

import pytest

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "no", "ré", "sü", "ta", "vo") for b in ("n", "rt", "sel", "mi", "pa", "", "lo", "gre", "x", "ndo")]


@pytest.fixture(scope="session")
def prose():
    """Random words, always the same for a seed."""
    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) for _ in range(n))
    return make


@pytest.fixture(scope="session")
def corpus(prose):
    """Copies, near copies, shared passages, white space of all kinds, nulls, empty and long texts, repeated rows and ids."""
    base, line = prose(1, 120), prose(2, 60)
    near = base.split(" ")
    near[40] = "other"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, prose(3, 200) + "\n" + line), (5, line + "\t\n" + prose(4, 30)),
            (6, None), (7, ""), (8, "  \n "), (9, "one two"), (10, "one two"), (12, "baba " * 400), (13, prose(5, 20_000)),
            (14, prose(5, 20_000)[:5000] + line), (14, prose(6, 90)), (14, prose(6, 90)), (None, line + " " + prose(7, 10)), (None, None),
            (20, "日本語 " + line.replace(" ", "  ")), (21, prose(8, 49)), (22, prose(8, 49) + " x"), (-3, prose(8, 49) + " x y")]
    rows += [(100 + i, line + " " + prose(200 + i, 15)) for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with more columns, some of them named like the operators' own."""
    names = ["did", "th", "body", "block", "data", "set", "root", "bands", "key", "n_pii", "log_weight", "rank", "task", "length", "class", "item"]

    def make(rows, extra=True):
        if not extra:
            return spark.createDataFrame(rows, "doc_id long, text string")
        return spark.createDataFrame([(i, t, len(t or ""), *[k] * len(names)) for k, (i, t) in enumerate(rows)],
                                     "doc_id long, text string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    return make
