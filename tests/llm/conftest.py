import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, words string, fp string, source_size int"


def make_words(rnd, n):
    return [rnd.choice(["th", "an", "er", "on", "ti"]) + rnd.choice(["ne", "ra", "lo", "mi", "su"]) + rnd.choice("abcdefgh") for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Texts with shared passages, copies, near copies, ties, nulls, nothing, one very long one and repeated rows."""
    rnd = random.Random(7)
    passage, other = make_words(rnd, 70), make_words(rnd, 55)
    base = make_words(rnd, 120)
    texts = {
        5: " ".join(make_words(rnd, 30) + passage + make_words(rnd, 20)), 2: " ".join(passage[5:] + make_words(rnd, 60)),
        9: " ".join(make_words(rnd, 3) + passage + other + passage), 11: "\n".join(other), 12: " ".join(other[1:] + ["zz"]),
        20: " ".join(base), 21: " ".join(base), 22: " ".join(base[:118] + ["changed", "end"]), 40: " ".join(base).upper(),
        23: "", 24: None, 25: " \n\t ", 26: "one", 27: "é ß   ü x", 28: "The " * 400, 29: " ".join(["a b c d e f g"] * 30),
        30: " ".join(make_words(rnd, 40000)), 31: "x" * 3000, 32: "a|b # $ " * 30, 33: "same line here\n" * 8 + "end", 34: "WOW!! " * 40,
        60: " ".join(make_words(rnd, 500)), 80: " ".join(make_words(rnd, 90)),
    }
    rows = [(i, t, "en", [None, "s1", "s2", "", "é"][i % 5], len(t or ""), 1, 2, "w", "f", 3) for i, t in texts.items()]
    rows += [rows[0], rows[0], (None, texts[5], None, None, None, None, None, None, None, None), (None, None, None, "s1", None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DDL).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DDL)
