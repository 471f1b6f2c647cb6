import random

import pytest

SCHEMA = "doc_id long, text string, source string, n_chars long, uid string, key string, h long"


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghéü") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source): plain, copied, near, odd, null and empty documents; rows equal in all columns; a null id."""
    rng = random.Random(7)
    base = [_words(rng, rng.randint(60, 140)) + ".\n" + _words(rng, 40) for _ in range(14)]
    passage = _words(rng, 130)
    texts = list(base)
    texts += [base[0], base[0], base[1].replace(" ", "  ", 1), base[2].upper(), base[3][:-2] + "zz", base[4] + " one more"]
    texts += [_words(rng, 30) + " " + passage + " " + _words(rng, 30) for _ in range(4)]
    texts += [passage + "\n" + passage, "ab " * 500, "x" * 3000, _words(rng, 3000), "", None, "word", "two words", " \t\n", "same line of text that is long\n" * 5]
    texts += ["Released under the MIT License.", "mail bob.42@mail8.example.com and +1 (487) 555-7209 or 10.1.22.201 again bob.42@mail8.example.com", "card 4539 1488 0343 6467, Anna Smith met Paul Weber", "#$% && <> ||| ***"]
    out = [(k, t, f"s{k % 3}" if k % 7 else None) for k, t in enumerate(texts)]
    return out + [out[5], out[5], (None, base[6], "s1"), (90, base[7], "s0"), (90, base[8], "s0")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "u", "k", 1) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
