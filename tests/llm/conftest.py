import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, row string, words string, key string, code long, piece string, _rows string, _row long, doc string"


def _prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in any column, empty and long texts, repeated rows and ids, near copies, and columns with clashing names."""
    rng = random.Random(5)
    base = _prose(rng, 120)
    texts = [
        None, "", " \t\n", "one two", base, base, base + " extra", base.replace(base[:4], "zzzz", 1), _prose(rng, 4000), "x" * 50_000, "go go go " * 60,
        "\n".join(["Same line of text here"] * 30), "### %%% $$$ " * 30, "É Ñ ß token = \"abcdef123\" AKIA" + "Q" * 16 + " deadbeef" * 3 + "0123456789abcdef01234567",
        "Released under the MIT License. Apache license, general public LICENSE mit license", "a<|endoftext|>b 日本語 ١٢٣ ½", "tab\x0bvt\x0cff\rcr \x85 \xa0 　 end",
        "key aB3dE5fG7hI9jK1lM2nO4pQ6 and example1example2example3 done",
    ]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src1", None]), len(t or ""), i, "r", "w", "k", 1, "p", "q", 2, "d") for i, t in enumerate(texts)]
    out += [out[4], (None, base, *[None] * 12), (None, *[None] * 13)]
    out += [(100 + i, _prose(rng, rng.randint(30, 300)), "en", f"src{i % 3}", 0, 0, "", "", "", 0, "", "", 0, "") for i in range(40)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
