import random

import pytest

FIELDS = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " size string, score string, findings string, class string, label string, bucket string, key string, row string"
)
WORDS = ["the", "of", "and", "alpha", "Beta", "gamma", "delta", "été", "straße", "niño", "kilo", "mike", "LIMA", "oscar", "papa", "x1"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * r.randrange(2) for _ in range(n))


def messy_rows():
    long = prose(1, 6000)
    texts = [(1, prose(2, 80)), (2, prose(2, 80)), (3, prose(2, 80) + " end"), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "ONE"),
             (9, long), (10, long + " tail"), (None, prose(3, 40)), (None, prose(3, 40)), (11, prose(4, 3)), (12, prose(5, 60)),
             (12, prose(5, 60)), (12, "another text of the same id"), (13, "\x1c  <|endoftext|> \u0000 日本語"), (14, "!!! ??? 123"),
             (15, 'key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and x.12@mail3.example.com')]
    return [(i, t, [None, "en", "fr"][k % 3], [None, "a", "b"][k % 3], None, *["clash"] * 8) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), FIELDS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], FIELDS)
