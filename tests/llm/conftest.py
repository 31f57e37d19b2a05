import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept boolean, _key int, label int"
LONG = "word alpha beta. " * 30_000
# nulls in every column, empty and very long texts, ties and repeated rows, columns with clashing names
ODD = [
    (1, "The quick brown fox jumps over the lazy dog.\nIt runs far away.", "en", "a", 64, "x", True, 1, 0),
    (2, "the QUICK brown fox jumps over the lazy dog.\nIt runs far away.", "en", "a", 64, "y", None, 2, 1),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, "", False, 0, 0),
    (5, " \n\t ", "en", "b", 4, "z", False, 0, 1),
    (6, LONG, "en", "a", len(LONG), "q", True, 7, 1),
    (7, "einzig Ärger über Öl. <|endoftext|> 42!", "de", "c", 38, "r", True, 8, 1),
    (7, "einzig Ärger über Öl. <|endoftext|> 42!", "de", "c", 38, "r", True, 8, 1),
    (8, "solo", "es", "c", 4, "s", True, 9, 1),
    (8, "one id, another text of other words altogether", "es", "c", 46, "s", True, 9, 1),
    (None, "solo", "es", "c", 4, "t", True, 9, 1),
    (None, None, "es", None, None, "t", None, None, None),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cinestat.session import local_session
    s = local_session(8, app="llm-tests", shuffle_partitions=4)
    yield s


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
