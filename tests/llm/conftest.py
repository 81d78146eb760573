import pytest

SF = "/root/testdata/sf0.001"

# names that clash with what the operators compute or use inside
CLASHES = "n string, kept string, score string, th string, cls string, sh string, ws string, " \
          "h string, block string, ids string, label string, slot string, shard string, " \
          "n_tokens string, text_sha256 string, contaminated string, uid string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with nulls, empty, long, tied and repeated texts and clashing columns."""
    long = "the quick brown fox jumps over a lazy dog and runs away " * 4000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog today.", "en"),
        (2, "The quick brown  fox jumps over the lazy dog today.", "en"),
        (2, "The quick brown  fox jumps over the lazy dog today.", "en"),   # a repeated row
        (3, None, "en"), (4, "", None), (5, " \n\t ", "en"),
        (None, "Der schnelle braune Fuchs springt über den faulen Hund.", "de"),
        (None, None, None), (6, long, "en"), (7, long + " x", None),
        (8, "1234 5678 !!", "de"), (9, "é", "fr"), (10, "😀 😀", None),
        (11, "a" * 50_000, None),
    ]
    n = len(CLASHES.split(","))
    return spark.createDataFrame([(*r, *["x"] * n) for r in rows],
                                 f"doc_id long, text string, lang string, {CLASHES}")


@pytest.fixture(scope="session")
def nothing(frame):
    return frame.limit(0)
