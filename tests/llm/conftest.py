import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _k long, key string, fp string, t string, score double, predicted int, fingerprint string, size long, taken long, target double, "
    "kept boolean, keep_id long, digest string, h long, g int, head long, ones int, _row string, _src string, _size long, _quality_score double, _quality_kept int"
)


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = prose(1, 60_000)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \t\n", "en", "a", 5), (4, long, "en", "b", len(long)), (5, long + " x", "en", "b", len(long)), (6, prose(2, 80), "en", None, 3),
        (6, prose(2, 80), "en", None, 3), (7, prose(2, 80), "de", "c", 3), (None, prose(3, 90), "de", "c", 3), (None, None, None, None, None), (8, "Größe ß 日本 \U0001f600 end.", "de", "a", 1), (9, "a", "de", "a", 1), (10, prose(4, 36), "de", "c", 3), (11, "x " * 70, "de", "c", 3),
        (12, "\U0001f600 mail a.b@c.de, 1.2.3.4 or 1.2.3.256, +1 (555) 555-1234; 4111 1111 1111 1111 é 4111111111111112", "en", "a", 3), (13, "see <|endoftext|> there", "en", "a", 3),
    ]
    return spark.createDataFrame([(*r, 1, "k", "f", "t", 0.5, 1, "p", 2, 3, 4.0, True, 5, "d", 6, 7, 8, 9, "r", "s", 10, 0.25, 1) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
