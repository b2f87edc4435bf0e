import pytest

#: Names that the operators use inside or return; a table may have them too.
CLASHING = ("score", "size", "key", "n", "rate", "copies", "target", "fp", "stats", "spans", "unit", "_at", "_row", "_hash", "_id", "component_id", "digest", "payload")

LONG = " ".join(f"word{i % 977}" for i in range(60_000))


@pytest.fixture(scope="session")
def edge_documents(spark, tmp_path_factory):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, extra columns; a table, as stages get one."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from all of the others " * 8
    rows = [
        (1, prose + "one", "en", "a"), (2, prose + "one", "en", "a"), (2, prose + "one", "en", "a"), (3, None, "en", None), (4, "", None, "a"), (5, " \t\n\v\f\r ", "de", "b"), (None, "no id here", "en", "b"), (None, None, None, None),
        (6, LONG, "en", "b"), (7, "x" * 200_000, "en", "c"), (8, "mail a.b@c.example.com +1 (212) 555-0199 card 4111111111111111 at 10.0.0.1 now", "fr", "c"), (9, "All rights reserved. CC BY 4.0 SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0-only)", "fr", "c"),
        (10, "naïve café 漢字 🙂 <|endoftext|> İstanbul ΣΑΣ", "es", "a"), (-3, prose + "two", "es", "c"),
    ]
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    df = spark.createDataFrame([(i, t, lang, s, len(t or ""), *["clash"] * len(CLASHING)) for i, t, lang, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3)
    at = str(tmp_path_factory.mktemp("edges") / "documents.parquet")
    df.write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="session")
def empty_documents(edge_documents):
    return edge_documents.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0), (6, 0, 1), (None, 1, 0), (77, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def paths():
    import public_tokenizers

    return {n: str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
