import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, block int"


@pytest.fixture(scope="session")
def small():
    """Rows with nulls, empty and long texts, ties, repeats and columns of clashing names."""
    prose = "The quick brown fox jumps over the lazy dog while seven wizards box the daft jinn near a quiet lake at dusk . "
    french = "le chat noir est sur la table et la souris est dans le jardin avec le chien et les oiseaux de la forêt "
    rows = [
        (1, prose * 4, "en", "a"),
        (2, prose * 4, "en", "a"),
        (3, french * 5, "fr", "b"),
        (4, None, None, None),
        (5, "", "en", "a"),
        (6, " \t\n\v ", "en", "b"),
        (7, "one two three", "en", None),
        (8, "One TWO three", "en", "c"),
        (9, "!!! ??? ###", "fr", "c"),
        (10, prose * 400, "en", "b"),
        (11, "héllo wörld — ça va? 日本語テキスト мир <|endoftext|> it's 12345 \U0001f600  end", "fr", "b"),
        (12, (prose * 4).replace("lake", "pond", 1), "en", "a"),
        (13, prose + french, "fr", "a"),
        (14, french * 5, "fr", "b"),
        (14, french * 5, "fr", "b"),
        (15, "word " * 200, "en", "c"),
        (16, "x", "en", "c"),
        (17, "a\x1cb c d e  \n\n f", "en", "a"),
    ]
    return [(i, t, lang, src, None if t is None else len(t), "clash", 3) for i, t, lang, src in rows]


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.createDataFrame(small, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
