import duckdb
import pytest

TEXT = "One small step. Two small steps here, three there! Is it four? Yes, five of them."
LONG = " ".join(f"word{i % 977}{'.' if i % 13 == 0 else ''}" for i in range(30_000))
ROWS = [
    (1, TEXT), (2, TEXT), (2, TEXT), (2, "another text under the same id, quite unlike the first one"), (None, TEXT), (None, None), (None, "a text without any id"),
    (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG + " tail"), (8, "one"), (9, "one two"), (10, "ONE two"), (11, "\u00e9\U0001f600 \u00a0 x"), (12, "..."), (-5, "minus five words in here"),
]
SCHEMA = "n_hit string, doc_id long, text string, lang string, source string, n_chars long, score int, marks int"


def edge(spark):
    """Rows with nulls, empty and long texts, ties and repeats, and columns whose names clash with results."""
    return spark.createDataFrame([("own", d, t, "en", "web", None if t is None else len(t), 1, 2) for d, t in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """All tables: edge rows of documents and small others."""
    return _tables(spark, tmp_path_factory.mktemp("edge"), edge(spark))


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("empty"), edge(spark).limit(0), 0)


def _tables(spark, path, docs, n=None):
    def put(name, rows, schema):
        df = spark.createDataFrame(rows, schema)
        (df if n is None else df.limit(n)).write.parquet(f"{path}/{name}.parquet")

    docs.write.parquet(f"{path}/documents.parquet")
    put("labels", [(1, 1, 0), (2, 0, 1), (6, None, None), (None, 1, 0), (-5, 1, None), (8, 0, 0), (9, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    put("benchmark", [("a", TEXT), ("b", "one two"), ("c", None), (None, "minus five words"), ("d", "..."), ("e", "tail"), ("a", "five words")], "item_id string, text string")
    put("pages", [(1, None, None, 1), (2, "", "", 1), (3, "no scheme", "bare text & more &amp; x", 2), (4, "HTTP://Sub.Example.COM/de/x?y#z", "<article><h1>T</h1><p>Some words of a real article, long enough to be kept by itself.</p></article><footer>foot</footer>", 3), (None, "a://b.org/fr/", "<p>unclosed", 4), (4, "x://net", "<script>only</script>", 5), (5, "x://net/", "<p>", 6)], "page_id long, url string, html string, path int")
    nan, inf = float("nan"), float("inf")
    put("embeddings", [(0, [1.0, 0.0], 1), (100, [0.0, 2.0], 1), (1, [1.0, 0.0], 2), (2, [1.0, 0.0], 2), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (9, [], 0), (200, [1.0, 2.0, 2.0], 0), (2, [3.0, 3.0], 0)], "vec_id long, embedding array<float>, score int")
    put("conversations", [(1, 0, "system", "s"), (1, 1, "ana", "oi"), (1, 2, "bo", None), (1, 2, "bo", None), (1, 2, "ana", "tie"), (1, None, None, "x"), (2, 0, "system", "s"), (None, 1, "u", "n"), (3, 700, "u", "late"), (3, 1, "v", "early")], "conv_id long, turn long, role string, text string")
    return str(path)


@pytest.fixture(scope="session")
def oracle():
    from vozlens.llm import registry

    def rows(name, path):
        c = duckdb.connect()
        for t in ("documents", "benchmark", "conversations", "labels", "pages", "embeddings"):
            where = f"{path}/{t}.parquet/*.parquet" if not path.startswith("/root") else f"{path}/{t}.parquet"
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{where}'")
        r = c.sql(registry.oracle_sql()[name])
        return r.columns, r.fetchall()

    return rows


def same(df, columns, rows):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(r) for r in rows), key=key)
