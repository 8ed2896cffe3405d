import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes tables given as rows to a folder that queries can read."""

    def made(**rows):
        path = tmp_path_factory.mktemp("tables")
        schemas = {"documents": DOCS, "benchmark": "item_id long, text string", "conversations": "conv_id long, turn long, role string, text string", "labels": "doc_id long, quality int, toxic int"}
        for name, schema in schemas.items():
            spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return made


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""))
