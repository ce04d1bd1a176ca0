import pytest


@pytest.fixture()
def rows(spark):
    """Rows with the named columns typed, and columns whose names could clash."""

    def make(schema, data):
        names = [x.split()[0] for x in schema.split(", ")]
        clash = [c for c in ("raw", "canon", "words", "text", "order", "shard") if c not in names]
        df = spark.createDataFrame(data, schema)
        for c in clash:
            df = df.selectExpr("*", f"'x' as `{c}`")
        return df

    return make


def pairs(df):
    return sorted(map(tuple, df.collect()))
