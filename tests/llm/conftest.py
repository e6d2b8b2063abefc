import pytest


@pytest.fixture
def table(tmp_path):
    """Write rows as the table ``name`` of a folder and return the folder."""

    def make(name, df):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
