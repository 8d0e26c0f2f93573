import pytest

from kohorta.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    from kohorta.session import literal_table

    return lambda rows, schema: literal_table(spark, rows, schema)


@pytest.fixture
def rows():
    def sorted_rows(df, *columns):
        columns = columns or df.columns
        return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((v is None, v) for v in r))

    return sorted_rows


def records(table, patients):
    """Long records from {patient: [[code, ...], ...]}."""
    out = [
        (p, v, c, code)
        for p, visits in patients.items()
        for v, codes in enumerate(visits)
        for c, code in enumerate(codes)
    ]
    return table(out, "p_id STRING, visit_idx INT, code_idx INT, code STRING")
