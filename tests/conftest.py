import pytest

from tarn.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session(
        "tests",
        master="local[4]",
        spark__sql__shuffle__partitions=4,
        spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
