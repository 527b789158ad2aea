import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from kelpie.session import local_session, ship

    session = local_session("4", 2, **{"spark.ui.showConsoleProgress": "false", "driver_memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)
