from __future__ import annotations

import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = local_session(4, "6g", 4, **{"spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": f"file://{base}/shared"})
    yield session
    session.stop()
