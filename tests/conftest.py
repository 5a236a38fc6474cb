from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from veridraft.session import clean_up, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", shuffle_partitions=4, memory="6g", work=str(tmp_path_factory.mktemp("work")))
    yield session
    clean_up(session)
    session.stop()
