"""Every query of the subpackage that has SQL, over the given tables."""

from pathlib import Path

import pytest
from held import SF_DIR, differences

from millrace.llm.queries import QUERIES
from millrace.llm.sql import ORACLES


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_its_sql_says(spark, name):
    assert not differences(spark, QUERIES[name], ORACLES[name])
