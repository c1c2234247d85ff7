import pytest
from compare import connect, difference

from patronlens.llm.oracle import ORACLE
from patronlens.llm.queries import REGISTERED


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, folder, name):
    query = {q.__name__: q for q in REGISTERED}[name]
    assert difference(query(spark, folder), connect(folder), ORACLE[name]) is None


def test_one_query_for_each_operator():
    assert [q.__name__.split("_")[0] for q in REGISTERED] == [*[f"op{n}" for n in range(1, 14)], "pipeline"]
