import os

import pytest

from tallyloom.llm.queries import oracle_sql, queries
from tests.test_queries import FOLDER, compared

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_is_its_sql(spark, name):
    compared(spark, name, queries(), oracle_sql())


def test_every_document_is_packed_once(spark):
    from tallyloom.session import read_table

    found = queries()["p7_containers"](spark, FOLDER)
    per_mail = found.groupBy("doc_id").agg({"from_token": "min", "piece": "count"}).where("`min(from_token)` = 0")
    assert per_mail.count() == read_table(spark, FOLDER, "documents").count()
    assert found.groupBy("container").agg({"n_tokens": "sum"}).agg({"sum(n_tokens)": "max"}).first()[0] <= 2048


@pytest.mark.parametrize("name", ["p8_found", "p9_found"])
def test_found_columns(spark, name):
    df = queries()[name](spark, FOLDER)
    assert df.columns == {"p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "subject"]}[name]
    assert df.count() == df.distinct().count()
