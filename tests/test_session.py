import os

from tracewell.operators.ordered import add_index
from tracewell.session import cut_lineage, intermediate_tables


def test_intermediate_tables_are_deleted(spark):
    with intermediate_tables(spark) as folder:
        path = folder.removeprefix("file:")
        df = add_index(spark.range(1000).withColumnRenamed("id", "t"), [], ["t"])
        with intermediate_tables(spark) as inner:
            assert cut_lineage(df).count() == 1000 and os.listdir(inner.removeprefix("file:"))
        assert not os.path.exists(inner.removeprefix("file:"))
        assert df.count() == 1000 and os.listdir(path)
    assert not os.path.exists(path)
