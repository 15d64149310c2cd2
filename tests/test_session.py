"""The package reaches Python workers."""

from tilewright.plans.session import ship


def test_workers_can_import_the_package(spark):
    def name(batches):
        import pandas as pd

        import tilewright

        for _ in batches:
            yield pd.DataFrame({"name": [tilewright.__name__]})

    ship(spark)
    assert ship(spark).range(1, numPartitions=1).mapInPandas(name, "name string").first().name == "tilewright"
