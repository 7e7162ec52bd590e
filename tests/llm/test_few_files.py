from quarry.llm import components
from quarry.llm.common import ROWS_PER_FILE, saved


def test_small_tables_are_written_by_few_tasks(spark, monkeypatch):
    files = []

    def noted(df, name, rows=None):
        table = saved(df, name, rows)
        files.append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(components, "saved", noted)
    edges = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 10 != 9], "a long, b long")
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = {row.node: row.root for row in components.connected_components(edges).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found == {k: k - k % 10 for k in range(300)}
    assert len(files) > 2 and max(files[1:]) <= spark.sparkContext.defaultParallelism


def test_a_large_table_keeps_its_tasks(spark):
    n = spark.sparkContext.defaultParallelism + 3
    table = spark.range(100).repartition(n)
    assert len(saved(table, "many", n * ROWS_PER_FILE).inputFiles()) == n
    assert len(saved(table, "few", 100).inputFiles()) <= n - 3
