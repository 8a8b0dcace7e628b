from pathlib import Path

from strandloom.llm import storage


def test_written_tables_come_and_go(spark):
    df = storage.written(spark.range(10), "one")
    other = storage.written(spark.range(3), "two")
    home = Path(storage.shared_dir(spark).removeprefix("file:"))
    assert df.count() == 10 and list(home.glob("one-*"))
    storage.discard(df)
    assert not list(home.glob("one-*")) and other.count() == 3
    storage.clear(spark)
    assert not list(home.glob("two-*"))
