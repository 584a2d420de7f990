"""Facts that no query over the star schema shows."""

import pytest
from pyspark.sql import functions as F

from lattica import queries
from lattica.functions import scalar as S
from lattica.operators import dml, relational as R
from lattica.operators import predicates as P
from lattica.sources.bulk_import import Import
from lattica.sources.catalog import Database, lenient_long, lenient_timestamp, spark_type
from lattica.streaming import cdc


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scalar_edges(spark):
    assert one(spark, S.round_(F.lit(-1.5))) == -1 and one(spark, S.round_(F.lit(2.5))) == 3
    assert one(spark, S.bit_shift_right(F.lit(-1), F.lit(60))) == 15
    assert one(spark, S.trim(F.lit("\t a b \n"))) == "a b"
    assert one(spark, S.hex_(F.lit(15))) == "3135"
    assert one(spark, S.sum_of(F.lit(None), F.lit(None))) is None and one(spark, S.avg_of(F.lit(None))) == 0.0
    assert one(spark, S.week_of_year(F.lit("2000-12-31").cast("date"))) == 1
    assert one(spark, S.is_null(F.lit(None))) is True and len(S.REGISTRY) == 50


def test_two_valued_logic(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "g string")
    assert [r.g for r in df.filter(P.eq(F.col("g"), F.lit(None))).collect()] == [None]
    assert df.filter(P.ne(F.col("g"), F.lit(None))).count() == 2
    assert df.filter(~P.lt(F.col("g"), "b")).count() == 2
    assert df.filter(P.not_in(F.col("g"), ["a"])).count() == 1
    assert df.filter(P.like(F.col("g"), "?")).count() == 2 and df.filter(P.like(F.col("g"), None)).count() == 1


def test_order_of_nulls(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "a int")
    assert [r.a for r in R.order(df, "a").collect()] == [1, 2, None] and [r.a for r in R.order(df, ("a", "desc")).collect()] == [None, 2, 1]
    assert [len(p) for p in R.pages(spark.range(25), 10)] == [10, 10, 5]


def test_pages_without_the_driver(spark, sf_dir, monkeypatch):
    """The starts of pages are those of the pages themselves; finding them brings no rows to the driver."""
    for n, size in ((0, 10), (9, 10), (1000, 10), (1001, 7), (3, 1)):
        df = R.order(spark.range(n, numPartitions=5).select((F.col("id") * 7919 % 1009).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s")), "s", "k")
        want = [(i, len(p), p[0]) for i, p in enumerate(R.pages(df, size))]
        assert [(r.page, r.n, r.first) for r in R.page_starts(df, size).orderBy("page").collect()] == want

    def sent(self, *args, **kwargs):
        raise AssertionError("rows go to the driver")

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", sent)
    found = queries.QUERIES["cursor_pages"](spark, sf_dir)
    assert found.dtypes == [("page", "bigint"), ("n", "bigint"), ("first", "bigint")]
    assert found.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_unique_and_transactions(spark, tmp_path):
    db = Database(spark)
    db.create("t", {"ID": "BIGINT", "name": "VARCHAR(4)"}, ["id"])
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    db.insert("t", rows)
    with pytest.raises(dml.UniqueViolation, match="Unique constraint violated"):
        db.insert("t", rows)
    db.insert("t", rows.withColumn("name", F.lit("z")), ignore=True)
    assert sorted(map(tuple, db["t"].collect())) == [(1, "z"), (2, "z")]
    with pytest.raises(ValueError, match="longer"):
        db.insert("t", spark.createDataFrame([(3, "abcde")], "id long, name string"))
    db.begin()
    with pytest.raises(ValueError):
        db.insert("t", rows, ignore=True)
    db.change("t", dml.delete(db["t"]))
    db.rollback()
    assert db["t"].count() == 2
    db.begin()
    db.change("t", dml.update(db["t"], {"name": F.lit("q")}, F.col("id") == 1))
    db.commit(str(tmp_path / "v1"))
    assert sorted(map(tuple, db["t"].collect())) == [(1, "q"), (2, "z")]
    with pytest.raises(KeyError):
        db["missing"]


def test_types(spark):
    assert spark_type("varchar(20)")[1] == {"width": 20} and spark_type("decimal(10,2)")[0].simpleString() == "decimal(10,2)"
    with pytest.raises(ValueError):
        spark_type("struct")
    assert one(spark, lenient_long(F.lit("1.9"))) == 1 and one(spark, lenient_long(F.lit("x"))) is None
    assert str(one(spark, lenient_timestamp(F.lit("2001-02-03 04:05:06")))) == "2001-02-03 04:05:06"


def test_messages_flat_nested_and_keyless(spark):
    schema = spark.createDataFrame([], "id long, name string").schema
    lines = [
        '{"events":[{"_cdc_dbname":"d","_cdc_tablename":"t","_cdc_action":"insert","id":1,"name":"a"}]}',
        '{"events":[{"_cdc_dbname":"d","_cdc_tablename":"t","_cdc_action":"UPDATE","before":{"id":2,"name":"b"},"after":{"id":2,"name":"c"}},{"_cdc_dbname":"d","_cdc_tablename":"t","_cdc_action":"DELETE","record":{"id":3}}]}',
        "not json",
        '{"events":[{"_cdc_action":"MERGE"}]}',
    ]
    events = cdc.decode(spark.createDataFrame([(x,) for x in lines], "value string"), schema)
    assert cdc.dead_letters(events).count() == 2
    table = spark.createDataFrame([(2, "b"), (2, "b"), (3, "x")], "id long, name string")
    assert sorted(map(tuple, cdc.apply(table, events, None).collect())) == [(1, "a"), (2, "c"), (2, "c")]
    assert sorted(map(tuple, cdc.apply(table.distinct(), events, ["id"]).collect())) == [(1, "a"), (2, "c")]


def test_import(spark, tmp_path):
    job = Import(spark, "t")
    job.run(spark.range(10), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10 and job.progress()[0] >= 1


def test_dead_letters_among_all_events(spark, sf_dir, monkeypatch):
    from lattica import queries

    seen, streamed = [], queries._streamed
    monkeypatch.setattr(queries, "_streamed", lambda *a: seen.append(streamed(*a)) or seen[-1])
    queries.QUERIES["cdc_dead_letter"](spark, sf_dir)
    assert seen[0][0].count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()
