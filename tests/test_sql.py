"""SQL text against the meaning that the engine gives it."""

import pytest

from lattica.operators import dml
from lattica.plans import procedures
from lattica.plans.sql import SqlError
from lattica.sources.catalog import Database, Engine


@pytest.fixture
def db(spark):
    out = Database(spark)
    out.execute("create table t (id bigint primary key, name varchar(9), n integer)")
    out.execute("insert into t values (1, 'a', 5), (2, null, 7), (3, 'A', null), (4, 'b_c', -3)")
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "where,ids",
    [
        ("name = null", [2]),
        ("name <> 'a'", [2, 3, 4]),
        ("not n < 6", [2, 3]),
        ("n in (5, 7) or name like '%_c'", [1, 2, 4]),
        ("name not in ('a')", [3, 4]),
        ("name like '?'", [1, 3]),
        ("n between 7 and 5", [1, 2]),
        ("n not between 5 and 7", [4]),
        ("n / 2 = 2", [1]),
        ("(n + 1) * 2 = 12 and -n = -5", [1]),
        ("n & 5 = 5 and n ^ 1 = 6", [2]),
        ("is_null(name)", [2]),
        ("n is not null and not (id = 1 or id = 2)", [4]),
        ("lower(name) = 'a' and length(name) = 1", [1, 3]),
        ("id = 2 or id = 3 and n = 5", [2]),
    ],
)
def test_where(db, where, ids):
    assert [r[0] for r in rows(db.execute(f"select id from t where {where}"))] == ids


def test_queries(db):
    assert [tuple(r) for r in db.execute("select id, n from t order by n desc, id").collect()] == [(3, None), (2, 7), (1, 5), (4, -3)]
    assert [r.id for r in db.execute("select id from t order by id limit 2 offset 1").collect()] == [2, 3]
    assert [r.id for r in db.execute("select id from t order by id limit 2 offset 2", compat=True).collect()] == [2, 3]
    assert rows(db.execute("select count(*) as c, sum(n) as s, max(n, id) as m from t group by id having count(*) > 5")) == []
    assert rows(db.execute("select sum(n) as s, avg(n) as a from t where id > 9", compat=True)) == [(0, 0.0)]
    assert db.execute("select upper(name), upper(name), t.id from t").columns == ["upper(name)", "upper(name)_2", "t.id"] or db.execute("select upper(name), upper(name), t.id from t").columns[-1] == "id"
    assert rows(db.execute("select distinct lower(name) as x from t where name <> 'b_c'")) == [("a",), (None,)]
    assert rows(db.execute("select name, count(*) as c from t group by name", compat=True)) == [("A", 1), ("a", 1), ("b_c", 1)]
    assert rows(db.execute("select id from t where id = ? or name = ?", [1, "A"])) == [(1,), (3,)]
    assert rows(db.execute("select id from t where id < :x and name = :y", {"x": 9, "y": "b_c"})) == [(4,)]
    assert rows(db.execute("select a.id, b.id as other from t a left join t b on a.n = b.id")) == [(1, None), (2, None), (3, None), (4, None)]


def test_changes(db):
    assert db.execute("update t set n = n + 1, name = 'x' where n > 5").first().n == 1
    assert rows(db.execute("select id, name, n from t where n = 8")) == [(2, "x", 8)]
    with pytest.raises(dml.UniqueViolation):
        db.execute("insert into t (id) values (1)")
    db.execute("insert ignore into t (id, n) values (1, 9)")
    assert rows(db.execute("select * from t where id = 1")) == [(1, None, 9)]
    assert db.execute("delete from t where n = 9").first().n == 1 and db["t"].count() == 3
    db.execute("begin")
    db.execute("truncate table t")
    assert db["t"].count() == 0 and db.snapshot()["t"].count() == 3
    db.execute("rollback")
    assert db["t"].count() == 3
    db.execute("alter table t add column more double")
    assert db["t"].columns == ["id", "name", "n", "more"]
    with pytest.raises(ValueError, match="key"):
        db.execute("alter table t drop column id")
    db.execute("drop table t")
    with pytest.raises(KeyError):
        db.execute("select * from t")


def test_unique_index(db):
    db.execute("create unique index by_n on t (n)")
    with pytest.raises(dml.UniqueViolation):
        db.execute("insert into t values (9, 'z', 5)")
    with pytest.raises(dml.UniqueViolation):
        db.execute("insert ignore into t values (2, 'z', 5)")
    db.execute("insert ignore into t values (1, 'z', 5)")
    new = db.spark.createDataFrame([(1, "k", 50), (8, "k", 5), (9, "k", 50), (9, "l", 51), (10, "m", 50)], "id long, name string, n int")
    got = [(r.id, r.n, r.status) for r in db.batch_insert("t", new, new.n).collect()]
    assert sorted(got) == [(1, 50, dml.KEY_USED), (8, 5, dml.FAILED), (9, 50, dml.DONE), (9, 51, dml.KEY_USED), (10, 50, dml.FAILED)]
    db.execute("drop index t.by_n")
    with pytest.raises(KeyError):
        db.execute("drop index t.by_n")
    with pytest.raises(dml.UniqueViolation):
        db.execute("create unique index by_name on t (name)") if db["t"].filter("name = 'k'").count() > 1 else db.execute("insert into t values (1, 'q', 0)")


def test_catalog_text(db):
    db.execute("create index by_name on t (name)")
    assert [r.line for r in db.execute("describe index t.by_name").collect()] == ["table t", "index by_name", "columns name", "unique false"]
    assert db.execute("describe schema version").first().line == "db 2"
    assert db.execute("describe server health").first().line.endswith("running") and db.execute("describe server stats").count() == 3
    assert db.execute("describe shards").count() == 1 and db.execute("describe tables").first().line == "t"
    assert db.execute("explain select id from t").filter("line like '%Physical Plan%'").count() == 1
    with pytest.raises(SqlError):
        db.execute("explain delete from t")


@pytest.mark.parametrize("text", ["", "selec 1", "select id from t where", "select id from t where nothing(id)", "select id from t extra words here", "select id from t where id between id and 5", "insert into t (id, n) values (1)", "select id from t where id = ?", "select id from t where id = :x", "select id ; from t", "update t set where id = 1"])
def test_errors(db, text):
    with pytest.raises((SqlError, KeyError)):
        db.execute(text)


def test_engine(spark):
    e = Engine(spark)
    with pytest.raises(KeyError):
        e.execute("use nothing")
    e.execute("create database a")
    e.execute("create database b")
    with pytest.raises(ValueError, match="exists"):
        e.execute("create database a")
    with pytest.raises(ValueError, match="not in use"):
        e.execute("drop database b")
    e.execute("use b")
    e.execute("drop database b")
    assert sorted(e.databases) == ["a"]


def test_procedure_by_name(db):
    import pandas as pd

    @procedures.procedure("twice", lambda db, p: db["t"])
    class Twice(procedures.Procedure):
        response = "id long, n double"

        def init(self, *args):
            self.factor, self.note = self.parameters.get_double(0), self.parameters.get_string(1)

        def execute(self, parts):
            out = procedures.Records(["id", "n"])
            for p in parts:
                for i, n in zip(p["id"], p["n"]):
                    r = out.create()
                    r["id"], r["n"] = i, None if pd.isna(n) else n * self.factor
            yield out.frame()

    got = rows(db.execute("call procedure 'twice', 2, null"))
    assert [(i, n) for i, n in got if n is not None and n == n] == [(1, 10.0), (2, 14.0), (4, -6.0)] and len(got) == 4
    with pytest.raises(KeyError):
        db.execute("execute procedure 'missing'")
    p = procedures.Parameters((None, "1.5", 7, "TRUE", "2001-02-03 04:05:06"))
    assert p.get_long(0) is None and p.get_double(1) == 1.5 and p.get_string(2) == "7" and p.get_boolean(3) is True and p.get_timestamp(4).year == 2001 and str(p.get_decimal(1)) == "1.5" and p.get_bytes(1) == b"1.5" and len(p) == 5
