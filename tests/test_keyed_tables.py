"""Tables by key: what a change touches, replays, restarts, races; deals merged by a stream."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from farewright.sources.keyed import Conflict, KeyedTable
from farewright.streaming import ingest
from tests.test_operators import deal


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), "k", spark.createDataFrame([], "k string, v int, w int").schema, buckets=8)


def rows(spark, *values):
    return spark.createDataFrame([(k, v, 0) for k, v in values], "k string, v int, w int")


def content(df):
    return {r.k: r.v for r in df.collect()}


def test_changes(spark, table):
    """Upsert, update and delete; older versions stay readable; keys of any kind, null among them."""
    assert table.read().collect() == [] and table.versions() == [] and table.unnamed() == []
    many = [(f"k{i}", i) for i in range(40)]
    assert table.upsert(rows(spark, *many)) == 0
    assert table.upsert(rows(spark, ("k1", -1), ("new", 7))) == 1
    assert table.update(spark.createDataFrame([("k2", -2), ("absent", 5)], "k string, v int")) == 2
    assert table.delete(spark.createDataFrame([("k3",), ("absent",)], "k string")) == 3
    want = {**dict(many), "k1": -1, "new": 7, "k2": -2}
    del want["k3"]
    assert content(table.read()) == want and content(table.read(0)) == dict(many) and table.versions() == [0, 1, 2, 3]
    assert table.read().columns == ["k", "v", "w"] and {r.w for r in table.read().collect()} == {0}
    assert table.upsert(rows(spark)) == 4 and content(table.read()) == want
    assert table.delete(table.read().select("k")) == 5 and table.read().collect() == [] and table.manifest().folders == {}


def test_untouched_buckets_keep_their_files(spark, table):
    table.upsert(rows(spark, *((f"k{i}", i) for i in range(200))))
    first, files = table.manifest().folders, set(table.read().inputFiles())
    table.upsert(rows(spark, ("k5", 0)))
    second = table.manifest().folders
    changed = [b for b in first if first[b] != second[b]]
    assert len(first) == 8 and len(changed) == 1
    assert len(files & set(table.read().inputFiles())) >= len(files) - 1
    assert table.unnamed(keep=1) == [first[changed[0]]] and table.unnamed(keep=2) == []


def test_a_change_that_dies_changes_nothing(spark, table):
    table.upsert(rows(spark, ("a", 1)))

    def dies(old, new):
        return new.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))

    with pytest.raises(Exception, match="lost"):
        table.change(rows(spark, ("a", 2)), dies)
    assert content(table.read()) == {"a": 1} and table.upsert(rows(spark, ("a", 3))) == 1 and content(table.read()) == {"a": 3}


def test_races(spark, table):
    """A change of what somebody else has changed since fails, whether it was seen before or only when it commits."""
    table.upsert(rows(spark, ("a", 1)))
    with pytest.raises(Conflict):
        table.upsert(rows(spark, ("a", 2)), base=-1)
    other = KeyedTable(spark, table.path, "k", table.schema, buckets=3)

    def meanwhile(old, new):
        other.upsert(rows(spark, ("b", 9)))
        return new

    with pytest.raises(Conflict):
        table.change(rows(spark, ("a", 2)), meanwhile)
    assert content(table.read()) == {"a": 1, "b": 9} and table.manifest().buckets == 8
    assert table.upsert(rows(spark, ("a", 2)), base=1) == 2


def test_writers(spark, table):
    up = lambda v, **kw: table.upsert(rows(spark, ("a", v)), **kw)
    with pytest.raises(ValueError):
        up(0, writer="s", batch=4)
    assert up(1, writer="s", batch=0) == 0 and up(2, writer="s", batch=1) == 1
    assert up(99, writer="s", batch=1) == 1 and up(99, writer="s", batch=0) == 1 and content(table.read()) == {"a": 2}
    with pytest.raises(ValueError):
        up(3, writer="s", batch=3)
    for batch in (0, 1, 2):
        with pytest.raises(ValueError):
            up(3, writer="other", batch=batch)
    assert up(4) == 2 and up(99, writer="s", batch=1) == 2 and up(5, writer="s", batch=2) == 3
    assert up(6, writer="other", batch=0, take_over=True) == 4 and content(table.read()) == {"a": 6}


@pytest.fixture
def stream(spark, tmp_path):
    src, n = str(tmp_path / "in"), iter(range(100))

    def run(store, checkpoint, *deals):
        for d in deals:
            d.write.mode("append").parquet(src)
        q = ingest.ingest(spark.readStream.schema(deal(spark).schema).parquet(src), store, str(tmp_path / checkpoint))
        q.awaitTermination()
        return next(n)

    return run


def prices(store):
    return {r.dedupe_key: (r.price_krw, r.sources) for r in store.latest().collect()}


def test_stream(spark, tmp_path, stream):
    """Batches of one stream, taken up again; a batch delivered again changes nothing."""
    store = ingest.DealStore(spark, str(tmp_path / "store"), buckets=4)
    assert store.latest().collect() == []
    stream(store, "cp", deal(spark).unionByName(deal(spark, id=2, dedupe_key="z", sources=["b"])))
    stream(store, "cp", deal(spark, id=3, sources=["c"], price_krw=50))
    want = {"k": (50, ["a", "c"]), "z": (100, ["b"])}
    assert prices(store) == want and store.versions() == [0, 1]
    again = deal(spark, id=3, sources=["c"], price_krw=1)
    assert store.merge(again, 1, store.manifest().writer) == 1 and prices(store) == want
    assert prices(ingest.DealStore(spark, str(tmp_path / "store"))) == want


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_a_fresh_checkpoint_loses_nothing(spark, tmp_path, stream, batches):
    """At any version: a stream that does not know the stored batches fails, unless it is to go on from them."""
    path = str(tmp_path / "store")
    store = ingest.DealStore(spark, path, buckets=4)
    for i in range(batches):
        stream(store, "cp", deal(spark, id=i, dedupe_key=f"k{i}"))
    stored = prices(store)
    with pytest.raises(StreamingQueryException):
        stream(store, "fresh")
    assert prices(store) == stored and len(stored) == batches
    stream(ingest.DealStore(spark, path, take_over=True), "next", deal(spark, id=9, dedupe_key="k9"))
    assert set(prices(store)) == {*stored, "k9"}
