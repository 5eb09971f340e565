"""Transactions of many files whose writer is lost at every step."""

import hashlib

import pytest

from corvane.sources import journal, shared
from corvane.sources.sinks import StaleSnapshot

CHANGES = "rel string, content string, expected string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def files(store):
    return {r.rel: r.content for r in store.refresh().files().collect()}


@pytest.fixture
def store(spark, tmp_path):
    s = journal.Store(spark, str(tmp_path / "store"), buckets=4)
    journal.apply(s, spark.createDataFrame([(f"f{i}", f"old {i}", None) for i in range(12)], CHANGES))
    return s


OLD = {f"f{i}": f"old {i}" for i in range(12)}
CHANGE = [("f1", "new 1", sha("old 1")), ("f2", None, sha("old 2")), ("g", "made", None), ("f3", "", sha("old 3"))]
NEW = {**{k: v for k, v in OLD.items() if k != "f2"}, "f1": "new 1", "g": "made", "f3": ""}


class Lost(Exception):
    pass


@pytest.mark.parametrize("step", ["entries half", "entries", "data half", "data", "prepared empty", "prepared", "mark empty", "mark"])
def test_writer_is_lost(spark, store, monkeypatch, tmp_path, step):
    changes = spark.createDataFrame(CHANGE, CHANGES)
    tx = journal.Transaction(store)
    where = tmp_path / "store" / "tx" / tx.id
    write = shared.write_new

    def dying(spark_, path, text):
        name = "prepared" if path.endswith("PREPARED") else "mark" if "/commits/" in path else None
        if name and step == f"{name} empty":
            write(spark_, path, "")
            raise Lost
        done = write(spark_, path, text)
        if name == step:
            raise Lost
        return done

    with monkeypatch.context() as m:
        m.setattr(shared, "write_new", dying)
        try:
            tx.stage(changes)
            if step.startswith("entries"):
                raise Lost
            if step.startswith("data"):
                m.setattr(shared, "write_new", lambda *a: (_ for _ in ()).throw(Lost()))
            tx.prepare()
            tx.commit()
            raise AssertionError("the writer lives")
        except Lost:
            pass
    if step.endswith("half"):
        part = where / step.split()[0]
        (part / "_SUCCESS").unlink()
        sorted(part.rglob("part-*"))[0].unlink()
    seen = files(journal.Store(spark, store.root))
    assert seen == (NEW if step == "mark" else OLD)  # until the mark is there readers see the old contents
    again = journal.Store(spark, store.root)
    ended = journal.recover(again)
    replayed = step in ("prepared", "mark", "mark empty")
    assert files(again) == (NEW if replayed else OLD)
    assert ended.get(tx.id, "committed") == ("committed" if replayed else "rolled_back")
    assert journal.recover(again) == {} and files(again) == (NEW if replayed else OLD)
    if step not in ("entries half",):
        got = {r.rel: (r.action, r.before_sha256, r.after_sha256, r.status) for r in again.journal().where(f"tx = '{tx.id}'").collect()}
        state = "committed" if replayed else "rolled_back"
        assert got == {
            "f1": ("write", sha("old 1"), sha("new 1"), state), "f2": ("delete", sha("old 2"), None, state),
            "g": ("create", None, sha("made"), state), "f3": ("write", sha("old 3"), sha(""), state),
        }
    if not replayed:  # the same change by a living writer
        journal.apply(again, changes)
        assert files(again) == NEW


def test_preconditions(spark, store):
    for bad in ([("f1", "x", sha("other"))], [("f1", "x", None)], [("new", "x", sha("y"))], [("new", None, sha("y"))], [("a", "x", None), ("a", "y", None)], [(None, "x", None)]):
        with pytest.raises(StaleSnapshot):
            journal.apply(store, spark.createDataFrame(bad, CHANGES))
    assert files(store) == OLD and {r.status for r in store.journal().select("status").distinct().collect()} == {"committed"}


def test_two_writers(spark, store):
    one, two, three = (journal.Transaction(journal.Store(spark, store.root)) for _ in range(3))
    one.stage(spark.createDataFrame([("f1", "one", sha("old 1"))], CHANGES)).prepare()
    two.stage(spark.createDataFrame([("f1", "two", sha("old 1"))], CHANGES)).prepare()
    same = {b for b in one.buckets}
    other = next(f"f{i}" for i in range(2, 12) if store.spark.range(1).select(store.bucket(journal.F.lit(f"f{i}"))).first()[0] not in same)
    three.stage(spark.createDataFrame([(other, "three", sha("old " + other[1:]))], CHANGES)).prepare()
    assert one.commit() == 2 and three.commit() == 3 and one.commit() == 2
    with pytest.raises(StaleSnapshot):
        two.commit()
    assert files(store) == {**OLD, "f1": "one", other: "three"} and store.status(two.id) == "rolled_back"
    with pytest.raises(StaleSnapshot):
        two.commit()


def test_undo_brings_old_contents_back(spark, store):
    tx = journal.Transaction(store).stage(spark.createDataFrame(CHANGE, CHANGES)).prepare()
    tx.commit()
    assert files(store) == NEW
    journal.undo(store, tx.id)
    assert files(store) == OLD
    assert {r.rel: r.content for r in store.files(upto=2).collect()} == NEW  # earlier commits stay readable
    tx = journal.Transaction(store).stage(spark.createDataFrame([("f1", "x", sha("old 1"))], CHANGES)).prepare()
    tx.commit()
    journal.apply(store, spark.createDataFrame([("f1", "y", sha("x"))], CHANGES))
    with pytest.raises(StaleSnapshot):
        journal.undo(store, tx.id)


def test_nothing_to_change(spark, store):
    journal.apply(store, spark.createDataFrame([], CHANGES))
    assert files(store) == OLD
    empty = journal.Store(spark, store.root + "-new")
    assert files(empty) == {} and journal.recover(empty) == {} and empty.journal().count() == 0
