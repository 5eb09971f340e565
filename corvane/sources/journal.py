"""Changes of many files as journalled transactions over a bucketed table: all of one or none, whatever is lost on the way.

A store is a folder. Files (rel, content) lie in buckets by a hash of rel; a transaction writes new versions of the buckets that it touches and
nothing else, so its cost follows the change and not the table:

    tx/ID/entries    the journal: one row for each file with its action and the SHA-256 of its content before and after
    tx/ID/data       the new versions of the touched buckets
    tx/ID/PREPARED   written when both are whole: the commit that they build on, and the buckets
    commits/NUMBER   the commit mark, which names the transaction; creating a number fails if another writer has it
    tx/ID/ROLLED_BACK

A bucket is read from the last committed transaction that touched it. Old versions stay where they are, so until the mark is there
readers see the old contents, and undo() can bring back what a committed one replaced. recover() ends what lost writers left: a prepared transaction is
replayed by giving it its mark, anything less is rolled back.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources import shared
from corvane.sources.sinks import StaleSnapshot, changed, stale_changes

FILES = "rel string, content string"
ENTRIES = "rel string, action string, before_sha256 string, after_sha256 string"
SALTS = 4  # tasks that share the files of one bucket
WAITS = 15


class Store:
    """The committed state of a store as it was opened; refresh() moves to the last one."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        """buckets counts when the store is new; later its own number holds."""
        self.spark, self.root = spark, root.rstrip("/")
        shared.write_new(spark, f"{self.root}/FORMAT", json.dumps({"buckets": buckets}))
        self.buckets = json.loads(shared.read_small(spark, f"{self.root}/FORMAT"))["buckets"]
        self.commits: list[str] = []
        self._prepared: dict[str, dict] = {}
        self.refresh()

    def refresh(self) -> Store:
        names = shared.names(self.spark, f"{self.root}/commits")
        self.commits += [shared.read_small(self.spark, f"{self.root}/commits/{n}").strip() for n in names[len(self.commits) :]]
        while self.commits and not self.commits[-1]:  # a mark that its writer has not filled yet, or died over
            self.commits.pop()
        return self

    def prepared(self, tx: str) -> dict | None:
        """What the transaction builds on and which buckets it has, once it is prepared."""
        if tx not in self._prepared and "PREPARED" in shared.names(self.spark, f"{self.root}/tx/{tx}"):
            text = shared.read_small(self.spark, f"{self.root}/tx/{tx}/PREPARED")
            if text.endswith("}"):
                self._prepared[tx] = json.loads(text)
        return self._prepared.get(tx)

    def _versions(self, upto: int | None = None) -> dict[int, str]:
        """The transaction that has the present version of each bucket."""
        return {b: tx for tx in self.commits[:upto] if tx != "-" for b in self.prepared(tx)["buckets"]}

    def files(self, buckets: list[int] | None = None, upto: int | None = None) -> DataFrame:
        """(rel, content) of the committed files, of some buckets only or as of an earlier commit."""
        found: dict[str, list[int]] = {}
        for b, tx in self._versions(upto).items():
            if buckets is None or b in buckets:
                found.setdefault(tx, []).append(b)
        paths = []
        for tx, own in found.items():
            there = set(shared.names(self.spark, f"{self.root}/tx/{tx}/data"))
            paths += [f"{self.root}/tx/{tx}/data/bucket={b}" for b in own if f"bucket={b}" in there]  # a bucket without files has no folder
        return self.spark.read.schema(FILES).parquet(*paths) if paths else self.spark.createDataFrame([], FILES)

    def bucket(self, rel: str | Column = "rel") -> Column:
        return F.pmod(F.xxhash64(rel), F.lit(self.buckets)).cast("int")

    def status(self, tx: str) -> str:
        """staged, prepared, committed or rolled_back."""
        if tx in self.commits:
            return "committed"
        names = shared.names(self.spark, f"{self.root}/tx/{tx}")
        return "rolled_back" if "ROLLED_BACK" in names else "prepared" if self.prepared(tx) else "staged"

    def journal(self) -> DataFrame:
        """(tx, rel, action, before_sha256, after_sha256, status) of all transactions whose entries are whole."""
        rows = []
        for tx in shared.names(self.spark, f"{self.root}/tx"):
            if "_SUCCESS" in shared.names(self.spark, f"{self.root}/tx/{tx}/entries"):
                entries = self.spark.read.schema(ENTRIES).parquet(f"{self.root}/tx/{tx}/entries")
                rows.append(entries.select(F.lit(tx).alias("tx"), "*", F.lit(self.status(tx)).alias("status")))
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], f"tx string, {ENTRIES}, status string")


class Transaction:
    """One change of many files: stage, prepare, commit, in this order; each step can be the last that its writer lives to do."""

    def __init__(self, store: Store):
        self.store, self.id = store.refresh(), f"t-{uuid.uuid4().hex}"
        self.root = f"{store.root}/tx/{self.id}"

    def stage(self, changes: DataFrame) -> Transaction:
        """Write the journal of changes (rel, content or null to delete, expected: SHA-256 of the present content, null where there must be no file).

        Refused, and rolled back, if a precondition fails, two changes name one file, or one has no name.
        """
        spark, store = self.store.spark, self.store
        self.base = len(store.commits)
        self.changes = changes.select("rel", "content", "expected")
        counts = self.changes.groupBy(store.bucket().alias("b")).agg(F.count("*").alias("n"), F.count_distinct("rel").alias("names")).collect()  # at most one row for each bucket
        if any(r.n != r.names for r in counts):
            return self._refuse("two changes of one file, or one without a name")
        self.buckets = sorted(r.b for r in counts)
        before = store.files(self.buckets)
        bad = stale_changes(before, self.changes).orderBy("rel").limit(5).collect()
        if bad:
            return self._refuse(f"changed meanwhile: {', '.join(r['rel'] for r in bad)}")
        known = before.select("rel", F.sha2("content", 256).alias("before_sha256"))
        after = F.sha2("content", 256).alias("after_sha256")
        action = F.when(F.col("content").isNull(), "delete").when(F.col("before_sha256").isNull(), "create").otherwise("write").alias("action")
        self.changes.join(known, "rel", "left").select("rel", action, "before_sha256", after).write.parquet(f"{self.root}/entries")
        return self

    def _refuse(self, why: str):
        roll_back(self.store, self.id)
        raise StaleSnapshot(why)

    def prepare(self) -> Transaction:
        """Write the new versions of the touched buckets, then the note that all is whole."""
        rows = changed(self.store.files(self.buckets, self.base), self.changes).withColumn("bucket", self.store.bucket())
        spread = F.pmod(F.xxhash64("rel", F.lit(1)), F.lit(SALTS))
        rows.repartition("bucket", spread).write.partitionBy("bucket").parquet(f"{self.root}/data")
        shared.write_new(self.store.spark, f"{self.root}/PREPARED", json.dumps({"base": self.base, "buckets": self.buckets}))
        return self

    def commit(self) -> int:
        return commit(self.store, self.id)


def commit(store: Store, tx: str) -> int:
    """Give a prepared transaction its mark: the number of the commit. Refused, and rolled back, if a later commit touched its buckets."""
    plan = store.prepared(tx)
    if plan is None or store.status(tx) == "rolled_back":
        raise StaleSnapshot(f"{tx} is not prepared")
    while True:
        store.refresh()
        if tx in store.commits:
            return store.commits.index(tx) + 1
        others = {b for other in store.commits[plan["base"] :] if other != "-" for b in store.prepared(other)["buckets"]}
        if others & set(plan["buckets"]):
            roll_back(store, tx)
            raise StaleSnapshot(f"another commit changed the buckets of {tx}")
        number = len(store.commits) + 1
        if shared.write_new(store.spark, f"{store.root}/commits/{number:09d}", tx):
            return number if tx in store.refresh().commits else commit(store, tx)
        _fill(store, number)


def _fill(store: Store, number: int) -> None:
    """An empty mark belongs to a writer that is about to fill it or died before: after some seconds it becomes a commit of nothing."""
    path = f"{store.root}/commits/{number:09d}"
    for _ in range(WAITS):
        if shared.read_small(store.spark, path).strip():
            return
        time.sleep(0.2)
    if not shared.read_small(store.spark, path).strip():
        fs, where = shared.store(store.spark, path)
        out = fs.create(where, True)
        out.write(bytearray(b"-"))
        out.close()


def roll_back(store: Store, tx: str) -> None:
    """End a transaction without a mark: its files are never read, and its data is deleted; committed ones stay."""
    if tx in store.refresh().commits:
        return
    shared.write_new(store.spark, f"{store.root}/tx/{tx}/ROLLED_BACK", "")
    fs, where = shared.store(store.spark, f"{store.root}/tx/{tx}/data")
    fs.delete(where, True)


def recover(store: Store) -> dict[str, str]:
    """End every transaction that a lost writer left open, and say how: prepared ones are committed where nothing stands against it, others rolled back.

    For a store that nobody is writing to; running it again, or after being lost itself, gives the same end.
    """
    out = {}
    names = shared.names(store.spark, f"{store.root}/tx")
    number = len(store.refresh().commits) + 1
    if f"{number:09d}" in shared.names(store.spark, f"{store.root}/commits"):
        _fill(store, number)
    for tx in sorted(names, key=lambda t: ((store.prepared(t) or {"base": 0})["base"], t)):
        state = store.status(tx)
        if state == "prepared":
            try:
                commit(store, tx)
            except StaleSnapshot:
                pass
        elif state == "staged":
            roll_back(store, tx)
        if state in ("prepared", "staged"):
            out[tx] = store.refresh().status(tx)
    return out


def undo(store: Store, tx: str) -> int:
    """Commit the contents that a committed transaction replaced; refused if one of its files was changed since."""
    number = store.refresh().commits.index(tx)
    plan = store.prepared(tx)
    entries = store.spark.read.schema(ENTRIES).parquet(f"{store.root}/tx/{tx}/entries")
    before = store.files(plan["buckets"], number)
    changes = entries.join(before, "rel", "left").select("rel", "content", F.col("after_sha256").alias("expected"))
    return Transaction(store).stage(changes).prepare().commit()


def apply(store: Store, changes: DataFrame) -> int:
    """Stage, prepare and commit changes; the number of the commit."""
    return Transaction(store).stage(changes).prepare().commit()
