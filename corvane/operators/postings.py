"""A search index that outlives its queries: postings by term, a gram table over the vocabulary, and sections for phrases.

An index is a folder of segments. Adding notes writes a segment and then publishes the list of segments as a small snapshot (sinks.publish), so a
build that is lost midway leaves the old index in place; removing notes writes a segment of names only. The last segment that
names a note decides whether it is there, so neither needs a rebuild.

* postings (term, rel, section, tf, n, area), in folders by a hash of the term and in files ordered by term: a query reads the folders of its words.
  Sections -1 and -2 are the title and the tags, -3 the whole content where it is not just its sections. area: 1 heading, 2 body, 4 the body has a code fence.
* grams (gram, word): the words that have a run of three characters. Boosts for substrings ask which words contain a term, and then read
  the postings of those words: a query term without blanks stands inside a word, so texts are not read for it.
* sections (rel, section, heading, body), in folders by a hash of rel: phrases of several words are looked up in the sections
  that have all their words, and only the folders of those are read.
* notes (rel, title, tags, kind, n): a row for each note.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.search import K1, B, Term
from corvane.sources import shared, sinks

BUCKET_BYTES = 256 << 20  # of text; the number of folders is fixed when an index is new
FEW = 300  # words that a query reads by name
SALTS = 4  # tasks that share the postings of one bucket
GRAM = 3
RUN = "[a-z0-9_.\\-]+|[\\u4e00-\\u9fff]+"
TITLE, TAGS, CONTENT = -1, -2, -3
HEADING, BODY, FENCE = 1, 2, 4


SCHEMAS = {
    "notes": "rel {}, title string, low string, tags array<string>, kind string, n int, there boolean",
    "postings": "term string, rel {}, section int, tf int, n int, area int, bucket int",
    "sections": "rel {}, section int, heading string, body string, part int",
    "grams": "gram string, word string, bucket int",
}


def _bucket(c: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _format(spark: SparkSession, root: str) -> dict:
    """What holds for all segments of an index: its number of folders, and the type of rel."""
    return json.loads(shared.read_small(spark, f"{root}/FORMAT"))


def _runs(text: Column) -> Column:
    """The distinct maximal runs of a lower-cased text that a term without other characters can stand in."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({RUN})"), 1))


def _postings(notes: DataFrame, buckets: int) -> DataFrame:
    """(bucket, term, rel, section, tf, n, area) of notes (rel, title, tags, content, sections)."""
    whole = lambda s: F.concat_ws("\n", s["heading"], s["body"])
    s = notes.select("rel", F.posexplode("sections").alias("section", "s")).select("rel", "section", "s.heading", "s.body", whole(F.col("s")).alias("text"))
    fence = F.when(F.contains("body", F.lit("```")), FENCE).otherwise(0).cast("int")
    # the words of a body without a heading are known from its tokens; beside others, and beside CJK runs, places come in rows of their own
    plain = ~F.lower(F.coalesce("heading", F.lit(""))).rlike(RUN) & ~F.coalesce("body", F.lit("")).rlike(T.CJK)
    s = s.select("rel", "section", "heading", "body", T.token_bags(F.col("text")).alias("b"), plain.alias("plain"), fence.alias("fence"))
    # what a function of each word asks for is a column: it would be computed for each word of the section
    s = s.withColumns({"n": T.token_count(F.col("b")), "area": F.when(F.col("plain"), F.col("fence") + BODY).otherwise(0), "around": F.col("fence") + BODY})
    at = lambda xs, tf, area: F.transform(xs, lambda x: F.struct(x.alias("term"), F.lit(tf).alias("tf"), area.alias("area")))
    places = F.concat(at(_runs(F.col("heading")), 0, F.lit(HEADING)), at(_runs(F.col("body")), 0, F.col("around")))
    inside = F.concat(at("b.words", 1, F.col("area")), at("b.parts", 1, F.lit(0)), F.when(~F.col("plain"), places).otherwise(F.array().cast("array<struct<term:string,tf:int,area:int>>")))
    tokens = s.select("rel", "section", "n", F.explode(inside).alias("x"))
    tokens = tokens.select("rel", "section", F.when(F.col("x.tf") > 0, F.col("n")).otherwise(0).alias("n"), "x.term", "x.tf", "x.area")

    def of(k: int, text: Column) -> Column:
        return F.transform(_runs(text), lambda x: F.struct(x.alias("term"), F.lit(k).alias("section")))

    other = F.concat(of(TITLE, F.col("title")), of(TAGS, F.concat_ws(" ", "tags")))
    beside = notes.select("rel", F.explode(other).alias("x")).select("rel", "x.section", F.lit(0).alias("n"), "x.term", F.lit(0).alias("tf"), F.lit(0).alias("area"))
    outside = ~F.col("content").eqNullSafe(F.array_join(F.transform("sections", whole), "\n"))
    content = notes.where(outside).select("rel", T.token_bags(F.col("content"), distinct=True).alias("b"), _runs(F.col("content")).alias("r"))
    content = content.select("rel", F.lit(CONTENT).alias("section"), F.lit(0).alias("n"), F.explode(F.array_distinct(F.concat("b.words", "b.parts", "r"))).alias("term"), F.lit(0).alias("tf"), F.lit(0).alias("area"))
    rows = reduce(DataFrame.unionByName, (tokens, beside, content))
    rows = rows.select(_bucket("term", buckets).alias("bucket"), F.pmod(F.xxhash64("rel"), F.lit(SALTS)).alias("salt"), "*").repartition("bucket", "salt")
    return rows.groupBy("bucket", "salt", "term", "rel", "section").agg(F.sum("tf").cast("int").alias("tf"), F.max("n").alias("n"), F.bit_or("area").cast("int").alias("area")).drop("salt")


def add(notes: DataFrame, root: str) -> str:
    """Index notes (rel, title, tags, kind, content, sections), in place of those of the same rel; the name of the segment.

    Missing lists count as empty; rows without a rel are left out; of rows that share a rel in one call the index holds all, as one note.
    """
    spark, name = notes.sparkSession, f"seg-{uuid.uuid4().hex}"
    size = notes.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shared.write_new(spark, f"{root}/FORMAT", json.dumps({"buckets": min(4096, 4 + size // BUCKET_BYTES), "rel": notes.schema["rel"].dataType.simpleString()}))
    buckets = _format(spark, root)["buckets"]
    notes = shared.spread(notes.where("rel IS NOT NULL"))
    low = F.lower(F.coalesce("title", F.lit("")))
    notes.select("rel", "title", low.alias("low"), F.coalesce("tags", F.expr(T.EMPTY)).alias("tags"), "kind", T.token_count(T.token_bags(F.col("content"))).alias("n"), F.lit(True).alias("there")).write.parquet(f"{root}/{name}/notes")
    _postings(notes, buckets).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{root}/{name}/postings")
    parts = notes.select(_bucket("rel", buckets).alias("part"), "rel", F.posexplode("sections").alias("section", "s")).select("part", "rel", "section", "s.heading", "s.body")
    parts.repartition("part").write.partitionBy("part").parquet(f"{root}/{name}/sections")
    words = _read(spark, root, name, "postings").select("term").distinct()
    grams = words.select(F.explode(F.array_distinct(F.when(F.length("term") < GRAM, F.array("term")).otherwise(T.ngrams(F.col("term"), GRAM)))).alias("gram"), F.col("term").alias("word"))
    grams.select(_bucket("gram", buckets).alias("bucket"), "*").repartition("bucket").sortWithinPartitions("gram").write.partitionBy("bucket").parquet(f"{root}/{name}/grams")
    _publish(spark, root, name)
    return name


def remove(rels: DataFrame, root: str) -> str:
    """Take notes (rel) out of the index; names that it does not have change nothing."""
    spark, name = rels.sparkSession, f"seg-{uuid.uuid4().hex}"
    kinds = "title string, low string, tags array<string>, kind string, n int"
    none = [F.lit(None).cast(k.split(" ")[1]).alias(k.split(" ")[0]) for k in kinds.split(", ")]
    rels.select("rel").distinct().select("rel", *none, F.lit(False).alias("there")).write.parquet(f"{root}/{name}/notes")
    _publish(spark, root, name)
    return name


def _publish(spark: SparkSession, root: str, name: str) -> None:
    """Add a segment to the published list; tried again when another writer was first, as segments do not depend on each other."""
    for _ in range(20):
        before = sinks.current(spark, root)
        rows = [] if before is None else [(r.at, r.segment) for r in spark.read.parquet(f"{root}/{before}").collect()]
        listed = spark.createDataFrame([*rows, (len(rows), name)], "at int, segment string").coalesce(1)
        try:
            sinks.publish(listed, root, before)
            return
        except sinks.StaleSnapshot:
            continue
    raise sinks.StaleSnapshot(f"no turn to publish {name}")


def _read(spark: SparkSession, root: str, segment: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name].format(_format(spark, root)["rel"])).parquet(f"{root}/{segment}/{name}")


def _grams(text: str) -> list[str]:
    return sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})


class Index:
    """The published state of an index: tables of all its segments, with the notes that are there now."""

    def __init__(self, spark: SparkSession, root: str):
        name = sinks.current(spark, root)
        self.spark, self.root = spark, root
        self.buckets = _format(spark, root)["buckets"] if name else 0
        self.segments = [] if name is None else [r.segment for r in spark.read.parquet(f"{root}/{name}").orderBy("at").collect()]
        self._holds = [set(shared.names(spark, f"{root}/{s}")) for s in self.segments]
        if not self.segments:
            raise ValueError(f"no index at {root}")
        notes = self._table("notes")
        last = notes.groupBy("rel").agg(F.max("at").alias("at"))
        self.notes = (notes if len(self.segments) == 1 else notes.join(last, ["rel", "at"])).where("there")

    def _table(self, name: str) -> DataFrame:
        found = [_read(self.spark, self.root, s, name).withColumn("at", F.lit(i)) for i, s in enumerate(self.segments) if name in self._holds[i]]
        return reduce(DataFrame.unionByName, found)

    def _buckets(self, values: list[str]) -> list[int]:
        """The folders of a few terms or grams."""
        return sorted(set(self.spark.sql("SELECT 1").select(F.array(*(_bucket(F.lit(v), self.buckets) for v in values))).first()[0]))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows of the notes that are there, from the segment that has them."""
        return rows if len(self.segments) == 1 else rows.join(self.notes.select("rel", "at"), ["rel", "at"], "left_semi")

    def postings(self, terms: list[str]) -> DataFrame:
        """The live postings of a few terms: only their folders are read."""
        return self._live(self._table("postings").where(F.col("bucket").isin(self._buckets(terms)) & F.col("term").isin(terms)))

    def matching(self, test: Column, parts: list[str]) -> DataFrame:
        """The live postings whose term passes a test that implies that it contains one of the parts.

        The grams of the parts say which words those are. If they are few, only their folders and row groups are read; a test that many words pass, such as one for
        a short part, is applied to all postings.
        """
        rows = self._table("postings")
        if all(len(p) >= GRAM for p in parts):
            own = sorted({g for p in parts for g in _grams(p)})
            grams = self._table("grams").where(F.col("bucket").isin(self._buckets(own)) & F.col("gram").isin(own))
            few = grams.select(F.col("word").alias("term"), _bucket("word", self.buckets).alias("bucket")).distinct().where(test).limit(FEW + 1).collect()
            if len(few) <= FEW:
                rows = rows.where(F.col("bucket").isin(sorted({r.bucket for r in few})) & F.col("term").isin([r.term for r in few])) if few else rows.where(F.lit(False))
        return self._live(rows.where(test))

    def statistics(self, terms: list[Term]) -> dict:
        """N, the mean number of tokens, and the document frequency of each term."""
        known = self.postings([t.text for t in terms]).where((F.col("section") == CONTENT) | (F.col("tf") > 0)).groupBy("term").agg(F.count_distinct("rel").alias("k"), F.lit(0.0).alias("mean"))
        rows = known.unionAll(self.notes.agg(F.lit(None).cast("string").alias("term"), F.count("*").alias("k"), F.avg("n").alias("mean")).select("term", "k", "mean")).collect()
        found, notes = {r.term: r.k for r in rows if r.term is not None}, next(r for r in rows if r.term is None)
        return {"n": notes.k, "mean": notes.mean} | {f"df{i}": found.get(t.text, 0) for i, t in enumerate(terms)}

    def phrase(self, phrase: str) -> DataFrame:
        """(rel, section, head, body): live sections whose heading or body contains a phrase of several words; nothing is missed, whatever stands between them."""
        spans = [m.span() for m in re.finditer(RUN, phrase)]
        rows = self._table("sections")
        if spans:
            # the longest of its words, one that is whole if there is one, picks the sections to look at
            a, b = max(spans, key=lambda s: (s[0] > 0 and s[1] < len(phrase), s[1] - s[0]))
            word, term = phrase[a:b], F.col("term")
            test = F.contains(term, F.lit(word)) if b - a == len(phrase) else (term == word) if a > 0 and b < len(phrase) else F.startswith(term, F.lit(word)) if a > 0 else F.endswith(term, F.lit(word))
            sections = self.matching(test, [word]).where("section >= 0").select("rel", "section", "at")
            if self.buckets > 64:
                parts = [r[0] for r in sections.select(_bucket("rel", self.buckets)).distinct().collect()]  # at most self.buckets
                rows = rows.where(F.col("part").isin(parts) if parts else F.lit(False))
            rows = rows.join(sections, ["rel", "section", "at"], "left_semi")
        else:
            rows = self._live(rows)
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(phrase))
        return rows.select("rel", "section", has("heading").alias("head"), has("body").alias("body")).where("head OR body")


def search(index: Index, query: str, terms: list[Term], language: str | None = None, tag: str | None = None, top: int | None = 3, clusters: list[tuple[list[str], list[str]]] = ()) -> DataFrame:
    """(rel, title, section, score, rank) as search.search gives it, from the index.

    Terms are runs of ASCII word characters or of CJK characters, as query_terms makes them; others are looked up as phrases.
    clusters: (triggers, expansions) that the query set off; a core term that one of them lists is covered by any of its expansions.
    """
    q = query.lower().strip()
    stats = index.statistics(terms)
    mean = float(stats["mean"] or 1.0) or 1.0
    idf = [math.log(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)) if stats[f"df{i}"] else 1.0 for i in range(len(terms))]
    plain = [bool(re.fullmatch(RUN, t.text)) for t in terms]
    one = bool(re.fullmatch(RUN, q))
    asked = [t.text for t in terms] + ([q] if one else [])
    looked = [(i, x) for i, x in enumerate(asked) if i >= len(terms) or plain[i]]
    zero = F.lit(0.0)
    plus = lambda test, x: F.when(test, F.lit(float(x))).otherwise(zero)
    bit = lambda c, i: F.col(c).bitwiseAND(F.lit(1 << i)) != 0
    spoken = [(1 << i, t.text) for i, t in enumerate(terms) if not plain[i]] + ([] if one or len(q) < 1 else [(1 << len(terms), q)])
    of = lambda test, c="bits": F.bit_or(F.when(test, F.col(c)).otherwise(F.lit(0).cast("long")))
    parts = []
    if looked:
        bits = reduce(Column.bitwiseOR, (F.when(F.contains("term", F.lit(x)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, x in looked))
        rows = index.matching(bits != 0, [x for _, x in looked]).withColumn("bits", bits)
        area = lambda k: (F.col("section") >= 0) & (F.col("area").bitwiseAND(F.lit(k)) != 0)
        parts.append(rows.select("rel", "section", "bits", area(HEADING).alias("head"), area(BODY).alias("body"), area(FENCE).alias("fence"), F.when(F.col("term").isin([t.text for t in terms]), F.col("tf")).alias("tf"), "n", "term"))
    for b, text in spoken:
        hit = index.phrase(text).select("rel", "section", F.lit(b).cast("long").alias("bits"), "head", "body", F.lit(False).alias("fence"), F.lit(0).alias("tf"), F.lit(0).alias("n"), F.lit("").alias("term"))
        parts.append(hit)
    rows = reduce(DataFrame.unionByName, parts).repartition("rel")  # for both groupings
    none = F.lit(0).cast("long")
    counted = [F.max(F.when(F.col("term") == t.text, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)]
    sections = rows.groupBy("rel", "section").agg(of(F.col("head")).alias("head"), of(F.col("body")).alias("body"), F.bool_or("fence").alias("fence"), F.max("n").alias("n"), of(F.lit(True)).alias("any"), *counted)
    total, long_ = zero, F.lit(False)
    for i, (t, w) in enumerate(zip(terms, idf)):
        tf = F.col(f"tf{i}").cast("double")
        total = total + F.when(tf > 0, F.lit(t.weight * w) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.lit(mean)))).otherwise(zero) + plus(bit("head", i), w * t.weight * 3.0)
        long_ = long_ | bit("body", i) if len(t.text) > 2 else long_
    if len(q) > 1:
        total = total + plus(bit("head", len(terms)), 15) + plus(bit("body", len(terms)), 8)
    total = total + plus(F.col("fence") & long_, 2)
    scored = sections.select("rel", "section", "any", F.when(F.col("section") >= 0, total).alias("score"))
    best = F.min(F.when(F.col("score") > 0, F.struct((-F.col("score")).alias("s"), "section"))).alias("best")
    place = lambda k: of(F.col("section") == k, "any")
    docs = scored.groupBy("rel").agg(best, place(TITLE).alias("title_bits"), place(TAGS).alias("tag_bits"), of(F.lit(True), "any").alias("raw"))
    has = lambda c, s: F.contains(c, F.lit(s))
    notes = index.notes if tag is None else index.notes.where(F.exists("tags", lambda x: has(x, tag.lower())))
    docs = notes.select("rel", "title", "low", "tags", "kind").join(docs, "rel", "left")
    for c in ("title_bits", "tag_bits", "raw"):
        docs = docs.withColumn(c, F.coalesce(c, none))
    in_title = lambda i, text: bit("title_bits", i) if i < len(terms) and plain[i] else has("low", text)
    in_tags = lambda i, text: F.exists("tags", lambda x: has(x, text)) if not plain[i] else bit("tag_bits", i)
    boost = plus(has("low", q), 20) if q else zero
    for i, (t, w) in enumerate(zip(terms, idf)):
        boost = boost + plus(in_title(i, t.text), w * t.weight * 3.5) + plus(in_tags(i, t.text), w * t.weight * 4.0)
    there = lambda i: bit("raw", i) | F.lit(False) if plain[i] else bit("raw", i) | in_title(i, terms[i].text) | in_tags(i, terms[i].text)
    number = {t.text: i for i, t in enumerate(terms)}

    def covers(i: int) -> Column:
        met = there(i)
        for triggers, expansions in clusters:
            if terms[i].text in triggers or terms[i].text in expansions:
                for x in expansions:
                    met = met | there(number[x]) if x in number else met
        return met.cast("int")

    core = [i for i, t in enumerate(terms) if t.core]
    covered = sum((covers(i) for i in core), F.lit(0)) / float(len(core)) if core else F.lit(1.0)
    doc = F.coalesce(-F.col("best.s"), zero) + boost
    factor = F.lit(1.0)
    if language:
        own = F.array_contains("tags", language)
        doc = doc + plus(own & F.col("kind").isin("standards", "cheatsheet"), 8)
        factor = F.when(own, 2.5).when(F.exists("tags", lambda x: x.startswith("lang/")), 0.2).otherwise(0.6)
    score = doc * F.pow(covered, F.lit(1.5)) * factor + plus(covered >= 0.99, 5)
    out = docs.select("rel", "title", F.coalesce("best.section", F.lit(0)).cast("int").alias("section"), score.alias("score")).where("score > 0.5")
    if top is None:
        return out
    return out.orderBy(F.desc("score"), "rel").limit(top).select("*", F.row_number().over(Window.orderBy(F.desc("score"), "rel")).alias("rank"))
