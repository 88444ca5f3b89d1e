"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A document's size is its number of words.  Sources in code-point order (null last) weigh 5, 2, 1, repeating; they share
all words by weight, but no source gets more than ``max_ratio`` times its own, the excess going to the others by
weight (water-filling: sort by cap over weight, one running sum).  A source with target/size = w + f takes w certain
copies of every document.  The rest, f of its words, is an unequal-probability sample without replacement: a document's
inclusion odds are f/(1-f) times its size over the mean size of its source (times its importance, if given), so that
long documents are likelier than short ones, and documents are ranked by Pareto's key, random odds U/(1-U) over
inclusion odds.  Down the ranks every document is taken whose words fit the words still missing; at last the one whose
size is nearest to the words missing, if that brings the source nearer.  So a source ends within half the smallest
document left out.

The running sum over ranks never gathers a source.  In rounds, the documents that fit the words missing and rank behind
the last one taken fall into ``BUCKETS`` monotone buckets, whose word sums are added up; only documents of the one bucket
where the words run out are ordered one by one.  A round ends before the first document that does not fit any more, and
the next leaves out all that are larger than what is then missing; each takes at least one document, and what is missing
falls below the size of the one that ended it, so rounds are few (a handful; their number grows with the logarithm of the
sizes).  The outcome is one small table of cut-offs per source, so that the decision on a document is a function of its
own row: reruns and lost tasks give the same, and no text is shuffled.

Defined cases: a very long text counts whole; null text or one without words has size 0 and only its certain copies; null
source is a source of its own, null id draws as the empty string; rows alike in id, source and size draw alike, count
together and are taken or left together; no words at all give target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixeltide.llm.common import broadcast_below, fresh, kept, scratch, written

WEIGHTS = (5, 2, 1)
MAX_RATIO = 3
SEED = "mix"
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"
#: A table of sources up to so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(seed: str, key: Column, source: Column, size: Column) -> Column:
    """Uniform in (0, 1) from 52 bits of an MD5 digest, so that any engine can repeat it."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), F.coalesce(source, F.lit("")), F.lit(":"), size.cast("string"))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_ratio: int = MAX_RATIO) -> DataFrame:
    """source, source_size, documents (those that have words), target: one row per source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("documents"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cap = F.col("source_size") * max_ratio
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")))
    level = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    share = left.cast("double") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = weighed.select("source", "source_size", "documents", "weight", cap.alias("cap"), share.alias("share"), F.row_number().over(level).alias("place"))
    free = F.when(F.col("cap").cast("double") / F.col("weight") > F.col("share"), F.struct("place", "share"))
    rate = F.min(free).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["share"]
    return filled.select("source", "source_size", "documents", F.coalesce(F.least(F.col("cap").cast("double"), rate * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def _keyed(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Adds q, the Pareto key, its bucket, and words, those of all rows alike.  ``few``: the plan is small enough to broadcast."""
    plan = plan.withColumnRenamed("source", "plan_source")
    joined = rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    length = F.col("size").cast("double") * F.col("documents").cast("double") / F.col("source_size").cast("double")
    odds = F.col("share") / (F.lit(1.0) - F.col("share"))
    q = (F.col("u") / (F.lit(1.0) - F.col("u"))) / (odds * (length * F.col("importance")))
    with_q = joined.withColumn("q", F.when((F.col("share") > 0) & (F.col("importance") > 0) & (F.col("size") > 0), q))
    even = F.col("q") * odds
    return with_q.withColumn("bucket", F.floor(F.least(even / (even + 1.0), F.lit(1 - 1e-12)) * BUCKETS).cast("int")).withColumn("words", F.col("size") * F.col("alike"))


class Mix:
    """Cut-offs of every source (``cuts``: one row per source) and the narrow table they were found on."""

    def __init__(self, docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", importance_col: str | None = None, weights=WEIGHTS, max_ratio: int = MAX_RATIO, seed: str = SEED):
        self.names, self.seed = (id_col, text_col, source_col, importance_col), seed
        with scratch() as held:
            rows = written(docs.select(F.col(id_col).alias("id"), *self._own()), "sizes")
            again = written(rows.groupBy(*SAME).agg(F.count("*").alias("n")).where("n > 1"), "again")
            self.again = None if again.isEmpty() else kept(held, again)
            targets = written(source_targets(rows, weights, max_ratio), "targets")
            ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
            whole = F.floor(ratio)
            plan = targets.select("source", "source_size", "documents", "target", whole.cast("int").alias("whole"), (ratio - whole).alias("share"), (F.col("target") - whole * F.col("source_size")).alias("wanted"))
            self.few = targets.count() <= BROADCAST_SOURCES
            cuts = _cut_offs(_keyed(self._counted(rows), plan, self.few).where("q IS NOT NULL"), plan, self.few)
            self.rows, self.cuts = kept(held, rows), kept(held, written(cuts, "cuts"))

    def _own(self) -> list[Column]:
        id_col, text_col, source_col, importance_col = self.names
        key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
        size, source = words_in(F.col(text_col)), F.col(source_col).cast("string")
        importance = F.coalesce(F.col(importance_col).cast("double"), F.lit(0.0)) if importance_col else F.lit(1.0)
        return [source.alias("source"), size.alias("size"), key.alias("key"), draw(self.seed, key, source, size).alias("u"), importance.alias("importance")]

    def _counted(self, rows: DataFrame) -> DataFrame:
        """Adds alike, the number of rows that draw alike."""
        if self.again is None:
            return rows.withColumn("alike", F.lit(1))
        again = broadcast_below(self.again.select(*[F.col(c).alias(f"again_{c}") for c in SAME], "n"), BROADCAST_SOURCES)
        joined = rows.join(again, F.expr(" AND ".join(f"{c} <=> again_{c}" for c in SAME)), "left")
        return joined.withColumn("alike", F.coalesce("n", F.lit(1))).drop(*again.columns)

    def decided(self, rows: DataFrame) -> DataFrame:
        """Adds source_size, target and copies to rows that have source, size, key, u and importance."""
        keyed = _keyed(self._counted(rows), self.cuts, self.few)
        at = F.struct("q", "key")
        chosen = F.exists("cuts", lambda c: F.coalesce((F.col("words") <= c["most"]) & (at >= c["first"]) & (at <= c["last"]), F.lit(False))) & F.col("q").isNotNull()
        return keyed.withColumn("copies", F.col("whole") + F.coalesce(chosen, F.lit(False)).cast("int"))

    def per_document(self) -> DataFrame:
        done = self.decided(self.rows)
        return done.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))

    def mixed(self, docs: DataFrame) -> DataFrame:
        """The documents themselves, each as often as it is taken; only the small table of cut-offs is joined."""
        held = fresh("document", docs.columns)
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(held), *self._own())
        done = self.decided(rows).where("copies > 0")
        return done.select(held, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(f"{held}.*")


#: Rows alike in these draw alike.
SAME = ("source", "key", "size")
CUTS = "array<struct<most:bigint,first:struct<q:double,key:string>,last:struct<q:double,key:string>>>"


def _cut_offs(live: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """``plan`` with cuts: of each round the ranks and the most words of what it takes, and at last the nearest document."""
    start = F.struct(F.lit(-1.0).alias("q"), F.lit("").alias("key"))
    cut = written(plan.select("source", "wanted", F.lit(0).cast("bigint").alias("got"), F.array().cast(CUTS).alias("cuts"), start.alias("last")), "cut")
    while True:
        rest = _rest(live, cut, few).where((F.col("at") > F.col("last")) & (F.col("words") <= F.col("room")))
        sums = written(rest.groupBy("source", "room", "bucket").agg(F.sum("size").alias("words"), F.max("at").alias("top")), "sums")
        if sums.isEmpty():
            break
        cut = written(_round(rest, sums, cut, few), "cut")
    off = F.abs(F.col("words") - F.col("gap"))
    best = _rest(live, cut, few).where(off < F.abs("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("at"), F.col("words"))).alias("best"))
    best = best.select(F.col("source").alias("s"), F.array(F.struct(F.col("best.words").alias("most"), F.col("best.at").alias("first"), F.col("best.at").alias("last"))).cast(CUTS).alias("one"))
    done = cut.join(best, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("c"), F.concat("cuts", F.coalesce("one", F.array().cast(CUTS))).alias("cuts"))
    return plan.join(done, F.col("source").eqNullSafe(F.col("c"))).drop("c")


def _rest(live: DataFrame, cut: DataFrame, few: bool) -> DataFrame:
    """Documents no cut-off takes yet, with their rank and the words their source misses, ``gap``, whole ``room``."""
    own = cut.select(F.col("source").alias("s"), "cuts", "last", (F.col("wanted") - F.col("got")).alias("gap"), (F.floor("wanted") - F.col("got")).alias("room"))
    joined = live.withColumn("at", F.struct("q", "key")).join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return joined.where(~F.exists("cuts", lambda c: (F.col("words") <= c["most"]) & (F.col("at") <= c["last"])))


def _round(rest: DataFrame, sums: DataFrame, cut: DataFrame, few: bool) -> DataFrame:
    """Down the ranks while the words fit: whole buckets, then documents of the bucket where they run out."""
    upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
    run = sums.withColumn("upto", upto)
    over, fits = F.col("upto") > F.col("room"), F.col("upto") <= F.col("room")
    ends = run.groupBy("source").agg(F.min(F.when(over, F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("edge"), F.max(F.when(fits, F.col("upto"))).alias("whole"), F.max(F.when(fits, F.col("top"))).alias("whole_top"))
    ends = ends.select(F.col("source").alias("s"), F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before"), "whole", "whole_top")
    edges = ends.where("edge IS NOT NULL").select("s", "edge", "before")
    ordered = rest.join(F.broadcast(edges) if few else edges, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("edge")))
    ordered = ordered.select("source", "room", "at", (F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("at"))).alias("run"))
    inside = ordered.where("run <= room").groupBy("source").agg(F.max("run").alias("run"), F.max("at").alias("top")).withColumnRenamed("source", "i")
    taken = ends.join(inside, F.col("s").eqNullSafe(F.col("i")), "left").select("s", F.coalesce("run", "whole").alias("more"), F.coalesce("top", "whole_top").alias("top"))
    joined = cut.join(taken, F.col("source").eqNullSafe(F.col("s")), "left")
    start = F.struct(F.lit(-1.0).alias("q"), F.lit("").alias("key"))
    one = F.array(F.struct((F.floor("wanted") - F.col("got")).alias("most"), start.alias("first"), F.col("top").alias("last"))).cast(CUTS)
    return joined.select("source", "wanted", (F.col("got") + F.coalesce("more", F.lit(0))).alias("got"), F.when(F.col("top").isNull(), F.col("cuts")).otherwise(F.concat("cuts", one)).alias("cuts"), F.coalesce("top", "last").alias("last"))


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken."""
    return Mix(docs, **options).per_document()


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix: every document repeated as often as it is taken (0 to ``max_ratio`` times), with its own columns."""
    return Mix(docs, **options).mixed(docs)
