"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Targets are filled like vessels: sources get words by weight up to ``most`` times their own, and what
overflows is shared again by weight. Every document of a source is then taken ``floor(target / source
size)`` times for certain, and what is left of the target, a share p of the source, goes to documents in Pareto order: by random odds
divided by inclusion odds, ``u / (1 - u) / (p / (1 - p))``, smallest first. Within a source that order is one of u, so ranges of u are
ranges of it; only the bucket of u in which the target is reached is looked at document by document. There, too, documents are taken in
order up to the first that does not fit. The rest of the target, less than the size of that one, goes to those from it on that still fit, in order, and at last to the
smallest that did not fit, if the sum is nearer to the target with it. Of ``DROPS`` times ``TURNS`` such endings that one is taken which comes nearest, in steps of 0.2 % of what is needed,
and of equals the first: that of the order itself, then those that begin further on, then those that take up to ``DROPS - 1`` of the last documents in order back. So
sources of few documents meet their targets too, and in large ones the order decides all but the last documents.

u is a hash of the id and the size, so reruns agree. Rows are taken, not ids: rows of the same id and size are one entry with a
count, of which so many are taken as fit. No source is gathered in one task: sizes, buckets and boundary
buckets (about ``bucket_rows`` rows, fewer entries) are pre-aggregated. The table of sources, one row each, is ranked in one task.

Defined cases: null and empty texts have size 0 and cost nothing; very long texts are counted whole, in the JVM; a null source is a source, the last; a
source without words has target 0; rows that repeat an id are weighed one by one, and of equal ones any may be taken; ties in u go by id, then size;
an empty table gives an empty mix; further columns are dropped here, kept by ``apply_mix`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, free_names, quoted

WORD = "[^\\x20\\x09-\\x0D]+"
SEED = "mix"
#: Endings that are tried in a boundary bucket: so many of the last documents in order are taken back, and so many places are begun from.
DROPS, TURNS = 8, 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, size: Column, seed: str = SEED) -> Column:
    """u in [0, 1): the first 52 bits of the MD5 of the seed, the id and the size."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"), size.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def pareto(u: Column, odds: Column) -> Column:
    """Random odds divided by inclusion odds."""
    return u / (1 - u) / odds


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, n_docs, source_size): one row for each source.

    Sources by code point, null last, weigh ``weights``, repeating. With sources in order of cap / weight, the
    first k are full exactly if the level (budget - caps of the full) / (weights of the rest) exceeds each full one's cap / weight.
    """
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("source").cast("binary").asc_nulls_last()]
    filled = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # the level at the first source that is not full holds for it and all after it; further down levels only fall
    water = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    return rows.select("source", "n_docs", "source_size", F.least("cap", F.coalesce(water * F.col("weight"), F.col("cap"))).alias("target"))


def decisions(sized: DataFrame, bucket_rows: int = 1000, **shares) -> DataFrame:
    """One row for each source: what of it is taken.

    (source, source_size, target, odds, whole, buckets, edge, stop, chosen): rows are taken ``whole`` times, and
    once more in buckets of u below ``edge``; in bucket ``edge`` those before ``stop`` in Pareto order, and so many of an id and size as ``chosen`` says (m of n).
    ``sized`` has (id, source, size, u).
    """
    sizes = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = (
        targets(sizes, **shares)
        .withColumn("whole", F.floor(ratio + F.lit(1e-12)).cast("long"))
        .withColumn("need", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
        .withColumn("p", F.when(F.col("source_size") > 0, F.col("need") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("odds", F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("p") / (1 - F.col("p"))).otherwise(F.lit(1.0)))
        .withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_rows)).cast("long"))
        .drop("n_docs", "p")
    )
    goals = cut(goals, "mix-goals")  # a row for each source
    g = goals.select(F.col("source").alias("g_source"), "need", "odds", "buckets")
    placed = sized.join(g, F.col("source").eqNullSafe(F.col("g_source"))).withColumn("bucket", F.floor(F.col("u") * F.col("buckets")))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the first bucket in which the words reach what is needed
    reached = sums.withColumn("sum", F.sum("words").over(upto)).where(F.col("sum") >= F.col("need"))
    first = reached.groupBy("source").agg(F.min(F.struct("bucket", (F.col("need") - F.col("sum") + F.col("words")).alias("left"))).alias("e"))
    edges = cut(first.select(F.col("source").alias("e_source"), F.col("e.bucket").alias("edge"), F.col("e.left").alias("left")), "mix-edges")
    at_edge = placed.join(edges, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("edge")))
    entries = at_edge.groupBy("source", "u", "id", "size").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("left", "need", "odds")))
    entry = F.struct(pareto(F.col("u"), F.col("odds")).alias("q"), "id", "size", "n")
    ranked = entries.groupBy("source").agg(F.array_sort(F.collect_list(entry)).alias("docs"), F.first("left").alias("left"), F.first("need").alias("need"))
    chosen = filled(ranked).select(F.col("source").alias("c_source"), "stop", "chosen")
    return (
        goals.join(edges.select("e_source", "edge"), F.col("source").eqNullSafe(F.col("e_source")), "left")
        .join(chosen, F.col("source").eqNullSafe(F.col("c_source")), "left")
        .select("source", "source_size", "target", "odds", "whole", "buckets", F.coalesce("edge", F.lit(-1)).alias("edge"), "stop", F.coalesce("chosen", F.array().cast(CHOSEN)).alias("chosen"))
    )


CHOSEN = "array<struct<id:bigint,size:bigint,m:bigint,n:bigint>>"


def _pick(d: Column, m: Column) -> Column:
    return F.named_struct(F.lit("id"), d["id"], F.lit("size"), d["size"], F.lit("m"), m, F.lit("n"), d["n"])


def _fitting(d: Column, left: Column) -> Column:
    """So many of an entry's rows fit; those of size 0 cost nothing."""
    return F.when(d["size"] > 0, F.least(d["n"], F.floor(left / F.greatest(d["size"], F.lit(1))).cast("bigint"))).otherwise(d["n"])


def filled(ranked: DataFrame) -> DataFrame:
    """(source, stop, chosen) of boundary buckets (source, docs in order, left, need).

    Entries before ``stop`` are taken whole, all of them where it is null; of it and those after it what ``chosen`` says.
    """

    def in_order(acc: Column, d: Column) -> Column:
        whole = acc["open"] & (_fitting(d, acc["left"]) == d["n"])
        left = F.when(whole, acc["left"] - d["size"] * d["n"]).otherwise(acc["left"])
        return F.named_struct(F.lit("left"), left, F.lit("at"), acc["at"] + F.when(whole, 1).otherwise(0), F.lit("open"), whole)

    begin = F.struct(F.col("left").alias("left"), F.lit(0).alias("at"), F.lit(True).alias("open"))
    known = ranked.withColumn("head", F.aggregate("docs", begin, in_order)).withColumn("rest", F.slice("docs", F.col("head.at") + 1, F.size("docs")))
    known = known.where(F.size("rest") > 0)

    def ending(number: Column) -> Column:
        drop = F.least(F.floor(number / TURNS).cast("int"), F.col("head.at"))
        back = F.slice("docs", F.col("head.at") - drop + 1, drop)
        turn = F.floor((number % TURNS) * (F.size("rest") + drop) / TURNS).cast("int")
        line = F.concat("rest", back)
        order = F.concat(F.slice(line, turn + 1, F.size("docs")), F.slice(line, 1, turn))
        left = F.aggregate(back, F.col("head.left"), lambda acc, d: acc + d["size"] * d["n"])
        return F.struct(number.alias("number"), (F.col("head.at") - drop).alias("at"), left.alias("left"), order.alias("docs"))

    fine = F.greatest(F.lit(1.0), F.lit(0.002) * F.col("need"))
    tried = F.transform(F.transform(F.sequence(F.lit(0), F.lit(DROPS * TURNS - 1)), ending), lambda e: _ending(e, fine))
    ended = known.withColumn("best", F.array_min(tried)).withColumn("stop", F.get("docs", F.col("best.at")))
    picks, extra = F.col("best.picks"), F.col("best.extra")
    same = lambda d: d["id"].eqNullSafe(extra["id"]) & (d["size"] == extra["size"])
    more = F.when(F.exists(picks, same), F.transform(picks, lambda d: _pick(d, d["m"] + F.when(same(d), 1).otherwise(0)))).otherwise(F.concat(picks, F.array(_pick(extra, F.lit(1).cast("bigint")))))
    return ended.select("source", F.struct("stop.q", "stop.id", "stop.size").alias("stop"), F.when(extra.isNotNull(), more).otherwise(picks).cast(CHOSEN).alias("chosen"))


def _ending(tried: Column, fine: Column) -> Column:
    """(gap, in steps of ``fine``; number; entries kept; picks; one more): rows taken in the order given, those that do not fit passed over."""
    start = F.struct(tried["left"].alias("left"), F.array().cast(CHOSEN).alias("picks"), F.lit(None).cast("struct<size:bigint,id:bigint,n:bigint>").alias("over"))

    def step(acc: Column, d: Column) -> Column:
        """Takes what fits of an entry; of entries that do not fit whole, remembers the smallest."""
        m = F.when(d["size"] > 0, _fitting(d, acc["left"])).otherwise(F.lit(0).cast("bigint"))
        skipped = F.when((d["size"] > 0) & (m < d["n"]), F.least(acc["over"], F.named_struct(F.lit("size"), d["size"], F.lit("id"), d["id"], F.lit("n"), d["n"]))).otherwise(acc["over"])
        return F.named_struct(F.lit("left"), acc["left"] - m * d["size"], F.lit("picks"), F.when(m > 0, F.concat(acc["picks"], F.array(_pick(d, m)))).otherwise(acc["picks"]), F.lit("over"), skipped)

    def end(acc: Column) -> Column:
        nearer = F.coalesce(acc["over"]["size"] < 2 * acc["left"], F.lit(False))
        gap = F.when(nearer, acc["over"]["size"] - acc["left"]).otherwise(acc["left"])
        return F.named_struct(F.lit("gap"), F.floor(gap / fine), F.lit("number"), tried["number"], F.lit("at"), tried["at"], F.lit("picks"), acc["picks"], F.lit("extra"), F.when(nearer, acc["over"]))

    return F.aggregate(tried["docs"], start, step, end)


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> DataFrame:
    ident, source, size = F.col(quoted(id_col)).cast("long"), F.col(quoted(source_col)).cast("string"), word_count(F.col(quoted(text_col)))
    rows = docs.select(ident.alias("id"), source.alias("source"), size.alias("size"))
    return rows.withColumn("u", draw(F.col("id"), F.col("size"), seed)).withColumn("place", F.monotonically_increasing_id())


def _with_copies(rows: DataFrame, plan: DataFrame, ident: str, source: str, size: str, u: str, place: str, copies: str) -> DataFrame:
    """``rows`` with how often each is taken in a column ``copies``, and what the plan says of its source in columns ``copies`` + name."""
    d = plan.select(*(F.col(c).alias(copies + c) for c in plan.columns))
    c = lambda n: F.col(copies + n)
    bucket = F.floor(F.col(u) * c("buckets"))
    rank = F.struct(pareto(F.col(u), c("odds")).alias("q"), F.col(ident).alias("id"), F.col(size).alias("size"))
    same = lambda x: x["id"].eqNullSafe(F.col(ident)) & (x["size"] == F.col(size))
    at_edge = bucket == c("edge")
    # null but for what is chosen from the stop on
    pick = F.when(at_edge & F.coalesce(rank >= c("stop"), F.lit(False)), F.get(F.filter(c("chosen"), same), F.lit(0)))
    joined = rows.join(d, F.col(source).eqNullSafe(c("source"))).withColumn(copies + "pick", pick)
    before_stop = at_edge & F.coalesce(rank < c("stop"), F.lit(True))
    certain = c("whole") + F.when((bucket < c("edge")) | before_stop, 1).when(c("pick.m") == c("pick.n"), 1).otherwise(0)
    if plan.where(F.exists("chosen", lambda x: x["m"] < x["n"])).limit(1).count() == 0:
        return joined.withColumn(copies, certain)
    # of rows with the same id and size, the first m by partition and place in it; no partition is gathered
    partial = F.coalesce(c("pick.m") < c("pick.n"), F.lit(False))
    some = cut(joined.where(partial).withColumn(copies + "part", F.shiftright(place, 33)), "mix-partial")
    key = [source, ident, size]
    counts = some.groupBy(*key, copies + "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("n", F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy(copies + "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*(F.col(k).alias(f"{copies}key{i}") for i, k in enumerate(key)), F.col(copies + "part").alias(copies + "key3"), F.col("n").alias(copies + "before"))
    numbered = some.withColumn(copies + "number", F.row_number().over(Window.partitionBy(*key, copies + "part").orderBy(place)))
    met = numbered.join(before, [F.col(k).eqNullSafe(F.col(f"{copies}key{i}")) for i, k in enumerate([*key, copies + "part"])])
    taken = c("whole") + F.when(c("number") + c("before") <= c("pick.m"), 1).otherwise(0)
    return joined.where(~partial).withColumn(copies, certain).unionByName(met.withColumn(copies, taken).select(*joined.columns, copies))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, **shares) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of every row; ``taken`` counts words, repeats included."""
    sized = cut(_sized(docs, id_col, source_col, text_col, seed), "mix-sizes")
    plan = cut(decisions(sized, **shares), "mix-plan")
    done = _with_copies(sized, plan, "id", "source", "size", "u", "place", "d_")
    return done.select(F.col("id").alias(id_col), "size", F.col("d_source_size").alias("source_size"), F.col("d_target").alias("target"), (F.col("size") * F.col("d_")).alias("taken"), F.col("source").alias(source_col))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, **shares) -> DataFrame:
    """The rows of the mix with all columns of ``docs``: each row as often as it is taken."""
    sized = cut(_sized(docs, id_col, source_col, text_col, seed), "mix-sizes")
    plan = cut(decisions(sized, **shares), "mix-plan")
    names, free = docs.columns, free_names(docs, 6)
    ident, source, size, u, place, copies = free
    rows = docs.withColumns({ident: F.col(quoted(id_col)).cast("long"), source: F.col(quoted(source_col)).cast("string"), size: word_count(F.col(quoted(text_col))), place: F.monotonically_increasing_id()})
    rows = rows.withColumn(u, draw(F.col(ident), F.col(size), seed))
    done = _with_copies(rows, plan, ident, source, size, u, place, copies)
    repeated = done.withColumn(place, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int"))))
    return repeated.select(*map(quoted, names))
