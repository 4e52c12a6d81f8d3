"""Mixing sources to target weights by pivotal dependent rounding (native).

Each document of a source is wanted ``target / source size`` times. The whole part is taken as it is; the fraction is
rounded by the pivotal method: two documents meet, words move from one to the other until one of them is whole, and the
other meets the next one. Words (size x fraction) are conserved in each meeting, so a source's sum stays at its target.
Documents meet inside small chunks; the one fractional document left in each chunk goes to the next level of a reduction
tree, until one is left per source. It is rounded to the nearest, and the words that this adds or takes away are worked
off on documents of its last chunk and then on those of POOL chunks, so that the source misses its target by less than a
short document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.common import ids_unique, write_table

CHUNK = 64
#: First chunks of a source whose documents may be turned over for the words owed in the end.
POOL = 4
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets from (src_null, src, source_size, n): weights repeat over the sources in code point order, null last.
    No target is above ``most`` times its source's size; what is cut off is shared again by weight. One row per source."""
    order = Window.orderBy("src_null", "src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("level", F.col("cap") / F.col("w"))
    by = Window.orderBy("level", "src_null", "src")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    rest = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    t = t.withColumn("rate", rest / F.sum("w").over(after))
    # sources sorted by level are capped up to the first whose share fits; from there on one rate holds
    t = t.withColumn("fits", F.min(F.when(F.col("rate") <= F.col("level"), F.struct("level", "src_null", "src", "rate"))).over(Window.partitionBy()))
    t = t.withColumn("target", F.when(F.col("fits").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fits.rate") * F.col("w"))))
    return t.select("src_null", "src", "source_size", "n", "target")


def _chance(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _pivot(chunks: DataFrame, level: int) -> DataFrame:
    """One level: fold each chunk's fractional documents; rows (src_null, src, chunk, doc_id, size, base, left, up), up null for what is left."""
    doc = "struct<doc_id:{0},size:bigint,base:int,left:double,up:int>".format(dict(chunks.dtypes)["doc_id"])
    as_doc = lambda d, left, up: F.struct(d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["base"].alias("base"), left.alias("left"), up.cast("int").alias("up")).cast(doc)
    none = F.lit(None)

    def step(acc: Column, b: Column) -> Column:
        a = acc["held"]
        a_room, b_room = a["size"] - a["left"], b["size"] - b["left"]
        to_a, to_b = F.least(a_room, b["left"]), F.least(a["left"], b_room)
        a_gains = _chance(F.lit(level), a["doc_id"], b["doc_id"], a["left"]) < to_b / (to_a + to_b)
        both = a["left"] + b["left"]
        # words move to a: a is full, or else b is empty; and the other way round
        done = (
            F.when(a_gains & (a_room <= b["left"]), as_doc(a, a["size"].cast("double"), F.lit(1)))
            .when(a_gains, as_doc(b, F.lit(0.0), F.lit(0)))
            .when(b_room <= a["left"], as_doc(b, b["size"].cast("double"), F.lit(1)))
            .otherwise(as_doc(a, F.lit(0.0), F.lit(0)))
        )
        held = (
            F.when(a_gains & (a_room <= b["left"]), as_doc(b, both - a["size"], none))
            .when(a_gains, as_doc(a, both, none))
            .when(b_room <= a["left"], as_doc(a, both - b["size"], none))
            .otherwise(as_doc(b, both, none))
        )
        first = a.isNull()
        return F.struct(F.when(first, as_doc(b, b["left"], none)).otherwise(held).alias("held"), F.when(first, acc["outs"]).otherwise(F.concat(acc["outs"], F.array(done))).alias("outs"))

    start = F.struct(F.lit(None).cast(doc).alias("held"), F.lit(F.array()).cast(f"array<{doc}>").alias("outs"))
    packed = chunks.groupBy("src_null", "src", "chunk").agg(F.array_sort(F.collect_list(F.struct(F.negative("size").alias("order"), F.xxhash64(F.lit(level), "doc_id", "left").alias("h"), "doc_id", "size", "base", "left"))).alias("docs"))
    folded = packed.select("src_null", "src", "chunk", F.aggregate("docs", start, step, lambda acc: F.concat(acc["outs"], F.array(acc["held"]))).alias("docs"))
    out = folded.select("src_null", "src", "chunk", F.inline("docs"))
    # a held document may have come out whole, within rounding of doubles
    whole = F.when(F.col("left") <= 1e-6, 0).when(F.col("left") >= F.col("size") - 1e-6, 1)
    return out.withColumn("up", F.coalesce("up", whole).cast("int"))


def _work_off(chunk: DataFrame) -> DataFrame:
    """Rounds the one document left in each source's last chunk, and turns over others of the chunk for the words that
    this adds or takes away."""
    up = F.coalesce(F.col("up"), (F.col("left") * 2 >= F.col("size")).cast("int"))
    owed = F.when(F.col("up").isNull(), F.col("left") - up * F.col("size"))
    return _turn_over(chunk.select("src_null", "src", "doc_id", "size", "base", "left", up.alias("up"), owed.alias("owed"), F.col("up").isNull().alias("last")))


def _turn_over(rows: DataFrame) -> DataFrame:
    """Turns documents of each source over (taken or not), long ones first, while their size fits into the words still
    ``owed`` to it; rows (src_null, src, doc_id, size, base, up). ``last`` ones stay. A few chunks' documents a source."""
    doc = "struct<doc_id:{0},size:bigint,base:int,up:int>".format(dict(rows.dtypes)["doc_id"])
    one = F.struct(F.negative("size").alias("order"), F.xxhash64("doc_id", "left").alias("h"), "doc_id", "size", "base", "up", "last")
    packed = rows.groupBy("src_null", "src").agg(F.array_sort(F.collect_list(one)).alias("docs"), F.max("owed").alias("owed"))

    def step(acc: Column, d: Column) -> Column:
        gain = F.when(d["up"] == 0, d["size"]).otherwise(-d["size"])
        turn = ~d["last"] & (d["size"] > 0) & (F.signum(gain) == F.signum(acc["owed"])) & (d["size"] <= F.abs(acc["owed"]))
        new = F.struct(d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["base"].alias("base"), F.when(turn, 1 - d["up"]).otherwise(d["up"]).cast("int").alias("up")).cast(doc)
        return F.struct((acc["owed"] - F.when(turn, gain).otherwise(0)).cast("double").alias("owed"), F.concat(acc["outs"], F.array(new)).alias("outs"))

    start = F.struct(F.col("owed").cast("double").alias("owed"), F.array().cast(f"array<{doc}>").alias("outs"))
    return packed.select("src_null", "src", F.inline(F.aggregate("docs", start, step, lambda acc: acc["outs"])))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, src_null, src, size, source_size, target, copies, taken (= copies x size).

    Null texts have size 0 and are never taken; a null source is a source of its own, the last. Where ids are repeated or
    null, rows that agree in id, source and size are numbered; they may swap results, which no one can see. The draws
    hang on these values alone, so that reruns agree under any partitioning. An empty table gives no rows. Extra columns
    are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("src_null"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), size.alias("size"))
    if ids_unique(docs.select(id_col), id_col):
        rows = rows.withColumn("salt", F.lit(0).cast("long"))
    else:
        rows = rows.groupBy(*rows.columns).count().select(*rows.columns, F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("salt"))
    rows = write_table(rows, "mix-rows")
    sizes = rows.groupBy("src_null", "src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goals = write_table(source_targets(sizes, weights=weights, share=share, most=most), "mix-goals")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    wanted = rows.join(goals.select("src_null", "src", "n", near.alias("rate")), ["src_null", "src"])
    wanted = wanted.withColumn("base", F.floor("rate").cast("int")).withColumn("left", (F.col("rate") - F.col("base")) * F.col("size"))
    begin = wanted.select("src_null", "src", "doc_id", "size", "base", "left", "n", "salt", F.when(F.col("left") <= 0, F.lit(0)).cast("int").alias("up"))
    tables, level = [begin.where("up is not null").select("src_null", "src", "doc_id", "size", "base", "up")], 0
    left = begin.where("up is null").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "salt"), F.ceil(F.col("n") / chunk)))
    names = ["src_null", "src", "doc_id", "size", "base", "up"]
    while True:
        done = write_table(_pivot(left, level), f"mix-level{level}")
        rest = done.where("up is null")
        counts = write_table(rest.groupBy("src_null", "src").agg(F.count(F.lit(1)).alias("n"), F.first("chunk").alias("chunk")), "mix-left")
        ended = counts.where("n = 1").select("src_null", "src", "chunk")  # sources with one document left, and its chunk
        drawn = done.where("up is not null").join(ended, ["src_null", "src", "chunk"], "left_anti")
        if level == 0:  # a few chunks of each source wait for what is owed in the end
            pool, drawn = drawn.where(F.col("chunk") < POOL).select(*names, "left"), drawn.where(F.col("chunk") >= POOL)
        tables += [drawn.select(names), _work_off(done.join(ended, ["src_null", "src", "chunk"])).select(names)]
        more = counts.where("n > 1").drop("chunk")
        if more.isEmpty():
            break
        level += 1
        left = rest.drop("chunk").join(more, ["src_null", "src"]).withColumn("chunk", F.pmod(F.xxhash64(F.lit(level), "doc_id", "left"), F.ceil(F.col("n") / chunk)))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    taken = out.unionByName(pool.select(names)).groupBy("src_null", "src").agg(F.sum((F.col("base") + F.col("up")) * F.col("size")).alias("words"))
    owed = taken.join(goals, ["src_null", "src"]).select("src_null", "src", (F.col("target") - F.col("words")).alias("owed"))
    owed = write_table(owed, "mix-owed")
    out = out.unionByName(_turn_over(pool.join(owed, ["src_null", "src"]).withColumn("last", F.lit(False))).select(names))
    out = out.withColumn("copies", F.col("base") + F.col("up")).join(goals.select("src_null", "src", "source_size", "target"), ["src_null", "src"])
    return out.select("doc_id", "src_null", "src", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: ``docs`` with every document as often as it was taken, none or up to ``most`` times. Where ids are
    repeated or null, rows go by their content, and equal rows by a number."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_rid"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    if not ids_unique(docs.select(id_col), id_col):
        alike = rows.groupBy(F.sha2(F.to_json("row"), 256).alias("content")).agg(*[F.first(c).alias(c) for c in ("row", "text", "source")], F.count(F.lit(1)).alias("n"))
        numbered = alike.select("row", "text", "source", "content", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
        rows = write_table(numbered.select("row", F.concat("content", F.lit("-"), F.col("k").cast("string")).alias("_rid"), "text", "source"), "mix-keyed")
    taken = mix_sources(rows.select("_rid", "text", "source"), id_col="_rid", **how).where("copies > 0").select(F.col("doc_id").alias("_rid"), "copies")
    both = rows.select("_rid", "row").join(taken, "_rid").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_pivotal_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.when(~F.col("src_null"), F.col("src")).alias("source"), "copies")
