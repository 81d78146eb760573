"""Personal data by candidate generation and gradient-boosted trees.

Generators with high recall propose spans that may overlap.  The four base
patterns, where their checks hold, are personal data in any case.  Every
other proposal is judged by boosted trees over its format and context; they
learn, from all proposals of one half, which look like the checked ones (the
checks themselves aren't among the features).  A threshold on the score,
calibrated on all proposals of the other half, selects further redactions.
Proposals that look the same are one row with their number as its weight.

DataFrame and SQL functions and Spark's own trees only.  A text is searched
once; what follows works on its proposals.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import written

KINDS = ("email", "ip", "card", "phone")
LEAST_ROWS = 40               # with fewer of either label nothing is learnt
PRECISION = 0.98              # that a threshold must reach on the calibration half
TREES, TREE_DEPTH = 12, 4
BINS = 32                     # of a feature's values in the trees, at least
CONTEXT = 24                  # characters on each side

# Possessive forms match what the plain ones do, in time linear in the text:
# inside a run of name characters or digits a match can't begin but at the
# run's start or where the last match ended (\G).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# what else might be of a kind
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?"
             r"[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,24}+){1,6}+",
    "ip": r"(?:\G|(?<![0-9.]))[0-9]{1,5}+(?:\.[0-9]{1,5}+){2,6}+",
    "card": r"(?:\G|(?<![0-9]))[0-9]{2,6}+(?:[ ./-]{1,2}+[0-9]{2,6}+){1,5}+",
    "phone": r"(?:\G|(?<![0-9+]))\+?+(?:\([0-9]{1,4}+\)|[0-9]{1,4}+)"
             r"(?:[ ./-]{1,2}+(?:\([0-9]{1,4}+\)|[0-9]{2,5}+)){2,5}+",
}


def _proposals(text: Column) -> Column:
    """array<struct<g, k, gap, m, pre, post>>: generator (the base patterns are
    0-3, the wide ones 4-7), number, characters since the last match, match,
    and the text on both sides."""
    def found(g: int, pattern: str) -> Column:
        # a lambda's body is evaluated for each element, the arrays it runs over
        # once: the text is split and searched once a row
        sides = lambda parts: F.zip_with(
            parts, F.slice(parts, F.lit(2), F.size(parts)),
            lambda a, b: F.struct(F.char_length(a).cast("long").alias("gap"),
                                  F.right(a, F.lit(CONTEXT)).alias("pre"),
                                  F.left(b, F.lit(CONTEXT)).alias("post")))
        parted = F.get(F.transform(F.array(F.split(text, pattern, -1)), sides), F.lit(0))
        pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), parted,
                           lambda m, s: F.struct(m.alias("m"), s.alias("s")))
        # the part behind the last match has no match
        return F.transform(
            F.filter(pairs, lambda x: x["m"].isNotNull()),
            lambda x, k: F.struct(
                F.lit(g).alias("g"), k.cast("int").alias("k"), x["s"]["gap"].alias("gap"),
                x["m"].alias("m"), x["s"]["pre"].alias("pre"), x["s"]["post"].alias("post")))

    at = text.contains("@") | text.contains("(at)") | text.contains("[at]")
    none = F.array().cast("array<struct<g:int,k:int,gap:bigint,m:string,pre:string,post:string>>")
    own = F.array(F.struct(F.lit(-1).alias("g"), F.lit(0).alias("k"),
                           F.lit(0).cast("long").alias("gap"), F.lit("").alias("m"),
                           F.lit("").alias("pre"), F.lit("").alias("post")))
    digits = text.rlike("[0-9]")
    parts = []
    for g, (kind, pattern) in enumerate([*BASE.items(), *WIDE.items()]):
        need = at if kind == "email" else digits
        parts.append(F.when(need, found(g, pattern)).otherwise(none))
    return F.concat(own, *parts)


def _luhn(digits: Column) -> Column:
    d = F.split(F.reverse(digits), "")
    each = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        (x.cast("int") * 2) % 10 + F.floor(x.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def proposals(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, g, kind, start, stop, m, pre, post, base): one row for
    each proposal, and one with g -1 for each document row."""
    rows = (docs.withColumn("uid", F.monotonically_increasing_id())
            .select("uid", "doc_id", F.explode_outer(_proposals(F.col("t"))).alias("p"))
            .select("uid", "doc_id", "p.*"))
    rows = written(docs.sparkSession, rows, "proposals")
    before = (Window.partitionBy("uid", "g").orderBy("k")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stop = F.sum(F.col("gap") + F.char_length("m")).over(before)
    digits = F.regexp_replace("m", "[^0-9]", "")
    n = F.char_length(digits)
    kind = F.pmod("g", F.lit(4))
    octets = F.forall(F.split("m", r"\."), lambda x: (F.char_length(F.ltrim(x, F.lit("0"))) <= 3)
                      & (F.right(F.concat(F.lit("000"), x), F.lit(3)).cast("int") <= 255))
    checks = (F.when(F.col("g") == 0, True).when(F.col("g") == 1, octets)
              .when(F.col("g") == 2, n.between(12, 19) & _luhn(digits))
              .when(F.col("g") == 3, n.between(9, 15)).otherwise(False))
    return (rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.char_length("m"))
            .select("uid", "doc_id", "g", kind.alias("kind"), "start", "stop", "m", "pre", "post",
                    checks.alias("base")))


FEATURES = [f"is_{k}" for k in KINDS] + [
    "length", "n_digits", "n_groups", "longest", "dots", "dashes", "blanks", "brackets", "slashes",
    "plus", "ats", "tail", "word_before", "word_after", "symbol_before", "symbol_after",
    "cue_mail", "cue_phone", "cue_card", "cue_net"]


def features(df: DataFrame) -> DataFrame:
    """The columns of FEATURES: what a proposal and its surroundings look like."""
    m, pre, post = F.col("m"), F.lower("pre"), F.col("post")
    many = lambda pattern: F.regexp_count(m, F.lit(pattern)).cast("double")
    flag = lambda c: c.cast("int").cast("double")
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    values = {
        **{f"is_{k}": flag(F.col("kind") == i) for i, k in enumerate(KINDS)},
        "length": F.char_length(m).cast("double"), "n_digits": many("[0-9]"),
        "n_groups": F.size(groups).cast("double"),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0))
        .cast("double"),
        "dots": many(r"\."), "dashes": many("-"), "blanks": many(" "), "brackets": many(r"[()]"),
        "slashes": many("/"), "plus": flag(m.startswith("+")), "ats": many(r"@|\(at\)|\[at\]"),
        "tail": F.char_length(F.regexp_extract(m, r"([A-Za-z]*)$", 1)).cast("double"),
        "word_before": flag(pre.rlike(r"[\p{L}0-9]$")),
        "word_after": flag(post.rlike(r"^[\p{L}0-9]")),
        "symbol_before": flag(pre.rlike(r"[%#=/\\_.:-]$")),
        "symbol_after": flag(post.rlike(r"^[%#=/\\_:-]")),
        "cue_mail": flag(pre.rlike("mail|contact|write|kontakt|courriel|correo")),
        "cue_phone": flag(pre.rlike("tel|phone|call|fax|mobile|anruf|appel|llam")),
        "cue_card": flag(pre.rlike("card|visa|credit|account|karte|carte|tarjeta|konto")),
        "cue_net": flag(pre.rlike("ip|host|server|addr|from|login")),
    }
    out = df.select("*", *[F.coalesce(values[c], F.lit(0.0)).alias(c) for c in FEATURES])
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(out)


def formats(props: DataFrame) -> DataFrame:
    """(FEATURES, half, label, weight): what proposals look like, and how many do,
    by half (a hash of the proposal) and label.  A label is 1 if the proposal's
    span is a checked base span of its kind, else 0."""
    key = ["uid", "kind", "start", "stop"]
    judged = props.filter("g >= 0")
    good = judged.filter("base").select(*key).distinct().withColumn("hit", F.lit(1.0))
    h = F.xxhash64("doc_id", "g", "start", "m")
    rows = (judged.select(*key, "m", "pre", "post", F.pmod(F.hash(h), F.lit(2)).alias("half"))
            .join(good, key, "left").withColumn("label", F.coalesce("hit", F.lit(0.0))))
    return (features(rows).groupBy(*FEATURES, "half", "label")
            .agg(F.count(F.lit(1)).cast("double").alias("weight")))


def fit(props: DataFrame) -> tuple[GBTClassificationModel, float] | None:
    """(trees, threshold) learnt from every proposal, or None if there is too
    little to learn from."""
    spark = props.sparkSession
    some = written(spark, formats(props), "formats")
    some = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(some).select(
        "features", "half", "label", "weight")
    seen = some.groupBy("half", "label").agg(F.sum("weight").alias("n"),
                                             F.count(F.lit(1)).alias("kinds")).collect()
    if sum(r["n"] for r in seen) < 2 * LEAST_ROWS:
        return None
    first = {r["label"]: r["n"] for r in seen if r["half"] == 0}
    if min(first.get(0.0, 0), first.get(1.0, 0)) < LEAST_ROWS // 2:
        return None
    # Spark takes split candidates from a sample once the rows outnumber the square
    # of the bins
    bins = max(BINS, math.isqrt(sum(r["kinds"] for r in seen if r["half"] == 0)) + 1)
    trees = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight",
                          maxIter=TREES, maxDepth=TREE_DEPTH, maxBins=bins,
                          seed=7).fit(some.filter("half = 0"))
    # precision above each of the scores of the calibration half, in steps of 1/100
    steps = (trees.transform(some.filter("half = 1"))
             .select(F.floor(vector_to_array("probability")[1] * 100).cast("int").alias("s"),
                     "label", "weight")
             .groupBy("s").agg(F.sum(F.col("label") * F.col("weight")).alias("hits"),
                               F.sum("weight").alias("n"))
             .orderBy(F.col("s").desc()).collect())               # 101 rows at most
    hits = total = 0
    threshold = None
    for r in steps:
        hits, total = hits + r["hits"], total + r["n"]
        if total and hits / total >= PRECISION:
            threshold = r["s"] / 100
    return None if threshold is None else (trees, threshold)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans (kind:start:end of base and further spans by start,
    then kind, comma-joined; code points, end exclusive).

    The counts and the digest are of the base spans.  A further span overlaps
    neither a base one nor a better-scored further one.  A null or empty text
    has no spans.  Repeated rows give a row each; other columns are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    props = written(df.sparkSession, proposals(docs), "spans")
    own = props.filter("g < 0 OR base").select(
        "uid", "doc_id", "g", "kind", "start", "stop", "base")
    learnt = fit(props)
    if learnt is not None:
        own = own.unionByName(_further(props, *learnt))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.when(F.col("g") >= 0, F.struct("start", "kind", "stop", F.concat_ws(
        ":", name, "start", "stop").alias("s")))
    joined = lambda a: F.concat_ws(",", F.transform(F.array_sort(a), lambda x: x["s"]))
    return (own.groupBy("uid", "doc_id")
            .agg(*[F.count(F.when(F.col("base") & (F.col("kind") == i), 1)).alias(f"n_{k}")
                   for i, k in enumerate(KINDS)],
                 F.collect_list(F.when(F.col("base"), span)).alias("b"),
                 F.collect_list(span).alias("a"))
            .select("doc_id", *[f"n_{k}" for k in KINDS],
                    F.sha2(joined("b"), 256).alias("base_sha256"), joined("a").alias("spans")))


def _further(props: DataFrame, trees: GBTClassificationModel, threshold: float) -> DataFrame:
    """The proposals beside the base spans that the trees select."""
    judged = props.filter("g >= 0")
    order = Window.partitionBy("uid").orderBy("start", F.col("base").desc(), "stop", "g")
    # the rows that follow, in an order that is the exact reverse: a frame up to
    # the partition's end is computed anew for each row
    back = Window.partitionBy("uid").orderBy(F.col("start").desc(), "base", F.col("stop").desc(),
                                             F.col("g").desc())
    upto, rest = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, back))
    base_stop = F.max(F.when(F.col("base"), F.col("stop"))).over(upto)
    base_next = F.min(F.when(F.col("base"), F.col("start"))).over(rest)
    free = (judged.withColumn("last", base_stop).withColumn("next", base_next)
            .filter("NOT base AND coalesce(last, 0) <= start "
                    "AND (next IS NULL OR next >= stop)"))
    scored = (trees.transform(features(free))
              .withColumn("p", vector_to_array("probability")[1])
              .filter(F.col("p") >= threshold)
              .select("uid", "doc_id", "g", "kind", "start", "stop", "base", "p"))
    # of spans that overlap in a chain the best one stays
    fresh = F.when(F.col("start") >= F.coalesce(F.max("stop").over(upto), F.lit(0)), 1) \
        .otherwise(0)
    chain = scored.withColumn("fresh", fresh).withColumn(
        "island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("uid", "island").orderBy(
        F.col("p").desc(), (F.col("stop") - F.col("start")).desc(), "start", "kind", "g")
    return (chain.withColumn("r", F.row_number().over(best)).filter("r = 1")
            .select("uid", "doc_id", "g", "kind", "start", "stop", "base"))

