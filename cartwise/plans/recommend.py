"""Step 3: recommend products for many customers at once.

Input is a *prediction table*: one row per customer with the predicted
category and the customer's coordinates.  For each customer u:

1. leave out u's own rows (B7: rows with an unknown customer stay);
2. the products of the predicted category among the remaining rows (I4);
3. the ``estimation_n`` best of them by average review score (F3; the
   score table still counts u's rows, S5), ties by product id (S11);
4. ``product_number`` of those drawn without replacement (F4, md5 order);
5. per drawn product, the ``n_nearest`` rows nearest to u by L1 distance
   (F6) give a customer set; price, freight and delivery time are averaged
   over *all* rows of the product bought by that set (D5, D6, S6).

Nothing loops over customers or products.  Two exact rewrites keep the
work bounded at scale:

* Step 2 only removes a product for u when u is its sole buyer (S5).  A
  per-(category, product) aggregate records that sole buyer; each customer
  then needs only the first ``estimation_n + s_u`` ranks of its category,
  where ``s_u`` counts the products u alone bought there.  The ranks are
  generated per customer and equi-joined -- no customer x product pairs.
  A category's ranking goes as deep as its own customers need.
* Step 5 orders rows by distance, then customer (the reference's sort is
  unstable, so any tie order is valid; this one keeps a customer's rows
  together).  The distance depends on the product and the place only, so the
  search runs once for each distinct (product, place) and its result is joined
  to the customers there, who leave out their own rows.  Rows are
  pre-aggregated to *units* (product, customer, location), written once; each
  location contributes at most ``n_nearest + 1`` customers.  A place meets the
  cells of a grid and the locations in a few of them (``operators.nearest``),
  not all locations of its product.
* Rankings deeper than the engine's group limit are cut in salted parts first,
  so a hot group never sorts whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.functions.scalar import days_floor, exact_quotient, exact_sum, seconds_between
from cartwise.operators import nearest
from cartwise.operators.aggregates import avg_score_per_product
from cartwise.operators.ranking import DEFAULT_SEED, sample_key, top_within
from cartwise.session import stored

CUSTOMER = "customer_unique_id"
CATEGORY = "product_category_name"
PRODUCT = "product_id"
LAT, LNG = "customer_geolocation_lat", "customer_geolocation_lng"

# Rows of a ranking that is broadcast, at most (about 100 bytes each).
SHORT_RANKING = 200_000

PRED_COLUMNS = (CUSTOMER, "predicted_category", "pred_lat", "pred_lng")


def not_this_customer(data: DataFrame, customer_value, customer: str = CUSTOMER) -> DataFrame:
    """Every row except the given customer's; rows with a NULL customer
    are kept, and a NULL given customer removes nothing."""
    return data.where(~F.coalesce(F.col(customer) == customer_value, F.lit(False)))


def products_in_category(data: DataFrame, category_value) -> DataFrame:
    """I4: distinct product ids of one category (NULL product kept)."""
    return data.where(F.col(CATEGORY) == category_value).select(PRODUCT).distinct()


def category_product_summary(data: DataFrame) -> DataFrame:
    """Per (category, product): the sole buyer, if exactly one known
    customer and no unknown one bought it (S5)."""
    s = (data.where(F.col(CATEGORY).isNotNull() & F.col(PRODUCT).isNotNull())
         .groupBy(CATEGORY, PRODUCT)
         .agg(F.min(CUSTOMER).alias("_lo"), F.max(CUSTOMER).alias("_hi"),
              F.max(F.col(CUSTOMER).isNull().cast("int")).alias("_has_null")))
    sole = F.when((F.col("_lo") == F.col("_hi")) & (F.col("_has_null") == 0), F.col("_lo"))
    return s.select(CATEGORY, PRODUCT, sole.alias("sole_buyer"))


def ranked_category_products(data: DataFrame, scores: DataFrame,
                             depth: DataFrame | None = None,
                             summary: DataFrame | None = None) -> DataFrame:
    """Per category, products ranked by score (desc, NULL last), then id; with
    ``depth`` (category, ``_depth``) its categories only, each to its depth."""
    summary = summary if summary is not None else category_product_summary(data)
    scored = summary.join(scores, PRODUCT)
    order = [F.col("review_score").desc_nulls_last(), F.col(PRODUCT).asc()]
    if depth is None:
        return scored.withColumn("cat_rank", F.row_number().over(
            Window.partitionBy(CATEGORY).orderBy(*order)))
    return top_within(scored.join(depth, CATEGORY), [CATEGORY], order, F.col("_depth"),
                      salt_on=[PRODUCT], out="cat_rank").drop("_depth")


def sole_counts(preds: DataFrame, data: DataFrame,
                summary: DataFrame | None = None) -> DataFrame:
    """Per prediction row, how many products of its category it alone bought."""
    summary = summary if summary is not None else category_product_summary(data)
    sole = summary.where(F.col("sole_buyer").isNotNull()).select(
        F.col(CATEGORY).alias("predicted_category"), F.col("sole_buyer").alias(CUSTOMER))
    return (preds.join(sole, ["predicted_category", CUSTOMER])
            .groupBy(CUSTOMER, "predicted_category").agg(F.count(F.lit(1)).alias("_s")))


def top_products_for(preds: DataFrame, ranked: DataFrame, estimation_n: int) -> DataFrame:
    """F3 per prediction row: the ``estimation_n`` best products of the
    predicted category after leaving out products u alone bought."""
    sole = ranked.where(F.col("sole_buyer").isNotNull()).select(
        F.col(CATEGORY).alias("predicted_category"), F.col("sole_buyer").alias(CUSTOMER))
    s_u = (preds.join(sole, ["predicted_category", CUSTOMER])
           .groupBy(CUSTOMER, "predicted_category").agg(F.count(F.lit(1)).alias("_s")))
    # dealt by customer before the ranks are generated, so that these are not shuffled
    # (in a number of parts that isn't lowered to what the few rows before them need)
    parts = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = preds.join(s_u, [CUSTOMER, "predicted_category"], "left").repartition(parts, CUSTOMER)
    p = dealt.withColumn(
        "cat_rank", F.explode(F.sequence(F.lit(1), F.lit(estimation_n)
                                         + F.coalesce(F.col("_s"), F.lit(0)).cast("int"))))
    r = ranked.withColumnRenamed(CATEGORY, "predicted_category")
    # the planner takes the generated ranks for as few as the rows before them and would
    # broadcast those: the ranking is, if it is short, else neither side
    short = ranked.limit(SHORT_RANKING + 1).count() <= SHORT_RANKING
    r = F.broadcast(r) if short else r.hint("merge")
    cand = (p.join(r, ["predicted_category", "cat_rank"])
            .where(~F.coalesce(F.col("sole_buyer") == F.col(CUSTOMER), F.lit(False))))
    w = Window.partitionBy(CUSTOMER, "predicted_category").orderBy("cat_rank")
    return (cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= estimation_n)
            .drop("_r", "_s", "sole_buyer"))


def draw_products(top: DataFrame, product_number: int, seed=DEFAULT_SEED) -> DataFrame:
    """``product_number`` products per customer without replacement."""
    w = Window.partitionBy(CUSTOMER).orderBy(
        sample_key(seed, F.col(CUSTOMER), F.col(PRODUCT)), F.col(PRODUCT))
    n_avail = F.count(F.lit(1)).over(Window.partitionBy(CUSTOMER))
    return (top.withColumn("n_available", n_avail)
            .withColumn("draw_rank", F.row_number().over(w))
            .where(F.col("draw_rank") <= product_number))


def purchase_units(data: DataFrame, products: DataFrame) -> DataFrame:
    """One aggregate over the rows of the given products: per unit
    (product, customer, location) the row count and the sums the estimates
    need.  NULL customer and NULL location are groups too."""
    rows = data.join(products.select(PRODUCT).distinct(), PRODUCT, "left_semi")
    secs = seconds_between(F.col("order_purchase_timestamp"),
                           F.col("order_delivered_customer_date"))
    return rows.groupBy(PRODUCT, CUSTOMER, LAT, LNG).agg(
        F.count(F.lit(1)).alias("_rows"),
        exact_sum(F.col("price")).alias("_sp"), F.count("price").alias("_cp"),
        exact_sum(F.col("freight_value")).alias("_sf"), F.count("freight_value").alias("_cf"),
        F.sum(secs).alias("_ss"), F.count(secs).alias("_cs"))


def places_near(pairs: DataFrame, units: DataFrame, n_nearest: int) -> DataFrame:
    """For each distinct (product, ``_place``) of ``pairs``: the units nearest
    to it (``_c``, location, ``_rows``, ``_d``), in order of distance, then
    customer, ``_extra`` more than ``n_nearest`` of them, the most that one of
    the customers there owns itself."""
    key, cls = [CUSTOMER, PRODUCT], [PRODUCT, "_place"]
    # at least as many as the pairs of places and locations
    most_pairs = (pairs.groupBy(PRODUCT).agg(F.count(F.lit(1)).alias("_p"))
                  .join(units.groupBy(PRODUCT).agg(F.count(F.lit(1)).alias("_u")), PRODUCT)
                  .agg(F.sum(F.col("_p").cast("double") * F.col("_u"))).first()[0] or 0)
    own = (pairs.join(units.select(*key), key).groupBy(*key)
           .agg(F.count(F.lit(1)).alias("_own")))
    places = (pairs.join(own, key, "left").groupBy(*cls)
              .agg(F.coalesce(F.max("_own"), F.lit(0)).alias("_extra")))
    # a location never contributes more than n_nearest + 1 units (u at most once)
    units = top_within(units, [PRODUCT, LAT, LNG], [F.col(CUSTOMER).asc_nulls_last()],
                       n_nearest + 1, salt_on=[CUSTOMER], out="_crn").drop("_crn")
    locs = units.groupBy(PRODUCT, LAT, LNG).agg(F.count(F.lit(1)).alias("_units"))

    # locations that can hold one of the first n_nearest + _extra units
    pl = nearest.reachable(places, locs, PRODUCT, LAT, LNG, n_nearest + F.col("_extra"),
                           most_pairs)
    by_d = Window.partitionBy(*cls).orderBy(F.col("_d").asc_nulls_last()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    same_d = Window.partitionBy(*cls, "_d")
    pl = (pl.withColumn("_before", F.sum("_units").over(by_d) - F.sum("_units").over(same_d))
          .where(F.col("_before") < n_nearest + F.col("_extra"))
          .select(*cls, "_extra", "_d", F.struct(LAT, LNG).alias("_at")))
    near = pl.join(units.select(PRODUCT, F.col(CUSTOMER).alias("_c"), "_rows",
                                F.struct(LAT, LNG).alias("_at")), [PRODUCT, "_at"])
    return top_within(near, cls, _unit_order(), n_nearest + F.col("_extra"),
                      salt_on=["_c", "_at"], out="_rk").drop("_rk", "_extra")


def _unit_order():
    """Units by distance, then customer, then location, NULLs last."""
    return [F.asc_nulls_last(c) for c in ("_d", "_c", "_at." + LAT, "_at." + LNG)]


def nearest_customers(pairs: DataFrame, data: DataFrame, n_nearest: int,
                      units: DataFrame | None = None) -> DataFrame:
    """per (customer u, product p) pair, the customers (``_c``; NULL is
    one of them) owning the ``n_nearest`` rows of p nearest to u, u's own
    rows left out.  ``pairs`` holds u, p, pred_lat, pred_lng."""
    units = units if units is not None else stored(purchase_units(data, pairs), "units")
    units = units.select(PRODUCT, CUSTOMER, LAT, LNG, "_rows")
    key = [CUSTOMER, PRODUCT]
    # as a struct, so that a missing coordinate equals itself in joins; with one
    # of them missing every distance is
    known = F.col("pred_lat").isNotNull() & F.col("pred_lng").isNotNull()
    place = F.struct(F.when(known, F.col("pred_lat")).alias("lat"),
                     F.when(known, F.col("pred_lng")).alias("lng"))
    pairs = pairs.select(*key, place.alias("_place"))
    cand = pairs.join(places_near(pairs, units, n_nearest), [PRODUCT, "_place"]).where(
        ~F.coalesce(F.col("_c") == F.col(CUSTOMER), F.lit(False)))
    # n_nearest + _extra rows a pair at most
    wo = Window.partitionBy(*key).orderBy(*_unit_order())
    cand = cand.withColumn("_rk", F.row_number().over(wo)).where(F.col("_rk") <= n_nearest)
    wcum = wo.rowsBetween(Window.unboundedPreceding, -1)
    cand = cand.withColumn("_rows_before", F.coalesce(F.sum("_rows").over(wcum), F.lit(0)))
    return cand.where(F.col("_rows_before") < n_nearest).select(*key, "_c").distinct()


def estimates_for(chosen: DataFrame, data: DataFrame,
                  units: DataFrame | None = None) -> DataFrame:
    """D5 + D6 per (u, p): means over all rows of p bought by the chosen
    customers (NULL customer matches NULL, as ``isin`` does)."""
    key = [CUSTOMER, PRODUCT]
    units = units if units is not None else purchase_units(data, chosen)
    # per (product, customer) totals
    t = units.groupBy(PRODUCT, CUSTOMER).agg(
        *[F.sum(c).alias(c) for c in ("_sp", "_cp", "_sf", "_cf", "_ss", "_cs")])
    t = t.withColumnRenamed(CUSTOMER, "_tc").withColumnRenamed(PRODUCT, "_p")
    est = (chosen.join(t, (F.col(PRODUCT) == F.col("_p")) & F.col("_c").eqNullSafe(F.col("_tc")))
           .groupBy(*key).agg(
               exact_quotient(F.sum("_sp"), F.sum("_cp")).alias("estimated_price"),
               exact_quotient(F.sum("_sf"), F.sum("_cf")).alias("shipping_price"),
               days_floor(F.try_divide(F.sum("_ss"), F.sum("_cs"))).cast("bigint")
               .alias("estimated_delivery_time")))
    return est


def drawn_products(data: DataFrame, preds: DataFrame, product_number: int,
                   estimation_n: int, scores: DataFrame | None = None,
                   seed=DEFAULT_SEED) -> DataFrame:
    """Steps 1-4 for every prediction row: the drawn (customer, product)
    pairs with the product's score, ``n_available`` and ``draw_rank``."""
    scores = scores if scores is not None else avg_score_per_product(data)
    # the prediction rows and the drawn pairs are small (customers x
    # product_number) and referenced by several later joins: keep them once
    # instead of re-planning their lineage at every use
    preds = preds.select(*PRED_COLUMNS).persist()
    # ranks of a category beyond estimation_n + (most products that one of its
    # customers alone bought there) are never read
    summary = category_product_summary(data).persist()  # one row per product
    alone = sole_counts(preds, data, summary)
    depth = (preds.select(CUSTOMER, "predicted_category")
             .join(alone, [CUSTOMER, "predicted_category"], "left")
             .groupBy(F.col("predicted_category").alias(CATEGORY))
             .agg((F.coalesce(F.max("_s"), F.lit(0)) + estimation_n).alias("_depth")))
    ranked = stored(ranked_category_products(data, scores, depth, summary), "ranked")
    top = top_products_for(preds, ranked, estimation_n)
    # the small result is written, and its inputs are released
    drawn = stored(draw_products(top, product_number, seed), "drawn")
    preds.unpersist()
    summary.unpersist()
    return drawn


def expected_values(pairs: DataFrame, data: DataFrame, n_nearest: int) -> DataFrame:
    """Nearest customers (F6), then their estimates (D5, D6), both from
    one aggregate of the drawn products' rows."""
    units = stored(purchase_units(data, pairs), "units")
    return estimates_for(nearest_customers(pairs, data, n_nearest, units), data, units)


def recommend(data: DataFrame, preds: DataFrame, product_number: int = 3,
              estimation_n: int = 5, n_nearest: int | None = None,
              scores: DataFrame | None = None, seed=DEFAULT_SEED,
              keep_rank: bool = False) -> DataFrame:
    """Recommendations for every prediction row.

    ``preds`` columns: customer_unique_id, predicted_category, pred_lat,
    pred_lng.  ``estimation_n`` bounds the short list and, unless
    ``n_nearest`` is given, the number of nearest rows (S8).
    """
    n_nearest = estimation_n if n_nearest is None else n_nearest
    drawn = drawn_products(data, preds, product_number, estimation_n, scores, seed)
    pairs = drawn.select(CUSTOMER, PRODUCT, "pred_lat", "pred_lng")
    est = expected_values(pairs, data, n_nearest)
    return (drawn.join(est, [CUSTOMER, PRODUCT], "left")
            .select(CUSTOMER, "predicted_category", PRODUCT, "review_score",
                    "estimated_price", "shipping_price", "estimated_delivery_time",
                    "n_available", *(["draw_rank"] if keep_rank else [])))


# --- I10: report lines -------------------------------------------------------
# The labels and widths of the printed report.
LEFT, RIGHT, BANNER = 35, 15, 50
HEADER_LABELS = ("Predictions for customer:", "Last purchase product category:",
                 "Predicted next product category:")
BANNER_TITLE = "  Recommended products  "
DETAILS_TITLE = "Complete data for order:"
PRODUCT_LABELS = ("Product:", "Price + estimated shipping cost:",
                  "Estimated delivery time:", "Avg. review score:")


def report_lines(recs: DataFrame, customers: DataFrame, verbose: bool = False) -> DataFrame:
    """I10 as rows (customer, line_no, line): three header lines, a blank
    line and a banner, four lines per recommended product in draw order, a
    closing banner and two blank lines.  ``recs`` comes from
    ``recommend(..., keep_rank=True)``; ``customers`` holds the customer,
    ``previous_category`` and ``predicted_category``.  ``verbose`` adds, before
    the first banner, a line for each field of the struct column ``details``."""
    from cartwise.functions.scalar import centered, fixed_width, id_prefix, two_decimals

    def txt(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("nan"))

    details = []
    if verbose:
        names = customers.schema["details"].dataType.names
        details = [F.lit(""), F.lit(DETAILS_TITLE), *[fixed_width(
            F.lit(n), txt(f"details.`{n}`"), LEFT, RIGHT) for n in names]]
    first = len(HEADER_LABELS) + len(details) + 2          # lines above the products
    # read three times: written, so that neither plans nor broadcasts are repeated
    recs = stored(recs, "recommendations")
    n_products = recs.groupBy(CUSTOMER).agg(F.count(F.lit(1)).alias("_np"))
    head = customers.join(n_products, CUSTOMER, "left").select(
        CUSTOMER, F.coalesce(F.col("_np"), F.lit(0)).alias("_np"),
        F.array(
            fixed_width(F.lit(HEADER_LABELS[0]), id_prefix(F.col(CUSTOMER)), LEFT, RIGHT),
            fixed_width(F.lit(HEADER_LABELS[1]), txt("previous_category"), LEFT, RIGHT),
            fixed_width(F.lit(HEADER_LABELS[2]), txt("predicted_category"), LEFT, RIGHT),
            *details, F.lit(""), centered(F.lit(BANNER_TITLE), BANNER, "#")).alias("_lines"))
    top = head.select(CUSTOMER, F.posexplode("_lines").alias("line_no", "line"))
    foot = head.select(CUSTOMER, F.posexplode(F.array(
        centered(F.lit(""), BANNER, "#"), F.lit(""), F.lit(""))).alias("_k", "line"),
        "_np").select(CUSTOMER, (F.lit(first) + 4 * F.col("_np") + F.col("_k")).alias("line_no"),
                      "line")
    price = F.concat(two_decimals(F.col("estimated_price")), F.lit(" + "),
                     two_decimals(F.col("shipping_price")), F.lit("R$"))
    days = F.concat(txt("estimated_delivery_time"), F.lit(" days"))
    prod = recs.select(CUSTOMER, "draw_rank", F.posexplode(F.array(
        fixed_width(F.lit(PRODUCT_LABELS[0]), id_prefix(F.col(PRODUCT)), LEFT, RIGHT),
        fixed_width(F.lit(PRODUCT_LABELS[1]), price, LEFT, RIGHT),
        fixed_width(F.lit(PRODUCT_LABELS[2]), days, LEFT, RIGHT),
        fixed_width(F.lit(PRODUCT_LABELS[3]), two_decimals(F.col("review_score")),
                    LEFT, RIGHT))).alias("_k", "line")).select(
        CUSTOMER, (F.lit(first) + 4 * (F.col("draw_rank") - 1) + F.col("_k")).alias("line_no"),
        "line")
    return (top.unionByName(prod).unionByName(foot)
            .select(CUSTOMER, F.col("line_no").cast("int"), "line"))
