"""Equi joins of the retail engine.

Semantics follow the pandas ``merge`` the engine replaces: joining ``on``
a key gives one merged key column; rows multiply on duplicate keys.  Two
NULL rules are offered:

* ``null_safe=False`` (default): SQL semantics, a NULL key never matches.
* ``null_safe=True``: NULL matches NULL, as pandas does with NaN keys.

Both give the same rows whenever one side has no NULL key, which holds
for every dimension table the engine joins.

Scale notes.  A full outer join cannot be broadcast or split by the engine, and
its output has no known partitioning, so a chain of them re-shuffles the growing
wide row at every step.  When one side is a dimension, ``full_outer_with_dimension``
writes ``big FULL JOIN dim`` as ``big LEFT JOIN dim`` plus the rows of ``dim``
that nothing matched, and the planner and AQE choose how.  A general
``full_outer`` finds keys with very many rows by a sketch and splits them itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _as_list(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


# A key is hot beyond this many rows of one side; it is cut in parts of about as
# many, MAX_PARTS at most.
HOT_ROWS = 1_000_000
MAX_PARTS = 1000
# Keys the sketch of a side tracks: none with more than about 1 / 7500 of the
# side's rows escapes it.
TRACKED = 10_000


def full_outer(left: DataFrame, right: DataFrame, on: str | Sequence[str],
               null_safe: bool = False, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Full outer join on named keys with one merged column per key.

    Under SQL semantics a row with a NULL key never matches.  Such rows would
    all hash to one reducer, which AQE cannot split in a full outer join; a
    salt joins the keys, 0 for whole keys and a row hash of a different sign
    on each side else, so they spread and still match nothing.  With
    ``null_safe`` NULL meets NULL as a key like any other.

    A key with ``hot_rows`` rows or more on a side is cut: its rows are dealt to
    parts there and copied to all parts of the other side, so each pair meets in
    one part.  Whether such a key has a partner is known from its counts, once
    for the key, so a copy that met nothing in its part is left out.  The sketch
    that finds such keys (and their exact counts, where there are any) reads the
    keys of both sides before the plan is built; ``hot_rows=None`` leaves that
    out.  Rows of a hot key that are equal in every column share a part."""
    keys = _as_list(on)
    hot = _hot_keys(left, right, keys, null_safe, hot_rows) if hot_rows else None
    l, r = (_with_parts(df, hot, keys, null_safe, hot_rows, side)
            for df, side in ((left, "l"), (right, "r")))
    rest_l, rest_r = ([c for c in df.columns if c not in keys] for df in (left, right))
    parts = ["__pl", "__pr"] if hot is not None else []
    if not null_safe:
        l, r = _null_salt(l, keys, 1, left.columns), _null_salt(r, keys, -1, right.columns)
        out = l.join(r, [*keys, *parts, "__salt"], "full")
        merged = [F.col(k) for k in keys]
    else:
        l, r = l.alias("_l"), r.alias("_r")
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}"))
        for p in parts:
            cond = cond & (F.col(f"_l.{p}") == F.col(f"_r.{p}"))
        out = l.join(r, cond, "full")
        merged = [F.coalesce(F.col(f"_l.{k}"), F.col(f"_r.{k}")).alias(k) for k in keys]
    if hot is not None:
        # of a key that both sides have, every row has a partner in some part
        met = F.col("__in_l").isNotNull() & F.col("__in_r").isNotNull()
        out = out.where(met | ~F.coalesce(F.col("__both_l"), F.col("__both_r"), F.lit(False)))
    side = ("_l.", "_r.") if null_safe else ("", "")
    return out.select(*merged, *[F.col(side[0] + c) for c in rest_l],
                      *[F.col(side[1] + c) for c in rest_r])


def _key_code(keys: list[str]):
    """A hash that tells a missing part of a key from any value."""
    return F.xxhash64(*[x for k in keys for x in (F.col(k), F.col(k).isNull())])


def _whole(keys: list[str]):
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return ok


def _hot_keys(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool,
              hot_rows: int) -> DataFrame | None:
    """Keys with ``hot_rows`` rows or more on a side, and in how many parts each
    side cuts them; None if there are none.  2 * TRACKED keys at most."""
    from cartwise.session import stored

    codes: set[int] = set()
    for df in (left, right):
        d = (df if null_safe else df.where(_whole(keys))).select(_key_code(keys).alias("__code"))
        top = d.agg(F.expr(f"approx_top_k(__code, {TRACKED}, {TRACKED})")).first()[0]
        codes |= {x["item"] for x in top or [] if x["count"] >= hot_rows}
    if not codes:
        return None
    count = lambda df, c: (df.where(_key_code(keys).isin(list(codes)))
                           .groupBy(*keys).agg(F.count(F.lit(1)).alias(c)))
    both = full_outer(count(left, "__nl"), count(right, "__nr"), keys, null_safe, hot_rows=None)
    both = both.where(F.greatest("__nl", "__nr") >= hot_rows)
    parts = lambda c: F.least(F.ceil(F.coalesce(F.col(c), F.lit(0)) / hot_rows),
                              F.lit(MAX_PARTS)).cast("int")
    return stored(both.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                              F.greatest(parts("__nl"), F.lit(1)).alias("__cl"),
                              F.greatest(parts("__nr"), F.lit(1)).alias("__cr"),
                              (F.col("__nl").isNotNull() & F.col("__nr").isNotNull())
                              .alias("__both")), "hot-keys")


def _with_parts(df: DataFrame, hot: DataFrame | None, keys: list[str], null_safe: bool,
                hot_rows: int | None, side: str) -> DataFrame:
    """Rows with the part of their own side (``__pl`` or ``__pr``) and, once for
    each, the parts of the other."""
    if hot is None:
        return df
    same = F.lit(True)
    for i, k in enumerate(keys):
        one = df[k].eqNullSafe(hot[f"__k{i}"]) if null_safe else df[k] == hot[f"__k{i}"]
        same = same & one
    other = "r" if side == "l" else "l"
    own = F.pmod(F.xxhash64(*[df[c] for c in df.columns]), F.col(f"__c{side}")).cast("int")
    copies = F.when(F.col("__both"), F.sequence(F.lit(0), F.col(f"__c{other}") - 1)) \
        .otherwise(F.array(F.lit(0)))
    return (df.join(F.broadcast(hot), same, "left")
            .select(*[df[c] for c in df.columns], F.coalesce(own, F.lit(0)).alias(f"__p{side}"),
                    F.col("__both").alias(f"__both_{side}"), F.lit(True).alias(f"__in_{side}"),
                    F.explode(copies).alias(f"__p{other}")))


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def shared_columns_set(seen: set[str], columns: Sequence[str]) -> set[str]:
    return {c for c in columns if c in seen}


def natural_full_outer(left: DataFrame, right: DataFrame, null_safe: bool = False,
                       hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Full outer join on every column name both sides share."""
    keys = shared_columns(left, right)
    if not keys:
        raise ValueError("natural join: the two tables share no column")
    return full_outer(left, right, keys, null_safe, hot_rows)


def pad_to(df: DataFrame, columns: Sequence[str], types: dict[str, str]) -> DataFrame:
    """Select ``columns`` in order, filling absent ones with typed NULLs."""
    have = set(df.columns)
    return df.select(*[
        F.col(c) if c in have else F.lit(None).cast(types[c]).alias(c) for c in columns
    ])


def _null_salt(df: DataFrame, keys: list[str], sign: int,
               columns: list[str] | None = None) -> DataFrame:
    # 2**62 values of the side's own sign
    spread = (F.shiftrightunsigned(F.xxhash64(*(columns or df.columns)), 2) + 1) * sign
    # always 0, but no literal: of a side whose keys can't be NULL the optimizer would
    # make a constant, and the salt would fall out of the other side's partitioning
    zero = F.pmod(F.xxhash64(*keys), F.lit(1))
    return df.withColumn("__salt", F.when(_whole(keys), zero).otherwise(spread).cast("long"))


def full_outer_with_dimension(big: DataFrame, dim: DataFrame, key: str,
                              keys_seen: DataFrame | None = None) -> DataFrame:
    """``big FULL JOIN dim USING (key)`` as a left join plus the rows of
    ``dim`` that no row of ``big`` matches.

    The planner broadcasts ``dim`` where its size allows, and else AQE can
    split a hot key of ``big``, as it cannot in a full outer join.
    ``keys_seen`` is a one-column frame holding every non-NULL ``key`` value of
    ``big``; pass a narrower source of the same keys when one exists (for
    example the fact table the key came from), which saves a pass over the
    wide ``big``.  SQL NULL semantics.
    """
    matched = big.join(dim, key, "left")
    seen = keys_seen if keys_seen is not None else big.select(key)
    seen = seen.where(F.col(key).isNotNull()).distinct()
    orphans = dim.join(seen, key, "left_anti")
    types = dict(big.dtypes) | dict(dim.dtypes)
    return matched.unionByName(pad_to(orphans, matched.columns, types))


def left_join_prefixed(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
                       rename: dict[str, str]) -> DataFrame:
    """Left join with differently named keys, renaming the
    right-side value columns and dropping the right key (S16)."""
    r = right.select(F.col(right_on).alias("__rk"),
                     *[F.col(src).alias(dst) for src, dst in rename.items()])
    return left.join(r, left[left_on] == r["__rk"], "left").drop("__rk")


def join_coordinates(data: DataFrame, zip_table: DataFrame, left_on: str, role: str,
                     value_columns: Sequence[str] = ("geolocation_lat", "geolocation_lng"),
                     zip_column: str = "geolocation_zip_code_prefix",
                     cluster_column: str | None = None) -> DataFrame:
    """Add ``<role>_geolocation_lat/lng`` (and optionally the
    ``<role>_location_cluster``) for a zip column, in one left join.  Whether
    the zip table is broadcast is the planner's choice.
    """
    rename = {c: f"{role}_{c}" for c in value_columns}
    if cluster_column is not None:
        rename[cluster_column] = f"{role}_location_cluster"
    return left_join_prefixed(data, zip_table, left_on, zip_column, rename)


def translate_categories(data: DataFrame, translation: DataFrame,
                         category: str = "product_category_name",
                         english: str = "product_category_name_english",
                         how: str = "full",
                         categories_seen: DataFrame | None = None) -> DataFrame:
    """C8 (``how='full'``) / C9 (``how='left'``): replace the category by its
    translation.  A category without translation becomes NULL; with
    ``how='full'`` a translation no row uses adds a row that is NULL
    elsewhere (S14)."""
    if how == "left":
        out = data.join(translation, category, "left")
    elif how == "full":
        out = full_outer_with_dimension(data, translation, category, categories_seen)
    else:
        raise ValueError(how)
    cols = [c for c in out.columns if c not in (category, english)]
    return out.select(*cols, F.col(english).alias(category))
