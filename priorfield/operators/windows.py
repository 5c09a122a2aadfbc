"""Windows over event histories and inside events. Frames of history windows end at -1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import materialize
from .hot import HotGroups, chunk_hot, find_hot, join_same, split_hot, spread


@dataclass(frozen=True)
class Prior:
    """One history feature: what is taken over the earlier rows of the key."""

    out: str
    kind: str  # count | sum | mean | rolling | last | latest
    col: str | None = None
    n: int = 0


def prior_mean(out: str, col: str) -> Prior:
    return Prior(out, "mean", col)


def prior_rolling_mean(out: str, col: str, n: int) -> Prior:
    return Prior(out, "rolling", col, n)


def prior_sum(out: str, col: str) -> Prior:
    return Prior(out, "sum", col)


def prior_count(out: str) -> Prior:
    return Prior(out, "count")


def previous(out: str, col: str) -> Prior:
    return Prior(out, "last", col)


def latest(out: str, col: str) -> Prior:
    """Last earlier value that is not null."""
    return Prior(out, "latest", col)


def _plain(spec: Prior, w, own: int) -> Column:
    before = w.rowsBetween(Window.unboundedPreceding, own - 1)
    if spec.kind == "count":
        e = (F.row_number().over(w) - 1 + own).cast("long")
    elif spec.kind == "sum":
        e = F.coalesce(F.sum(spec.col).over(before), F.lit(0))
    elif spec.kind == "mean":
        e = F.avg(spec.col).over(before)
    elif spec.kind == "last":
        e = F.col(spec.col) if own else F.lag(spec.col).over(w)
    elif spec.kind == "latest":
        e = F.last(spec.col, ignorenulls=True).over(before)
    elif spec.kind == "rolling":
        e = F.avg(spec.col).over(w.rowsBetween(own - spec.n, own - 1))
    else:
        raise ValueError(spec.kind)
    return e.alias(spec.out)


def _sum_type(df: DataFrame, col: str) -> str:
    """What a mean adds up in: doubles, or decimals of ten more digits."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.DecimalType):
        return f"decimal({min(38, kind.precision + 10)},{kind.scale})"
    return "double"


def _mean_type(df: DataFrame, col: str):
    return df.select(F.avg(col)).schema[0].dataType


def _chunked(rows: DataFrame, keys, order, specs, own: int, small: bool = False, source: DataFrame | None = None) -> DataFrame:
    """The same features when a key is cut into chunks: local windows plus what came before.

    Per (key, chunk) only totals and the last few rows are carried forward; ``small`` states that there are few of them.
    They are taken from ``source``, the same rows before they were dealt by chunk, if it is given.
    """
    base, source = rows.columns, rows if source is None else source
    cols = sorted({s.col for s in specs if s.kind in ("sum", "mean")})
    kept = sorted({s.col for s in specs if s.kind in ("rolling", "last")})
    lasts = sorted({s.col for s in specs if s.kind == "latest"})
    keep = max([s.n for s in specs if s.kind == "rolling"] + [1])
    at = [*keys, "_chunk"]
    w = Window.partitionBy(*at).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, own - 1)

    local = [F.row_number().over(w).alias("_rn")]
    for c in lasts:
        local += [F.last(c, ignorenulls=True).over(before).alias(f"_ll_{c}")]
    for c in cols:
        local += [F.sum(c).over(before).alias(f"_ls_{c}"), F.count(c).over(before).alias(f"_lc_{c}")]
    for s in specs:
        if s.kind == "rolling":
            local += [F.avg(s.col).over(w.rowsBetween(own - s.n, own - 1)).alias(f"_la_{s.out}")]
        if s.kind == "last":
            local += [F.lag(s.col).over(w).alias(f"_lag_{s.out}")]
    here = rows.select("*", *local)

    totals = source.groupBy(*at).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_s_{c}") for c in cols],
        *[F.count(c).alias(f"_c_{c}") for c in cols],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_l_{c}") for c in lasts],
    )
    values = [F.col(c).alias(f"v_{c}") for c in kept]
    if kept:
        back = Window.partitionBy(*at).orderBy(*[F.desc(c) for c in order])
        value = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *values)
        tails = (
            source.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= keep)
            .groupBy(*at).agg(F.sort_array(F.collect_list(value)).alias("_tail"))
        )
        totals = join_same(totals, tails, at)
    rolling = any(s.kind == "rolling" for s in specs)
    if rolling:  # a row whose frame reaches into earlier chunks finds the rest of it here
        heads = (
            source.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep)
            .groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("_rn", *values))).alias("_head"))
        )
        totals = join_same(totals, heads, at)
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    past = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *at,
        F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_pn"),
        *[F.sum(f"_s_{c}").over(past).alias(f"_ps_{c}") for c in cols],
        *[F.coalesce(F.sum(f"_c_{c}").over(past), F.lit(0)).alias(f"_pc_{c}") for c in cols],
        *[F.last(f"_l_{c}", ignorenulls=True).over(past).alias(f"_pl_{c}") for c in lasts],
        *([F.flatten(F.collect_list("_tail").over(chunks.rowsBetween(-keep, -1))).alias("_past")] if kept else []),
        *(["_head"] if rolling else []),
    )
    full = join_same(here, carry, at, "left", small)

    def total(c):
        return F.coalesce(F.col(f"_ps_{c}"), F.lit(0)) + F.coalesce(F.col(f"_ls_{c}"), F.lit(0))

    out = []
    for s in specs:
        if s.kind == "count":
            e = (F.col("_pn") + F.col("_rn") - 1 + own).cast("long")
        elif s.kind == "sum":
            e = total(s.col)
        elif s.kind == "mean":
            n = F.col(f"_pc_{s.col}") + F.col(f"_lc_{s.col}")
            e = F.try_divide(total(s.col).cast(_sum_type(rows, s.col)), n).cast(_mean_type(rows, s.col))
        elif s.kind == "latest":
            e = F.coalesce(F.col(f"_ll_{s.col}"), F.col(f"_pl_{s.col}"))
        elif s.kind == "last" and own:
            e = F.col(s.col)
        elif s.kind == "last":
            e = F.when(F.col("_rn") > 1, F.col(f"_lag_{s.out}")).otherwise(
                F.try_element_at("_past", F.lit(-1))[f"v_{s.col}"])
        else:
            have = F.col("_rn") - 1 + own
            m = F.greatest(F.lit(s.n) - have, F.lit(0))
            size = F.size("_past")
            tail = F.slice("_past", F.greatest(size - m + 1, F.lit(1)), F.least(m, size))
            # the carried rows and then the local ones, added in the order of the plain window
            kind = _sum_type(rows, s.col)
            far = F.when((m > 0) & (size > 0), F.transform(tail, lambda r: r[f"v_{s.col}"].cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))
            near = F.transform(F.slice("_head", F.lit(1), F.least(have, F.lit(s.n))), lambda r: r[f"v_{s.col}"].cast(kind))
            vals = F.filter(F.concat(far, near), lambda v: v.isNotNull())
            added = F.aggregate(vals, F.lit(0).cast(kind), lambda a, v: (a + v).cast(kind))
            near_start = F.try_divide(added, F.size(vals)).cast(_mean_type(rows, s.col))
            e = F.when(have >= s.n, F.col(f"_la_{s.out}")).otherwise(near_start)
        out.append(e.alias(s.out))
    return full.select(*base, *out)


def prior_features(df: DataFrame, keysets, order, hot: HotGroups | None = None,
                   inclusive: bool = False, dealt: bool = True) -> DataFrame:
    """History features for one or more key sets that all contain the first one.

    ``inclusive`` lets the row itself count as the latest one: the state after the event.
    ``dealt`` states that the rows need no deal by the first key set: they lie so already, or are few. Otherwise
    tasks grow in number with the table, so that their sorts and window buffers stay in memory.

    ``keysets`` is a list of (keys, specs). The first key set is the coarsest, so one shuffle on
    it serves every window of ordinary keys.
    """
    order, own = list(order), int(inclusive)
    coarse = list(keysets[0][0])
    for keys, _ in keysets:
        if not set(coarse) <= set(keys):
            raise ValueError("every key set must contain the first one")
    hot = find_hot(df, coarse) if hot is None else hot
    cold, big = split_hot(df, hot)
    plain = cold if dealt else spread(cold, coarse, hot.total)
    for keys, specs in keysets:
        w = Window.partitionBy(*keys).orderBy(*order)
        plain = plain.select("*", *[_plain(s, w, own) for s in specs])
    if big is None:
        return plain
    source = chunk_hot(big, hot, order)
    big = spread(source, [*hot.keys, "_chunk"], hot.total)  # a task sorts about one chunk however large the table is
    for keys, specs in keysets:
        if specs:
            # chunks of the hot keys themselves are bounded in number, as the keys are
            big = _chunked(big, list(keys), order, specs, own, set(keys) == set(hot.keys), source)
    return plain.unionByName(big.drop("_chunk"))


def attach_group(df: DataFrame, keys, hot: HotGroups | None = None, **aggs: Column) -> DataFrame:
    """Aggregates of the whole key on each of its rows (size, min, mean, ...)."""
    keys = list(keys)
    hot = find_hot(df, keys) if hot is None else hot
    if not set(hot.keys) <= set(keys):
        raise ValueError("hot groups must be found on a subset of the keys")
    cold, big = split_hot(df, hot)
    w = Window.partitionBy(*keys)
    plain = cold.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    if big is None:
        return plain
    rolled = big.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    bounded = set(hot.keys) == set(keys)  # then one row per hot key
    return plain.unionByName(join_same(big, rolled, keys, small=bounded))


def rank_first(df: DataFrame, event, order, out: str, hot: HotGroups | None = None) -> DataFrame:
    """1..n inside the event in the stated order; ``order`` must end in a unique column."""
    keys = [event] if isinstance(event, str) else list(event)
    return prior_features(df, [(keys, [prior_count(out)])], order, hot).withColumn(
        out, F.col(out) + 1)


def rank_average(df: DataFrame, event, score: str, out: str, hot: HotGroups | None = None) -> DataFrame:
    """Average rank over ties, ascending by score."""
    keys = [event] if isinstance(event, str) else list(event)
    hot = find_hot(df, keys) if hot is None else hot
    cold, big = split_hot(df, hot)
    w = Window.partitionBy(*keys).orderBy(score)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, score))
    plain = cold.select("*", (F.rank().over(w) + (ties - 1) / 2).alias(out))
    if big is None:
        return plain
    counts = big.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_m"))
    # tied rows are counted once, so the running total is over distinct scores
    placed = prior_features(counts, [(keys, [prior_sum("_b", "_m")])], [score], hot)
    placed = placed.withColumn(out, F.col("_b") + (F.col("_m") + 1) / 2).drop("_b", "_m")
    return plain.unionByName(join_same(big, placed, [*keys, score]))


def top_k(df: DataFrame, event, order, k: int, out: str = "place") -> DataFrame:
    """First k rows per event. Spark limits each group on the map side before the shuffle."""
    keys = [event] if isinstance(event, str) else list(event)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def first_per(df: DataFrame, keys, order, **sums: Column) -> DataFrame:
    """First row per key in the order (nulls last is up to the order columns), with sums over
    all its rows. A grouped minimum: combined before the shuffle, no sort."""
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    got = df.groupBy(*keys).agg(F.min(row).alias("_row"), *[s.alias(n) for n, s in sums.items()])
    return got.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in order + rest], *sums)


def last_per(df: DataFrame, keys, order) -> DataFrame:
    """Last row per key in the order."""
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    got = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return got.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in order + rest])


def next_in(df: DataFrame, keys, order, col: str, out: str, hot: HotGroups | None = None) -> DataFrame:
    """Value of the next row of the key; null on its last row."""
    keys, order = list(keys), list(order)
    hot = find_hot(df, keys) if hot is None else hot
    cold, big = split_hot(df, hot)
    plain = cold.withColumn(out, F.lead(col).over(Window.partitionBy(*keys).orderBy(*order)))
    if big is None:
        return plain
    big = chunk_hot(big, hot, order)
    at = [*keys, "_chunk"]
    heads = big.groupBy(*at).agg(F.min_by(col, F.struct(*order)).alias("_head"))
    nxt = heads.withColumn(
        "_next", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_head")
    w = Window.partitionBy(*at).orderBy(*order)
    last = F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy(*at))
    here = big.withColumn("_lead", F.lead(col).over(w)).withColumn("_last", last)
    value = F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_lead"))
    full = join_same(here, nxt, at, "left").withColumn(out, value)
    return plain.unionByName(full.select(*plain.columns))


def event_seq(events: DataFrame, order, out: str = "event_index", hot: HotGroups | None = None) -> DataFrame:
    """0-based position of each event in the global order, as a prefix count over chunks."""
    one = events.withColumn("_all", F.lit(1))
    return prior_features(one, [(["_all"], [prior_count(out)])], order, hot).drop("_all")


def assign_blocks(events: DataFrame, order, sizes: dict[str, int], rest: str, out: str = "block",
                  hot: HotGroups | None = None) -> DataFrame:
    """Name consecutive chronological blocks of the given sizes; what is left is ``rest``."""
    seq = event_seq(events, order, "_seq", hot)
    label, start = F, 0
    for name, size in sizes.items():
        label = label.when(F.col("_seq") < start + size, F.lit(name))
        start += size
    return seq.withColumn(out, label.otherwise(F.lit(rest))).drop("_seq")


def split_blocks(events: DataFrame, order, date: str, shares: dict[str, float], rest: str, out: str = "block",
                 hot: HotGroups | None = None) -> DataFrame:
    """Name consecutive chronological blocks by shares of all events; what is left is ``rest``.

    ``order`` begins with ``date``. Events of one date stay together, in the block of the date's first event, so no
    date lies in two blocks. A block without events, ``rest`` included, is an error.
    """
    seq = materialize(event_seq(events, order, "_seq", hot))
    n = seq.count()
    first = seq.groupBy(date).agg(F.min("_seq").alias("_first"))
    label, end = F, 0.0
    for name, share in shares.items():
        end += share
        label = label.when(F.col("_first") < round(end * n), F.lit(name))
    named = materialize(join_same(seq, first, [date]).withColumn(out, label.otherwise(F.lit(rest))).drop("_seq", "_first"))
    held = {r[out] for r in named.select(out).distinct().collect()}  # one row for each block
    if empty := [b for b in [*shares, rest] if b not in held]:
        raise ValueError(f"no events for {', '.join(empty)}: {n} events are too few for these shares")
    return named


def temporal_folds(df: DataFrame, season: str, folds) -> DataFrame:
    """One copy of a row per fold it takes part in: fit up to the end season, score after it."""
    options = [
        F.when(F.col(season) <= end, F.struct(F.lit(name).alias("fold"), F.lit("fit").alias("fold_role")))
        .when(F.col(season) == score, F.struct(F.lit(name).alias("fold"), F.lit("score").alias("fold_role")))
        for name, end, score in folds
    ]
    roles = F.filter(F.array(*options), lambda r: r.isNotNull())
    return df.withColumn("_f", F.explode(roles)).select(*df.columns, "_f.fold", "_f.fold_role")


def normalised_order(df: DataFrame, event: str, order: str, out: str = "target", hot=None) -> DataFrame:
    d = attach_group(df, [event], hot, _n=F.count(F.lit(1)))
    return d.withColumn(out, (F.col(order) - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_n")


def relevance(df: DataFrame, event: str, order: str, out: str = "relevance", by_max: bool = False, hot=None) -> DataFrame:
    top = F.max(order) if by_max else F.count(F.lit(1))
    return attach_group(df, [event], hot, _top=top).withColumn(
        out, F.col("_top") - F.col(order) + 1).drop("_top")


def running_total(df: DataFrame, keys, order, hot=None, **cols: str) -> DataFrame:
    """Inclusive running sums: everything before the row plus the row itself."""
    specs = [prior_sum(out, c) for out, c in cols.items()]
    d = prior_features(df, [(list(keys), specs)], order, hot)
    for out, c in cols.items():
        d = d.withColumn(out, F.col(out) + F.coalesce(F.col(c), F.lit(0)))
    return d
