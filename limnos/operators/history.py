"""Historical-baseline matching: exact hierarchy and fuzzy token matching.

The reference loops over stations and rescans the baseline per station
(a nested loop).  Here both matchers are joins:

* exact: three equi-joins (river+state, river, state) and a per-station
  ``min(level)``; no row of one side is compared with every row of the other.
* fuzzy: a prefix-filtered set-similarity join over the distinct names.  The
  tokens of a name are put in order from rare to common; two sets over the
  threshold share a token of both prefixes, which are short and rare, and their
  sizes are close.  Only pairs that pass both filters are verified exactly.  A
  common token ("river") is in a prefix only where a name has nothing rarer.
* "the baseline's state contains the station's" is an equi-join with the
  substrings of the distinct state names.
* the level of a match is decided on keys (station, river, state); the baseline's
  rows are joined to the keys of the best level only.

Every per-station collection is bounded by the number of parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import rules as R
from ..functions import text as T


def _mean(c: str) -> Column:
    return F.try_divide(F.sum(F.col(c).cast("decimal(38,9)")).cast("double"), F.count(c))


def first_samples(pred: DataFrame, params=K.HISTORY_PARAMS) -> DataFrame:
    """First (earliest) sample per station via min_by: constant memory per station."""
    have = [p for p in params if p in pred.columns]
    first = pred.groupBy("station_name").agg(
        F.min_by(F.struct("river_name", "state_name", *have), "sampling_date").alias("_f"))
    return first.select("station_name", "_f.*")


def _current_long(cur: DataFrame, params) -> DataFrame:
    have = [p for p in params if p in cur.columns]
    idx = {p: i for i, p in enumerate(params)}
    return cur.select("station_name", F.explode(F.array(*[
        F.struct(F.lit(p).alias("parameter"), F.lit(idx[p]).alias("p_idx"), F.col(p).cast("double").alias("cur"))
        for p in have])).alias("x")).select("station_name", "x.*").where(F.col("cur").isNotNull())


def _bkeys(baseline: DataFrame) -> DataFrame:
    return baseline.select(F.col("state_name").alias("b_state"), F.col("river_name").alias("b_river"),
                           "parameter", "median", "min", "max")


def hist_exact(cur: DataFrame, baseline: DataFrame, params=K.HISTORY_PARAMS) -> DataFrame:
    """jn_hist_exact: river+state, else river, else state; per parameter mean(median), mean(max) text."""
    b = _bkeys(baseline)
    st = cur.select("station_name", "river_name", "state_name")
    river_ok = F.col("river_name").isNotNull() & (F.col("river_name") != "")
    state_ok = F.col("state_name").isNotNull() & (F.col("state_name") != "")
    k1 = b.select("b_state", "b_river").distinct().withColumn("_l1", F.lit(True))
    k2 = b.select("b_river").distinct().withColumn("_l2", F.lit(True))
    k3 = b.select("b_state").distinct().withColumn("_l3", F.lit(True))
    lev = (st.join(k1, river_ok & (F.col("river_name") == F.col("b_river")) & (F.col("state_name") == F.col("b_state")), "left")
           .drop("b_state", "b_river")
           .join(k2, river_ok & (F.col("river_name") == F.col("b_river")), "left").drop("b_river")
           .join(k3, state_ok & (F.col("state_name") == F.col("b_state")), "left").drop("b_state"))
    lev = lev.select("station_name", "river_name", "state_name",
                     F.when(F.col("_l1"), 1).when(F.col("_l2"), 2).when(F.col("_l3"), 3).alias("level")) \
        .where(F.col("level").isNotNull())
    m1 = lev.where("level = 1").join(b, (F.col("river_name") == F.col("b_river")) & (F.col("state_name") == F.col("b_state")))
    m2 = lev.where("level = 2").join(b, F.col("river_name") == F.col("b_river"))
    m3 = lev.where("level = 3").join(b, F.col("state_name") == F.col("b_state"))
    matched = m1.unionByName(m2).unionByName(m3)
    agg = matched.groupBy("station_name", "parameter").agg(_mean("median").alias("med"), _mean("max").alias("mx"))
    j = _current_long(cur, params).join(agg, ["station_name", "parameter"])
    cur_t = R.fmt2("cur")
    direction = F.when(F.col("cur") > F.col("med"), F.lit("above")).otherwise(F.lit("at/below"))
    texts = F.array_compact(F.array(
        F.when(F.col("med").isNotNull(), F.concat(F.col("parameter"), F.lit(" current="), cur_t,
                                                 F.lit(" vs historical median="), R.fmt2("med"),
                                                 F.lit(" ("), direction, F.lit(")"))),
        F.when(F.col("mx").isNotNull() & (F.col("cur") > F.col("mx")),
               F.concat(F.lit("WARNING: "), F.col("parameter"), F.lit(" current="), cur_t,
                        F.lit(" exceeds historical max="), R.fmt2("mx")))))
    per = j.groupBy("station_name").agg(F.array_sort(F.collect_list(F.struct("p_idx", texts.alias("t")))).alias("_t"))
    ctx = per.select("station_name", F.flatten(F.transform("_t", lambda s: s["t"])).alias("_c")) \
        .where(F.size("_c") > 0)
    names = F.element_at(F.array(F.lit("river_state"), F.lit("river_only"), F.lit("state_only")), F.col("level"))
    return lev.join(ctx, "station_name").select(
        "station_name", "river_name", F.col("state_name").alias("state"), names.alias("match_level"),
        F.array_join("_c", "; ").alias("historical_context"))


def _prefixes(sets: DataFrame, order: DataFrame, threshold: float) -> DataFrame:
    """(text, toks, n, tok): a row for each of the first n - floor(threshold * n) tokens in the order from rare to common.

    Over the threshold two sets share more than threshold * n of a set's n tokens, so not all of them are behind the prefix."""
    each = sets.select("text", F.explode("toks").alias("tok")).join(order, "tok")
    ranked = each.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("_r"))  # tokens of one name
    n = F.size("_r")
    toks = F.transform("_r", lambda r: r["tok"])
    return ranked.select("text", toks.alias("toks"), n.alias("n"), F.explode(F.slice(toks, F.lit(1), (n - F.floor(threshold * n)).cast("int"))).alias("tok"))


def similar_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l_text, l_toks, r_text, r_toks) of the distinct (text) values on both sides whose prefixes meet and whose sizes allow it."""
    sides = [d.select("text").where("text is not null").distinct().select("text", F.array_distinct(T.tokens("text")).alias("toks")) for d in (left, right)]
    order = reduce(DataFrame.unionByName, [d.select(F.explode("toks").alias("tok")) for d in sides]).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    a, b = (_prefixes(d, order, threshold).select("tok", *[F.col(c).alias(f"{side}_{c}") for c in ("text", "toks", "n")]) for d, side in zip(sides, "lr"))
    close = (F.col("l_n") > threshold * F.col("r_n")) & (F.col("r_n") > threshold * F.col("l_n"))
    return a.join(b, "tok").where(close).select("l_text", "l_toks", "r_text", "r_toks").distinct()


def similar_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l_text, r_text): pairs of names, column `text` of both sides, with token sets of Jaccard > threshold (exact)."""
    shared = F.size(F.array_intersect("l_toks", "r_toks"))
    return similar_candidates(left, right, threshold).where(
        shared / (F.size("l_toks") + F.size("r_toks") - shared) > threshold).select("l_text", "r_text")


def hist_fuzzy(cur: DataFrame, baseline: DataFrame, params=K.HISTORY_PARAMS) -> DataFrame:
    """jn_hist_fuzzy: L1 Jaccard(river)>.4 + state contains; L2 river; L3 Jaccard(station, river)>.25;
    L4 state contains; else a sentinel row.  One output row per matched parameter."""
    b = _bkeys(baseline)
    st = cur.select("station_name", "river_name", "state_name",
                    F.lower(F.trim(F.coalesce("state_name", F.lit("")))).alias("state_lower"))
    rivers = b.select(F.col("b_river").alias("text"))

    def like(column, threshold):
        pairs = similar_texts(st.select(F.col(column).alias("text")), rivers, threshold)
        return st.join(pairs, F.col(column) == F.col("l_text")).select("station_name", F.col("r_text").alias("b_river")).distinct()
    # "the baseline's state contains the station's" as an equi-join: a state name has few substrings
    states = b.select("b_state").distinct().where(F.col("b_state").isNotNull())
    n = F.length("b_state")
    parts = states.select("b_state", F.explode(F.sequence(F.lit(1), n)).alias("i")).select(
        "b_state", "i", F.explode(F.sequence(F.lit(1), n - F.col("i") + 1)).alias("k"))
    parts = parts.select("b_state", F.substring(F.lower("b_state"), F.col("i"), F.col("k")).alias("state_lower")).distinct()
    state_c = st.where(F.col("state_lower") != "").join(parts, "state_lower").select("station_name", "b_state")
    river_states = b.select("b_river", "b_state").distinct()
    by_river = like("river_name", 0.4).join(river_states, "b_river").join(state_c.withColumn("_in", F.lit(True)), ["station_name", "b_state"], "left").select(
        "station_name", "b_river", "b_state", F.when(F.col("_in"), 1).otherwise(2).alias("level"))
    no_name = F.lit(None).cast("string")
    by_name = like("station_name", 0.25).select("station_name", "b_river", no_name.alias("b_state"), F.lit(3).alias("level"))
    by_state = state_c.select("station_name", no_name.alias("b_river"), "b_state", F.lit(4).alias("level"))
    keys = by_river.unionByName(by_name).unionByName(by_state)
    # keys of a station: rivers and states of the baseline, a top list
    kept = keys.withColumn("_best", F.min("level").over(Window.partitionBy("station_name"))).where("level = _best").drop("_best")
    best = keys.groupBy("station_name").agg(F.min("level").alias("level"))
    k = kept.select("station_name", "level", F.col("b_river").alias("_river"), F.col("b_state").alias("_state"))
    chosen = reduce(DataFrame.unionByName, [k.where(which).join(b, on).drop("_river", "_state") for which, on in (
        ("level <= 2", (F.col("_river") == F.col("b_river")) & F.col("_state").eqNullSafe(F.col("b_state"))),
        ("level = 3", F.col("_river") == F.col("b_river")), ("level = 4", F.col("_state") == F.col("b_state")))])
    agg = chosen.groupBy("station_name", "level", "parameter").agg(
        _mean("median").alias("med"), _mean("min").alias("mn"), _mean("max").alias("mx"))
    j = _current_long(cur, params).join(agg, ["station_name", "parameter"])
    j = j.join(st.select("station_name", "river_name", "state_name"), "station_name")
    cur_t = R.fmt2("cur")
    direction = F.when(F.col("cur") > F.col("med"), F.lit("above")).otherwise(F.lit("at/below"))
    note = F.when(F.col("med").isNotNull(), F.concat(
        F.lit("Current "), F.col("parameter"), F.lit("="), cur_t, F.lit(" is "), direction,
        F.lit(" historical median="), R.fmt2("med"),
        F.when(F.col("mx").isNotNull() & (F.col("cur") > F.col("mx")),
               F.concat(F.lit(" (EXCEEDS historical max="), R.fmt2("mx"), F.lit(")"))).otherwise(F.lit(""))
    )).otherwise(F.concat(F.lit("Current "), F.col("parameter"), F.lit("="), cur_t, F.lit(", insufficient baseline data")))
    lvl = F.col("level")
    river_txt = F.coalesce(F.col("river_name"), F.lit(""))
    state_txt = F.coalesce(F.col("state_name"), F.lit(""))
    source = (F.when(lvl == 1, F.concat(F.lit("river='"), river_txt, F.lit("' + state='"), state_txt, F.lit("'")))
              .when(lvl == 2, F.concat(F.lit("river='"), river_txt, F.lit("'")))
              .when(lvl == 3, F.concat(F.lit("station='"), F.col("station_name"), F.lit("' fuzzy-matched")))
              .otherwise(F.concat(F.lit("state='"), state_txt, F.lit("'"))))
    level_name = F.element_at(F.array(*[F.lit(x) for x in
                                        ["river_state", "river_only", "station_to_river_fuzzy", "state_only"]]), lvl)
    conf = F.element_at(F.array(*[F.lit(x) for x in ["Medium", "Low", "Low", "Very Low"]]), lvl)
    matched = j.select(
        "station_name", "river_name", F.col("state_name").alias("state"), level_name.alias("attempted_match_level"),
        source.alias("matched_baseline_source"), F.col("parameter").alias("matched_parameter"),
        F.col("cur").alias("current_value"), F.col("med").alias("baseline_median"),
        (F.col("mx") - F.col("mn")).alias("baseline_range"), note.alias("context_note"), conf.alias("match_confidence"))
    none = st.join(best, "station_name", "left_anti").select(
        "station_name", "river_name", F.col("state_name").alias("state"),
        F.lit("no_reliable_match").alias("attempted_match_level"), F.lit("").alias("matched_baseline_source"),
        F.lit("").alias("matched_parameter"), F.lit(None).cast("double").alias("current_value"),
        F.lit(None).cast("double").alias("baseline_median"), F.lit(None).cast("double").alias("baseline_range"),
        F.lit("No historical baseline match found for this station.").alias("context_note"),
        F.lit("None").alias("match_confidence"))
    return matched.unionByName(none)
