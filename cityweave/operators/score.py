"""Detected against planted: matching, scorecard, recall, coverage, decoy leaks."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..params import DEFAULT, Params
from .link import connected_components, upper_median
from .scale import one_row, stage
from ..functions.numbers import round_exact

GROUP_PAIRS = 1_000_000


def overlaps(truth_members: DataFrame, sit_members: DataFrame) -> DataFrame:
    """Share of each truth's events in each situation: an equi-join on the event and a count."""
    size = truth_members.groupBy("truth_id").agg(F.count("*").alias("size"))
    both = (truth_members.join(sit_members.select("situation_id", "event_id"), "event_id")
            .groupBy("truth_id", "situation_id").agg(F.count("*").alias("shared")))
    return both.join(size, "truth_id").withColumn("overlap", F.col("shared") / F.col("size"))


def _greedy(min_overlap: float):
    """Truths of one table of pairs in their order, each with its best free situation."""
    def run(pairs: pa.Table) -> pa.Table:
        pairs = pairs.sort_by([("pos", "ascending"), ("overlap", "descending"), ("created_utc", "ascending"), ("situation_id", "ascending")])
        taken, picks, decided = set(), [], set()
        for truth, sit, overlap in zip(*(pairs.column(c).to_pylist() for c in ("truth_id", "situation_id", "overlap"))):
            if truth not in decided and sit not in taken and overlap >= min_overlap:
                taken.add(sit)
                decided.add(truth)
                picks.append((truth, sit))
        return pa.table([pa.array([p[0] for p in picks], pa.string()), pa.array([p[1] for p in picks], pa.string())], names=["truth_id", "situation_id"])

    return run


def _proposals(open_: DataFrame) -> DataFrame:
    """The same by proposals: every undecided truth asks for its best situation not yet lost, the
    earliest asker holds it and the others lose it, until nothing is lost. Every round removes a pair."""
    while True:
        want = open_.groupBy("truth_id", "pos").agg(F.min_by("situation_id", F.struct(
            (-F.col("overlap")).alias("o"), "created_utc", "situation_id")).alias("situation_id"))
        held = want.groupBy("situation_id").agg(F.min_by("truth_id", "pos").alias("_winner"))
        lost = want.join(held, "situation_id").filter(F.col("truth_id") != F.col("_winner")).select("truth_id", "situation_id")
        lost = stage(lost, "match-lost")
        if lost.limit(1).count() == 0:
            return want.select("truth_id", "situation_id")
        open_ = stage(open_.join(lost, ["truth_id", "situation_id"], "left_anti"), "match-open")


def match(truths: DataFrame, truth_members: DataFrame, situations: DataFrame, sit_members: DataFrame,
          min_overlap: float = 0.5, group_pairs: int = GROUP_PAIRS) -> DataFrame:
    """(truth_id, pos, situation_id, overlap): truths in order ``pos`` each take their best free
    situation, earliest created first on a tie.

    Truths that contend, directly or through others, are a group of their own and are gone through
    in one task, one after the other; a group of more than ``group_pairs`` pairs is solved by rounds
    of proposals instead, which end in the same assignment."""
    o = overlaps(truth_members, sit_members).join(truths.select("truth_id", "pos"), "truth_id")
    o = o.join(situations.select("situation_id", "created_utc"), "situation_id")
    all_pairs = stage(o, "match-pairs")
    open_ = all_pairs.filter(F.col("overlap") >= min_overlap)
    t, u = F.concat(F.lit("t"), "truth_id"), F.concat(F.lit("s"), "situation_id")
    group = connected_components(open_.select(t.alias("episode_id")).distinct(), open_.select(t.alias("i"), u.alias("j")))
    open_ = stage(open_.join(group, t == F.col("episode_id")).select("truth_id", "pos", "situation_id", "overlap", "created_utc", "component"), "match-open")
    large = open_.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > group_pairs)
    small = open_.join(large, "component", "left_anti").groupBy("component").applyInArrow(_greedy(min_overlap), "truth_id string, situation_id string")
    rest = open_.join(large, "component", "left_semi")
    won = stage(small.unionByName(_proposals(rest)) if rest.limit(1).count() else small, "match-won")
    want = won.join(truths.select("truth_id", "pos"), "truth_id")
    assert want.groupBy("situation_id").count().filter("count > 1").limit(1).count() == 0, "a situation was given twice"
    taken = want.select("situation_id", F.col("pos").alias("_by"))
    # an unmatched truth reports its best situation among those no earlier truth had taken
    free = (all_pairs.join(taken, "situation_id", "left").filter(F.col("_by").isNull() | (F.col("_by") >= F.col("pos")))
            .groupBy("truth_id").agg(F.max("overlap").alias("overlap")))
    return (truths.select("truth_id", "pos").join(won, "truth_id", "left").join(free, "truth_id", "left")
            .withColumn("overlap", F.coalesce("overlap", F.lit(0.0))))


def per_truth(matches: DataFrame, truths: DataFrame, situations: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Status, lag and alert agreement per truth. ``truths``: onset_utc, detect_by_utc and
    expected_alert_level besides truth_id and pos."""
    d = (matches.join(truths.drop("pos"), "truth_id")
         .join(situations.select("situation_id", "created_utc", F.col("alert_level").alias("detected_alert_level")), "situation_id", "left"))
    hit = F.col("situation_id").isNotNull()
    late = F.col("created_utc") > F.col("detect_by_utc")
    late_status = "missed" if p.strict_deadline else "matched_late"
    return d.select(
        "truth_id", "situation_id", F.when(~hit, "missed").when(late, late_status).otherwise("matched").alias("status"),
        "expected_alert_level", "detected_alert_level",
        F.when(hit, times.epoch(F.col("created_utc")) - times.epoch(F.col("onset_utc"))).alias("detection_lag_sec"),
        round_exact("overlap", 2).alias("member_overlap"))


def decoy_status(decoy_members: DataFrame, sit_members: DataFrame) -> DataFrame:
    """A decoy counts as alerted when any of its events is in any situation."""
    ids = sit_members.select("event_id").distinct().withColumn("_in", F.lit(1))
    d = decoy_members.join(ids, "event_id", "left").groupBy("decoy_id").agg(F.count("_in").alias("leaked"))
    return d.withColumn("status", F.when(F.col("leaked") > 0, "decoy_alerted").otherwise("decoy_ignored"))


def false_positives(per_truth_: DataFrame, situations: DataFrame, sit_members: DataFrame, decoy_members: DataFrame) -> DataFrame:
    used = per_truth_.filter("situation_id is not null").select("situation_id").distinct()
    rest = situations.select("situation_id", "alert_level").join(used, "situation_id", "left_anti")
    bad = sit_members.join(decoy_members.select("event_id"), "event_id", "left_semi").select("situation_id").distinct().withColumn("_d", F.lit(1))
    return rest.join(bad, "situation_id", "left").select(
        "situation_id", F.when(F.col("_d").isNotNull(), "decoy_alerted").otherwise("false_positive").alias("status"),
        F.col("alert_level").alias("detected_alert_level"))


def scorecard(per_truth_: DataFrame, fps: DataFrame, decoys: DataFrame) -> DataFrame:
    """One row of totals and ratios."""
    hit = F.col("status").isin("matched", "matched_late")
    a = per_truth_.agg(
        F.count("*").alias("truth_situations"), F.count(F.when(hit, 1)).alias("matched"),
        F.count(F.when(F.col("status") == "matched_late", 1)).alias("matched_late"),
        F.count(F.when(F.col("status") == "missed", 1)).alias("missed"),
        F.count(F.when(hit & (F.col("expected_alert_level") == F.col("detected_alert_level")), 1)).alias("_alert"))
    lags = (per_truth_.filter("detection_lag_sec is not null").withColumn("_k", F.lit(1))
            .groupBy("_k", "detection_lag_sec").agg(F.count("*").alias("_n")))
    med = upper_median(lags, ["_k"], "detection_lag_sec", "_n").select(F.col("median").alias("_m")).agg(F.max("_m").alias("median_detection_lag_sec"))
    b = fps.agg(F.count("*").alias("false_positives"))
    c = decoys.agg(F.count("*").alias("decoys_planted"), F.count(F.when(F.col("status") == "decoy_ignored", 1)).alias("decoys_correctly_ignored"))
    d = one_row(a, b, c, med)
    m = F.col("matched")
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    prec, rec = ratio(m, m + F.col("false_positives")), ratio(m, m + F.col("missed"))
    return d.select(
        "truth_situations", (m + F.col("false_positives")).alias("detected_situations"), "matched", "matched_late", "missed",
        "false_positives", "decoys_planted", "decoys_correctly_ignored", round_exact(prec, 2).alias("precision"), round_exact(rec, 2).alias("recall"),
        round_exact(ratio(2 * prec * rec, prec + rec), 2).alias("f1"), round_exact(ratio(F.col("_alert"), m), 2).alias("alert_level_accuracy"),
        "median_detection_lag_sec")


def recall_by_category(truth_members: DataFrame, events: DataFrame, flagged: DataFrame) -> DataFrame:
    """Per truth and category: how many member events any anomaly holds."""
    f = flagged.select("event_id").distinct().withColumn("_f", F.lit(1))
    d = truth_members.join(events.select("event_id", "category"), "event_id").join(f, "event_id", "left")
    return d.groupBy("truth_id", "category").agg(F.count("*").alias("total"), F.count("_f").alias("flagged"))


def link_coverage(by_category: DataFrame) -> DataFrame:
    return by_category.groupBy("truth_id").agg(
        F.sum("total").alias("total"), F.sum("flagged").alias("flagged"), F.count("*").alias("links"),
        F.count(F.when(F.col("flagged") > 0, 1)).alias("links_covered"),
        (F.sum("flagged") / F.sum("total")).alias("overlap"))


def decoy_leaks(decoy_members: DataFrame, sit_members: DataFrame, matched: DataFrame) -> DataFrame:
    """Leaked decoy events in any situation and in matched situations, per decoy."""
    hit = decoy_members.join(sit_members.select("situation_id", "event_id"), "event_id")
    ok = matched.filter("situation_id is not null").select("situation_id").distinct().withColumn("_m", F.lit(1))
    d = hit.join(ok, "situation_id", "left").groupBy("decoy_id").agg(
        F.count_distinct("event_id").alias("leaked_any"), F.count_distinct(F.when(F.col("_m") == 1, F.col("event_id"))).alias("leaked_matched"))
    return decoy_members.select("decoy_id").distinct().join(d, "decoy_id", "left").na.fill(0)
