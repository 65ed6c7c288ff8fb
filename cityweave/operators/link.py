"""Episodes, lift, links, components, evidence and near misses.

Every pair search is an equi-join on (cell ring, category or time bucket); every
event-to-event comparison is a bucketed as-of lookup over distinct seconds, so no group is
compared all against all."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, times
from ..functions.hexgrid import distance, ring
from ..params import DEFAULT, Params
from .detect import SEV
from .scale import PAGE, id_pages, latest_within, set_keys, stage, with_scalars
from ..functions.numbers import round_exact


# ------------------------------------------------------------------ episodes ---------------
def number_episodes(anomalies: DataFrame) -> DataFrame:
    """Give each anomaly the episode it merges into: same cell and category, no gap. A new
    episode opens when a window starts strictly after the previous one ended. The partition
    holds at most one row per time step of the detection window."""
    w = Window.partitionBy("h3_cell", "category").orderBy("window_start_utc", "anomaly_id")
    d = anomalies.withColumn("_prev", F.lag("window_end_utc").over(w))
    opens = F.col("_prev").isNull() | (F.col("window_start_utc") > F.col("_prev"))
    d = d.withColumn("_start", F.last(F.when(opens, F.col("window_start_utc")), True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    # text that sorts like (cell, category, start)
    eid = F.concat_ws(" ", F.lpad(F.col("h3_cell").cast("string"), 14, "0"), "category",
                      F.lpad(times.epoch(F.col("_start")).cast("string"), 11, "0"))
    return d.withColumn("episode_id", eid).drop("_prev", "_start")


def episode_members(numbered: DataFrame, detection: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Bridge episode -> event rows. Steps covered by an episode's windows are distinct, and
    an event lies in one step, so the bridge has no duplicates."""
    step = p.step_sec
    panes = numbered.select("episode_id", "h3_cell", "category", F.explode(F.sequence(
        times.epoch(F.col("window_start_utc")), times.epoch(F.col("window_end_utc")) - step, F.lit(step).cast("bigint"))).alias("pane")).distinct()
    t = times.epoch(F.col("start_utc"))
    ev = detection.select("event_id", "h3_cell", "category", t.alias("t"), "severity", "confidence", "source",
                          "lat", "lon", "end_utc", (F.floor(t / step) * step).alias("pane"))
    return panes.join(ev, ["h3_cell", "category", "pane"]).drop("pane")


def build_episodes(numbered: DataFrame, members: DataFrame) -> DataFrame:
    """One row per burst; severity is recomputed from distinct member events."""
    a = numbered.groupBy("episode_id", "h3_cell", "category").agg(
        F.when(F.max(F.when(F.col("trigger") == "rare", 1)) == 1, "rare").otherwise("volume").alias("trigger"),
        F.min("window_start_utc").alias("window_start_utc"), F.max("window_end_utc").alias("window_end_utc"),
        F.min("p_value").alias("min_p_value"), F.array_sort(F.collect_set("anomaly_id")).alias("anomaly_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_feeds")))).alias("source_feeds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("degraded_by_stale_feeds")))).alias("degraded_by_stale_feeds"))
    m = members.groupBy("episode_id").agg(
        F.count("*").alias("observed_count"), F.sum(F.col("severity").cast(SEV)).cast("double").alias("severity_weighted"),
        F.min(F.struct("t", "event_id")).alias("rep"), F.max("t").alias("last_t"))
    return a.join(m, "episode_id").select(
        *a.columns, "observed_count", "severity_weighted", F.col("rep.t").alias("rep_t"),
        F.col("rep.event_id").alias("rep_event_id"), "last_t")


def episode_seconds(members: DataFrame) -> DataFrame:
    """Distinct seconds of an episode with the first event of each."""
    return members.groupBy("episode_id", "t").agg(F.min("event_id").alias("event_id"))


# ------------------------------------------------------------------ lift -------------------
def cause_effect_lags(history: DataFrame, edges: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per cause second (``n`` causes) the lag to the closest plausible effect in the ring, null
    when none falls inside the pair's window."""
    secs = history.groupBy("h3_cell", "category", times.epoch(F.col("start_utc")).alias("t")).agg(F.count("*").alias("n"))
    causes = (secs.join(edges.select("cause", "effect", "min_gap_sec", "max_gap_sec"), secs["category"] == F.col("cause"))
              .select("h3_cell", "cause", "effect", (F.col("t") + F.col("min_gap_sec")).alias("t"), "n", "min_gap_sec", "max_gap_sec"))
    # one point per effect second and ring cell serves every cause; two cells may give the same
    # second, which an as-of lookup without carried columns does not mind
    effects = (secs.join(edges.select(F.col("effect").alias("category")).distinct(), "category", "left_semi")
               .select(F.explode(ring(F.col("h3_cell"), p.link_max_distance)).alias("h3_cell"), F.col("category").alias("effect"), "t"))
    width = edges.agg(F.max(F.col("max_gap_sec") - F.col("min_gap_sec"))).first()[0]
    hit = latest_within(causes, effects, ["h3_cell", "effect"], "t", [], width, reverse=True)
    lag = F.col("hit.t") - F.col("t") + F.col("min_gap_sec")
    return hit.select("h3_cell", "cause", "effect", "n",
                      F.when(lag <= F.col("max_gap_sec"), lag).alias("lag"))


def lift_table(history: DataFrame, edges: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """How often an effect follows a cause nearby, against chance, for every plausible pair."""
    t = times.epoch(F.col("start_utc"))
    span = history.agg(F.greatest(F.lit(1.0), (F.max(t) - F.min(t)).cast("double")).alias("span"))
    per_cell = history.groupBy("h3_cell", "category").agg(F.count("*").alias("n"))
    totals = per_cell.groupBy("category").agg(F.sum("n").alias("n"))
    local = (per_cell.select(F.explode(ring(F.col("h3_cell"), p.link_max_distance)).alias("h3_cell"),
                             F.col("category").alias("effect"), "n")
             .groupBy("h3_cell", "effect").agg(F.sum("n").alias("n_local")))
    w = F.col("max_gap_sec") - F.col("min_gap_sec")
    exp = (per_cell.join(edges, per_cell["category"] == edges["cause"]).drop("category")
           .join(local, ["h3_cell", "effect"])
           .groupBy("cause", "effect").agg(F.sum(
               F.col("n") * (1 - F.exp(-F.col("n_local") * w / span.scalar()))).alias("expected")))
    hist = (cause_effect_lags(history, edges, p).filter("lag is not null")
            .groupBy("cause", "effect", "lag").agg(F.sum("n").alias("n")))
    obs = upper_median(hist, ["cause", "effect"], "lag", "n")
    d = (edges.join(obs, ["cause", "effect"], "left").join(exp, ["cause", "effect"], "left")
         .join(totals.select(F.col("category").alias("cause"), F.col("n").alias("n_cause")), "cause", "left")
         .join(totals.select(F.col("category").alias("effect"), F.col("n").alias("n_effect")), "effect", "left"))
    d = with_scalars(d, span)
    o, e = F.coalesce("total", F.lit(0)), F.coalesce("expected", F.lit(0.0))
    hours = F.col("span") / 3600.0
    return d.select(
        "cause", "effect", w.alias("window_sec"), "min_gap_sec", "max_gap_sec",
        F.coalesce("n_cause", F.lit(0)).alias("n_cause"), F.coalesce("n_effect", F.lit(0)).alias("n_effect"),
        o.alias("cooccurrences"), round_exact(e, 4).alias("expected_cooccurrences"),
        round_exact(o / hours, 6).alias("observed_rate_per_hour"), round_exact(e / hours, 6).alias("baseline_rate_per_hour"),
        round_exact((o + p.lift_smoothing) / (e + p.lift_smoothing), 3).alias("value"),
        F.col("median").alias("median_lag_sec"), round_exact(hours, 2).alias("history_hours"))


def upper_median(hist: DataFrame, keys: list, value: str, n: str) -> DataFrame:
    """Element [len // 2] of each key's sorted values, from a histogram (value, count): the
    window sees distinct values only."""
    w = Window.partitionBy(*keys).orderBy(value)
    d = hist.withColumn("_cum", F.sum(n).over(w))
    tot = hist.groupBy(*keys).agg(F.sum(n).alias("total"))
    d = d.join(tot, keys).filter(F.col("_cum") > F.floor(F.col("total") / 2))
    return d.groupBy(*keys).agg(F.min(value).alias("median"), F.max("total").alias("total"))


# ------------------------------------------------------------------ links ------------------
def score(distance_, gap, lo, hi, lift, p: Params = DEFAULT):
    space = F.when(distance_ == 0, 1.0).otherwise(0.6)
    time = F.greatest(F.lit(0.0), 1.0 - (gap - lo) / F.greatest(F.lit(1.0), (hi - lo).cast("double")))
    above = F.when(lift > 0, F.least(F.lit(1.0), lift / 1.5)).otherwise(0.0)
    return round_exact(p.w_space * space + p.w_time * time + p.w_lift * above, 4)


def _bucketed(df: DataFrame, lo, hi, width: int) -> DataFrame:
    return df.withColumn("_b0", F.floor(lo / width)).withColumn(
        "_b", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))


def nearby_pairs(episodes: DataFrame, edges: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Directed episode pairs a plausible edge allows: ring, categories and overlapping reach.
    Join keys are (cell, category, time bucket); the first shared bucket keeps a pair once."""
    width = max(edges.agg(F.max("max_gap_sec")).first()[0], 3600)
    e = episodes.select("episode_id", "h3_cell", "category", "rep_t", "last_t")
    a = (e.join(edges, e["category"] == edges["cause"])
         .select(F.col("episode_id").alias("i"), F.col("h3_cell").alias("cell_i"), "cause", "effect", "min_gap_sec", "max_gap_sec",
                 F.explode(ring(F.col("h3_cell"), p.link_max_distance)).alias("h3_cell"),
                 (F.col("rep_t") + F.col("min_gap_sec")).alias("_lo"), (F.col("last_t") + F.col("max_gap_sec")).alias("_hi")))
    a = _bucketed(a, F.col("_lo"), F.col("_hi"), width).withColumnRenamed("_b0", "_a0")
    b = _bucketed(e.select(F.col("episode_id").alias("j"), "h3_cell", F.col("category").alias("effect"), "rep_t", "last_t"),
                  F.col("rep_t"), F.col("last_t"), width)
    d = a.join(b, ["h3_cell", "effect", "_b"]).filter(
        (F.col("_b") == F.greatest("_a0", "_b0")) & (F.col("last_t") >= F.col("_lo")) & (F.col("rep_t") <= F.col("_hi")))
    return d.select("i", "j", "cause", "effect", "min_gap_sec", "max_gap_sec",
                    distance(F.col("cell_i"), F.col("h3_cell")).alias("distance"))


def best_event_pairs(pairs: DataFrame, seconds: DataFrame) -> DataFrame:
    """Per pair the smallest gap inside its window and the two events that show it; among equal
    gaps the earliest cause event, then the earliest effect event. For every effect second only
    the latest cause second can matter, so this is an as-of lookup."""
    k = ["i", "j"]
    a = seconds.select(F.col("episode_id").alias("i"), "t", F.col("event_id").alias("ea"))
    b = seconds.select(F.col("episode_id").alias("j"), "t", F.col("event_id").alias("eb"))
    points = pairs.select(*k).join(a, "i")
    probes = (pairs.select(*k, "min_gap_sec", "max_gap_sec").join(b, "j")
              .withColumn("t", F.col("t") - F.col("min_gap_sec")))
    width = pairs.agg(F.max("max_gap_sec")).first()[0] or 1
    h = latest_within(probes, points, k, "t", ["ea"], width).filter("hit is not null")
    gap = F.col("t") + F.col("min_gap_sec") - F.col("hit.t")
    h = h.withColumn("gap", gap).filter(F.col("gap") <= F.col("max_gap_sec"))
    best = h.groupBy(*k).agg(F.min(F.struct(
        "gap", F.col("hit.t").alias("ta"), F.col("hit.ea").alias("ea"),
        (F.col("t") + F.col("min_gap_sec")).alias("tb"), "eb")).alias("m"))
    return best.select(*k, F.col("m.gap").alias("gap_sec"), F.col("m.ea").alias("cause_event_id"),
                       F.col("m.eb").alias("effect_event_id"), F.col("m.ta").alias("cause_t"), F.col("m.tb").alias("effect_t"))


def candidate_links(episodes: DataFrame, seconds: DataFrame, edges: DataFrame, lift: DataFrame,
                    p: Params = DEFAULT) -> DataFrame:
    pairs = nearby_pairs(episodes, edges, p)
    d = pairs.join(best_event_pairs(pairs, seconds), ["i", "j"])
    d = d.join(lift.select("cause", "effect", "value"), ["cause", "effect"], "left")
    value = F.coalesce("value", F.lit(1.0))
    d = d.withColumn("lift_value", value).filter(value >= p.link_min_lift)
    return d.select("i", "j", "cause", "effect", "distance", "gap_sec",
                    score(F.col("distance"), F.col("gap_sec"), F.col("min_gap_sec"), F.col("max_gap_sec"), F.col("lift_value"), p).alias("score"),
                    "lift_value", "cause_event_id", "effect_event_id", "cause_t", "effect_t")


def best_link_per_pair(links: DataFrame) -> DataFrame:
    """The strongest link of each unordered pair; first of (-score, i, j) on a tie."""
    a, b = F.least("i", "j"), F.greatest("i", "j")
    s = F.struct((-F.col("score")).alias("s"), "i", "j")
    return links.groupBy(a.alias("a"), b.alias("b")).agg(
        F.min_by(F.struct("i", "j", "cause", "effect", "score"), s).alias("m")).select("a", "b", "m.*")


# ------------------------------------------------------------------ components -------------
def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(episode_id, component): the smallest id reachable over undirected links.

    Each round every node points to the smallest of itself and its neighbours, pointers are
    followed to their ends twice over, and the graph is contracted to the pointed-to nodes; so
    links and nodes shrink from round to round. The pointer tables of all rounds are then composed
    from the last to the first. Every round is written to the shared folder."""
    g = links.select(F.col("i").alias("u"), F.col("j").alias("w"))
    g = stage(g.unionByName(g.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct(), "cc-graph")
    rounds = []
    while g.limit(1).count():  # each round leaves fewer nodes
        ptr = g.groupBy("u").agg(F.min("w").alias("p")).select("u", F.least("u", "p").alias("p"))
        for _ in range(2):
            ptr = _follow(ptr, ptr)
        ptr = stage(ptr, "cc-pointers")
        rounds.append(ptr)
        left = g.join(ptr, "u").select(F.col("p").alias("a"), "w")
        g = (left.join(ptr, left["w"] == ptr["u"]).select(F.col("a").alias("u"), F.col("p").alias("w"))
             .filter("u <> w").distinct())
        g = stage(g, "cc-graph")
    if not rounds:
        return nodes.select("episode_id", F.col("episode_id").alias("component"))
    found = rounds[-1]
    for ptr in reversed(rounds[:-1]):
        found = _follow(ptr, found)
    found = found.select(F.col("u").alias("episode_id"), F.col("p").alias("_root"))
    out = nodes.select("episode_id").join(found, "episode_id", "left")
    return stage(out.select("episode_id", F.coalesce("_root", "episode_id").alias("component")), "cc-components")


def _follow(ptr: DataFrame, onward: DataFrame, salts: int = 16) -> DataFrame:
    """Replace each pointer by where ``onward`` sends its target. Many nodes may share a target,
    so the lookup is salted; ``onward`` is reduced to targets that move before it is copied."""
    to = (onward.filter("u <> p").select(F.col("u").alias("p"), F.col("p").alias("_to"))
          .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    return (ptr.withColumn("_salt", F.pmod(F.xxhash64("u"), F.lit(salts)).cast("int")).join(to, ["p", "_salt"], "left")
            .select("u", F.coalesce("_to", "p").alias("p")))


# ------------------------------------------------------------------ evidence ---------------
def anchors(episodes: DataFrame, links: DataFrame) -> DataFrame:
    """Anchor event of each episode: effect event of its closest incoming link (then higher
    score, then lower id); without one, its own earliest event."""
    inc = links.groupBy(F.col("j").alias("episode_id")).agg(F.min_by(
        F.struct(F.col("effect_event_id").alias("e"), F.col("effect_t").alias("t")),
        F.struct("gap_sec", (-F.col("score")).alias("s"), "i")).alias("a"))
    return episodes.join(inc, "episode_id", "left").select(
        "episode_id", F.coalesce("a.e", "rep_event_id").alias("anchor_event_id"), F.coalesce("a.t", "rep_t").alias("anchor_t"))


def prune_evidence(members: DataFrame, anchor: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Member events within one window length of their episode's anchor."""
    return members.join(anchor, "episode_id").filter(F.abs(F.col("t") - F.col("anchor_t")) <= p.window_sec)


def resolved_episodes(pruned: DataFrame) -> DataFrame:
    return pruned.groupBy("episode_id", "h3_cell", "category", "anchor_event_id", "anchor_t").agg(
        F.count("*").alias("n_events"), F.sum(F.col("severity").cast(SEV)).cast("double").alias("severity_weighted"),
        F.array_sort(F.collect_set("source")).alias("source_feeds"))


def eligible_components(components: DataFrame, episodes: DataFrame, edges: DataFrame, cats: DataFrame,
                        p: Params = DEFAULT) -> DataFrame:
    """Components that become situations: linked ones, and lone episodes that can start a chain,
    are discrete incidents and weigh enough."""
    size = components.groupBy("component").agg(F.count("*").alias("size"))
    roots = edges.select(F.col("cause").alias("category")).distinct().withColumn("root", F.lit(True))
    lone = (episodes.join(roots, "category", "left").join(cats.select("category", "rare_eligible"), "category", "left")
            .select(F.col("episode_id").alias("component"),
                    (F.coalesce("root", F.lit(False)) & F.coalesce("rare_eligible", F.lit(False))
                     & (F.col("severity_weighted") >= p.standalone_min_severity)).alias("ok")))
    return (size.join(lone, "component").filter((F.col("size") > 1) | F.col("ok"))
            .select("component", "size", (F.col("size") == 1).alias("standalone")))


# ------------------------------------------------------------------ near misses ------------
def near_miss_pairs(episodes: DataFrame, components: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Unordered episode pairs of different components, close in space and possibly in time."""
    width = max(p.near_max_gap_sec, 3600)
    e = episodes.join(components, "episode_id").select("episode_id", "component", "h3_cell", "category", "rep_t", "last_t")
    a = e.select(F.col("episode_id").alias("i"), F.col("component").alias("_ci"), F.col("category").alias("category_i"),
                 F.col("h3_cell").alias("cell_i"), F.explode(ring(F.col("h3_cell"), p.near_max_distance)).alias("cell_j"),
                 (F.col("rep_t") - p.near_max_gap_sec).alias("_lo"), (F.col("last_t") + p.near_max_gap_sec).alias("_hi"))
    a = _bucketed(a, F.col("_lo"), F.col("_hi"), width).withColumnRenamed("_b0", "_a0")
    b = _bucketed(e.select(F.col("episode_id").alias("j"), F.col("component").alias("_cj"), F.col("category").alias("category_j"),
                           F.col("h3_cell").alias("cell_j"), "rep_t", "last_t"), F.col("rep_t"), F.col("last_t"), width)
    d = a.join(b, ["cell_j", "_b"]).filter(
        (F.col("i") < F.col("j")) & (F.col("_ci") != F.col("_cj")) & (F.col("_b") == F.greatest("_a0", "_b0"))
        & (F.col("last_t") >= F.col("_lo")) & (F.col("rep_t") <= F.col("_hi")))
    return d.select("i", "j", "category_i", "category_j", "cell_i", "cell_j",
                    distance(F.col("cell_i"), F.col("cell_j")).alias("distance"))


def closest_gaps(pairs: DataFrame, seconds: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Signed gap (second minus first) of the closest two events of a pair, when within reach."""
    k = ["i", "j"]
    a = pairs.select(*k).join(seconds.select(F.col("episode_id").alias("i"), "t"), "i")
    b = pairs.select(*k).join(seconds.select(F.col("episode_id").alias("j"), "t"), "j")
    hits = [latest_within(a, b, k, "t", [], p.near_max_gap_sec, reverse=r) for r in (False, True)]
    both = hits[0].unionByName(hits[1]).filter("hit is not null").withColumn("gap", F.col("hit.t") - F.col("t"))
    return both.groupBy(*k).agg(F.min_by("gap", F.struct(F.abs("gap"), "t", "hit.t")).alias("gap"))


def rejection_reason(d: DataFrame, edges: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Why a close pair did not link, in both languages; the forward direction is tried first."""
    def side(x, y, tag):
        return edges.select(F.col("cause").alias(x), F.col("effect").alias(y),
                            F.struct("min_gap_sec", "max_gap_sec").alias(tag))
    d = d.join(side("category_i", "category_j", "_fw"), ["category_i", "category_j"], "left")
    d = d.join(side("category_j", "category_i", "_bw"), ["category_i", "category_j"], "left")
    fw = F.col("_fw").isNotNull()
    e = F.coalesce("_fw", "_bw")
    cause, effect = F.when(fw, F.col("category_i")).otherwise(F.col("category_j")), F.when(fw, F.col("category_j")).otherwise(F.col("category_i"))
    gap = F.when(fw, F.col("gap")).otherwise(-F.col("gap"))
    dist = F.col("distance").cast("string")
    mins = F.bround(e["max_gap_sec"] / 60, 0).cast("bigint").cast("string")
    none, far, early = e.isNull(), F.col("distance") > p.link_max_distance, gap < e["min_gap_sec"]
    ci, cj = F.col("category_i"), F.col("category_j")
    t = lambda *x: F.concat(*[F.lit(z) if isinstance(z, str) else z for z in x])
    # fixed values: the published sentences
    en = (F.when(none, t(ci, " and ", cj, " overlapped in time and space but this category pair is not in the plausibility table"))
          .when(far, t(cause, " and ", effect, " fit the expected time gap but the areas are ", dist, " apart, not adjacent"))
          .when(early, t(effect, " showed up before ", cause, " would plausibly cause it"))
          .otherwise(t(cause, " and ", effect, " are more than ", mins, " minutes apart, outside the usual window")))
    hi = (F.when(none, t(ci, " और ", cj, " समय और स्थान में साथ थे लेकिन यह जोड़ी प्रशंसनीयता तालिका में नहीं है"))
          .when(far, t(cause, " और ", effect, " का समय अंतर ठीक है लेकिन क्षेत्र सटे हुए नहीं हैं (", dist, " दूर)"))
          .when(early, t(effect, ", ", cause, " के असर में आने से पहले ही दिख गया"))
          .otherwise(t(cause, " और ", effect, " के बीच ", mins, " मिनट से ज़्यादा का अंतर है")))
    return d.withColumn("reason_en", en).withColumn("reason_hi", hi).drop("_fw", "_bw")


def rejected(episodes: DataFrame, components: DataFrame, seconds: DataFrame, edges: DataFrame,
             p: Params = DEFAULT) -> DataFrame:
    """Close pairs that did not link, one row each, with when the later of their windows has closed. The id
    hashes both episodes' sorted anomaly ids, which stream through the hash; a row has none of them
    (``rejected_documents`` has them in pages)."""
    pairs = near_miss_pairs(episodes, components, p)
    d = pairs.join(closest_gaps(pairs, seconds, p), ["i", "j"])
    d = stage(rejection_reason(d, edges, p), "near-misses")
    ends = lambda k: episodes.select(F.col("episode_id").alias(k), F.col("window_end_utc").alias(f"_{k}"))
    keys = set_keys(_pair_members(d, episodes), ["i", "j"], "anomaly_id", "REJ-", 8, "rejected_id")
    d = d.join(keys, ["i", "j"]).join(ends("i"), "i").join(ends("j"), "j")
    return d.select(
        "rejected_id", F.array_sort(F.array_distinct(F.array("category_i", "category_j"))).alias("categories"),
        F.array_sort(F.array_distinct(F.array("cell_i", "cell_j"))).alias("h3_cells"),
        F.abs("gap").alias("gap_sec"), F.col("distance").alias("grid_distance"), "reason_en", "reason_hi", "i", "j", F.greatest("_i", "_j").alias("reveal_utc"))


def _pair_members(pairs: DataFrame, episodes: DataFrame) -> DataFrame:
    """(i, j, anomaly_id) of pairs of episodes."""
    of = lambda k: episodes.select(F.col("episode_id").alias(k), "anomaly_ids")
    sides = [pairs.select("i", "j").join(of(k), k).select("i", "j", F.explode("anomaly_ids").alias("anomaly_id")) for k in ("i", "j")]
    return sides[0].unionByName(sides[1])


def rejected_documents(rejected_: DataFrame, episodes: DataFrame, page_size: int = PAGE) -> DataFrame:
    """Rejected links as they are sunk, one row a page of their anomaly ids (``scale.id_pages``)."""
    members = _pair_members(rejected_, episodes).join(rejected_.select("i", "j", "rejected_id"), ["i", "j"]).select("rejected_id", "anomaly_id")
    d = rejected_.drop("i", "j", "reveal_utc").join(id_pages(members, "rejected_id", "anomaly_id", page_size), "rejected_id")
    return ids.with_public(d.withColumnRenamed("ids", "anomaly_ids"))


# ------------------------------------------------------------------ edge-table helpers -----
def successors(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("cause").alias("category")).agg(F.array_sort(F.collect_set("effect")).alias("successors"))


def predecessors(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("effect").alias("category")).agg(F.array_sort(F.collect_set("cause")).alias("predecessors"))


def pair_facts(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b) with ``related`` (an edge either way), and the window and reasons of the edge a to b."""
    e = edges.select(F.col("cause").alias("a"), F.col("effect").alias("b"), "min_gap_sec", "max_gap_sec", "why_en", "why_hi")
    back = edges.select(F.col("cause").alias("b"), F.col("effect").alias("a"), F.lit(True).alias("_back"))
    d = pairs.select("a", "b").distinct().join(e, ["a", "b"], "left").join(back, ["a", "b"], "left")
    return d.withColumn("related", F.col("min_gap_sec").isNotNull() | F.col("_back").isNotNull()).drop("_back")
