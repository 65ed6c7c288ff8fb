"""What was known at time t: reveal, partial views, roll-ups, deltas, lineage."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import ids, severity as sv, text as tx, times
from ..params import DEFAULT, Params
from .scale import one_row, rank_in, with_scalars

# fixed values: the sentences of this module, and its thresholds 60, -2, 2 and 0.5 for terrain and water, are the published ones
CHUNK = DEFAULT.step_sec  # seconds of one situation that a task sorts


def at(t) -> Column:
    """A time given as ISO text, epoch seconds or a Column."""
    if isinstance(t, Column):
        return t
    return F.timestamp_seconds(F.lit(t)) if isinstance(t, int) else F.to_timestamp(F.lit(t), times.ISO)


# ------------------------------------------------------------------ events -----------------
def revealed_events(events: DataFrame, t) -> DataFrame:
    """Events started by t; a store partitioned by ``date`` is read up to that day."""
    d = events.filter(F.col("start_utc") <= at(t))
    return d.filter(F.col("date") <= F.to_date(at(t))) if "date" in events.columns else d


def active_events(events: DataFrame, t, p: Params = DEFAULT) -> DataFrame:
    return revealed_events(events, t).filter(
        F.col("end_utc").isNull() | (times.epoch(F.col("end_utc")) >= times.epoch(at(t)) - p.active_window_sec))


def delayed_events(events: DataFrame, t, delays: DataFrame) -> DataFrame:
    """Events of a delayed feed appear ``delay_sec`` later. ``delays``: one row per feed."""
    d = events.join(delays.select(F.col("feed").alias("source"), "delay_sec"), "source", "left")
    return d.filter(times.epoch(F.col("start_utc")) + F.coalesce("delay_sec", F.lit(0)) <= times.epoch(at(t))).drop("delay_sec")


def delayed_milestones(ms: DataFrame, delays: DataFrame) -> DataFrame:
    """Members of a delayed feed are confirmed ``delay_sec`` later."""
    d = ms.join(delays.select(F.col("feed").alias("source"), "delay_sec"), "source", "left")
    later = F.timestamp_seconds(times.epoch(F.col("milestone")) + F.coalesce("delay_sec", F.lit(0)))
    return d.withColumn("milestone", later).select(*ms.columns)


def duplicate_message(events: DataFrame, t) -> DataFrame:
    """A re-served event: same id, seen now, tagged."""
    return events.withColumn("received_at", at(t)).withColumn("is_duplicate", F.lit(True))


# ------------------------------------------------------------------ milestones -------------
def event_window_end(anomaly_members: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Latest window end over the anomalies that hold an event."""
    return (anomaly_members.join(anomalies.select("anomaly_id", "window_end_utc"), "anomaly_id")
            .groupBy("event_id").agg(F.max("window_end_utc").alias("window_end_utc")))


def milestones(sit_members: DataFrame, window_ends: DataFrame) -> DataFrame:
    """When each member event is confirmed: its last window end, else its own start."""
    d = sit_members.join(window_ends, "event_id", "left")
    return d.withColumn("milestone", F.coalesce("window_end_utc", "start_utc")).drop("window_end_utc")


def number_milestones(ms: DataFrame) -> DataFrame:
    return rank_in(ms, ["situation_id"], ["milestone", "event_id"], F.floor(times.epoch(F.col("milestone")) / CHUNK), "n")


def reveal_times(ms: DataFrame, situations: DataFrame) -> DataFrame:
    """Time of the second milestone; a lone member waits for creation. Two plain aggregates: the
    first milestone, then the smallest after it."""
    first = ms.groupBy("situation_id").agg(F.min(F.struct("milestone", "event_id")).alias("_f"))
    second = (ms.join(first, "situation_id").filter(F.struct("milestone", "event_id") > F.col("_f"))
              .groupBy("situation_id").agg(F.min("milestone").alias("_second")))
    return (situations.select("situation_id", "created_utc").join(second, "situation_id", "left")
            .select("situation_id", F.coalesce("_second", "created_utc").alias("reveal_utc")))


# ------------------------------------------------------------------ situations as of t ------
def partial_situations(situations: DataFrame, ms: DataFrame, reveals: DataFrame, t) -> DataFrame:
    """Situations revealed by t, each reduced to the members confirmed by t. Fully confirmed ones
    keep their final scores. ``ms`` carries severity, confidence, source and category."""
    cut = at(t)
    seen = F.col("milestone") <= cut
    shown = reveals.filter(F.col("reveal_utc") <= cut)
    a = ms.join(shown, "situation_id", "left_semi").groupBy("situation_id").agg(
        F.count("*").alias("partial_of"), F.count(F.when(seen, 1)).alias("members_known"),
        F.max(F.when(seen, F.col("severity"))).alias("_sev"),
        (F.sum(F.when(seen, F.col("confidence").cast("decimal(9,4)"))).cast("double") / F.count(F.when(seen, 1))).alias("_conf"),
        F.array_compact(F.collect_set(F.when(seen, F.col("source")))).alias("_src"),
        F.array_sort(F.array_compact(F.collect_set(F.when(seen, F.col("category"))))).alias("known_categories"),
        F.size(F.collect_set("category")).alias("_ncat"))
    return _as_known(situations.join(shown, "situation_id").join(a, "situation_id"))


def _as_known(d: DataFrame) -> DataFrame:
    """Scores by what is known of a situation's members."""
    partial = F.col("members_known") < F.col("partial_of")
    pulse = F.when(F.col("members_known") == 0, 0).otherwise(sv.pulse(F.col("_sev"), F.col("_conf"), F.size("_src")))
    share = F.size("known_categories") / F.col("_ncat")
    level = (F.when((share < 0.5) & (F.col("confidence_level") == "high"), "med")
             .when(share < 0.35, "low").otherwise(F.col("confidence_level")))
    return (d.withColumn("partial", partial)
            .withColumn("pulse_score", F.when(partial, pulse).otherwise(F.col("pulse_score")))
            .withColumn("alert_level", F.when(partial, sv.alert_level(F.col("pulse_score"))).otherwise(F.col("alert_level")))
            .withColumn("confidence_level", F.when(partial, level).otherwise(F.col("confidence_level")))
            .drop("_sev", "_conf", "_src", "_ncat"))


def partial_situations_at(situations: DataFrame, ms: DataFrame, reveals: DataFrame, deltas: DataFrame, spans: DataFrame) -> DataFrame:
    """``partial_situations`` at the ``clock`` of every row of ``deltas`` (situation_id, clock) at once: members
    become a row a situation and tick (``spans``, see ``deltas_of_ticks``), and what is known is added up over a situation's ticks."""
    asked = deltas.select("situation_id", "clock").distinct()
    mine = ms.join(asked.select("situation_id").distinct(), "situation_id", "left_semi")
    total = mine.groupBy("situation_id").agg(F.count("*").alias("partial_of"), F.size(F.collect_set("category")).alias("_ncat"))
    edge = with_scalars(mine, spans.agg(F.min("prev").alias("_from")))
    before = edge.filter(times.epoch(F.col("milestone")) <= F.col("_from")).withColumn("clock", F.col("_from"))
    seen = before.drop("_from").unionByName(in_spans(mine, "milestone", spans).drop("prev"))
    per = seen.groupBy("situation_id", "clock").agg(
        F.count("*").alias("n"), F.max("severity").alias("sev"), F.sum(F.col("confidence").cast("decimal(9,4)")).alias("conf"),
        F.collect_set("source").alias("src"), F.collect_set("category").alias("cat"))
    per = per.join(asked.withColumn("_asked", F.lit(True)), ["situation_id", "clock"], "full")
    so_far = Window.partitionBy("situation_id").orderBy("clock").rowsBetween(Window.unboundedPreceding, 0)
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c).over(so_far))))
    n = F.coalesce(F.sum("n").over(so_far), F.lit(0).cast("bigint"))
    a = per.select("situation_id", "clock", "_asked", n.alias("members_known"), F.max("sev").over(so_far).alias("_sev"),
                   (F.sum("conf").over(so_far).cast("double") / n).alias("_conf"), sets("src").alias("_src"), sets("cat").alias("known_categories"))
    a = a.filter("_asked").drop("_asked").join(total, "situation_id")
    return _as_known(situations.join(reveals, "situation_id").join(a, "situation_id"))


def partial_predictions(partials: DataFrame, edges: DataFrame, n: int = 2) -> DataFrame:
    """Unobserved successors of the known categories with the reason, first ``n`` by
    (trigger, successor). At most one row per category and situation enters the window."""
    known = partials.filter("partial").select("situation_id", "known_categories", F.explode("known_categories").alias("cause"))
    c = known.join(edges, "cause").filter(~F.array_contains("known_categories", F.col("effect")))
    c = c.groupBy("situation_id", "effect").agg(F.min_by(F.struct("cause", "why_en", "why_hi"), "cause").alias("m"))
    w = Window.partitionBy("situation_id").orderBy("m.cause", "effect")
    return (c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        "situation_id", "rank", F.col("effect").alias("category"), F.col("m.cause").alias("trigger_category"),
        F.col("m.why_en").alias("plausible_because_en"), F.col("m.why_hi").alias("plausible_because_hi")))


def stopped_situations(sit_members: DataFrame, stopped: DataFrame) -> DataFrame:
    """Situations holding a member event of a stopped feed, with the feeds concerned."""
    hit = sit_members.join(stopped.select(F.col("feed").alias("source")), "source", "left_semi")
    return hit.groupBy("situation_id").agg(F.array_sort(F.collect_set("source")).alias("stopped_feeds"))


def apply_stopped(situations: DataFrame, sit_members: DataFrame, stopped: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Confidence one level down and a fixed pulse penalty while a member's feed is stopped;
    dropping the feed from ``stopped`` undoes it."""
    d = situations.join(stopped_situations(sit_members, stopped), "situation_id", "left")
    hit = F.col("stopped_feeds").isNotNull()
    names = F.array_join("stopped_feeds", " and ")
    lower = F.when(F.col("confidence_level") == "high", "med").otherwise("low")
    pulse = F.when(hit, F.greatest(F.lit(0), F.col("pulse_score") - p.stopped_pulse_penalty)).otherwise(F.col("pulse_score"))
    return (d.withColumn("confidence_level", F.when(hit, lower).otherwise(F.col("confidence_level")))
            .withColumn("confidence_reason_en", F.when(hit, F.concat(names, F.lit(" feed stopped — confidence lowered"))).otherwise(F.col("confidence_reason_en")))
            .withColumn("confidence_reason_hi", F.when(hit, F.concat(names, F.lit(" फीड बंद — भरोसा कम किया गया"))).otherwise(F.col("confidence_reason_hi")))
            .withColumn("pulse_score", pulse)
            .withColumn("alert_level", F.when(hit, sv.alert_level(F.col("pulse_score"))).otherwise(F.col("alert_level"))))


def rejected_as_of(rejected: DataFrame, t=None) -> DataFrame:
    """A rejected link shows once every window it considered has closed."""
    return rejected if t is None else rejected.filter(F.col("reveal_utc") <= at(t))


def anomalies_as_of(anomalies: DataFrame, t) -> DataFrame:
    return anomalies.filter(F.col("window_end_utc") <= at(t))


# ------------------------------------------------------------------ roll-ups ----------------
def _shown(situations: DataFrame) -> DataFrame:
    return situations.filter((F.col("status") == "active") & ~F.col("is_decoy"))


def city_rollup(situations: DataFrame) -> DataFrame:
    d = _shown(situations).agg(F.coalesce(F.max("pulse_score"), F.lit(0)).alias("pulse_score"))
    return d.withColumn("alert_level", sv.alert_level(F.col("pulse_score")))


def cell_rollup(situations: DataFrame) -> DataFrame:
    d = _shown(situations).select(F.explode("h3_cells").alias("h3_cell"), "pulse_score")
    d = d.groupBy("h3_cell").agg(F.max("pulse_score").alias("pulse_score"))
    return d.withColumn("alert_level", sv.alert_level(F.col("pulse_score")))


def counts(events: DataFrame, situations: DataFrame, t, p: Params = DEFAULT) -> DataFrame:
    e = active_events(events, t, p).agg(F.count("*").alias("events_active"))
    act = situations.filter("status = 'active'")
    s = act.agg(F.count("*").alias("situations_active"))
    c = act.select(F.explode("h3_cells").alias("c")).agg(F.count_distinct("c").alias("cells_touched"))
    return one_row(e, s, c)


# ------------------------------------------------------------------ deltas ------------------
def new_events(events: DataFrame, prev, cur) -> DataFrame:
    return events.filter((F.col("start_utc") > at(prev)) & (F.col("start_utc") <= at(cur)))


def situation_deltas(reveals: DataFrame, ms: DataFrame, prev, cur) -> DataFrame:
    """(situation_id, action): created when the reveal falls in (prev, cur], updated when it was
    already shown and a further milestone falls there."""
    a, b = at(prev), at(cur)
    created = reveals.filter((F.col("reveal_utc") > a) & (F.col("reveal_utc") <= b)).select("situation_id", F.lit("created").alias("action"))
    hit = ms.filter((F.col("milestone") > a) & (F.col("milestone") <= b)).select("situation_id").distinct()
    updated = reveals.filter(F.col("reveal_utc") <= a).join(hit, "situation_id", "left_semi").select("situation_id", F.lit("updated").alias("action"))
    return created.unionByName(updated)


def in_spans(rows: DataFrame, t: str, spans: DataFrame) -> DataFrame:
    """Rows with the span (prev, clock] of epoch seconds that holds their time ``t``; rows in none go. Spans don't meet,
    so blocks as long as the mean span are met by two spans each on average, and no row is tried against all."""
    edge = spans.agg(F.min("prev").alias("_lo"), F.greatest(F.lit(1), F.floor((F.max("clock") - F.min("prev")) / F.count("*"))).alias("_size"))
    block = lambda c: F.floor((F.col(c) - F.col("_lo")) / F.col("_size"))
    cut = with_scalars(spans, edge).withColumn("_b", F.explode(F.sequence(block("prev"), block("clock")))).select("prev", "clock", "_b")
    d = with_scalars(rows.withColumn("_t", times.epoch(F.col(t))), edge).withColumn("_b", block("_t"))
    return d.join(cut, "_b").filter((F.col("_t") > F.col("prev")) & (F.col("_t") <= F.col("clock"))).select(*rows.columns, "prev", "clock")


def deltas_of_ticks(reveals: DataFrame, ms: DataFrame, spans: DataFrame) -> DataFrame:
    """(situation_id, action, clock): ``situation_deltas`` of many ticks at once. ``spans`` (prev, clock), epoch
    seconds, are the ticks' spans, which follow one another."""
    created = in_spans(reveals, "reveal_utc", spans).select("situation_id", F.lit("created").alias("action"), "clock")
    hit = in_spans(ms.select("situation_id", "milestone"), "milestone", spans).select("situation_id", "prev", "clock").distinct()
    shown = reveals.select("situation_id", times.epoch(F.col("reveal_utc")).alias("_shown"))
    updated = hit.join(shown, "situation_id").filter(F.col("_shown") <= F.col("prev")).select("situation_id", F.lit("updated").alias("action"), "clock")
    return created.unionByName(updated)


# ------------------------------------------------------------------ expansion and text ------
def member_events(sit_members: DataFrame) -> DataFrame:
    """Members in start order, numbered."""
    return rank_in(sit_members, ["situation_id"], ["start_utc", "event_id"], F.floor(times.epoch(F.col("start_utc")) / CHUNK), "n")


def detail(situations: DataFrame) -> DataFrame:
    return situations.withColumn("framing_text", F.lit(v.FRAMING_EN)).withColumn("framing_text_hi", F.lit(v.FRAMING_HI))


def event_message(events: DataFrame, t) -> DataFrame:
    """type, sent_utc and the 14-field payload as JSON."""
    data = F.struct("event_id", "source", "category", "h3_cell", "lat", "lon", times.iso(F.col("start_utc")).alias("start_utc"),
                    times.iso(F.col("end_utc")).alias("end_utc"), "severity", "confidence",
                    times.iso(F.col("received_at")).alias("received_at"), "freshness_sec", "is_simulated", "raw_ref")
    return events.select(F.lit("event").alias("type"), times.iso(at(t)).alias("sent_utc"),
                         F.to_json(data, {"ignoreNullFields": "false"}).alias("data"), "event_id")


SITUATION_FIELDS = ("situation_id", "status", "pulse_score", "alert_level", "headline_en", "headline_hi", "h3_cells", "confidence_level",
                    "confidence_reason_en", "confidence_reason_hi", "is_decoy", "partial", "members_known", "partial_of")


def _message(rows: DataFrame, kind: str, t, fields, *more) -> DataFrame:
    """type, sent_utc, ``more`` and the payload of ``fields`` as JSON, times as text."""
    times_ = {f.name for f in rows.schema.fields if f.dataType.typeName() == "timestamp"}
    data = F.struct(*[(times.iso(F.col(c)) if c in times_ else F.col(c)).alias(c) for c in fields])
    return rows.select(F.lit(kind).alias("type"), times.iso(at(t)).alias("sent_utc"), *more, F.to_json(data, {"ignoreNullFields": "false"}).alias("data"))


def situation_message(shown: DataFrame, deltas: DataFrame, t, by=()) -> DataFrame:
    """A message for each situation created or updated: the situation as far as it is known at t.
    ``shown`` are partial situations (with any stopped feeds applied), ``deltas`` their actions, both by
    whole key, which ``situation_id`` holds beside the payload, and by the columns ``by``; the payload has the shown id."""
    d = shown.join(deltas, ["situation_id", *by]).withColumn("_key", F.col("situation_id"))
    d = ids.with_public(d)
    return _message(d, "situation", t, [c for c in SITUATION_FIELDS if c in d.columns], "action", F.col("_key").alias("situation_id"), *by)


def feedhealth_message(changes: DataFrame, t) -> DataFrame:
    """A message for each feed whose state changed: its health row."""
    return _message(changes, "feedhealth", t, ("feed", "state", "last_record_utc", "age_sec", "interval_sec", "records_total", "records_dropped", "message"))


def tick_message(counts_: DataFrame, city: DataFrame, t, tick: int, speed: float, state: str = "playing") -> DataFrame:
    """The clock's message: counts and the city's level at t."""
    c = city.select(F.col("pulse_score").alias("city_pulse_score"), F.col("alert_level").alias("city_alert_level"))
    d = one_row(counts_.select("events_active", "situations_active"), c)
    d = d.select(at(t).alias("sim_time_utc"), F.lit(tick).alias("tick"), F.lit(float(speed)).alias("speed"), F.lit(state).alias("state"), "*")
    return _message(d, "tick", t, d.columns)


# ------------------------------------------------------------------ raw viewer --------------
def latest_records(raw: DataFrame, feed: str, t, n: int = 50, tie: str = "seq") -> DataFrame:
    """Newest n records per feed as of t. The rank filter becomes a per-task group limit before
    the shuffle, so a dominant feed sends n rows per task."""
    if not 1 <= n <= 500:
        raise ValueError("n must be 1..500")
    w = Window.partitionBy(feed).orderBy(F.desc("t_utc"), F.desc(tie))
    d = raw if t is None else raw.filter(F.col("t_utc") <= at(t))
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def raw_view(raw: DataFrame, feed: str, t, n: int = 50) -> DataFrame:
    """Latest records of one feed, masked, with the number of masked items. ``raw`` carries the
    literal record in ``raw`` when the feed is text."""
    d = latest_records(raw.withColumn("_feed", F.lit(feed)), "_feed", t, n).drop("_feed")
    return tx.mask_record(d, feed, "raw" if "raw" in d.columns else None)


# ------------------------------------------------------------------ lineage -----------------
EXACT, PREFIX, COVER = 0, 1, 2


def _prefixes(rows: DataFrame, ref: str, others: DataFrame, other: str) -> DataFrame:
    """``rows`` with each proper prefix ``k`` of a reference that still holds its entity part and goes as far beyond it
    as some reference of the other side; those lengths are few. A reference that is such a prefix has the same
    entity part, so the lengths of the entities' own names don't matter."""
    start = lambda c: F.greatest(F.instr(F.col(c), "@"), F.instr(F.col(c), ":")) + 1
    lengths = others.agg(F.sort_array(F.collect_set(F.length(other) - start(other))).alias("_lengths"))
    fit = F.filter("_lengths", lambda n: (n >= 0) & (n < F.length(ref) - start(ref)))
    return with_scalars(rows, lengths).withColumn("k", F.explode(F.transform(fit, lambda n: F.substring(F.col(ref), F.lit(1), n + start(ref))))).drop("_lengths")


def lineage(records: DataFrame, events: DataFrame, open_sec: int = 3600) -> DataFrame:
    """(record_id, event_id, kind): the event a raw record opened, else one whose reference
    extends or shortens it, else one of the same entity whose span covers the record's time.
    Prefixes and time blocks are join keys; ``records``: record_id, raw_ref, entity_ref, t (epoch)."""
    ev = events.select("event_id", F.col("raw_ref").alias("ev_ref"), times.epoch(F.col("start_utc")).alias("s"),
                       F.coalesce(times.epoch(F.col("end_utc")), times.epoch(F.col("start_utc")) + open_sec).alias("e"))
    rec = records.filter(F.col("raw_ref") != "")
    exact = rec.join(ev, rec["raw_ref"] == ev["ev_ref"]).select("record_id", "event_id", F.lit(EXACT).alias("kind"))
    longer = _prefixes(ev, "ev_ref", rec, "raw_ref")
    shorter = _prefixes(rec, "raw_ref", ev, "ev_ref")
    prefix = (rec.join(longer, rec["raw_ref"] == longer["k"]).select("record_id", "event_id")
              .unionByName(shorter.join(ev, shorter["k"] == ev["ev_ref"]).select("record_id", "event_id"))
              .distinct().withColumn("kind", F.lit(PREFIX)))
    # a span goes to blocks as long as itself (at most two); a record asks only the block sizes its
    # entity has, so a span costs two rows whatever its length
    spans = ev.withColumn("entity_ref", F.regexp_extract("ev_ref", "^[^@]*@", 0)).filter("entity_ref <> '' and e >= s")
    spans = spans.withColumn("_size", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("e") - F.col("s"), F.lit(60))))).cast("bigint"))
    blocks = spans.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor(F.col("s") / F.col("_size")), F.floor(F.col("e") / F.col("_size"))))))
    sizes = spans.select("entity_ref", "_size").distinct()
    cover = (rec.filter("entity_ref <> '' and t is not null").join(sizes, "entity_ref").withColumn("_b", F.floor(F.col("t") / F.col("_size")))
             .join(blocks, ["entity_ref", "_size", "_b"]).filter("t between s and e").select("record_id", "event_id", F.lit(COVER).alias("kind")))
    hits = exact.unionByName(prefix).unionByName(cover)
    best = F.min("kind").over(Window.partitionBy("record_id"))
    return hits.withColumn("_best", best).filter("kind = _best").select("record_id", "kind", "event_id")


# ------------------------------------------------------------------ feed and resident views -
def feed_rates(events: DataFrame, tick_sec: int = 1, ticks: int = 10) -> DataFrame:
    """Events per tick and feed, and the city-wide mean of the last ``ticks`` ticks per minute.
    Each tick total feeds the next ticks, so there is no global ordered window."""
    k = (F.floor(times.epoch(F.col("received_at")) / tick_sec)).alias("tick")
    per = events.groupBy(k, "source").agg(F.count("*").alias("n"))
    tot = per.groupBy("tick").agg(F.sum("n").alias("total"))
    edge = tot.agg(F.min("tick").alias("lo"), F.max("tick").alias("hi"))
    roll = (tot.withColumn("tick", F.explode(F.sequence(F.col("tick"), F.col("tick") + ticks - 1)))
            .groupBy("tick").agg(F.sum("total").alias("recent")))
    roll = with_scalars(roll, edge).filter("tick between lo and hi")
    rate = F.col("recent") / F.least(F.lit(ticks), F.col("tick") - F.col("lo") + 1)
    return (per.join(roll, "tick").select("tick", "source", "n", rate.alias("per_tick"),
                                          F.floor(rate * (60 / tick_sec) + F.lit(0.5)).alias("per_minute")))


def feed_alerts(situations: DataFrame, chain: DataFrame, cats: DataFrame) -> DataFrame:
    """Highest-pulse active situation per feed named by its chain."""
    d = (chain.select("situation_id", "category").distinct().join(cats.select("category", "feeds"), "category")
         .select("situation_id", F.explode("feeds").alias("feed")).distinct().join(_shown(situations), "situation_id"))
    return d.groupBy("feed").agg(F.max_by(F.struct("alert_level", "pulse_score"), F.struct("pulse_score", "situation_id")).alias("m")).select(
        "feed", "m.alert_level", "m.pulse_score")


def distinct_feeds(sit_members: DataFrame, chain: DataFrame, cats: DataFrame) -> DataFrame:
    """Feeds of a situation by member source, and by single-feed categories of its chain."""
    a = sit_members.groupBy("situation_id").agg(F.count_distinct("source").alias("feeds_by_source"))
    one = cats.filter(F.size("feeds") == 1).select("category", F.get("feeds", F.lit(0)).alias("feed"))
    b = chain.join(one, "category").groupBy("situation_id").agg(F.count_distinct("feed").alias("feeds_by_chain"))
    return a.join(b, "situation_id", "left").na.fill(0, ["feeds_by_chain"])


def _rank(level):
    return F.array_position(F.array(*[F.lit(x) for _, x in v.ALERT_CUTOFFS]), level)


def alert_transitions(updates: DataFrame, keep: int = 3, area: str = None) -> DataFrame:
    """``new`` for a first appearance, ``worse`` when the level rises; the newest ``keep`` stay.
    ``updates``: situation_id, t, seq, action, alert_level, label_en, status, is_decoy. Updates are
    numbered by chunks and each is joined to the one before it."""
    n = rank_in(updates, ["situation_id"], ["t", "seq"], F.floor(times.epoch(F.col("t")) / CHUNK), "_n")
    prev = n.select("situation_id", (F.col("_n") + 1).alias("_n"), F.col("alert_level").alias("_prev"))
    d = n.join(prev, ["situation_id", "_n"], "left").drop("_n")
    kind = F.when(F.col("action") == "created", "new").when(_rank(F.col("alert_level")) > _rank(F.col("_prev")), "worse")
    d = d.withColumn("kind", kind).filter("kind is not null and not is_decoy and status <> 'closed'")
    if area is not None:
        d = d.filter(F.contains("label_en", F.lit(area)))
    return d.orderBy(F.desc("t"), F.desc("seq"), "situation_id").limit(keep).drop("_prev")


def primary_situation(situations: DataFrame) -> DataFrame:
    """The most serious active situation: level, then pulse, then newest, then lowest id."""
    d = _shown(situations)
    key = F.struct((-_rank(F.col("alert_level"))).alias("l"), (-F.col("pulse_score")).alias("p"),
                   (-times.epoch(F.col("created_utc"))).alias("c"), "situation_id")
    return d.agg(F.min_by(F.struct("situation_id", "alert_level", "pulse_score"), key).alias("m")).select("m.*")


def visible(situations: DataFrame, area: str = None) -> DataFrame:
    d = situations.filter(~F.col("is_decoy"))
    if area is not None:
        d = d.filter(F.col("label_en") == area)
    return d.orderBy(F.desc("pulse_score"), "situation_id")


# ------------------------------------------------------------------ terrain and water -------
FLOOD = ("weather.rain", "complaint.waterlogging")


def flood_situations(chain: DataFrame) -> DataFrame:
    return chain.filter(F.col("category").isin(*FLOOD)).select("situation_id").distinct()


def _area_names(d: DataFrame) -> DataFrame:
    """Name of each cell of a situation: its landmark, else "one area" then "another area"."""
    w = Window.partitionBy("situation_id", F.col("landmark").isNull()).orderBy("pos")
    n = F.row_number().over(w)
    return d.withColumn("name", F.coalesce("landmark", F.when(n == 1, "one area").otherwise("another area")))


def terrain_context(situations: DataFrame, chain: DataFrame, terrain: DataFrame, names: DataFrame) -> DataFrame:
    """What the ground says about flood-type situations. ``terrain``: h3_cell, rel_m, flow_pct;
    ``names``: h3_cell, landmark. Groups hold a situation's cells only."""
    d = (situations.join(flood_situations(chain), "situation_id", "left_semi")
         .select("situation_id", F.posexplode("h3_cells").alias("pos", "h3_cell")).join(terrain, "h3_cell").join(names, "h3_cell", "left"))
    d = _area_names(d)
    drains, low, raised = F.col("flow_pct") >= 60, F.col("rel_m") <= -2, F.col("rel_m") >= 2
    m = F.round(F.abs("rel_m"), 0).cast("bigint").cast("string")
    text = (F.when(low & drains, F.concat("name", F.lit(" sits "), m, F.lit(" m below its surroundings on a drainage path")))
            .when(low, F.concat("name", F.lit(" sits "), m, F.lit(" m below its surroundings")))
            .when(drains, F.concat("name", F.lit(" is on a drainage path (more runoff than "), F.col("flow_pct").cast("bigint").cast("string"), F.lit("% of the city)")))
            .when(raised, F.concat("name", F.lit(" sits "), m, F.lit(" m above its surroundings")))
            .otherwise(F.concat("name", F.lit(" is level with its surroundings"))))
    a = d.withColumn("text", text).groupBy("situation_id").agg(
        F.count("*").alias("areas"), F.count(F.when(low | drains, 1)).alias("supporting"),
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_t"))
    verdict = (F.when(F.col("supporting") == F.col("areas"), "Terrain supports this")
               .when(F.col("supporting") == 0, "Terrain doesn't explain this: blocked drains or local low spots are more likely")
               .otherwise("Terrain only partly explains this: local drainage likely matters"))
    return a.select("situation_id", "areas", "supporting",
                    F.concat(verdict, F.lit(". "), F.array_join(F.col("_t.text"), "; "), F.lit(".")).alias("context"))


def frame_index(t, t0, n_frames, frame_sec: int):
    """Index of the frame covering t, clamped to [-1, n-1]."""
    return F.greatest(F.lit(-1), F.least(n_frames - 1, F.floor((times.epoch(t) - times.epoch(t0)) / frame_sec)))


def water_context(situations: DataFrame, chain: DataFrame, cells: DataFrame, names: DataFrame, when_text: Column) -> DataFrame:
    """Share over 10 cm and deepest water per situation. ``cells``: h3_cell, over10_pct,
    max_depth_cm of the frame looked up."""
    d = (situations.join(flood_situations(chain), "situation_id", "left_semi")
         .select("situation_id", F.posexplode("h3_cells").alias("pos", "h3_cell")).join(cells, "h3_cell", "left").join(names, "h3_cell", "left")
         .na.fill(0.0, ["over10_pct", "max_depth_cm"]))
    deep = d.groupBy("situation_id").agg(F.max("max_depth_cm").alias("deepest"))
    wet = _area_names(d.filter("over10_pct >= 0.5"))
    parts = wet.groupBy("situation_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", F.concat(F.floor(F.col("over10_pct") + F.lit(0.5)).cast("string"), F.lit("% of "), F.col("name")).alias("text")))).alias("_t"))
    a = deep.join(parts, "situation_id", "left")
    return a.select("situation_id", F.when(F.col("_t").isNull(), F.concat(F.lit("Rain model at "), when_text, F.lit(": no water over 10 cm in these areas.")))
                    .otherwise(F.concat(F.lit("Rain model at "), when_text, F.lit(": water over 10 cm on "), F.array_join(F.col("_t.text"), " and "),
                                        F.lit(" (deepest "), F.floor(F.col("deepest") + F.lit(0.5)).cast("string"), F.lit(" cm)."))).alias("context"))


