"""Situations: chain, evidence, confidence, headline and prediction per component."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, severity as sv, times
from ..functions.hexgrid import HexGrid, distance, spread, spread_aggs
from ..params import DEFAULT, Params
from . import places
from .scale import PAGE, id_pages, rank_in, set_keys
from ..functions.numbers import round_exact

CHUNK = DEFAULT.step_sec  # seconds of one situation that a task sorts


def _txt(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _s(c):
    return c.cast("string")


def situation_ids(eligible: DataFrame, components: DataFrame, episodes: DataFrame) -> DataFrame:
    """(component, standalone, situation_id, created_utc). The id hashes the sorted anomaly ids, its shown
    part their shown texts; they stream through the hash and never make one row (``scale.set_keys``)."""
    d = eligible.join(components, "component").join(episodes, "episode_id")
    facts = d.groupBy("component", "standalone").agg(F.max("window_end_utc").alias("created_utc"))
    members = d.select("component", F.explode("anomaly_ids").alias("anomaly_id"))
    return facts.join(set_keys(members, ["component"], "anomaly_id", "SIT-", 6, "situation_id"), "component")


def chain(resolved: DataFrame, keyed: DataFrame, phrases: DataFrame) -> DataFrame:
    """One step per episode by anchor time, then cell; texts compare a step with the one before."""
    d = keyed.select("situation_id", "episode_id").join(resolved, "episode_id")
    d = rank_in(d, ["situation_id"], ["anchor_t", "h3_cell", "episode_id"], F.floor(F.col("anchor_t") / CHUNK), "step")
    prev = d.select("situation_id", (F.col("step") + 1).alias("step"), F.col("anchor_t").alias("_pt"),
                    F.col("h3_cell").alias("_pc"), F.col("anchor_event_id").alias("from_event_id"))
    d = d.join(prev, ["situation_id", "step"], "left").join(phrases, "category", "left")
    gap = F.col("anchor_t") - F.col("_pt")
    mins = _s(F.greatest(F.lit(1), F.bround(gap / 60, 0).cast("bigint")))
    dist = distance(F.col("_pc"), F.col("h3_cell"))
    area_en = F.when(dist == 0, "at the same spot").when(dist == 1, "one area away").otherwise("a couple of areas away")
    area_hi = F.when(dist == 0, "उसी जगह").when(dist == 1, "एक क्षेत्र दूर").otherwise("कुछ क्षेत्र दूर")
    n, many = _s(F.col("n_events")), F.col("n_events") > 1
    then_en = F.concat(F.lower(F.substring("start_en", 1, 1)), F.expr("substring(start_en, 2)"))
    en = F.when(F.col("_pt").isNull(), F.concat("start_en", F.when(many, _txt(" (", n, " reports)")).otherwise(""))).otherwise(
        F.concat(_txt(mins, " minutes later, ", then_en, " ", area_en), F.when(many, _txt(", ", n, " reports")).otherwise("")))
    hi = F.when(F.col("_pt").isNull(), F.concat("start_hi", F.when(many, _txt(" (", n, " रिपोर्ट)")).otherwise(""))).otherwise(
        F.concat(_txt(mins, " मिनट बाद, ", area_hi, " ", F.col("then_hi")), F.when(many, _txt(", ", n, " रिपोर्ट")).otherwise("")))
    return d.select("situation_id", "step", F.col("anchor_event_id").alias("event_id"), F.col("anchor_t").alias("t"),
                    "category", "h3_cell", "n_events", en.alias("text_en"), hi.alias("text_hi"),
                    "from_event_id", gap.alias("gap_sec"))


def zone(members: DataFrame, grid: HexGrid) -> DataFrame:
    """Cells of a situation, label of its most severe cell, mean position, spread."""
    a = members.groupBy("situation_id").agg(
        F.array_sort(F.collect_set("h3_cell")).alias("h3_cells"),
        F.min_by("h3_cell", F.struct((-F.col("severity")).alias("s"), "episode_id", "event_id")).alias("label_cell"),
        round_exact(F.sum(F.col("lat").cast("decimal(10,5)")).cast("double") / F.count("*"), 5).alias("lat"),
        round_exact(F.sum(F.col("lon").cast("decimal(10,5)")).cast("double") / F.count("*"), 5).alias("lon"),
        *[x.alias(f"_s{i}") for i, x in enumerate(spread_aggs(F.col("h3_cell")))])
    a = a.withColumn("max_grid_distance", spread([F.col(f"_s{i}") for i in range(6)])).drop(*[f"_s{i}" for i in range(6)])
    a = places.zone_labels(a, "label_cell", grid)
    en, hi = places.with_nearby(F.col("zone_en"), F.col("zone_hi"), F.size("h3_cells"))
    return a.select("situation_id", "h3_cells", en.alias("label_en"), hi.alias("label_hi"), "lat", "lon", "max_grid_distance")


# fixed values: the sentences of this module are the published ones
def spatial_note(n_cells, max_d):
    n = _s(n_cells)
    en = (F.when(n_cells <= 1, "All reports came from the same area")
          .when(max_d <= 1, _txt("All ", n, " areas involved are adjacent to each other"))
          .when(max_d <= 2, _txt("The ", n, " areas involved are close but not adjacent"))
          .otherwise(_txt("Reports span ", n, " areas across the wider zone")))
    hi = (F.when(n_cells <= 1, "सभी रिपोर्ट एक ही क्षेत्र से आईं")
          .when(max_d <= 1, _txt("सभी ", n, " क्षेत्र आपस में सटे हुए हैं"))
          .when(max_d <= 2, _txt("शामिल ", n, " क्षेत्र पास हैं लेकिन सटे नहीं हैं"))
          .otherwise(_txt("रिपोर्ट व्यापक क्षेत्र के ", n, " इलाकों में फैली हैं")))
    return en, hi


def lift_note(cooccurrences, value, observed_rate, p: Params = DEFAULT):
    hrs = _s(F.bround(1 / observed_rate, 0).cast("bigint"))
    enough = cooccurrences >= p.lift_min_cooccurrences
    return (F.when(enough & (value >= p.lift_strong), F.when(
        observed_rate > 0, _txt("These normally appear together about once every ", hrs, " hours here"))
        .otherwise("These appear together more often than chance here"))
        .when(enough, "These appear together about as often as chance would predict here")
        .otherwise("Too few past cases here to say how unusual this combination is"))


def used_pairs(keyed: DataFrame, links: DataFrame, edges: DataFrame, chain_: DataFrame) -> DataFrame:
    """The pair whose lift is reported: the strongest link; for a lone episode its first plausible
    successor (itself when there is none)."""
    k = keyed.select("situation_id", "episode_id")
    best = (k.join(links, k["episode_id"] == links["i"]).groupBy("situation_id").agg(
        F.min_by(F.struct("cause", "effect"), F.struct((-F.col("score")).alias("s"), "i", "j")).alias("p")))
    first = edges.groupBy(F.col("cause").alias("category")).agg(F.min("effect").alias("_next"))
    root = chain_.filter("step = 1").select("situation_id", "category").join(first, "category", "left")
    return root.join(best, "situation_id", "left").select(
        "situation_id", F.coalesce("p.cause", "category").alias("cause"),
        F.coalesce("p.effect", "_next", "category").alias("effect"))


def lift_evidence(pairs: DataFrame, lift: DataFrame, p: Params = DEFAULT) -> DataFrame:
    d = pairs.join(lift, ["cause", "effect"], "left")
    z = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return d.select("situation_id", F.array("cause", "effect").alias("pair"), z("value", 1.0).alias("lift_value"),
                    z("window_sec", 0).alias("window_sec"), z("baseline_rate_per_hour", 0.0).alias("baseline_rate_per_hour"),
                    z("observed_rate_per_hour", 0.0).alias("observed_rate_per_hour"),
                    lift_note(z("cooccurrences", 0), z("value", 1.0), z("observed_rate_per_hour", 0.0), p).alias("lift_note"))


def member_facts(members: DataFrame) -> DataFrame:
    """Severity, confidence, sources and closure of a situation's events."""
    return members.groupBy("situation_id").agg(
        F.max("severity").alias("max_severity"),
        (F.sum(F.col("confidence").cast("decimal(9,4)")).cast("double") / F.count("*")).alias("mean_confidence"),
        F.min("confidence").alias("min_confidence"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.every(F.col("end_utc").isNotNull()).alias("closed"), F.count("*").alias("n_members"))


def confidence_level(d: DataFrame, degraded: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Level and reason. Reads sources, min_confidence, max_grid_distance, max_gap, standalone;
    ``degraded`` holds (feed, age_sec) of feeds that are stale or failing (at most one per feed)."""
    n, far = F.size("sources"), F.col("max_grid_distance")
    weak = F.col("min_confidence") < p.low_member_confidence
    high = (n >= p.high_min_sources) & (far <= 1) & (F.col("max_gap") <= p.high_max_gap_sec)
    low = weak | (far == 2) | (n < p.med_min_sources)
    level = F.when(high, 2).when(low, 0).otherwise(1)
    ns = _s(n)
    slow = (n >= p.med_min_sources) & (F.col("max_gap") > p.high_max_gap_sec)
    en = (F.when(high, _txt(ns, " separate feeds, all within one area, in the expected order"))
          .when(low & weak, "At least one report is low-confidence on its own")
          .when(low & (far == 2), "The areas involved are close but not adjacent")
          .when(low, "Only one feed reported this")
          .when(slow, _txt(ns, " feeds agree, but the reports are more than 30 minutes apart"))
          .otherwise(_txt(ns, " separate feeds agree on this")))
    hi = (F.when(high, _txt(ns, " अलग-अलग फीड, एक ही क्षेत्र में, अपेक्षित क्रम में"))
          .when(low & weak, "कम से कम एक रिपोर्ट खुद अविश्वसनीय है")
          .when(low & (far == 2), "शामिल क्षेत्र पास हैं लेकिन सटे नहीं हैं")
          .when(low, "इसकी रिपोर्ट केवल एक फीड ने की")
          .when(slow, _txt(ns, " फीड सहमत हैं, पर रिपोर्ट 30 मिनट से ज़्यादा अलग हैं"))
          .otherwise(_txt(ns, " अलग-अलग फीड इस पर सहमत हैं")))
    capped = F.col("standalone") & (level > 1)
    en = F.when(capped, "A single strong signal with no second report to corroborate it yet").otherwise(en)
    hi = F.when(capped, "एक मज़बूत संकेत, अभी तक दूसरी पुष्टि रिपोर्ट के बिना").otherwise(hi)
    d = d.withColumn("_level", F.when(capped, 1).otherwise(level)).withColumn("_en", en).withColumn("_hi", hi)
    hit = (d.select("situation_id", F.explode("sources").alias("feed")).join(degraded, "feed")
           .groupBy("situation_id").agg(F.min(F.struct("feed", "age_sec")).alias("_bad")))
    d = d.join(hit, "situation_id", "left")
    bad, feed = F.col("_bad").isNotNull(), F.replace(F.col("_bad.feed"), F.lit("_"), F.lit(" "))
    age = F.when(F.coalesce(F.col("_bad.age_sec"), F.lit(0)) != 0, _txt(_s(F.floor(F.col("_bad.age_sec") / 60)), " min")).otherwise("a while")
    lvl = F.when(bad, F.greatest(F.lit(0), F.col("_level") - 1)).otherwise(F.col("_level"))
    return (d.withColumn("confidence_level", F.element_at(F.array(F.lit("low"), F.lit("med"), F.lit("high")), lvl + 1))
            .withColumn("confidence_reason_en", F.when(bad, _txt(feed, " feed stale ", age, ", confidence lowered")).otherwise(F.col("_en")))
            .withColumn("confidence_reason_hi", F.when(bad, _txt(feed, " फीड ", age, " से पुरानी है, भरोसा कम किया गया")).otherwise(F.col("_hi")))
            .drop("_level", "_en", "_hi", "_bad"))


def headlines(chain_: DataFrame, zones: DataFrame, phrases: DataFrame) -> DataFrame:
    """One sentence from the first and last step; the zone label loses its own "near"."""
    ends = chain_.groupBy("situation_id").agg(F.min_by("category", "step").alias("root"), F.max_by("category", "step").alias("last"))
    r = phrases.select(F.col("category").alias("root"), F.col("noun_en").alias("_re"), F.col("noun_hi").alias("_rh"))
    l = phrases.select(F.col("category").alias("last"), F.col("noun_en").alias("_le"), F.col("noun_hi").alias("_lh"), "effect_en", "effect_hi")
    d = ends.join(r, "root", "left").join(l, "last", "left").join(zones.select("situation_id", "label_en", "label_hi"), "situation_id")
    zen = F.regexp_replace("label_en", "^Near ", "")
    zhi = F.regexp_replace("label_hi", " के पास$", "")
    same = F.col("root") == F.col("last")
    een = F.coalesce("effect_en", _txt("is linked to ", F.lower("_le")))
    ehi = F.coalesce("effect_hi", _txt(F.col("_lh"), " से जुड़ा है"))
    en = F.when(same, _txt(F.col("_re"), " reported near ", zen)).otherwise(_txt(F.col("_re"), " near ", zen, " ", een))
    hi = F.when(same, _txt(zhi, " के पास ", F.col("_rh"), " की सूचना")).otherwise(_txt(zhi, " के पास ", F.col("_rh"), " ", ehi))
    return d.select("situation_id", en.alias("headline_en"), hi.alias("headline_hi"), F.col("last").alias("last_category"), F.col("root").alias("root_category"))


def predicted_next(chain_: DataFrame, edges: DataFrame, lift: DataFrame) -> DataFrame:
    """The strongest measured successor of the last step that the situation does not show yet."""
    last = chain_.groupBy("situation_id").agg(F.max_by("category", "step").alias("cause"))
    present = chain_.select("situation_id", F.col("category").alias("effect")).distinct()
    c = (last.join(edges.select("cause", "effect"), "cause").join(present, ["situation_id", "effect"], "left_anti")
         .join(lift.filter("n_cause > 0"), ["cause", "effect"]))
    best = c.groupBy("situation_id").agg(F.min_by(
        F.struct("effect", "min_gap_sec", "max_gap_sec", "cooccurrences"), F.struct((-F.col("value")).alias("v"), "effect")).alias("b"))
    return best.select("situation_id", F.col("b.effect").alias("next_category"), F.col("b.min_gap_sec").alias("lag_from_sec"),
                       F.col("b.max_gap_sec").alias("lag_to_sec"),
                       _txt(_s(F.col("b.cooccurrences")), " historical co-occurrences").alias("based_on"))


def keyed_members(pruned: DataFrame, components: DataFrame, sit_ids: DataFrame):
    """(episode key per situation, member event rows per situation)."""
    keyed = components.join(sit_ids.select("component", "situation_id"), "component").select("situation_id", "episode_id")
    return keyed, pruned.join(keyed, "episode_id")


def assemble(sit_ids: DataFrame, members: DataFrame, chain_: DataFrame, keyed: DataFrame, links: DataFrame,
             edges: DataFrame, lift: DataFrame, phrases: DataFrame, degraded: DataFrame, grid: HexGrid,
             p: Params = DEFAULT) -> DataFrame:
    """One flat row per situation; ``nest`` gives the document shape."""
    zones = zone(members, grid)
    gaps = chain_.groupBy("situation_id").agg(F.coalesce(F.max("gap_sec"), F.lit(0)).alias("max_gap"), F.count("*").alias("steps"))
    d = (sit_ids.join(member_facts(members), "situation_id").join(zones, "situation_id").join(gaps, "situation_id"))
    d = confidence_level(d, degraded, p)
    d = (d.join(headlines(chain_, zones, phrases), "situation_id")
         .join(lift_evidence(used_pairs(keyed, links, edges, chain_), lift, p), "situation_id")
         .join(predicted_next(chain_, edges, lift), "situation_id", "left"))
    n_en, n_hi = spatial_note(F.size("h3_cells"), F.col("max_grid_distance"))
    d = d.withColumn("pulse_score", sv.pulse(F.col("max_severity"), F.col("mean_confidence"), F.size("sources")))
    d = d.withColumn("is_decoy", F.lit(False))
    return (d.withColumn("alert_level", sv.alert_level(F.col("pulse_score"), F.col("is_decoy")))
            .withColumn("status", F.when(F.col("closed"), "closed").otherwise("active"))
            .withColumn("updated_utc", F.col("created_utc"))
            .withColumn("note_en", n_en).withColumn("note_hi", n_hi))


def nest(situations: DataFrame, members: DataFrame, chain_: DataFrame, page_size: int = PAGE) -> DataFrame:
    """The nested document per situation, one row per page of its member ids (``scale.id_pages``);
    ``member_page`` of ``member_pages`` tells which. Chain and gaps are one entry per episode."""
    c = chain_.groupBy("situation_id").agg(F.array_sort(F.collect_list(F.struct(
        "step", "event_id", times.iso(F.timestamp_seconds("t")).alias("t_utc"), "category", "h3_cell", "text_en", "text_hi"))).alias("chain"),
        F.array_sort(F.collect_list(F.when(F.col("from_event_id").isNotNull(), F.struct(
            "step", "from_event_id", F.col("event_id").alias("to_event_id"), "gap_sec")))).alias("_gaps"))
    ids_ = id_pages(members, "situation_id", "event_id", page_size)
    d = situations.join(c, "situation_id").join(ids_, "situation_id", "left")
    nxt = F.when(F.col("next_category").isNotNull(), F.struct(
        F.col("next_category").alias("category"), F.array("lag_from_sec", "lag_to_sec").alias("typical_lag_range_sec"), "based_on"))
    return d.select(
        ids.public(F.col("situation_id")).alias("situation_id"), times.iso(F.col("created_utc")).alias("created_utc"), times.iso(F.col("updated_utc")).alias("updated_utc"),
        "status", "pulse_score", "alert_level", "headline_en", "headline_hi",
        F.struct("label_en", "label_hi", "h3_cells", F.struct("lat", "lon").alias("centroid")).alias("zone"),
        F.col("ids").alias("member_event_ids"), F.col("page").alias("member_page"), F.col("pages").alias("member_pages"), "n_members", "chain",
        F.struct(F.struct("h3_cells", F.size("h3_cells").alias("cells_involved"), "max_grid_distance", "note_en", "note_hi").alias("spatial"),
                 F.transform("_gaps", lambda g: F.struct(g["from_event_id"].alias("from_event_id"), g["to_event_id"].alias("to_event_id"), g["gap_sec"].alias("gap_sec"))).alias("temporal_gaps"),
                 F.struct(F.col("lift_value").alias("value"), "pair", "window_sec", "baseline_rate_per_hour", "observed_rate_per_hour",
                          F.col("lift_note").alias("note_en")).alias("lift")).alias("evidence"),
        "confidence_level", "confidence_reason_en", "confidence_reason_hi", "is_decoy", nxt.alias("predicted_next"))
