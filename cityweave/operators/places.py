"""Landmark text matching, nearest landmark and registry lookups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import text as tx
from ..functions.hexgrid import HexGrid
from .scale import broadcast_if_small, stage

_WORD = r"(?U)[\p{L}\p{N}_]+"


_PREFIX = "^(" + "|".join(p.replace(".", "\\.") for p in v.ADDRESS_PREFIXES) + ") "


def strip_prefix(c) -> Column:
    """Folded text without one leading address word."""
    return F.trim(F.regexp_replace(tx.fold_space(c), _PREFIX, ""))


def plausible(c) -> Column:
    """Enough letters before and after the prefix is taken off."""
    ascii_letters = F.length(F.regexp_replace(strip_prefix(c), "[^a-z]", ""))
    return (tx.letter_count(c) >= v.MIN_ADDRESS_LETTERS) & (ascii_letters >= v.MIN_ADDRESS_LETTERS)


def _words(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(_WORD), F.lit(0)))


def word_candidates(inside: DataFrame, around: DataFrame) -> DataFrame:
    """(inside, around): the pairs of texts that can be contained in one another, which share the word of
    ``inside`` that is rarest in ``around``. A text with a word that is nowhere in ``around`` has none. Rows
    are bounded by the occurrences of rarest words, whatever the lengths."""
    words = stage(around.select("around", F.explode(_words(F.col("around"))).alias("_w")), "around-words")
    often = words.groupBy("_w").agg(F.count("*").alias("_n"))
    d = inside.select("inside", F.explode(_words(F.col("inside"))).alias("_w")).join(often, "_w", "left")
    rarest = d.groupBy("inside").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_w").alias("w"))).alias("_r")).filter("_r.n > 0")
    return words.join(rarest.select("inside", F.col("_r.w").alias("_w")), "_w").select("inside", "around")


def contained(inside: DataFrame, around: DataFrame) -> DataFrame:
    """(inside, around): which texts lie whole, from word edge to word edge, in which others."""
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.regexp_replace("inside", r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E\b"))
    return word_candidates(inside, around).filter(F.regexp_like("around", quoted))


def _pieces(name: str) -> list:
    words = name.split(" ")
    return [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]


def _match(s: Column, landmarks) -> Column:
    """Best landmark position for folded text: longest name, earliest on a tie. One pattern looks
    ahead from every word start for the longest name there, so names may overlap in the text; the
    opposite containment is a lookup of the text among all pieces of names. Map-only."""
    rank, pieces = {}, {}
    for i, lm in enumerate(landmarks):
        name = lm[0].lower()
        rank.setdefault(name, (len(name), -i))
        for piece in _pieces(name):
            pieces[piece] = max(pieces.get(piece, (0, 0)), rank[name])

    def table(mapping):
        return F.create_map(*[x for k, (n, p) in mapping.items() for x in (
            F.lit(k), F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")))])

    names = "|".join(r"\Q" + n + r"\E" for n in sorted(rank, key=lambda n: (-len(n), n)))
    found = F.regexp_extract_all(s, F.lit(r"(?U)\b(?=(" + names + r")\b)"), F.lit(1))
    best = F.array_max(F.concat(F.transform(found, lambda m: F.try_element_at(table(rank), m)),
                                F.array(F.try_element_at(table(pieces), s))))
    return -best["p"]


def landmark_position(text, landmarks=v.LANDMARKS) -> Column:
    """Index of the landmark a text names, or null, for a gazetteer given as a list: its names are
    part of the plan. A gazetteer table is matched by ``resolve_by_join``, with the same result."""
    return F.when(plausible(text), _match(strip_prefix(text), landmarks))


def resolve_by_join(texts: DataFrame, text: str, gazetteer: DataFrame) -> DataFrame:
    """The same match against a gazetteer table of any size: distinct texts meet the names that they may
    hold, or that may hold them, by one word, the rarest (``word_candidates``), and the whole is compared;
    the longest name decides."""
    d = stage(texts.select(F.col(text).alias("_text")).distinct()
              .filter(plausible(F.col("_text"))).withColumn("_s", strip_prefix(F.col("_text"))), "place-texts")
    g = stage(gazetteer.select(F.lower("name").alias("_n"), "pos").groupBy("_n").agg(F.min("pos").alias("pos")), "place-names")
    held, names = d.select("_s").distinct(), g.select("_n")
    pairs = contained(names.select(F.col("_n").alias("inside")), held.select(F.col("_s").alias("around"))).select(F.col("around").alias("_s"), F.col("inside").alias("_n"))
    pairs = pairs.unionByName(contained(held.select(F.col("_s").alias("inside")), names.select(F.col("_n").alias("around"))).select(F.col("inside").alias("_s"), F.col("around").alias("_n")))
    best = pairs.join(g, "_n").groupBy("_s").agg(F.max_by("pos", F.struct(F.length("_n"), -F.col("pos"))).alias("pos"))
    found = d.join(best, "_s").select("_text", "pos")
    return texts.join(found, texts[text] == found["_text"], "left").drop("_text")


def landmark_fields(pos: Column, grid: HexGrid, landmarks=v.LANDMARKS) -> dict:
    """lat, lon, cell and names of a landmark position: picks from constant arrays."""
    def pick(xs):
        return F.get(F.array(*[F.lit(x) for x in xs]), pos)
    cells = [grid.cell_of(lm[2], lm[3]) for lm in landmarks]
    out = {k: pick([lm[i] for lm in landmarks]) for i, k in enumerate(("name", "name_hi", "lat", "lon"))}
    return {**out, "h3_cell": pick(cells).cast("bigint")}


def locate(landmark, locality, landmarks=v.LANDMARKS) -> Column:
    """First of landmark and locality that resolves."""
    return F.coalesce(landmark_position(landmark, landmarks), landmark_position(locality, landmarks))


def nearest_landmark(lat: str, lon: str, landmarks=v.LANDMARKS) -> Column:
    """Position of the closest landmark to two columns by great-circle distance, earliest on a
    tie: the least of constant many (distance, position) pairs, written as one expression."""
    far = 2 * v.EARTH_RADIUS_KM
    pairs = [f"named_struct('km', {far}D * asin(sqrt(power(sin(radians({la}D - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({la}D))"
             f" * power(sin(radians({lo}D - {lon}) / 2), 2))), 'pos', {i})" for i, (_, _, la, lo) in enumerate(landmarks)]
    return F.expr(f"array_min(array({', '.join(pairs)})).pos")


def nearest_by_join(points: DataFrame, gazetteer: DataFrame, lat: str = "lat", lon: str = "lon", step: float = 0.01) -> DataFrame:
    """``points`` with the position ``pos`` of the closest landmark of a gazetteer table (pos, lat, lon)
    of any size, earliest on a tie; null without landmarks or coordinates.

    Distinct points look into the squares around theirs, of ``step`` degrees at first. A landmark is
    the closest for certain when it is nearer than the looked-at squares reach; points without one
    look again with squares four times as wide, until the squares cover the globe."""
    far = 2 * v.EARTH_RADIUS_KM
    km = lambda a, b, c, d: far * F.asin(F.least(F.lit(1.0), F.sqrt(F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2))))
    left = stage(points.select(F.col(lat).cast("double").alias("_la"), F.col(lon).cast("double").alias("_lo")).filter("_la is not null and _lo is not null").distinct(), "nearest")
    marks = stage(gazetteer.select("pos", F.col("lat").cast("double").alias("_ma"), F.col("lon").cast("double").alias("_mo")).filter("_ma is not null and _mo is not null"), "nearest-marks")
    found, around = [], F.array(*[F.lit(k) for k in (-1, 0, 1)])
    while left.limit(1).count():
        last = step >= 180.0
        m = marks.select("*", F.floor(F.col("_ma") / step).alias("_x"), F.floor(F.col("_mo") / step).alias("_y"))
        look = left.select("_la", "_lo", F.explode(around).alias("_i"), (F.floor(F.col("_la") / step)).alias("_x0"), F.floor(F.col("_lo") / step).alias("_y0")) \
                   .select("_la", "_lo", (F.col("_x0") + F.col("_i")).alias("_x"), "_y0", F.explode(around).alias("_j")).select("_la", "_lo", "_x", (F.col("_y0") + F.col("_j")).alias("_y"))
        best = (look.join(m, ["_x", "_y"]).groupBy("_la", "_lo")
                .agg(F.min(F.struct(km(F.col("_la"), F.col("_lo"), F.col("_ma"), F.col("_mo")).alias("km"), "pos")).alias("_b")))
        # a square's side in km: along a parallel it shrinks towards the poles, and the date line is not looked across
        reach = F.radians(F.lit(step)) * v.EARTH_RADIUS_KM * F.cos(F.radians(F.least(F.abs("_la") + 2 * step, F.lit(90.0))))
        sure = F.lit(True) if last else (F.col("_b.km") < reach) & (F.abs("_lo") + 2 * step < 180)
        best = stage(best.withColumn("_sure", sure), "nearest-found")
        found.append(best.filter("_sure").select("_la", "_lo", F.col("_b.pos").alias("pos")))
        if last:
            break
        left = stage(left.join(best.filter("_sure").select("_la", "_lo"), ["_la", "_lo"], "left_anti"), "nearest")
        step *= 4
    if not found:
        return points.withColumn("pos", F.lit(None).cast("int"))
    done = found[0]
    for f in found[1:]:
        done = done.unionByName(f)
    return points.join(done, (points[lat].cast("double") == done["_la"]) & (points[lon].cast("double") == done["_lo"]), "left").drop("_la", "_lo")


def zone_labels(cells: DataFrame, cell: str, grid: HexGrid, landmarks=v.LANDMARKS) -> DataFrame:
    """Add (zone_en, zone_hi) for a column of cells, resolved once per distinct cell: the
    landmark's own cell takes its name, others are near it. ``landmarks`` is a list or a table (pos,
    name, name_hi, lat, lon). Steps are separate columns so each expression is evaluated once."""
    d = cells.select(F.col(cell).alias("_cell")).distinct()
    lat, lon = grid.centroid(F.col("_cell"))
    d = d.withColumn("_lat", lat).withColumn("_lon", lon)
    if isinstance(landmarks, DataFrame):
        marks = landmarks.select("pos", "name", "name_hi", grid.cell(F.col("lat"), F.col("lon")).alias("h3_cell"))
        d = nearest_by_join(d, landmarks, "_lat", "_lon").join(marks, "pos", "left")
        f = {c: F.col(c) for c in ("name", "name_hi", "h3_cell")}
    else:
        d = d.withColumn("_pos", nearest_landmark("_lat", "_lon", landmarks))
        f = landmark_fields(F.col("_pos"), grid, landmarks)
    own = f["h3_cell"] == F.col("_cell")
    dim = d.select("_cell", F.when(own, f["name"]).otherwise(F.concat(F.lit("Near "), f["name"])).alias("zone_en"),
                   F.when(own, f["name_hi"]).otherwise(F.concat(f["name_hi"], F.lit(" के पास"))).alias("zone_hi"))
    return cells.join(dim, F.col(cell) == F.col("_cell"), "left").drop("_cell")


def with_nearby(label_en, label_hi, n_cells):
    """Append " + N nearby areas" when more than one cell is involved."""
    extra = n_cells - 1
    return (F.when(extra > 0, F.concat(label_en, F.lit(" + "), extra.cast("string"), F.lit(" nearby area"),
                                       F.when(extra > 1, "s").otherwise(""))).otherwise(label_en),
            F.when(extra > 0, F.concat(label_hi, F.lit(" + "), extra.cast("string"), F.lit(" और क्षेत्र")))
            .otherwise(label_hi))


def registry_lookup(df: DataFrame, registry: DataFrame, key: str, grid: HexGrid,
                    columns: list) -> DataFrame:
    """Left lookup of an entity in its registry; ``resolved`` is false on a miss. The registry
    is broadcast only when its counted size allows, otherwise the join shuffles."""
    reg = registry.select(F.col("id").alias(key), F.col("lat").alias("lat"), F.col("lon").alias("lon"),
                          grid.cell(F.col("lat"), F.col("lon")).alias("h3_cell"),
                          *[F.col(c).alias(f"reg_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = df.join(broadcast_if_small(reg), key, "left")
    return out.withColumn("resolved", F.col("_hit").isNotNull()).drop("_hit")
