"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

A benchmark item is cut into item-sized windows; a window is a set of positioned word shingles and
is in a document where all of them are. Containment in full needs one prefix shingle: the rarest
over all documents. Only its occurrences propose places, bounded by position (the window must begin
inside the document) and length (and end inside it), and the window's words decide."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stage, table

WINDOW = 10
SHINGLE = 3
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of folded text
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words in text as it is


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, CAPITALS, SMALL), SEPARATORS), "")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, window, len): the distinct runs of ``size`` words of each item, its whole sequence
    where it has fewer. ``window`` is the words with a space between them."""
    w = items.select("item", words(F.col("text")).alias("w")).filter("size(w) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("at")
    return w.select("item", "w", at).select("item", F.slice("w", F.col("at"), F.lit(size)).alias("v")) \
            .select("item", F.array_join("v", " ").alias("window"), F.size("v").alias("len")).distinct()


def _shingles(w: Column, n: int) -> Column:
    """Structs a, b, c, ... of n neighbouring words; the last ones run past the end."""
    return F.arrays_zip(*[(w if j == 0 else F.slice(w, F.lit(j + 1), F.greatest(F.size(w), F.lit(1)))).alias(f"s{j}") for j in range(n)])


def _hash(n: int) -> Column:
    return F.xxhash64(*[F.col(f"x.s{j}") for j in range(n)])


def _proposals(docs: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """(key, start, window, len): places where a window's rarest n-word shingle stands."""
    tokens = (windows.select("window", "len", F.split("window", " ").alias("w")).select("window", "len", F.posexplode(_shingles(F.col("w"), n)).alias("at", "x"))
              .filter(F.col("at") + n <= F.col("len")).select("window", "len", "at", _hash(n).alias("h")))
    tokens = stage(tokens, "leak-tokens")
    found = (docs.select("key", words(F.col("text")).alias("w")).select("key", F.size("w").alias("n_words"), F.posexplode(_shingles(F.col("w"), n)).alias("pos", "x"))
             .filter(F.col("pos") + n <= F.col("n_words")).select("key", "n_words", "pos", _hash(n).alias("h")))
    found = stage(found.join(broadcast_if_small(tokens.select("h").distinct()), "h", "left_semi"), "leak-shingles")
    rarity = found.groupBy("h").agg(F.count("*").alias("seen"))
    prefix = (tokens.join(rarity, "h").groupBy("window", "len").agg(
        F.min(F.struct("seen", "h", "at")).alias("p"), F.count("*").alias("present"))
        .filter(F.col("present") == F.col("len") - n + 1)  # a window with a shingle that no document has is nowhere
        .select("window", "len", F.col("p.h").alias("h"), F.col("p.at").alias("at")))
    start = F.col("pos") - F.col("at")
    return (found.join(broadcast_if_small(prefix), "h").filter((start >= 0) & (start + F.col("len") <= F.col("n_words")))
            .select("key", start.alias("start"), "window", "len"))


def occurrences(docs: DataFrame, windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(key, start, window, len): where the windows stand in documents (key, text), each once."""
    windows = stage(windows.select("window", "len").distinct(), "leak-windows")
    sizes = sorted(r["n"] for r in windows.select(F.least("len", F.lit(shingle)).alias("n")).distinct().collect())  # up to ``shingle`` numbers
    parts = [_proposals(docs, windows.filter(F.least("len", F.lit(shingle)) == n), n) for n in sizes]
    if not parts:
        return docs.select("key", F.lit(0).alias("start"), F.lit("").alias("window"), F.lit(0).alias("len")).limit(0)
    proposed = parts[0]
    for p in parts[1:]:
        proposed = proposed.unionByName(p)
    proposed = stage(proposed, "leak-proposals")
    near = broadcast_if_small(proposed.select("key").distinct())
    texts = docs.join(near, "key", "left_semi").dropDuplicates(["key"]).select("key", words(F.col("text")).alias("w"))
    there = F.array_join(F.slice("w", F.col("start") + 1, F.col("len")), " ") == F.col("window")
    return proposed.join(texts, "key").filter(there).select("key", "start", "window", "len")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated), one row per input row.

    Null and empty texts have no words; an item without words is nowhere. Rows of one id and one text
    are alike and get the same answer, texts that share an id are told apart. An item without an id
    hits words but isn't counted or named; items of one id are one item. Without items, or with an
    empty table, nothing is hit. Extra columns are ignored."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    key = F.struct("id", F.xxhash64("text").alias("th")).alias("key")
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    windows = stage(item_windows(asked, size), "leak-items")
    hits = stage(occurrences(base.filter("text is not null").select(key, "text"), windows), "leak-hits")
    order = Window.partitionBy("key").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)  # one document's hits
    end = F.col("start") + F.col("len")
    fresh = end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(order), F.lit(0)))
    n_hit = (hits.select("key", "start", "len").distinct().select("key", F.greatest(fresh, F.lit(0)).alias("fresh"))
             .groupBy("key").agg(F.sum("fresh").alias("n_hit")))
    named = (hits.select("key", "window").distinct().join(windows.filter("item is not null").select("window", "item"), "window").select("key", "item").distinct()
             .groupBy("key").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items")))
    found = n_hit.join(named, "key", "left")
    out = base.select("id", key, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")).join(found, "key", "left")
    listed = F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
                      F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a window of an item (see ``contamination``)."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    base = docs.filter(F.col(text_col).isNotNull()).select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    windows = item_windows(items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")), size)
    hit = stage(occurrences(base, windows).select(F.col("key").alias("_key")).distinct(), "leak-documents")
    return docs.join(broadcast_if_small(hit), key == F.col("_key"), "left_anti")


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(translate({column}, '{CAPITALS}', '{SMALL}'), '{SEPARATORS}'), lambda x: x <> '')"


ORACLE_SQL = f"""WITH i AS (SELECT item_id, {_sql_words("text")} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, array_to_string(w[o + 1:o + {WINDOW}], ' ') AS win, least(len(w), {WINDOW}) AS n
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS o FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_sql_words("text")}, []) AS w FROM documents),
grams AS (SELECT doc_id, o, n, array_to_string(w[o + 1:o + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS o FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, o, windows.n, item_id FROM grams JOIN windows ON grams.win = windows.win AND grams.n = windows.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(o, o + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""
