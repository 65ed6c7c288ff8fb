"""Free-text normalisation and masking, all inside the JVM."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as v

_TYPES = dict(v.COMPLAINT_TYPES)


def fold_space(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def complaint_category(c) -> Column:
    pairs = [F.lit(x) for kv in _TYPES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), fold_space(c))


def letter_count(c) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def channel(ch, tag: str) -> Column:
    """First value whose tag matches, null when there is none."""
    return F.get(F.filter(ch, lambda x: x["tag"] == tag), F.lit(0))["v"]


def _rewrite(text, pattern: str, keep, tag: str):
    """Replace accepted matches of a pattern. Splitting and extracting with one pattern gives
    the gaps and the matches in turn, so each match is judged by itself in one pass."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    fixed = F.transform(hits, lambda m: F.when(keep(m), F.lit(tag)).otherwise(m))
    out = F.array_join(F.zip_with(gaps, fixed, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return out, F.size(F.filter(hits, keep))


def _is_mobile(m) -> Column:
    d = F.regexp_replace(m, r"(?U)\D", "")
    bare = None
    for p in v.PHONE_PREFIXES:
        cond = d.startswith(p) & (F.length(d) == 10 + len(p))
        val = F.substring(d, len(p) + 1, 10)
        bare = F.when(cond, val) if bare is None else bare.when(cond, val)
    bare = bare.otherwise(d)
    return (F.length(bare) == 10) & F.substring(bare, 1, 1).isin(*"6789")


def blocked_words(landmarks=v.LANDMARKS) -> list:
    return sorted(set(v.NOT_NAMES) | {w for lm in landmarks for w in lm[0].split()})


def mask_phones(text):
    return _rewrite(text, "(?U)" + v.PHONE_PATTERN, _is_mobile, v.PHONE_TAG)


def mask_names(text, blocked=None):
    words = F.array(*[F.lit(w) for w in (blocked or blocked_words())])
    return _rewrite(text, "(?U)" + v.NAME_PATTERN,
                    lambda m: ~F.arrays_overlap(F.split(m, r"(?U)\s+"), words), v.NAME_TAG)


def scrub(text) -> Column:
    """struct(masked, items): phones first, then names on the result."""
    t = F.coalesce(text, F.lit(""))
    no_phone, phones = mask_phones(t)
    masked, names = mask_names(no_phone)
    return F.struct(masked.alias("masked"), (phones + names).cast("bigint").alias("items"))


def count_pii(text) -> Column:
    return scrub(text)["items"]


def contains_pii(text) -> Column:
    return count_pii(text) > 0


def mask_record(df, feed: str, raw_line: str = None):
    """Mask a feed's free-text columns (or its raw line) and add ``items_masked``."""
    fields = [raw_line] if raw_line else list(v.FREE_TEXT_FIELDS.get(feed, ()))
    if not v.FREE_TEXT_FIELDS.get(feed):
        return df.withColumn("items_masked", F.lit(0).cast("bigint"))
    total = F.lit(0).cast("bigint")
    for f in fields:
        df = df.withColumn(f"_{f}", scrub(F.col(f)))
        total = total + F.col(f"_{f}.items")
    df = df.withColumn("items_masked", total)
    for f in fields:
        df = df.withColumn(f, F.col(f"_{f}.masked")).drop(f"_{f}")
    return df
