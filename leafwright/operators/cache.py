"""Result cache as a table: fingerprints, lookup, work list, write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1


def fingerprint(engine: Column, dpi: Column, source: Column, backend: Column | None = None, model: Column | None = None, tier: Column | None = None) -> Column:
    """Twelve hex digits over what changes a result: sorted keys, JSON with a space after colons and commas."""
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    own = {
        "backend": (backend, engine.isin("hybrid", "ov")), "dpi": (dpi, None), "engine": (engine, None), "model": (model, engine.isin("hybrid", "glm", "dsocr", "llama")),
        "source": (source, None), "tier": (tier, engine == "ov"), "ver": (F.lit(VERSION), None),
    }
    parts = []
    for name, (value, where) in own.items():
        if value is None:
            continue
        text = value.cast("string") if name in ("dpi", "ver") else quoted(value)
        part = F.concat(F.lit(f'"{name}": '), text)
        parts.append(part if where is None else F.when(where, part))
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 12)


def key(stem: Column, page_no: Column, engine: Column, dpi: Column, signature: Column, content: Column | None = None) -> Column:
    """``stem_p1_engine_d150_signature``, and (where given) a hash of the content, so that namesakes do not meet."""
    base = F.format_string("%s_p%d_%s_d%d_%s", stem, page_no, engine, dpi, signature)
    return base if content is None else F.concat_ws("_", base, F.substring(F.sha2(content.cast("binary"), 256), 1, 12))


def looked_up(pages: DataFrame, cache: DataFrame, refresh: bool = False, no_cache: bool = False) -> DataFrame:
    """Pages with cached_text and hit; audit results are never cached."""
    if refresh or no_cache:
        return pages.withColumn("cached_text", F.lit(None).cast("string")).withColumn("hit", F.lit(False))
    held = cache.select("cache_key", F.col("text").alias("cached_text"))
    out = pages.join(held, "cache_key", "left")
    able = F.col("engine") != "audit" if "engine" in pages.columns else F.lit(True)
    return out.withColumn("cached_text", F.when(able, F.col("cached_text"))).withColumn("hit", F.col("cached_text").isNotNull())


def work_list(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages that have no cached text; only these are rendered and recognised."""
    return pages.join(cache.select("cache_key"), "cache_key", "left_anti")


def additions(results: DataFrame, cache: DataFrame) -> DataFrame:
    """(cache_key, text) to append: new keys with text."""
    new = results.where(F.length(F.coalesce("text", F.lit(""))) > 0).select("cache_key", "text")
    return new.join(cache.select("cache_key"), "cache_key", "left_anti")


def written_back(results: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache after a run: results with text replace what was held under their key."""
    new = results.where(F.length(F.coalesce("text", F.lit(""))) > 0).select("cache_key", "text")
    return cache.select("cache_key", "text").join(new.select("cache_key"), "cache_key", "left_anti").unionByName(new)
