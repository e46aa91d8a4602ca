"""Scalar functions of the engine as column expressions; all run inside the JVM."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import rules as R

CJK = "\\u4e00-\\u9fff"
WHITE = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
NOW = datetime(2024, 2, 1)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def exploded(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """rows with one row an item.

    An outer explode and a filter behind it: a plain explode would have the optimizer compute
    the items once more, below any exchange, to drop rows without items.
    """
    return rows.withColumn(name, F.explode_outer(items)).where(F.col(name).isNotNull())


# ---------------------------------------------------------------------- text


def tokens(text: Column | str) -> Column:
    """ASCII words, then all three- and two-character grams of CJK runs; repeats stay."""
    t = col(text)
    words = F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]+)"), 1)
    grams = [F.regexp_extract_all(t, F.lit(f"(?=([{CJK}]{{{n}}}))"), 1) for n in (3, 2)]
    return F.when(t.rlike(f"[{CJK}]"), F.concat(words, *grams)).otherwise(words)


def token_set(text: Column | str, backtick: bool = False) -> Column:
    """Distinct lower-cased parts of two characters or more between white space and punctuation."""
    marks = "[\\s,.;:!?，。；：！？、()（）\\[\\]{}<>《》\"'" + ("`" if backtick else "") + "]+"
    return F.array_distinct(F.filter(F.split(F.lower(col(text)), marks), lambda w: F.length(w) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def content_hash(text: Column | str) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(col(text)), WHITE + "+", " "))
    return F.concat(F.lit("sha256:"), F.sha2(plain, 256))


def estimate_tokens(text: Column | str) -> Column:
    """CJK characters count two thirds of a token, others a quarter."""
    t = col(text)
    cjk = F.length(t) - F.length(F.regexp_replace(t, f"[{CJK}]", ""))
    return F.ceil(cjk / 1.5 + (F.length(t) - cjk) / 4.0).cast("long")


def redact(text: Column | str) -> Column:
    hidden = F.regexp_replace(col(text), R.TOKEN_SHAPE, "[REDACTED_SECRET]")
    return F.regexp_replace(hidden, "(?i)" + R.SECRET_VALUE, "$1[REDACTED_SECRET]")


def strip_context(text: Column | str, tags: tuple[str, ...] = R.CONTEXT_TAGS) -> Column:
    """A turn without its reply preview, injected memory blocks (of the named tags) and system notes."""
    t = F.regexp_replace(col(text), R.REPLY_PREVIEW, "")
    for tag in tags:
        t = F.regexp_replace(t, f"(?is)<{tag}>.*?</{tag}>", "")
    return F.trim(F.regexp_replace(t, R.SYSTEM_NOTE, ""))


def any_of(low: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds one of the words."""
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


def is_meta(text: Column | str) -> Column:
    return any_of(F.lower(col(text)), R.META_MARKERS)


def is_learnable(text: Column | str) -> Column:
    """Whether a turn, without injected context, shows a sign worth learning and is no instruction about the assistant."""
    t = strip_context(text)
    return (F.length(t) > 0) & any_of(F.lower(t), R.LEARN_MARKERS) & ~is_meta(t)


def clean_capture(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[。.!！?？]+$", "")


def quality_gate(text: Column | str) -> Column:
    """Long enough, no question, no hedge, not cut off."""
    s = F.trim(col(text))
    ended, names = s.rlike("[。.!！;；]$"), s.rlike("[A-Za-z0-9_-]{4,}")
    hedge = lambda w: s.rlike(f"^{w}(?=[A-Za-z0-9_])")  # noqa: E731  a boundary lies between CJK and ASCII letters only
    return (
        (F.length(s) >= 8)
        & ~s.rlike("[吧吗呢啊哦？?]$")
        & ~((hedge("应该是") | hedge("不是")) & ~ended)
        & ~(hedge("不是") & ~names)
        & ~s.rlike("[能会][用做]?吗|能用[吗？]")
        & ~s.rlike("[,，、…]$")
    )


def entities(text: Column | str) -> Column:
    """Named things in order of kind (URL, version, tool, quoted), first of each name, of three characters or more."""
    t = col(text)
    kinds = (
        ("url", r"(https?://[^\s，。'\"`]+)", 1),
        ("version", R.B + r"(v\d+\.\d+\.\d+)" + R.E, 1),
        ("tool", "(?i)" + R.B + r"([a-z]{2,}(?:[-_][a-z0-9]+){1,4})" + R.E, 1),
        ("concept", r"['\"`]([^'\"`]{3,40})['\"`]", 1),
    )
    def named(kind: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), group), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type")))

    found = F.concat(*[named(*k) for k in kinds])
    long = F.filter(found, lambda e: F.length(e["name"]) > 2)
    names = F.transform(long, lambda e: e["name"])
    return F.filter(long, lambda e, i: F.array_position(names, e["name"]) == i + 1)


def summarize_turn(user: Column, assistant: Column) -> Column:
    """White space collapsed; 140 characters of each side, or 280 of the one there is."""
    a, b = (F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), "\\s+", " ")) for x in (user, assistant))
    return F.when((a != "") & (b != ""), F.concat(F.lit("User: "), F.substring(a, 1, 140), F.lit(" | Assistant: "), F.substring(b, 1, 140))).otherwise(F.substring(F.concat(a, b), 1, 280))


def pattern_kind(text: Column | str) -> Column:
    low = F.lower(col(text))
    out = F.lit("recurring")
    for kind, words in reversed(R.PATTERN_KINDS):
        out = F.when(low.rlike(words), kind).otherwise(out)
    return out


def time_reference(text: Column | str, now: datetime = NOW) -> Column:
    """The date a query speaks of: an ISO date, or today, yesterday, last week or month; else null."""
    t, today = F.lower(col(text)), F.lit(now.date())
    iso = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1)
    named = (("today|今天", 0), ("yesterday|昨天", 1), ("last week|上周", 7), ("last month|上个月", 30))
    out = F.when(iso != "", F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))))
    for words, days in named:
        out = out.when(t.rlike(words), F.date_sub(today, days))
    return out


def string_list(text: Column | str) -> Column:
    """The trimmed, non-empty parts of a comma list; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def message_text(message: Column | str) -> Column:
    """Text of a chat message in JSON: a string, an object's content, or the texts of its parts, a line each."""
    m = F.try_parse_json(col(message))
    whole = F.try_variant_get(m, "$", "string")
    content = F.try_variant_get(m, "$.content", "string")
    kind = F.schema_of_variant(m)
    parts = F.try_variant_get(m, "$.content", "array<variant>")
    one = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.lit(""))
    listed = F.array_join(F.transform(parts, one), "\n")
    is_list = kind.contains("content: ARRAY")
    return F.coalesce(F.when(kind == "STRING", whole), F.when(is_list, listed), F.when(kind.contains("content: STRING"), content), F.lit(""))


# ------------------------------------------------------------------- identity


def memory_id(layer: Column | str, day: Column, number: Column) -> Column:
    """The id of the day's n-th memory of a layer, as ENG-20240201-001."""
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in R.ID_PREFIXES.items() for x in kv]), col(layer))
    digits = number.cast("string")
    return F.concat_ws("-", prefix, F.date_format(day, "yyyyMMdd"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


def date_of_id(name: Column | str) -> Column:
    """The day in an id (yyyy-MM-dd), null for any other string."""
    d = F.regexp_extract(col(name), r"^[A-Z]+-(\d{8})-\d+$", 1)
    return F.when(d != "", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def feedback_id(at: Column | str) -> Column:
    """FB- and the instant's milliseconds in base 36."""
    return F.concat(F.lit("FB-"), F.lower(F.conv(F.floor(F.unix_micros(col(at).cast("timestamp")) / 1000).cast("string"), 10, 36)))


# ----------------------------------------------------------------- life cycle


def activation_value(strength: Column | str, storage: Column | str) -> Column:
    return (col(strength) + col(storage)) / 2


def parsed_activation(text: Column | str) -> Column:
    """A struct of an activation's JSON; null unless both strengths, frequency and last_accessed have their type."""
    v = F.try_parse_json(col(text))
    number = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, f"$.{k}", "double"))
    named = F.when(F.schema_of_variant(F.try_variant_get(v, "$.last_accessed", "variant")) == "STRING", F.try_variant_get(v, "$.last_accessed", "string"))
    strength, storage, frequency = number("retrieval_strength"), number("storage_strength"), number("frequency")
    whole = strength.isNotNull() & storage.isNotNull() & frequency.isNotNull() & named.isNotNull()
    return F.when(whole, F.struct(strength.alias("strength"), storage.alias("storage"), frequency.cast("long").alias("frequency"), F.coalesce(number("turn_count"), F.lit(0.0)).cast("long").alias("turns"), named.alias("last_accessed")))


def should_promote(status: Column | str, copies: Column) -> Column:
    """Whether a candidate was said twice or more."""
    return (col(status) == "candidate") & (copies >= 2)


def is_unsafe(text: Column | str, tags: tuple[str, ...] = R.CONTEXT_TAGS) -> Column:
    """Whether a text holds injected context or speaks to the model."""
    return col(text).rlike("(?i)</?(?:" + "|".join(tags) + ")>|\\[System note:") | col(text).rlike(R.INJECTION)


def has_secret(text: Column | str) -> Column:
    return redact(text) != col(text)


FACT = "array<struct<statement:string,type:string,polarity:string,rationale:string,confidence:string,entities:array<struct<name:string,type:string>>>>"


def facts(answer: Column | str, most: int = 5) -> Column:
    """A language model's facts (JSON, fenced or not), cleaned: an array of structs, empty if the answer is no list.

    Statements of 5 to 300 characters that hold no secret (nor do rationale and entities) and
    don't address the model; the first of equal ones; at most `most` (1 to 10).
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(col(answer), r"```(?:json?)?\s*", ""), r"```\s*", ""))
    raw = F.coalesce(F.from_json(F.when(plain.startswith("["), plain), FACT), F.array().cast(FACT))
    text = lambda f: F.trim(F.coalesce(f["statement"], F.lit("")))
    entity = lambda e: F.struct(F.substring(F.trim(F.coalesce(e["name"], F.lit(""))), 1, 80).alias("name"), F.coalesce(F.nullif(F.substring(F.trim(F.coalesce(e["type"], F.lit("concept"))), 1, 40), F.lit("")), F.lit("concept")).alias("type"))
    no = F.lit(False)
    safe = lambda f: ~is_unsafe(text(f)) & ~has_secret(text(f)) & ~F.coalesce(has_secret(f["rationale"]), no) & ~F.coalesce(F.exists(f["entities"], lambda e: F.coalesce(has_secret(e["name"]), no) | F.coalesce(has_secret(e["type"]), no)), no)
    good = F.filter(raw, lambda f: F.length(text(f)).between(5, 300) & safe(f))
    said = F.transform(good, text)
    first = F.filter(good, lambda f, i: F.array_position(said, text(f)) == i + 1)
    number = lambda c: F.when(c.rlike(r"^-?\d+(\.\d+)?$"), clamp(js_round(c.cast("double")), 1, 10).cast("long")).otherwise(F.lit(5).cast("long"))
    clean = lambda f: F.struct(
        text(f).alias("statement"),
        F.when(f["type"].isin(*R.MEMORY_KINDS), f["type"]).otherwise("behavioral").alias("type"),
        F.when(f["polarity"].isin("do", "dont"), f["polarity"]).alias("polarity"),
        F.substring(F.coalesce(f["rationale"], F.lit("")), 1, 300).alias("rationale"),
        number(F.coalesce(f["confidence"], F.lit(""))).alias("confidence"),
        F.slice(F.filter(F.transform(F.coalesce(f["entities"], F.array().cast("array<struct<name:string,type:string>>")), entity), lambda e: (e["name"] != "") & ~is_unsafe(e["name"])), 1, 8).alias("entities"),
    )
    return F.transform(F.slice(first, 1, max(1, min(10, most))), clean)


def days_since(t: Column | str, now: datetime = NOW) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(col(t).cast("timestamp"))) / 8.64e10)


def by_layer(layer: Column | str, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(col(layer) == k, F.lit(v)).otherwise(out)
    return out


def decayed_strength(strength: Column, layer: Column | str, weight: Column, days: Column) -> Column:
    """Strength fades to a floor of 0.05, by the layer's rate, slower for what is felt strongly."""
    return 0.05 + (strength - 0.05) * F.exp(-by_layer(layer, R.FADING) * (1 - weight / 20.0) * days)


def status_of(strength: Column) -> Column:
    return F.when(strength > 0.5, "active").when(strength > 0.3, "fading").when(strength > 0.1, "dormant").otherwise("retired")


def reactivated(strength: Column) -> Column:
    return F.least(F.lit(1.0), strength + 0.1)


def activation(strength: Column, frequency: Column, turns: Column) -> Column:
    return F.least(F.lit(1.0), strength + F.least(F.lit(0.2), 0.05 * F.log1p(frequency.cast("double"))) + F.least(F.lit(0.15), 0.04 * F.log1p(turns.cast("double"))))


def quality(turns: Column, act: Column, consolidated: Column, positive: Column, total: Column, adopted: Column) -> Column:
    part = F.when(total > 0, positive / total).otherwise(0.0)
    return F.least(
        F.lit(1.0),
        F.least(F.lit(0.30), 0.08 * F.log1p(turns.cast("double"))) + 0.30 * F.least(F.lit(1.0), act) + F.when(consolidated, 0.15).otherwise(0.0) + 0.15 * part + F.least(F.lit(0.20), 0.06 * F.log1p(adopted.cast("double"))),
    )


def decayed_confidence(confidence: Column, weight: Column, days: Column) -> Column:
    return F.greatest(F.lit(1), js_round(1 + (confidence - 1) * F.exp(-(math.log(2) / 90) * (1 - weight / 20.0) * days)).cast("int"))


# -------------------------------------------------------------------- ranking


def specificity(text: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(F.length(text).cast("double")) / math.log1p(200))


def recency(days: Column) -> Column:
    return F.coalesce(F.exp(-days / 30.0), F.lit(0.5))


def evidence_strength(proof: Column, evidence: Column, sources: Column) -> Column:
    parts = ((proof, 0.1, 0.5), (evidence, 0.1, 0.3), (sources, 0.05, 0.2))
    return F.least(F.lit(1.0), sum((F.least(F.lit(top), w * F.coalesce(c, F.lit(0))) for c, w, top in parts), F.lit(0.0)))


def scope_match(scope: Column, wanted: Column) -> Column:
    return F.when(wanted.isNull(), 0.5).when(scope == "global", 0.7).when(scope == wanted, 1.0).when(scope.startswith(wanted) | wanted.startswith(scope), 0.8).otherwise(0.3)


def polarity_weight(polarity: Column) -> Column:
    return F.when(polarity == "do", 0.8).when(polarity == "dont", 0.6).otherwise(0.5)


def time_relevance(days: Column) -> Column:
    return F.exp(-F.abs(days) / 10.0)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; 0 for vectors of different length."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)
