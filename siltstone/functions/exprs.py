"""Column expressions: everything here compiles to JVM expressions, no Python runs on executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CACHE_WRITE_FACTOR, OTHER, PRIMARY_CATEGORIES

#: White space that folds to one blank: as RE2 and DuckDB have it, or all of Unicode's.
WS_RE2 = r"[ \t\n\f\r]+"
WS_UNICODE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
FINGERPRINT_CHARS = 400
# U: word boundaries know all of Unicode's letters, whatever the Java version.
#: Fixed value: the words that tell of a fire.
FIRE_WORDS = r"(?iU)\b(fire|flame|caught on fire|smoke|burn(?:ed|ing)?)\b"
Z95 = 1.96


def fingerprint(incident: Column, narrative: Column, ws: str = WS_RE2, chars: int = FINGERPRINT_CHARS) -> Column:
    """Stable row key: incident id and the first characters of the folded narrative."""
    folded = F.trim(F.regexp_replace(narrative, ws, " "))
    return F.concat(incident, F.lit("||"), F.substring(folded, 1, chars))


def fingerprint_hash(incident: Column, narrative: Column, ws: str = WS_RE2) -> Column:
    return F.sha2(fingerprint(incident, narrative, ws), 256)


def recode(value: Column, mapping: Mapping[str, str]) -> Column:
    """Replace the mapping's keys; other values stay."""
    out = value
    for old, new in mapping.items():
        out = F.when(value == old, F.lit(new)).otherwise(out)
    return out


def top_level(code: Column, sep: str = ":", mapping: Mapping[str, str] | None = None) -> Column:
    """The part of a hierarchical code before the first separator, trimmed, then recoded."""
    return recode(F.trim(F.substring_index(code, sep, 1)), mapping or {})


def keep_or_other(value: Column, keep: Iterable[str] = PRIMARY_CATEGORIES, other: str = OTHER) -> Column:
    """Values of a closed list stay, all others (null too) fall into one bucket."""
    return F.when(value.isin(*keep), value).otherwise(F.lit(other))


def month_of(day: Column) -> Column:
    """yyyymm of a yyyymmdd string."""
    return F.substring(day, 1, 6)


def day_of(day: Column) -> Column:
    """Day of a yyyymmdd string; 0 where it is no number."""
    return F.coalesce(F.substring(day, 7, 2).try_cast("int"), F.lit(0))


def add_months(ym: Column, n: int) -> Column:
    return F.date_format(F.add_months(F.to_date(ym, "yyyyMM"), n), "yyyyMM")


def shift_month(ym: str, n: int) -> str:
    """add_months on the driver."""
    months = int(ym[:4]) * 12 + int(ym[4:6]) - 1 + n
    return f"{months // 12:04d}{months % 12 + 1:02d}"


def month_series(first: Column, last: Column) -> Column:
    """All months from first to last, yyyymm; empty if first is after last."""
    start, stop = F.to_date(first, "yyyyMM"), F.to_date(last, "yyyyMM")
    months = F.transform(F.sequence(start, F.greatest(start, stop), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyyMM"))
    return F.when(start <= stop, months).otherwise(F.array().cast("array<string>"))


def to_number(value: Column) -> Column:
    return value.try_cast("double")


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """struct(lo, hi): Wilson score interval, null where n is not positive."""
    k, n = successes.cast("double"), n.cast("double")
    p, z2 = k / n, z * z
    den = 1 + z2 / n
    centre, margin = (p + z2 / (2 * n)) / den, z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / den
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), centre - margin).alias("lo"), F.least(F.lit(1.0), centre + margin).alias("hi")))


def binomial_se(p: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(p * (1 - p) / n.cast("double")))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def js_divergence(p: Column, q: Column) -> Column:
    """Aggregate: Jensen-Shannon divergence (natural log) summed over aligned categories; 0 for no rows."""
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.ln(x / F.greatest(m, F.lit(1e-12)))).otherwise(F.lit(0.0))
    return F.coalesce(F.sum(term(p) / 2 + term(q) / 2), F.lit(0.0))


def js_distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), js_divergence(p, q)))


def token_cost(provider: Column, rate_in: Column, rate_cached: Column, rate_out: Column, uncached: Column, cached: Column, output: Column, written: Column, batch: Column, discount: float = 0.5) -> Column:
    """Dollars for the tokens of a call; null where the rates are."""
    factor = F.lit(1.0)
    for name, times in CACHE_WRITE_FACTOR.items():
        factor = F.when(provider == name, F.lit(times)).otherwise(factor)
    dollars = (uncached * rate_in + cached * rate_cached + written * rate_in * factor + output * rate_out) / 1e6
    return dollars * F.when(batch, F.lit(discount)).otherwise(F.lit(1.0))


def prompt_text(make: Column, model: Column, year: Column, narrative: Column) -> Column:
    """Model input (the wording is a fixed value); blanks stay, so an empty field leaves its blank behind."""
    return F.concat(F.lit("Make/Model/Year: "), make, F.lit(" "), model, F.lit(" "), year, F.lit("\nNarrative: "), narrative)


def target_json(component: Column, crash: Column, fire: Column, injured: Column, deaths: Column) -> Column:
    """Model target: a JSON object in this key order."""
    count = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
    return F.to_json(F.struct(component.alias("component"), crash.alias("crash"), fire.alias("fire"), count(injured).alias("injured"), count(deaths).alias("deaths")))


def extract_json(text: Column, schema: str) -> Column:
    """The object from the first { to the last } of a reply; null if there is none or it is broken."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", F.from_json(found, schema, {"mode": "PERMISSIVE"}))


def after_last(value: Column, sep: str = "-") -> Column:
    return F.substring_index(value, sep, -1)


def shortened(value: Column, chars: int, mark: str = "") -> Column:
    return F.when(F.length(value) > chars, F.concat(F.left(value, F.lit(chars)), F.lit(mark))).otherwise(value)


def join_non_empty(*parts: Column, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def safe_filename(value: Column) -> Column:
    return F.translate(value, "/:", "__")


def mentions(text: Column, pattern: str = FIRE_WORDS) -> Column:
    """Whether the pattern occurs; false for null."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def hash_order(key: Column, seed: int | str) -> Column:
    """Reproducible random order: md5 of the key and the seed."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def changed(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(v: Column) -> Column:
    """Maximum, exponentials and their sum are each computed once, so the work is linear in the dimension."""
    top = F.struct(v.alias("v"), F.array_max(v).cast("double").alias("m"))
    exponentials = _bound(top, lambda t: F.transform(t["v"], lambda x: F.exp(x.cast("double") - t["m"])))
    summed = _bound(exponentials, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, y: a + y).alias("s")))
    return _bound(summed, lambda t: F.transform(t["e"], lambda x: x / t["s"]))


def top_k(probabilities: Column, k: int = 3) -> Column:
    """array<struct(p, label)> of the k largest entries, ties to the smaller label."""
    pairs = F.transform(probabilities, lambda p, i: F.struct(p.alias("p"), (-i).alias("neg")))
    best = F.slice(F.sort_array(pairs, asc=False), 1, k)
    return F.transform(best, lambda x: F.struct(x["p"].alias("p"), (-x["neg"]).alias("label")))


def argmax(v: Column) -> Column:
    """Position (from 0) of the first largest entry."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def year_bucket(year: Column, buckets: Iterable[tuple[str, int, int]]) -> Column:
    out = F.when(year.isNotNull(), F.lit("other")).otherwise(F.lit("unknown"))
    for name, low, high in buckets:
        out = F.when(year.between(low, high), F.lit(name)).otherwise(out)
    return out


def same_to_3dp(a: Column, b: Column) -> Column:
    return F.round(a, 3) == F.round(b, 3)


def windows_at(as_of: str, last_n: int = 24, prior_months: int = 240) -> dict[str, str]:
    """The drift windows that end at a month: the last months, and the pool before them."""
    last_start = shift_month(as_of, 1 - last_n)
    return {"last_start": last_start, "last_end": as_of, "pool_start": shift_month(last_start, -prior_months), "pool_end": shift_month(last_start, -1)}
