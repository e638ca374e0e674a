"""Scalar functions on columns: hashes, times, labels, tokens, vectors and guarded arithmetic."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
US_EASTERN = "America/New_York"


def digest(text: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(text, 256)


def event_uuid_hash(uuid: Column) -> Column:
    """the empty string for null or empty identities, else SHA-256 in hex."""
    return F.when(uuid.isNull() | (uuid == ""), "").otherwise(digest(uuid))


def ns_to_text(ns: Column, zone: str = US_EASTERN) -> Column:
    """nanoseconds as local wall clock with nine decimals."""
    local = F.from_utc_timestamp(F.timestamp_seconds(F.floor(ns / F.lit(NS).cast("decimal(20,0)"))), zone)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(F.pmod(ns, F.lit(NS)).cast("string"), 9, "0"))


def seconds_to_text(seconds: Column, zone: str = US_EASTERN) -> Column:
    """F5."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone), "yyyy-MM-dd HH:mm:ss")


def text_to_ns(text: Column, zone: str = US_EASTERN) -> Column:
    """local wall clock to nanoseconds; microseconds are the finest that a timestamp keeps."""
    return F.unix_micros(F.to_utc_timestamp(F.to_timestamp(text), zone)) * F.lit(1000)


def iso_to_ns(text: Column, offset_hours: int = 4) -> Column:
    """`2019-09-23T11:23:45.5-04:00`: the digits after the point are milliseconds as they stand, without padding."""
    whole = F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d)T", 1)
    clock = F.regexp_extract(text, r"T(\d\d:\d\d:\d\d)", 1)
    millis = F.regexp_extract(text, r"\.(\d+)", 1)
    seconds = F.unix_seconds(F.to_timestamp(F.concat_ws(" ", whole, clock))) + offset_hours * 3600
    return seconds * F.lit(NS) + F.when(millis != "", millis).otherwise("0").cast("long") * F.lit(1_000_000)


def seconds_nanos_to_ns(text: Column) -> Column:
    """F8: "seconds.nanos" with its digits put together."""
    return F.replace(text, F.lit("."), F.lit("")).cast("long")


def path_tokens(label: Column) -> Column:
    """slashes stand alone; tokens are cut at white space. Punctuation stays with its word."""
    return _tokens(F.replace(F.regexp_replace(label, r"\\+", "/"), F.lit("/"), F.lit(" / ")))


def netflow_tokens(label: Column) -> Column:
    """colons and points stand alone."""
    return _tokens(F.regexp_replace(label, r"([:.])", " $1 "))


def any_tokens(label: Column) -> Column:
    """slashes, colons and points stand alone."""
    return _tokens(F.regexp_replace(label, r"([/:.])", " $1 "))


def _tokens(padded: Column) -> Column:
    words = F.filter(F.split(padded, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(words)


def label_tokens(node_type: Column, label: Column) -> Column:
    """by type of node; an empty label has the one token ""."""
    return F.when(node_type == "netflow", netflow_tokens(label)).when(node_type.isin("subject", "file"), path_tokens(label)).otherwise(any_tokens(label))


def prefixes(text: Column, separator: str = "/") -> Column:
    """a, a/b, a/b/c of a path or of an address."""
    parts = F.split(text, f"\\Q{separator}\\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def joined(parts: Column) -> Column:
    """F14."""
    return F.array_join(parts, "")


def word_weights(n: Column, percent: float) -> Column:
    """n weights that fall (percent > 0) in equal steps and sum to one."""
    step = -percent / (100.0 * n)
    first = 1.0 / n - 0.5 * (n - 1) * step
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: first + i * step)).otherwise(F.array().cast("array<double>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, epsilon: float = 1e-12) -> Column:
    """F16."""
    wide = v.cast("array<double>")
    return F.transform(wide, lambda x: x / (l2(wide) + epsilon))


def cosine(a: Column, b: Column) -> Column:
    """M6: clamped to [-1, 1]; 0 for a zero vector."""
    norms = l2(a) * l2(b)
    return F.when(norms > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))).otherwise(0.0)


def relation_id(number: Column, kinds: int) -> Column:
    """The id as a one-hot vector carries it; 0 wraps to the last."""
    return F.pmod(number - 1, F.lit(kinds)) + 1


def relation_token(number: Column, label: Column) -> Column:
    """"id:n" where there is a number, else "label:s"."""
    return F.coalesce(F.concat(F.lit("id:"), number.cast("string")), F.concat(F.lit("label:"), label))


def strict_long(text: Column) -> Column:
    """digits only; whatever else is an error, not null."""
    return F.when(text.isNull(), None).otherwise(F.coalesce(text.cast("string").try_cast("long"), F.raise_error(F.concat(F.lit("not an integer: "), text.cast("string"))).cast("long")))


def severity(score: Column) -> Column:
    """F21."""
    bands = ((1, "Negligible"), (10, "Minor"), (100, "Moderate"), (1000, "Significant"))
    out = F.lit("Critical")
    for limit, name in reversed(bands):
        out = F.when(score <= limit, name).otherwise(out)
    return out


def node_type_order(node_type: Column) -> Column:
    """F22."""
    return F.when(node_type == "netflow", 1).when(node_type.isin("process", "subject"), 2).when(node_type == "file", 3).otherwise(4)


def unit_range(x: Column, low: Column, high: Column) -> Column:
    """Clipped to [0, 1]; 0 where there is no range."""
    return F.when(high <= low, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x - low, high - low))))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """0 where the denominator is 0."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(under == 0, 0.0).otherwise(F.try_divide(tp * tn - fp * fn, under))


def fraction(part: Column, whole: Column) -> Column:
    """null where it is undefined."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def edge_cost(score: Column, scale: Column, distance: Column, gap: Column, penalty: Column, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0) -> Column:
    """dearer the less anomalous, the farther from a seed in time, and by kind of relation."""
    doubt = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / scale))
    return alpha * doubt + beta * F.least(F.lit(1.0), distance / gap) + gamma * F.coalesce(penalty, F.lit(1.0))


def equal_parts(total: Column, parts: int) -> Column:
    """the first total mod parts of them get one more."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.floor(total / parts).cast("long") + F.when(i < total % parts, 1).otherwise(0))


def short_host(name: Column) -> Column:
    """F30."""
    return F.split_part(name, F.lit("."), F.lit(1))


def position_code(position: Column, width: int) -> Column:
    """sines at even places, cosines at odd ones."""
    rate = lambda i: F.exp(-F.log(F.lit(10000.0)) * (i - i % 2) / width)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i % 2 == 0, F.sin(position * rate(i))).otherwise(F.cos(position * rate(i))))


def time_code(t: Column, weights: Sequence[float], shifts: Sequence[float]) -> Column:
    """F32: cosines of linear functions of time, with given parameters."""
    return F.array(*(F.cos(t * w + b) for w, b in zip(weights, shifts)))


def display_label(path: Column, cmd: Column) -> Column:
    """F33."""
    return F.replace(F.concat_ws("-", F.coalesce(path, F.lit("None")), F.coalesce(cmd, F.lit("None"))), F.lit("None-"), F.lit(""))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Any of the words is in the text, by case."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found
