"""Scalar building blocks as plain Column expressions (no Python UDFs)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------
TCP_FLAGS = {"tcp_syn": 0x02, "tcp_ack": 0x10, "tcp_fin": 0x01, "tcp_rst": 0x04}
PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP", 58: "ICMPV6"}
UP_WORDS = ("up", "upload", "client_to_server", "c2s")
DOWN_WORDS = ("down", "download", "server_to_client", "s2c")
OUT_WORDS = ("out", "outbound", "tx", "sent", "send")
IN_WORDS = ("in", "inbound", "rx", "received", "recv")
TIME_ALIASES = (
    "timestamp_epoch",
    "packet_timestamp",
    "timestamp",
    "time_epoch",
    "relative_time_sec",
    "relative_time",
)
REPRESENTATIONS = {0.5: "0.5 s", 1.0: "1 s", 2.0: "2 s", 5.0: "5 s"}
PROBABILITY_FLOOR = 1e-9
ABSENT_CLASS_PROBABILITY = 1e-15
# -------------------------------------------------------------------------


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text(value: Column | str) -> Column:
    """Trimmed text, null as empty."""
    return F.trim(F.coalesce(col(value).cast("string"), F.lit("")))


def filled(value: Column | str) -> Column:
    """Trimmed text, blank as null, so that parsers skip it without an exception."""
    return F.nullif(F.trim(col(value).cast("string")), F.lit(""))


def first_nonempty(*values: Column | str) -> Column:
    return F.coalesce(*[F.nullif(text(v), F.lit("")) for v in values], F.lit(""))


def finite(value: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def lenient_float(value: Column | str, default: float | None = 0.0) -> Column:
    parsed = finite(filled(value).try_cast("double"))
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def _prefixed(raw: Column, prefix: str, digits: str, base: int) -> Column:
    """0x/0o/0b integers; the pattern only runs on text that has the prefix."""
    signed = raw.startswith("-")
    magnitude = F.conv(F.regexp_extract(raw, digits + "+$", 0), base, 10).try_cast("long")
    number = F.when(signed, -magnitude).otherwise(magnitude)
    return F.when(raw.contains(prefix) & raw.rlike(f"^[+-]?{prefix}{digits}+$"), number)


def lenient_int(value: Column | str, default: int | None = 0) -> Column:
    """Integer with 0x/0o/0b prefix, else decimal truncated toward zero."""
    raw = F.lower(filled(value))
    parsed = F.coalesce(
        raw.try_cast("long"),
        _prefixed(raw, "0x", "[0-9a-f]", 16),
        _prefixed(raw, "0o", "[0-7]", 8),
        _prefixed(raw, "0b", "[01]", 2),
        finite(raw.try_cast("double")).try_cast("long"),
    )
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast("long"))


def strict_float(value: Column | str) -> Column:
    """Empty is 0, anything else must be a finite number or the query fails."""
    raw = text(value)
    parsed = finite(raw.try_cast("double"))
    return F.when(raw == "", F.lit(0.0)).when(parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit("not a finite number: "), raw)).cast("double")
    )


def int_list(value: Column | str) -> Column:
    """``a;b,c`` to array<bigint>; blanks, garbage and negatives are dropped."""
    pieces = F.split(F.coalesce(filled(value), F.lit("")), "[;,]")
    parsed = F.transform(pieces, lambda p: lenient_int(p, None))
    return F.filter(parsed, lambda v: v >= 0)


def tolerant_list(value: Column | str) -> Column:
    """Accepts list literals and ``,`` ``;`` ``|`` or blank separators."""
    bare = F.regexp_replace(F.coalesce(col(value).cast("string"), F.lit("")), r"[\[\]()]", " ")
    pieces = F.filter(F.split(bare, r"[,;|\s]+"), lambda p: p != "")
    return F.filter(F.transform(pieces, lambda p: lenient_float(p)), lambda v: v >= 0)


def mask_value(mask: Column | str) -> Column:
    """First parsable piece of a TCP flag mask, null if there is none."""
    pieces = F.transform(F.split(text(mask), "[;,]"), lambda p: _whole_number(p))
    return F.get(F.filter(pieces, lambda v: v.isNotNull()), F.lit(0))


def _whole_number(value: Column) -> Column:
    raw = F.lower(filled(value))
    plain = F.when(raw.rlike("^[+-]?(0+|[1-9][0-9]*)$"), raw.try_cast("long"))
    return F.coalesce(
        _prefixed(raw, "0x", "[0-9a-f]", 16),
        plain,
        _prefixed(raw, "0o", "[0-7]", 8),
        _prefixed(raw, "0b", "[01]", 2),
    )


def with_flags(df: DataFrame, mask: str = "tcp_flags_hex", fallback: Mapping[str, str] | None = None) -> DataFrame:
    """SYN/ACK/FIN/RST from the mask, from per-flag columns only where it is blank."""
    fallback = fallback or {}
    bits = F.col("_bits")

    def flag(name: str, bit: int) -> Column:
        other = (lenient_int(fallback[name]) != 0).cast("int") if name in fallback else F.lit(0)
        return F.when(bits.isNotNull(), (bits.bitwiseAND(F.lit(bit).cast("long")) != 0).cast("int")).otherwise(other)

    return (
        df.withColumn("_bits", mask_value(mask))
        .withColumns({name: flag(name, bit) for name, bit in TCP_FLAGS.items()})
        .drop("_bits")
    )


def transport_name(ip_protocol: Column | str, ipv6_next_header: Column | str | None = None) -> Column:
    number = lenient_int(
        first_nonempty(ip_protocol, ipv6_next_header) if ipv6_next_header is not None else ip_protocol, -1
    )
    names = F.create_map(*[F.lit(v) for pair in PROTOCOLS.items() for v in pair])
    return F.coalesce(F.try_element_at(names, number.cast("int")), F.lit("OTHER"))


def direction_of(
    src_is_client: Column, dst_is_client: Column, src_is_server: Column, dst_is_server: Column
) -> Column:
    """Client membership decides first, then the server address."""
    return (
        F.when(src_is_client & ~dst_is_client, "up")
        .when(dst_is_client & ~src_is_client, "down")
        .when(dst_is_server, "up")
        .when(src_is_server, "down")
        .otherwise("unknown")
    )


def normalized_direction(value: Column | str, role: Column | str) -> Column:
    raw, vantage = F.lower(text(value)), F.lower(text(role))
    sent, received = raw.isin(*OUT_WORDS), raw.isin(*IN_WORDS)
    return (
        F.when(raw.isin(*UP_WORDS), "up")
        .when(raw.isin(*DOWN_WORDS), "down")
        .when(((vantage == "client") & sent) | ((vantage == "server") & received), "up")
        .when(((vantage == "client") & received) | ((vantage == "server") & sent), "down")
        .otherwise("unknown")
    )


def canonical_client(value: Column | str) -> Column:
    """``Client-7`` and the like become ``client_7``; other names stay."""
    raw = text(value)
    bare = F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "")
    digits = F.regexp_extract(bare, r"client(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("client_"), digits)).otherwise(first_nonempty(raw, bare, F.lit("unknown")))


def endpoint_client(value: Column | str) -> Column:
    """Endpoint tables: digits alone are a client too, unknown names are null."""
    raw = F.lower(text(value))
    digits = F.regexp_extract(raw, r"client[_\-\s]?(\d+)", 1)
    return (
        F.when(digits != "", F.concat(F.lit("client_"), digits.cast("long").cast("string")))
        .when(raw.rlike(r"^\d+$"), F.concat(F.lit("client_"), raw.try_cast("long").cast("string")))
        .when(raw.startswith("client_"), raw)
    )


def source_role(participant: Column | str) -> Column:
    raw = F.lower(text(participant))
    return (
        F.when((raw == "proxy") | raw.startswith("proxy_"), "proxy")
        .when((raw == "server") | raw.startswith("server_"), "server")
        .when(raw.startswith("client"), "client")
        .otherwise("unknown")
    )


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def floor_divide(a: Column, b: Column | float) -> Column:
    """Quotient floor taken from the exact remainder, so 1.0 // 0.1 is 9."""
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.floor((a - a % b) / b + 0.5)


def connection_key(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port", transport="transport_protocol") -> Column:
    """Same key for both directions of a connection."""
    ends = F.array_sort(
        F.array(
            F.struct(col(src_ip).alias("ip"), col(src_port).alias("port")),
            F.struct(col(dst_ip).alias("ip"), col(dst_port).alias("port")),
        )
    )
    return F.concat_ws(
        "|",
        col(transport),
        F.concat_ws(":", ends[0]["ip"], ends[0]["port"].cast("string")),
        F.concat_ws(":", ends[1]["ip"], ends[1]["port"].cast("string")),
    )


def safe_alias(value: Column | str, fallback: Column | str = "trace") -> Column:
    """Letters, digits, ``-`` and ``_`` stay; every other character becomes ``_``."""
    bare = F.regexp_replace(text(value), r"[^A-Za-z0-9_-]", "_")
    bare = F.regexp_replace(bare, r"^_+|_+$", "")
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(bare == "", other).otherwise(bare)


def run_id_from_path(path: Column | str, embedded: Column | str | None = None) -> Column:
    """Run folder below ``collected_experiments`` on the proxy side, else the embedded id."""
    found = F.regexp_extract(col(path), r"collected_experiments/(run_[^/]+)/proxy/", 1)
    return first_nonempty(found, embedded) if embedded is not None else found


def last_run_folder(path: Column | str) -> Column:
    parts = F.filter(F.split(col(path), "/"), lambda p: p.startswith("run_"))
    return F.try_element_at(parts, F.lit(-1))


def representation(row_type: Column | str, window_size: Column | str) -> Column:
    """Report name of a feature row: a window scale, the whole trace, or null."""
    kind, size = F.lower(text(row_type)), lenient_float(window_size, -1.0)
    name = F.when(kind == "overall", "Aggregated")
    for scale, label in REPRESENTATIONS.items():
        name = name.when((kind == "window") & (F.abs(size - scale) < 1e-9), label)
    return name


def compact_count(value: Column | str, largest: str = "B") -> Column:
    """Short form of a count, in units up to ``largest`` (K, M or B); one digit, rounded by the double's exact value."""
    number = col(value).cast("double")
    label = number.cast("long").cast("string")
    for suffix, unit in (("K", 1e3), ("M", 1e6), ("B", 1e9)):
        scaled = F.call_function("format_number", number / F.lit(unit), F.lit("0.0"))
        label = F.when(F.abs(number) >= unit, F.concat(scaled, F.lit(suffix))).otherwise(label)
        if suffix == largest:
            break
    return label


def soften(probs: Column, temperature: float | Column) -> Column:
    """Temperature softening of a probability array."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    logits = F.transform(
        probs, lambda p: F.log(F.least(F.greatest(p, F.lit(PROBABILITY_FLOOR)), F.lit(1.0))) / t
    )
    top = F.array_max(logits)
    return normalized(F.transform(logits, lambda v: F.exp(v - top)))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def normalized(values: Column) -> Column:
    total = array_sum(values)
    return F.transform(values, lambda v: v / total)


def align_probabilities(probs: Column, classes: Sequence[str], fill: float = ABSENT_CLASS_PROBABILITY) -> Column:
    """Map of known classes to an array in class order, absent ones filled."""
    filled = F.array(*[F.coalesce(F.try_element_at(probs, F.lit(c)), F.lit(fill)) for c in classes])
    return normalized(filled)


def metric_delta(current: Column, previous: Column, improvement: str = "up") -> Column:
    now, before = finite(current), finite(previous)
    return before - now if improvement == "down" else now - before


def stable_seed(seed: int, budget: Column | int, *trace: Column | str) -> Column:
    """First four digest bytes, little end first, of the joined trace key."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), budget.cast("string"), *[col(t) for t in trace]), 256)
    pairs = [F.substring(digest, start, 2) for start in (7, 5, 3, 1)]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")


def phase_start(end_epoch: Column | str, duration_ms: Column | str) -> Column:
    return finite(col(end_epoch)) - finite(col(duration_ms)) / 1000.0


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    overlap = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(union > 0, overlap / union).otherwise(F.lit(0.0))


def mean_squared_difference(a: Column, b: Column) -> Column:
    """Per-row reconstruction error; arrays of different length fail the query."""
    total = array_sum(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")))
    return F.when(F.size(a) == F.size(b), total / F.size(a)).otherwise(
        F.raise_error(F.lit("reconstruction arrays differ in length")).cast("double")
    )


def l2_norm(a: Column) -> Column:
    return F.sqrt(array_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def draw(*parts: Column) -> Column:
    """A 60-bit number from the md5 of the parts, which any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body (or a lambda in it) names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_ids(value: Column | str, length: int, vocabulary: int) -> Column:
    """Arrays of ``length`` ids: lower-cased words hashed into ``[2, vocabulary)``, the last array padded with 0.

    Together they hold every word of the text; a text without words is one array of zeros.
    """
    words = F.filter(F.split(F.lower(F.trim(F.coalesce(col(value), F.lit("")))), r"\s+"), lambda w: w != "")

    def piece(own: Column, i: Column) -> Column:
        ids = F.transform(F.slice(own, i * length + 1, length), lambda w: F.lit(2) + draw(w) % F.lit(vocabulary - 2))
        missing = F.greatest((i + 1) * length - F.size(own), F.lit(0))
        return F.concat(ids, F.array_repeat(F.lit(0).cast("long"), missing))

    def pieces(own: Column) -> Column:
        last = F.greatest(F.ceil(F.size(own) / length).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: piece(own, i))

    return bound(words, pieces)


def masked_tokens(tokens: Column, row_key: Column, seed: int, probability: float = 0.15) -> tuple[Column, Column]:
    """(inputs, targets): chosen positions become id 1, other targets are -100.

    At least one eligible position (id above 1) is chosen: the one with the
    smallest draw.
    """
    draws = F.transform(
        tokens,
        lambda v, i: F.when(v > 1, draw(row_key, i, F.lit(seed)) % F.lit(1_000_000) / 1e6),
    )

    def choice(d: Column, least: Column) -> Column:
        return F.transform(d, lambda x: F.coalesce((x < probability) | (x == least), F.lit(False)))

    def sides(chosen: Column) -> Column:
        return F.struct(
            F.zip_with(tokens, chosen, lambda v, c: F.when(c, F.lit(1).cast("long")).otherwise(v)).alias("inputs"),
            F.zip_with(tokens, chosen, lambda v, c: F.when(c, v).otherwise(F.lit(-100).cast("long"))).alias("targets"),
        )

    both = bound(draws, lambda d: bound(F.array_min(d), lambda least: bound(choice(d, least), sides)))
    return both["inputs"], both["targets"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Half-up rounding of every double column (comparison and report form)."""
    unit = float(10**digits)
    return df.select(
        *[
            (F.floor(F.col(f"`{f.name}`") * unit + 0.5) / unit).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
