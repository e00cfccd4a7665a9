"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Base patterns find e-mail and IP addresses, card and phone numbers. These are the seeds:
the words around them are lexical patterns. In a graph of patterns and the identifiers seen
in them, a pattern is as good as the share of its identifiers that are known, and an
identifier as the patterns it occurs in; a few rounds of this score both, and identifiers
of no base kind whose patterns are trusted are personal data too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: An identifier this certain is personal data, and counts as known in the next round; a
#: pattern counts with so many known identifiers at least, and its share is taken as if it
#: had seen so many unknown ones more.
CERTAIN, LEAST_KNOWN, DOUBT = 0.9, 3.0, 2.0

_MARK = "\u0001"
# Loops are possessive: what follows them cannot start with what they take. A match starts
# where the last one ended or where no character of its own kind stands before it: any other
# start would fail as the earlier one did.
_EMAIL_AT = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))" + _EMAIL_AT,
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier of any kind: base forms, five digits or more, and words of
#: five characters or more that hold a digit, of any length.
_IDENTIFIER = (
    r"(?<![A-Za-z0-9._%+-])" + _EMAIL_AT + r"|\+[0-9][\x20().0-9-]+[0-9]|(?<![A-Za-z0-9])[0-9](?:[\x20.-]?[0-9]){4,}+(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{5,}+"
)


_RUN = 256


def _parts(text: Column, pattern: str, present: Column) -> Column:
    """The text cut at each match, leftmost and not overlapping: gaps and matches by turns."""
    return F.when(
        present, F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)
    ).otherwise(F.array(F.lit("")))


def _starts(parts: Column) -> Column:
    """Where each part starts; summed in runs, as growing an array copies it."""
    runs = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _RUN).cast("int"))

    def run(at: Column, k: Column) -> Column:
        return F.aggregate(
            F.slice(parts, k * _RUN + 1, _RUN), F.array(at),
            lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(part))),
        )

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("starts"))
    return F.aggregate(runs, first, lambda acc, k: F.struct(
        F.element_at(run(acc["at"], k), -1).alias("at"),
        F.concat(acc["starts"], F.array(F.slice(run(acc["at"], k), 1, _RUN))).alias("starts"),
    ), lambda acc: F.flatten(acc["starts"]))


def _matched(parts: Column, starts: Column, context: bool = False) -> Column:
    """The matches: array of start, end, value, and with ``context`` the words beside them:
    left, second (the one before it) and right. ``parts`` and ``starts`` are columns of
    their own, else they are computed anew for each match."""
    odd = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k % 2 == 1)

    def match(k: Column) -> Column:
        fields = [
            F.get(starts, k).alias("start"), (F.get(starts, k) + F.length(F.get(parts, k))).alias("end"), F.get(parts, k).alias("value"),
        ]
        if context:
            # Backwards, the words before a match are the first ones: a pattern tied to the
            # start of the gap reads no more of it than these words.
            back = F.reverse(F.get(parts, k - 1))
            fields += [
                F.lower(F.reverse(F.regexp_extract(back, r"^\s*+(\S++)", 1))).alias("left"),
                F.lower(F.reverse(F.regexp_extract(back, r"^\s*+\S++\s++(\S++)", 1))).alias("second"),
                F.lower(F.regexp_extract(F.get(parts, k + 1), r"^\s*+(\S++)", 1)).alias("right"),
            ]
        return F.struct(*fields)

    return F.transform(odd, match)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def worth(k: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        return F.when(k % 2 == 0, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, k: acc + worth(k))
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def _byte_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda part: part.cast("double") <= 255)


def _valid(kind: str, value: Column) -> Column:
    return {
        "email": lambda: F.lit(True), "ip": lambda: _byte_parts(value), "card": lambda: _luhn(value),
        "phone": lambda: F.length(_digits(value)).between(9, 15),
    }[kind]()


def _spans(kind: str, matched: Column) -> Column:
    return F.transform(F.filter(matched, lambda m: _valid(kind, m["value"])), lambda m: F.struct(
        F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")
    ))


def _is_seed(value: Column) -> Column:
    return (
        F.contains(value, F.lit("@")) | (value.startswith("+") & _valid("phone", value))
        | (value.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$") & _byte_parts(value))
        | (value.rlike(r"^[0-9](?:[ -]?[0-9])++$") & _luhn(value))
    )


def _identifiers(matched: Column, base: Column) -> Column:
    """Identifiers with what stands around them; known are those of a base kind. Identifiers
    that only touch a base span are left out."""
    free = F.filter(matched, lambda m: _is_seed(m["value"]) | ~F.exists(
        base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])
    ))
    return F.transform(free, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), _is_seed(m["value"]).alias("known"),
        m["left"].alias("left"), m["second"].alias("second"), m["right"].alias("right"),
    ))


def extracted(docs: DataFrame, *, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: __row (a number of its own), ``keep``, __id, __base (all base spans, by kind
    as listed, then start) and __identifiers."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _MARK, "\u0002")
    df = docs.select(*keep, F.col(id_col).alias("__id"), text.alias("__text"))
    text = F.col("__text")
    present = {
        "email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9 -]{11}"),
        "phone": text.rlike(r"\+[0-9]"), "any": text.rlike("[0-9@]"),
    }
    patterns = {**_PATTERNS, "any": _IDENTIFIER}
    df = df.withColumns({f"__p_{k}": _parts(text, pattern, present[k]) for k, pattern in patterns.items()})
    df = df.withColumns({f"__s_{k}": _starts(F.col(f"__p_{k}")) for k in patterns})
    df = df.withColumns({f"__m_{k}": _matched(F.col(f"__p_{k}"), F.col(f"__s_{k}"), k == "any") for k in patterns})
    df = df.withColumn("__base", F.concat(*[_spans(kind, F.col(f"__m_{kind}")) for kind in KINDS]))
    df = df.withColumn("__identifiers", _identifiers(F.col("__m_any"), F.col("__base")))
    return df.select(*keep, "__id", "__base", "__identifiers", F.monotonically_increasing_id().alias("__row"))


def certain_identifiers(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The identifiers of no base kind that patterns vouch for: value, certainty.

    ``seen``: one row per occurrence, with value, known, left, second, right. The graph is
    reduced to one row per pattern and identifier first; each round aggregates it by pattern
    and by identifier, and never gathers the neighbours of either.
    """
    def pattern(kind: str, *words: str) -> Column:
        there = F.lit(True)
        for word in words:
            there = there & (F.col(word) != "")
        return F.when(there, F.concat_ws(" ", F.lit(kind), *words))

    patterns = F.array_compact(F.array(
        pattern("after", "left"), pattern("before", "right"), pattern("between", "left", "right"),
        pattern("after two", "second", "left"),
    ))
    edges = stored(
        seen.select("value", "known", F.explode(patterns).alias("pattern"))
        .groupBy("pattern", "value").agg(F.max("known").alias("known")), "personal-graph",
    )
    nodes = edges.groupBy("value").agg(F.max(F.col("known").cast("double")).alias("certainty"))
    for k in range(rounds):
        mass = F.sum((F.col("certainty") >= CERTAIN).cast("double"))
        scores = (
            edges.join(nodes, "value").groupBy("pattern")
            .agg(mass.alias("mass"), F.count("*").alias("n")).where(F.col("mass") >= LEAST_KNOWN)
            .select("pattern", (F.col("mass") / (F.col("n") + DOUBT)).alias("share"))
        )
        doubt = F.sum(F.log1p(-F.col("share")))  # a share is below 1; null without a trusted pattern
        nodes = stored(
            edges.join(scores, "pattern", "left").groupBy("value").agg(
                F.max("known").alias("known"), F.coalesce(doubt, F.lit(0.0)).alias("doubt")
            ).select("value", F.when(F.col("known"), 1.0).otherwise(1 - F.exp("doubt")).alias("certainty"), "known"),
            f"personal-round-{k}",
        )
    return nodes.where(~F.col("known")).where(F.col("certainty") >= CERTAIN).select("value", "certainty")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _with_context(rows: DataFrame) -> DataFrame:
    """``rows`` with __spans: the base spans, then those of certain identifiers by start."""
    seen = rows.select("__row", F.explode("__identifiers").alias("m")).select("__row", "m.*")
    values = certain_identifiers(seen)
    more = seen.where(~F.col("known")).join(values, "value").groupBy("__row").agg(
        F.sort_array(F.collect_list(F.struct(F.lit("context").alias("kind"), "start", "end"))).alias("__more")
    )
    joined = rows.join(more.withColumnRenamed("__row", "__at"), F.col("__row") == F.col("__at"), "left").drop("__at")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return joined.withColumn("__spans", F.concat("__base", F.coalesce("__more", none)))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The personal data of each text; one row per row of ``docs``.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context. Spans are
    kind:start:end by kind (email, ip, card, phone, context), then start. Identifiers, and
    the words beside them, may have any length. Null or empty text: no spans, the digest of the empty string. Without seeds no pattern is trusted.
    Very long texts are read whole. Repeated rows and null ids stay as they are; an empty
    table gives no rows. Other columns are not read.
    """
    rows = _with_context(stored(extracted(docs, id_col=id_col, text_col=text_col), "personal"))

    def number(kind: str) -> Column:
        return F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        F.col("__id").alias("doc_id"), *[number(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_joined(F.col("__base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("__spans")).alias("spans"),
        number("context").alias("n_context"),
    )


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets.

    All columns and rows are kept. Of spans that overlap, the one that starts first (then
    the longer) is named, and the others' text goes with it. Null text stays null. A text
    without spans stays as it is.
    """
    own = docs.columns
    rows = _with_context(stored(extracted(docs, id_col=id_col, text_col=text_col, keep=tuple(own)), "personal"))
    order = F.sort_array(F.transform("__spans", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind")
    )))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        end = -s["last"]
        piece = F.when(s["start"] >= acc["at"], F.array(
            F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        )).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.concat(acc["pieces"], piece).alias("pieces"))

    whole = F.aggregate(order, start, step, lambda acc: F.concat(
        F.array_join(acc["pieces"], ""), F.substring(text, acc["at"] + 1, F.length(text))
    ))
    changed = F.when(F.size("__spans") > 0, whole).otherwise(F.col(text_col))
    return rows.select(*[changed.alias(c) if c == text_col else F.col(c) for c in own])
