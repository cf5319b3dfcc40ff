"""Secret scans in DataFrame operations only: pattern rules, and a randomness test battery for what they miss.

Spans come from splitting a text by a pattern: the pieces between matches and the matches give every place in code
points by running sums. The battery takes long unbroken tokens, infers an encoding from their alphabet, and tests each
against the null that it is writing: words joined as they are, in camel case, or by dashes, underscores or digits.

- uniformity: the chi-squared statistic of character counts against the even share of the alphabet; writing is uneven;
- runs: changes between lower case, upper case, digits and signs along the token; in writing at most half of the places;
- serial correlation: neighbours of which one is a vowel and one isn't; in writing at least 0.59 of the places, by far
  more than among random characters, since vowels and consonants take turns.

Each gives a z value by its moments under the null, on the safe side of what was measured on written tokens (see
WRITTEN). Stouffer's rule combines them into a p-value. Tokens are classed by encoding and length. Within each class the
Benjamini-Hochberg step-up rule, on counts of p-values in fine bins over all documents, sets the threshold; the level is
full for the longest class and halves with each shorter one, so that no class goes over the level.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base patterns, fixed by the contract: (kind, pattern, group that is measured, least length).
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
#: Patterns of the kept matches alone: a run of one alphabet ends where the alphabet does, so the least length can stand in
#: the pattern, and the many short runs of a text need no place.
KEPT = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: A cheap test for whether a text can have a kept match of each pattern at all.
HINTS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
KINDS = ["assign", "access", "hex", "random"]
#: Beyond every place.
FAR = (1 << 31) - 1
#: Tokens that the battery looks at: unbroken, of LEAST characters or more.
LEAST = 20
TOKEN = r"[A-Za-z0-9+/_-]{%d,}"
#: name, pattern, symbols.
ENCODINGS = [("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16), ("base32", r"^[A-Z2-7]+$", 32), ("alnum", r"^[A-Za-z0-9]+$", 62), ("base64", r"", 64)]
#: Moments under the null. Measured on 4,000 tokens of each kind and of 24, 40 and 64 characters, made of running English
#: words, and on 7,948 identifiers of program sources: equal pairs are 0.045 to 0.072 of all pairs of characters, with a
#: deviation of 0.078 / sqrt(n) at the lower end; class changes 0 to 0.50 of all places; vowel changes 0.59 to 0.67, with
#: a deviation of 0.43 to 0.49 / sqrt(n - 1). Taken are the ends next to random tokens. An alphabet of k characters can't
#: have fewer equal pairs than 1 / k; in small ones twice that counts as written.
WRITTEN = {"pairs": 0.045, "pair_deviation": 1.73, "changes": 0.5, "vowel_changes": 0.59}
#: Width of a bin of -log10 p, and where length classes begin.
BIN = 0.05
LENGTHS = [20, 24, 32, 48, 64]
SPANS = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, op) -> Column:
    """Array of op folded over an int array up to each place.

    Blocks of about sqrt(n) are folded apart and then lifted by what is before them: appending to an array copies it, so
    one fold over all of n would take n * n steps; this takes n * sqrt(n).
    """

    def fold(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda acc, v: F.array_append(acc, F.when(F.size(acc) == 0, v).otherwise(op(F.element_at(acc, -1), v))))

    def blocked(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        starts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / width).cast("int"))
        parts = F.transform(starts, lambda i: fold(F.slice(x, i * width + 1, width)))
        return let(parts, lambda p: let(fold(F.transform(p, lambda v: F.element_at(v, -1))), lambda sums: F.flatten(F.transform(p, lambda v, i: F.when(i == 0, v).otherwise(F.transform(v, lambda e: op(F.get(sums, i - 1), e)))))))

    return let(values, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(blocked(x)))


def shifted(values: Column, first: int) -> Column:
    """The array moved by one place, with a first value put before."""
    return let(values, lambda x: F.slice(F.concat(F.array(F.lit(first)), x), 1, F.size(x)))


def matches(text: Column, pattern: str, keep: Column | None = None, group: int = 0, least: int = 1) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches whose group has `least` characters or more."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    got = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)

    def spans(m: Column) -> Column:
        steps = F.zip_with(F.slice(pieces, 1, F.size(m)), m, lambda p, x: F.length(p) + F.length(x["match"]))
        placed = F.zip_with(m, running(steps, lambda a, v: a + v), lambda x, end: F.struct((end - F.length(x["match"])).alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.filter(placed, lambda x: F.length(x["value"]) >= least)

    out = let(F.arrays_zip(found.alias("match"), got.alias("value")), lambda m: F.when(F.size(m) == 0, F.array().cast(SPANS)).otherwise(spans(m)))
    return out if keep is None else F.when(keep, out).otherwise(F.array().cast(SPANS))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with one array of (start, end, value) for each base kind; expects a text without nulls in column text."""
    t = F.col("text")
    return docs.withColumns({kind: matches(t, KEPT.get(kind, pattern), t.rlike(HINTS[kind]), group, least) for kind, pattern, group, least in BASE})


def counts_of(token: Column) -> Column:
    """Array of how often each distinct character of a token occurs."""
    chars = F.split(token, "")
    return F.transform(F.array_distinct(chars), lambda c: F.length(token) - F.length(F.replace(token, c, F.lit(""))))


def normal_tail(z: Column) -> Column:
    """-log10 of the normal distribution's upper tail, by the bound phi(z) * 2 / (z + sqrt(z^2 + 8/pi)); z below 0 counts as 0."""
    z = F.greatest(z, F.lit(0.0))
    return (z * z / 2 + 0.9189385332046727 - 0.6931471805599453 + F.log(z + F.sqrt(z * z + 2.5464790894703255))) / 2.302585092994046


def by_encoding(token: Column, values: list) -> Column:
    """The value that belongs to a token's inferred encoding: the narrowest alphabet that holds it."""
    out = F.lit(values[-1])
    for (_, pattern, *_), v in reversed(list(zip(ENCODINGS[:-1], values, strict=False))):
        out = F.when(token.rlike(pattern), F.lit(v)).otherwise(out)
    return out


def evidence(token: Column) -> Column:
    """-log10 p of the combined battery against the null that the token is writing."""
    n = F.length(token).cast("double")
    k = by_encoding(token, [float(x[2]) for x in ENCODINGS])
    pairs = F.greatest(F.lit(WRITTEN["pairs"]), 2 / k)
    chi = k / n * F.aggregate(counts_of(token), F.lit(0.0), lambda a, c: a + c.cast("double") * c) - n
    uniform = (k * (1 + (n - 1) * pairs) - n - chi) / (k * (n - 1) * WRITTEN["pair_deviation"] * pairs / F.sqrt(n))
    binomial = lambda x, p: (x - p * (n - 1)) / F.sqrt((n - 1) * p * (1 - p))
    kinds = F.translate(token, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "A" * 26 + "a" * 26 + "0" * 10 + "+" * 4)
    runs = binomial(F.length(F.regexp_replace(kinds, r"(.)\1*+", "$1")) - 1, WRITTEN["changes"])
    vowels = F.translate(F.lower(token), "aeiouybcdfghjklmnpqrstvwxz0123456789+/_-", "1" * 6 + "0" * 34)
    serial = -binomial(F.length(F.regexp_replace(vowels, r"(.)\1*+", "$1")) - 1, WRITTEN["vowel_changes"])
    return normal_tail((uniform + runs + serial) / math.sqrt(3))


def class_of(token: Column) -> Column:
    """A number for encoding and length class."""
    length_class = sum((F.length(token) >= x).cast("int") for x in LENGTHS[1:])
    return by_encoding(token, list(range(len(ENCODINGS)))) * len(LENGTHS) + length_class


def thresholds(tokens: DataFrame, level: float) -> dict[int, int]:
    """The least bin of evidence that passes the step-up rule, for each class that has one; tokens: class, bin.

    The level of a class falls with its length class, by halves from the longest down, since short tokens carry less
    evidence. There are no more classes than encodings times length classes, whatever the corpus.
    """
    bins = tokens.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("c"))
    per = bins.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("bin", "c")), asc=False).alias("bins"), F.sum("c").alias("m"))
    share = level / F.pow(F.lit(2.0), len(LENGTHS) - 1 - F.col("class") % len(LENGTHS))
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("least"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["c"]
        passes = F.pow(F.lit(10.0), -x["bin"] * BIN) <= seen * share / F.col("m")
        return F.struct(seen.alias("seen"), F.when(passes, x["bin"]).otherwise(acc["least"]).alias("least"))

    found = per.select("class", F.aggregate("bins", zero, step, lambda a: a["least"]).alias("least")).filter("least is not null")
    return {r["class"]: r.least for r in found.collect()}


def spans_in_order(kinds: list[str]) -> Column:
    """Sorted array of (start, rank, end) of all spans of the kinds."""
    return F.sort_array(F.concat(*(F.transform(k, ranked(i)) for i, k in enumerate(kinds))))


def free_tokens(tokens: str) -> Column:
    """The tokens that no base span overlaps: what begins before a token ends before it, what begins later begins behind it."""

    def pick(x: Column) -> Column:
        before = shifted(running(F.transform(x, lambda v: F.when(v["rank"] < 3, v["end"]).otherwise(0)), F.greatest), 0)
        after = F.reverse(shifted(running(F.reverse(F.transform(x, lambda v: F.when(v["rank"] < 3, v["start"]).otherwise(FAR))), F.least), FAR))
        ok = F.zip_with(x, F.arrays_zip(before.alias("a"), after.alias("b")), lambda v, w: F.struct(v["rank"].alias("rank"), ((w["a"] <= v["start"]) & (w["b"] >= v["end"])).alias("ok")))
        flags = F.transform(F.filter(ok, lambda v: v["rank"] == 3), lambda v: v["ok"])
        return F.transform(F.filter(F.arrays_zip(F.col(tokens).alias("t"), flags.alias("ok")), lambda v: v["ok"]), lambda v: v["t"])

    return F.when(F.size(tokens) == 0, F.col(tokens)).otherwise(let(spans_in_order([*KINDS[:3], tokens]), pick))


def scan(docs: DataFrame, level: float = 0.01, least: int = LEAST) -> tuple[DataFrame, Callable[[Column], Column]]:
    """docs' columns, with text coalesced to empty, and assign, access, hex, tokens, random: arrays of (start, end, value);
    and the condition that a found token's value fulfils.

    Places are code points, ends exclusive. tokens holds all long tokens, random those outside every base span that the
    battery finds at the false-discovery level. Null and empty texts have no spans; repeated rows get equal results; a
    text takes a little more than linear time. Columns of docs with one of the five names are replaced here; report() and
    redact() don't mix them up.
    """
    base = base_spans(docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    pattern = TOKEN % least
    rows = base.withColumn("tokens", matches(F.col("text"), pattern, F.col("text").rlike(pattern))).withColumn("random", free_tokens("tokens"))
    bin_of = lambda v: F.floor(evidence(v) / BIN).cast("int")
    tokens = rows.select(F.explode_outer(F.transform("random", lambda x: F.struct(class_of(x["value"]).alias("class"), bin_of(x["value"]).alias("bin")))).alias("t")).select("t.class", "t.bin").filter("bin is not null")
    found = thresholds(tokens, level)
    if not found:
        return rows.withColumn("random", F.array().cast(SPANS)), lambda value: F.lit(False)
    need = F.create_map(*(F.lit(x) for kv in found.items() for x in kv))
    passes = lambda value: F.coalesce(bin_of(value) >= F.element_at(need, class_of(value)), F.lit(False))
    return rows.withColumn("random", F.filter("random", lambda x: passes(x["value"]))), passes


def ranked(rank: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))


def listed(kinds: list[str]) -> Column:
    """kind:start:end of all spans of the kinds by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(spans_in_order(kinds), lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, level: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans for every row of docs."""
    found, _ = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), level)
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"), listed(KINDS).alias("spans"))


def redact(docs: DataFrame, level: float = 0.01) -> DataFrame:
    """docs, same columns, with every found span replaced by [kind]; overlapping spans become one.

    n_chars, where there is one, becomes the new text's length for changed texts. Texts without spans stay as they
    are, null included.
    """
    columns = docs.columns
    found, passes = scan(docs.select(F.struct("*").alias("row"), "text"), level)
    rows = found.withColumn("spans", spans_in_order(KINDS)).withColumn("nested", well_nested())
    clean = F.when(F.size("spans") == 0, F.col("row.text")).when(F.col("nested"), kind_by_kind(F.col("text"), passes)).otherwise(merged_spans())
    out = rows.withColumn("clean", clean)
    changed = {"text": F.col("clean")}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(F.size("spans") == 0, F.col("row.n_chars")).otherwise(F.length("clean").cast(docs.schema["n_chars"].dataType))
    return out.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))


def well_nested() -> Column:
    """Whether each base span and long token lies inside one before it or behind all before it."""

    def check(x: Column) -> Column:
        before = shifted(running(F.transform(x, lambda v: v["end"]), F.greatest), 0)
        return F.forall(F.zip_with(x, before, lambda v, end: (v["start"] >= end) | (v["end"] <= end)), lambda ok: ok)

    return let(spans_in_order([*KINDS[:3], "tokens"]), check)


def replaced(kind: str, pattern: str, group: int, keep: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A text with the pattern's matches, where their group is to be kept secret, replaced by the kind."""

    def put(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        got = found if group == 0 else F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
        parts = F.arrays_zip(F.split(t, pattern, -1).alias("piece"), found.alias("match"), got.alias("value"))
        return F.array_join(F.transform(parts, lambda x: F.concat(x["piece"], F.when(x["match"].isNull(), "").when(keep(x["value"]), f"[{kind}]").otherwise(x["match"]))), "")

    return put


def kind_by_kind(text: Column, passes: Callable[[Column], Column]) -> Column:
    """The text with one kind of spans after the other replaced, between the pieces that its pattern splits; linear.

    Marks stand in brackets, which no pattern takes, so that what lies beside a span reads as before.
    """
    for kind, pattern, group, least in BASE:
        text = let(text, replaced(kind, KEPT.get(kind, pattern), group, lambda v, n=least: F.length(v) >= n))
    return let(text, replaced(KINDS[3], TOKEN % LEAST, 0, passes))


def merged_spans() -> Column:
    """The text with overlapping spans as one, named by the first: for texts where spans cross each other."""
    names = F.array(*(F.lit(k) for k in KINDS))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(piece, F.concat(F.lit("["), F.get(names, x["rank"]), F.lit("]"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return F.aggregate("spans", zero, step, rest)
