"""Text expressions of captions, phrases and prompts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a person word reads as in scene labels.
PERSON = {
    "woman": "person", "women": "persons", "man": "person", "men": "persons", "child": "person", "children": "persons", "boy": "person", "boys": "persons",
    "girl": "person", "girls": "persons", "teenager": "person", "teenagers": "persons", "adult": "person", "adults": "persons", "senior": "person", "seniors": "persons",
    "male": "person", "females": "persons", "infant": "person", "infants": "persons", "toddler": "person", "toddlers": "persons", "youth": "person", "elders": "persons",
    "adolescent": "person", "adolescents": "persons", "baby": "person", "babies": "persons", "elderly": "person", "teen": "person", "kid": "person", "kids": "persons",
    "gentleman": "person", "gentlemen": "persons", "lady": "person", "ladies": "persons",
}
#: Words that detectors' labels use for a person.
GROWN = ("man", "woman", "men", "women")
PUNCTUATION = "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"


def normalized(s: Column) -> Column:
    """Lower case, white space runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def words(s: Column) -> Column:
    """ASCII word runs in order."""
    return F.regexp_extract_all(s, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))


def contains_run(tokens: Column, label: Column) -> Column:
    """Whether the label's words stand in a row among the tokens; an empty label does."""
    n = F.size(label)
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return (n == 0) | F.exists(at, lambda i: F.slice(tokens, i, n) == label)


def after_colon(s: Column, lower: bool = False) -> Column:
    """What follows the first colon, other colons read as blanks; without one, the text as it is."""
    rest = F.trim(F.array_join(F.slice(F.split(s, ":"), 2, 1 << 20), " "))
    return F.when(F.instr(s, ":") > 0, F.lower(rest) if lower else rest).otherwise(s)


def without_assistant(s: Column) -> Column:
    return F.regexp_replace(s, r"(?i)\b(?:as)?sistant:?\s*", "")


def without_punctuation(s: Column) -> Column:
    """All ASCII punctuation but commas and periods goes."""
    return F.translate(s, PUNCTUATION, "")


def span_of(text: Column, phrase: Column) -> Column:
    """(start, end) of the first occurrence without regard to case, null without one."""
    at = F.instr(F.lower(text), F.lower(phrase))
    return F.when(at > 0, F.struct((at - 1).cast("long").alias("start"), (at - 1 + F.length(phrase)).cast("long").alias("end")))


def differs_by_s(a: Column, b: Column) -> Column:
    return (a == F.concat(b, F.lit("s"))) | (b == F.concat(a, F.lit("s")))


def as_person(label: Column) -> Column:
    """Detectors' words for a person, in either case, as person; others as they are."""
    return F.when(F.lower(label).isin(*GROWN), "person").otherwise(label)


def as_person_or_persons(label: Column) -> Column:
    """Chosen labels of the fixed table as person or persons, others as they are."""
    table = F.create_map(*(F.lit(x) for kv in PERSON.items() for x in kv))
    return F.coalesce(F.element_at(table, label), label)


def tagged(caption: Column, spans: Column, before: str = "<p> ", after: str = " </p> [SEG]") -> Column:
    """Tags around sorted, disjoint (start, end) spans, put in from the right."""
    put = lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"].cast("int")), F.lit(before), F.substring(acc, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")), F.lit(after), F.substring(acc, s["end"].cast("int") + 1, F.length(acc)))
    return F.aggregate(F.sort_array(spans, asc=False), caption, put)


def phrases_in_tags(s: Column) -> Column:
    """What stands between <p> and </p> in a line, which ends at \\n alone; blanks of any kind go at both ends."""
    trimmed = lambda v: F.regexp_replace(v, r"\A\p{Zs}+|(?<!\p{Zs})\p{Zs}+\z", "")
    return F.transform(F.regexp_extract_all(s, F.lit(r"<p>([^\n]*?)</p>"), F.lit(1)), trimmed)


def cleaned(s: Column) -> Column:
    """The answer's text: what follows the last assistant mark, without tags, segment marks and single quotes."""
    last = F.element_at(F.split(s, "ASSISTANT: "), -1)
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.regexp_replace(last, r"<.*?>", ""), F.lit("[SEG]"), F.lit("")), r"\s+", " "), "'", ""))


def prompt(turns: Column, style: str, system: str = "", sep: str = " ", sep2: str = "</s>") -> Column:
    """A conversation (array of (role, text) in order) as one prompt string in a separator style."""
    role, text = (lambda t: t["role"]), (lambda t: t["text"])
    if style == "single":
        return F.concat(F.lit(system + sep), F.array_join(F.transform(turns, lambda t: F.concat(role(t), F.lit(": "), text(t), F.lit(sep))), ""))
    if style == "two":
        return F.concat(F.lit(system + sep), F.array_join(F.transform(turns, lambda t, i: F.concat(role(t), F.lit(": "), text(t), F.when(i % 2 == 0, F.lit(sep)).otherwise(F.lit(sep2)))), ""))
    if style == "mpt":
        return F.concat(F.lit(system + sep), F.array_join(F.transform(turns, lambda t: F.concat(role(t), text(t), F.lit(sep))), ""))
    if style == "llama2":
        ask = F.lit(f"<<SYS>>\n{system}\n<</SYS>>\n\n") if system else F.lit("")
        one = lambda t, i: F.when(i % 2 == 0, F.concat(F.lit(sep), F.lit("[INST] "), F.when(i == 0, ask).otherwise(F.lit("")), text(t), F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), text(t), F.lit(" "), F.lit(sep2)))
        return F.regexp_replace(F.array_join(F.transform(turns, one), ""), "^" + "".join(f"\\x{ord(c):02x}" for c in sep), "")
    if style == "plain":
        return F.concat(F.lit(system), F.array_join(F.transform(turns, lambda t, i: F.concat(text(t), F.when(i % 2 == 0, F.lit(sep)).otherwise(F.lit(sep2)))), ""))
    raise ValueError(style)


def folded(s: Column) -> Column:
    """Unicode NFKC, which Spark has no function for: one Arrow batch at a time."""
    @F.pandas_udf("string")
    def nfkc(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return nfkc(F.replace(s, F.lit("\\\\"), F.lit("\\")))


def templated(key: Column, templates: list[str], seed: int = 0) -> Column:
    """One of the templates, chosen by a hash of the key."""
    return F.get(F.array(*(F.lit(t) for t in templates)), F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(templates))).cast("int"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
