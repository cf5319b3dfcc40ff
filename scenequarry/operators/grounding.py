"""Grounding of caption phrases: exact and fuzzy joins of phrases within an image, and what is kept of them.

Captions and phrases are joined by image; a phrase table has rows, not lists, and pos gives the order in which a rule
prefers them. Phrase words come without a parser: words that aren't stop words, plural s taken off.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as x

#: Words without content of their own, in English.
STOP = "a an the of in on at to and or with by for from is are was were be it its this that as his her their".split()


def content_words(phrase: Column, stop: list[str] | None = None) -> Column:
    """Lower-cased words but stop words, a plural s taken off words of over three letters."""
    kept = F.filter(F.split(F.lower(phrase), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(stop or STOP))
    return F.transform(kept, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def phrase_similarity(a: Column, b: Column) -> Column:
    """1 if either phrase contains the other, else the share of the shorter one's content words that the longer contains."""
    short, long = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    words = content_words(short)
    hits = F.size(F.filter(words, lambda w: long.contains(w)))
    return F.when(a.contains(b) | b.contains(a), F.lit(1.0)).when(F.size(words) == 0, F.lit(0.0)).otherwise(hits / F.size(words))


def words_held(words: list[list[str]], texts: list[str]) -> np.ndarray:
    """How many of each list's words (letters and digits alone) each text contains, as lists x texts."""
    joined, starts = "\n".join(texts), np.cumsum([0] + [len(v) + 1 for v in texts]).tolist()
    place = {w: k for k, w in enumerate({w for ws in words for w in ws})}
    held = np.zeros((len(place), len(texts)), bool)
    for w, k in place.items():
        i = joined.find(w)
        while i >= 0:
            at = bisect.bisect_right(starts, i)
            held[k, at - 1] = True
            i = joined.find(w, starts[at])
    some = [i for i, ws in enumerate(words) if ws]
    out = np.zeros((len(words), len(texts)), np.int32)
    if some:
        first = np.cumsum([0] + [len(words[i]) for i in some])[:-1]
        out[some] = np.add.reduceat(held[[place[w] for ws in words for w in ws]], first, axis=0, dtype=np.int32)
    return out


def best_matches(left: list[dict], right: list[dict], cells: int = 1 << 20) -> list[dict]:
    """at, similarity: for each left phrase the place of the first right phrase of the greatest phrase_similarity. Phrases
    have text, words (content_words) and plain: lower-casing leaves them as they are. Pairs are gone over `cells` at a time.

    A plain phrase with content words that is part of another has all its words there, so it needn't be looked for.
    """
    texts, n = [p["text"] for p in right], np.array([len(p["words"]) for p in right])
    size = np.array([len(v) for v in texts])
    seek = [j for j, p in enumerate(right) if not p["words"] or not p["plain"]]
    out, step = [], max(1, cells // len(right))
    for low in range(0, len(left), step):
        part = left[low : low + step]
        own, own_n = [p["text"] for p in part], np.array([len(p["words"]) for p in part])
        shorter = np.array([len(v) for v in own])[:, None] < size
        hits = np.where(shorter, words_held([p["words"] for p in part], texts), words_held([p["words"] for p in right], own).T)
        similarity = hits / np.maximum(np.where(shorter, own_n[:, None], n), 1)
        for i, p in enumerate(part):
            if not p["words"] or not p["plain"]:
                for j in np.flatnonzero(shorter[i]):
                    if own[i] in texts[j]:
                        similarity[i, j] = 1.0
        for j in seek:
            for i in np.flatnonzero(~shorter[:, j]):
                if texts[j] in own[i]:
                    similarity[i, j] = 1.0
        at = similarity.argmax(axis=1)
        out += [{"at": int(j), "similarity": float(v)} for j, v in zip(at, similarity[np.arange(len(part)), at], strict=True)]
    return out


def fuzzy_matches(left: DataFrame, right: DataFrame, limit: float = 0.75, by: str = "image_id") -> DataFrame:
    """left (by, pos, phrase) with the most similar right phrase (by, pos, phrase) of its image, the first of equal ones,
    if it is similar by the limit or more: match, match_pos, similarity.

    An image's phrases travel once, and their content words are taken once; pairs aren't rows (best_matches).
    """
    place = F.struct(F.col("pos").isNull().alias("none"), "pos", "phrase")
    side = lambda t, name: t.filter(F.col(by).isNotNull() & F.col("phrase").isNotNull()).select(by, place.alias(name))
    images = side(left, "a").unionByName(side(right, "b"), allowMissingColumns=True).groupBy(by).agg(F.collect_set("a").alias("a"), F.array_sort(F.collect_set("b")).alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    told = lambda c: F.transform(c, lambda v: F.struct(v["phrase"].alias("text"), content_words(v["phrase"]).alias("words"), (F.lower(v["phrase"]) == v["phrase"]).alias("plain")))
    rows = images.withColumns({"left": told("a"), "right": told("b")})
    found = pa.list_(pa.struct([("at", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [best_matches(x.as_py(), y.as_py()) for x, y in zip(b["left"], b["right"], strict=True)]
            yield pa.RecordBatch.from_arrays([b[by], b["a"], b["b"], pa.array(best, found)], [by, "a", "b", "best"])

    types = dict(images.dtypes)
    done = rows.mapInArrow(run, f"{by} {types[by]}, a {types['a']}, b {types['b']}, best array<struct<at:int,similarity:double>>")
    kept = F.filter(F.zip_with("a", "best", lambda v, m: F.struct(v.alias("v"), m["at"].alias("at"), m["similarity"].alias("similarity"))), lambda v: v["similarity"] >= limit)
    each = done.select(by, "b", F.explode(kept).alias("m")).select(by, "m.v.pos", "m.v.phrase", F.get("b", F.col("m.at")).alias("o"), "m.similarity")
    return each.select(by, "pos", "phrase", F.col("o.phrase").alias("match"), F.col("o.pos").alias("match_pos"), "similarity")


def exact_groundings(captions: DataFrame, attributes: DataFrame, relations: DataFrame, by: str = "image_id") -> DataFrame:
    """by, kind, pos, phrase, start, end, object_ids of phrases that stand in their image's caption, regardless of case.

    attributes (by, object_pos, object_id, pos, attribute): of each object the first attribute that occurs, without what
    stands before a colon. relations (by, pos, phrase, object_ids): those whose phrase no attribute has, each phrase once.
    """
    caps = captions.select(by, F.lower(F.trim("caption")).alias("caption"))
    named = attributes.withColumn("phrase", F.lower(F.trim(x.after_colon(F.col("attribute"))))).join(caps, by).filter(F.col("caption").contains(F.col("phrase")))
    first = named.groupBy(by, "object_pos", "object_id").agg(F.min_by(F.struct("phrase", "caption"), "pos").alias("b"))
    one = first.select(by, F.lit("attribute").alias("kind"), F.col("object_pos").alias("pos"), "b.phrase", "b.caption", F.array("object_id").alias("object_ids"))
    said = relations.withColumn("phrase", F.lower(F.trim("phrase"))).join(caps, by).filter(F.col("caption").contains(F.col("phrase")))
    said = said.join(one.select(by, "phrase").distinct(), [by, "phrase"], "left_anti")
    two = said.groupBy(by, "phrase").agg(F.min_by(F.struct("pos", "caption", "object_ids"), "pos").alias("b")).select(by, F.lit("relation").alias("kind"), "b.pos", "phrase", "b.caption", "b.object_ids")
    start = F.instr("caption", F.col("phrase")) - 1
    return one.unionByName(two).select(by, "kind", "pos", "phrase", start.cast("long").alias("start"), (start + F.length("phrase")).cast("long").alias("end"), "object_ids")


def distinct_groundings(groundings: DataFrame, by: str = "image_id") -> DataFrame:
    """Of equal (phrase, objects) rows the first by pos, then of equal phrases the first."""
    w = Window.partitionBy(by, "phrase").orderBy("pos")
    return groundings.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def longest_groundings(groundings: DataFrame, by: str = "image_id") -> DataFrame:
    """Rows without those whose phrase is part of a longer one, or of an equal one before it, with the same objects."""
    g_ = groundings.withColumn("__size", F.length("phrase"))
    over = g_.select(by, F.col("objects").alias("__o"), F.col("phrase").alias("__p"), F.col("pos").alias("__pos"), F.col("__size").alias("__s")).withColumnRenamed(by, "__by")
    ahead = (F.col("__s") > F.col("__size")) | ((F.col("__s") == F.col("__size")) & (F.col("__pos") < F.col("pos")))
    return g_.join(over, (F.col(by) == F.col("__by")) & (F.col("objects") == F.col("__o")) & ahead & F.col("__p").contains(F.col("phrase")), "left_anti").drop("__size")


def grounding_rows(groundings: DataFrame, objects: DataFrame, by: str = "image_id") -> DataFrame:
    """by, phrase, objects: a phrase's object boxes as an array of (id, box) in id order; unknown ids have none."""
    each = groundings.select(by, "phrase", F.explode("object_ids").alias("object_id"))
    found = each.join(objects.select(by, "object_id", g.struct(g.box()).alias("box")), [by, "object_id"])
    return found.groupBy(by, "phrase").agg(F.sort_array(F.collect_set(F.struct(F.col("object_id").alias("id"), "box"))).alias("objects"))


def noun_objects(nouns: DataFrame, objects: DataFrame, by: str = "image_id") -> DataFrame:
    """by, noun, object_id: objects whose label is the noun or differs by a plural s: one alone, or of two the one that
    holds the other; none of three or more. nouns (by, noun); objects (by, object_id, label, corners)."""
    stem = lambda c: F.when(c.endswith("s"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    rows = objects.withColumn("__stem", stem(F.col("label")))
    asked = nouns.withColumn("__stem", stem(F.col("noun")))
    near = asked.join(rows, [by, "__stem"]).filter((F.col("label") == F.col("noun")) | x.differs_by_s(F.col("label"), F.col("noun")))
    b = F.struct(F.col("object_id"), *(F.col(f) for f in g.FIELDS))
    each = near.groupBy(by, "noun").agg(F.count(F.lit(1)).alias("n"), F.min(b).alias("a"), F.max(b).alias("b")).filter("n <= 2")
    one, two = g.box(F.col("a")), g.box(F.col("b"))
    pick = F.when((F.col("n") == 1) | g.inside(two, one), F.col("a.object_id")).when(g.inside(one, two), F.col("b.object_id"))
    return each.select(by, "noun", pick.alias("object_id")).filter("object_id is not null")


def combined_models(dets: DataFrame, limit: float = 0.65, dice: float = 0.75) -> DataFrame:
    """image_id, det_id, labels: boxes of the first model, and those of later ones that match no box before; a box that
    does adds its label to the first it matches. Models come in order of model_id, boxes in order of det_id."""
    rows = dets.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("model_id", "det_id", *g.FIELDS, F.trim("label").alias("label")))).alias("boxes"), F.min("model_id").alias("first"))
    match = lambda k, e: (g.iou(g.box(k), g.box(e), 1) > limit) & (g.dice(g.box(k), g.box(e)) > dice)
    joins = lambda k, e: (e["model_id"] > F.col("first")) & match(k, e)
    rows = rows.withColumn("kept", g.keep_first(F.col("boxes"), joins))
    same = lambda k, e: k["det_id"] == e["det_id"]
    own = F.transform("boxes", lambda e: F.struct(F.when(F.exists("kept", lambda k: same(k, e)), e["det_id"]).otherwise(g.owner(F.col("kept"), e, joins, same)["det_id"]).alias("seed"), e["model_id"].alias("model_id"), e["det_id"].alias("det_id"), e["label"].alias("label")))
    each = rows.select("image_id", F.explode(own).alias("x")).select("image_id", "x.*")
    got = each.groupBy("image_id", F.col("seed").alias("det_id")).agg(F.sort_array(F.collect_list(F.struct("model_id", F.col("det_id").alias("d"), "label"))).alias("l"))
    return got.select("image_id", "det_id", F.transform("l", lambda v: v["label"]).alias("labels"))


def rejoined_words(rows: DataFrame, phrase: str, words: DataFrame, most: int = 8 << 20) -> DataFrame:
    """rows with `rejoined`: fragments of the phrase joined to the shortest run that is a word of the table (word), from
    the first fragment on, then from the one behind that run; where none begins, all that is left is joined.

    A table of up to `most` characters goes to the tasks, which walk each phrase once, so phrases aren't shuffled. Phrases
    meet a larger one by a join of their runs.
    """
    from ..plans.tables import cut

    known = cut(words.select(F.col("word").alias("__run")).filter(F.length("__run") > 0).distinct())
    size, longest = known.agg(F.sum(F.octet_length("__run")), F.max(F.length("__run"))).first()
    if (size or 0) > most:
        return joined_runs(rows, phrase, known, longest)
    sent = rows.sparkSession.sparkContext.broadcast({r[0] for r in known.collect()})  # of `most` characters at most

    @F.pandas_udf("string")
    def walk(said: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = sent.value
        sizes = {len(w) for w in table}
        last = max(sizes, default=0)

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            f = [v for v in re.split(r"[ \t\n\x0b\f\r]+", text) if v]
            out, i = [], 0
            while i < len(f):
                end, n = len(f), 0
                for j in range(i, len(f)):
                    n += len(f[j])
                    if n > last:
                        break
                    if n in sizes and "".join(f[i : j + 1]) in table:
                        end = j + 1
                        break
                out.append("".join(f[i:end]))
                i = end
            return " ".join(out)

        for series in said:
            yield pd.Series([one(v) for v in series], dtype=object)

    return rows.withColumn("rejoined", walk(F.col(phrase)))


def joined_runs(rows: DataFrame, phrase: str, known: DataFrame, longest: int) -> DataFrame:
    """rejoined_words by a join: runs of no more characters than the longest word, keyed by their text's digest."""
    fragments = F.filter(F.split(F.col("__p"), r"\s+"), lambda f: f != "")
    said = rows.select(F.col(phrase).alias("__p")).filter("__p is not null").select(F.unhex(F.sha2("__p", 256)).alias("__h"), "__p").groupBy("__h").agg(F.first("__p").alias("__p")).withColumn("f", fragments)
    starts = said.select("__h", "f", F.posexplode("f").alias("i", "__first")).filter(F.length("__first") <= longest)
    ends = F.sequence(F.col("i"), F.least(F.size("f"), F.col("i") + longest) - 1)
    runs = starts.select("__h", "i", "f", F.explode(ends).alias("j")).select("__h", "i", "j", F.array_join(F.slice("f", F.col("i") + 1, F.col("j") - F.col("i") + 1), "").alias("__run")).filter(F.length("__run") <= longest)
    nearest = runs.join(known, "__run").groupBy("__h", "i").agg(F.min("j").alias("j")).groupBy("__h").agg(F.map_from_entries(F.collect_list(F.struct("i", "j"))).alias("ends"))

    def step(acc: Column, i: Column) -> Column:
        end = F.coalesce(F.element_at("ends", i), F.size("f") - 1)
        joined = F.concat_ws(" ", acc["text"], F.array_join(F.slice("f", i + 1, end - i + 1), ""))
        return F.when(i == acc["next"], F.struct((end + 1).alias("next"), joined.alias("text"))).otherwise(acc)

    begin = F.struct(F.lit(0).alias("next"), F.lit(None).cast("string").alias("text"))
    places = F.when(F.size("f") > 0, F.sequence(F.lit(0), F.size("f") - 1)).otherwise(F.array().cast("array<int>"))
    done = said.join(nearest, "__h", "left").select("__h", F.aggregate(places, begin, step, lambda acc: F.coalesce(acc["text"], F.lit(""))).alias("rejoined"))
    return rows.withColumn("__h", F.unhex(F.sha2(phrase, 256))).join(done, "__h", "left").drop("__h")


def pairs_of_characters(s: Column) -> Column:
    """The different pairs of neighbouring characters, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"(?s)(?=(..))."), F.lit(1)))


def best_phrase(phrases: Column, caption: Column) -> Column:
    """Of several readings of a phrase: the first if all are equal, else the words of the first that stand in a row in the
    caption, else the reading that shares most of its pairs of characters with it (Dice), the first of equal ones.

    What is taken from the caption is bound once for all readings, and each step is linear in the caption.
    """
    words = lambda s: F.regexp_extract_all(s, F.lit(r"((?U)\w+)"), F.lit(1))
    apart = lambda s: F.concat(F.lit(" "), F.array_join(F.transform(words(s), lambda w: F.concat(w, F.lit(" "))), ""))
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    said = F.coalesce(caption, F.lit(""))
    found = bound(apart(said), lambda row: F.get(F.filter(phrases, lambda p: row.contains(apart(p))), F.lit(0)))

    def rank(all_of: Column) -> Column:
        shared = lambda own: 2.0 * F.size(F.array_intersect(own, all_of)) / F.greatest(F.size(own) + F.size(all_of), F.lit(1))
        ranked = F.transform(phrases, lambda p, i: F.struct(bound(pairs_of_characters(p), shared).alias("shared"), (-i).alias("place"), p.alias("p")))
        return F.array_max(ranked)["p"]

    in_a_row = bound(found, lambda p: F.coalesce(F.array_join(words(p), " "), bound(pairs_of_characters(said), rank)))
    return F.when(F.size(F.array_distinct(phrases)) == 1, F.get(phrases, F.lit(0))).otherwise(in_a_row)


def noun_phrases(caption: Column, stop: list[str] | None = None) -> Column:
    """Array of runs of words between stop words and punctuation, lower-cased: noun phrases without a parser."""
    words = "|".join(re.escape(w) for w in (stop or STOP))
    cut = F.regexp_replace(F.lower(caption), rf"(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])|[^\p{{L}}\p{{N}}\s]+", "|")
    return F.filter(F.transform(F.split(cut, r"\s*\|\s*"), F.trim), lambda s: s != "")


def phrases_of(first: Column, second: Column) -> Column:
    """Phrases of one extraction, or of another where it finds none."""
    return F.when(F.size(first) > 0, first).otherwise(second)
