"""Token counts and token ids by a public tokenizer's vocabulary file.

The tokenizer's own pre-tokens never hold ASCII white space, its normaliser works within them, and its special strings
hold none, so a text's ids are those of its white-space runs, one after the other. A run is the pre-token here, or its
letters and its closing punctuation apart, between which the tokenizer always splits. Pre-tokens are tokenised by the
library itself. ASCII letters are lower-cased first, as the tokenizer does, unless a special string could be meant.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, stored, texts

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that are split at a time, and the longest pre-token that is remembered or joined.
BLOCK = 1 << 20
LONGEST = 64
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 400_000

_state: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The library's tokenizer, loaded once in a process."""
    if path not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _state[path] = Tokenizer.from_file(path)
    return _state[path]


def runs(data: bytes) -> Iterator[list[bytes]]:
    """The white-space runs of a text, by blocks of about BLOCK bytes."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end].split()
        at = end


#: Latin letters and closing punctuation without apostrophes, in UTF-8.
CLOSED = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)")


def folded(data: bytes | None) -> bytes:
    """ASCII lower case, except where a special string of the tokenizer may begin, as these are told apart by case."""
    data = data or b""
    return data if b"<|" in data else data.lower()


def apart(counts: Counter) -> Counter:
    """Frequencies of runs as frequencies of pre-tokens."""
    out: Counter = Counter()
    for run, n in counts.items():
        if m := CLOSED.fullmatch(run):
            out[m[1]] += n
            out[m[2]] += n
        else:
            out[run] += n
    return out


def encode_each(path: str, pieces: list[bytes]) -> list[list[int]]:
    tok, out = tokenizer(path), []
    for at in range(0, len(pieces), 10_000):
        out += [e.ids for e in tok.encode_batch([x.decode() for x in pieces[at : at + 10_000]], add_special_tokens=False)]
    return out


def ids_of(path: str, data: bytes | None) -> bytes:
    """A text's ids, each as four little-endian bytes."""
    known: dict[bytes, bytes] = _state.setdefault(("ids", path), {})
    out = []
    for words in runs(folded(data)):
        try:
            out.append(b"".join([known[w] for w in words]))
        except KeyError:
            got = dict(known_apart(path, known, [w for w in dict.fromkeys(words) if w not in known]))
            out.append(b"".join([known[w] if w in known else got[w] for w in words]))
            for w, ids in got.items():
                if len(known) < REMEMBERED and len(w) <= LONGEST:
                    known[w] = ids
    return b"".join(out)


def known_apart(path: str, known: dict[bytes, bytes], words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Runs with their ids; the library sees only pre-tokens that aren't known."""
    parts = [m.groups() if (m := CLOSED.fullmatch(w)) else (w,) for w in words]
    new = [x for x in dict.fromkeys(x for p in parts for x in p) if x not in known]
    got = dict(zip(new, (np.array(x, "<u4").tobytes() for x in encode_each(path, new)), strict=True))
    for w, p in zip(words, parts, strict=True):
        yield w, b"".join([known[x] if x in known else got[x] for x in p])
    for x in new:
        if len(known) < REMEMBERED and len(x) <= LONGEST:
            known[x] = got[x]


def count_pretokens(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """pretoken, n: how often each occurs in all texts; tasks add up what they meet first."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            parts = apart(seen)
            return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.binary()), pa.array(list(parts.values()), pa.int64())], ["pretoken", "n"])

        for b in batches:
            for data in as_bytes(b.column(0)):
                for words in runs(folded(data)):
                    seen.update(words)
                    if len(seen) >= flush:
                        yield out()
                        seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "pretoken binary, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def count_pieces(pretokens: DataFrame, path: str) -> DataFrame:
    """pretokens with n_pieces, each pre-token being tokenised once."""

    def run(batches):
        for b in batches:
            sizes = [len(x) for x in encode_each(path, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32())], ["pretoken", "n", "n_pieces"])

    return pretokens.mapInArrow(run, "pretoken binary, n long, n_pieces int")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, head: int = 131_072) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs; null and empty texts have 0 tokens.

    Pieces are counted once for each distinct pre-token of the corpus. The most frequent ones, `head` at most, a bound
    that doesn't grow with the corpus, go to every worker; the sums over them need no shuffle, and no frequent pre-token
    is a join key. The rest of each document's pre-token frequencies is joined to the table of counts.
    """
    path = path or vocabulary_path()
    rows = texts(docs)
    counted = stored(count_pieces(count_pretokens(rows), path))
    octave = F.floor(F.log2("n") * 16).cast("int")
    short = F.length("pretoken") <= LONGEST
    least, held = None, 0  # the lowest step of frequency down to which there are `head` pre-tokens at most
    for r in sorted(counted.filter(short).groupBy(octave.alias("o")).count().collect(), key=lambda r: -r.o):  # 16 rows for each doubling
        held += r["count"]
        if held > head:
            break
        least = r.o
    in_head = short & (octave >= least) if least is not None else F.lit(False)
    frequent = counted.filter(in_head).select("pretoken", "n_pieces").collect()
    shared = docs.sparkSession.sparkContext.broadcast({bytes(r.pretoken): r.n_pieces for r in frequent})

    def run(batches):
        known = shared.value
        for b in batches:
            sizes, sums, rest, freq, ends = [], [], [], [], [0]
            for data in as_bytes(b.column(1)):
                seen, other, total = Counter(), Counter(), 0
                for words in runs(folded(data)):
                    seen.update(words)
                for w, c in seen.items():
                    if (n := known.get(w)) is not None:
                        total += n * c
                    else:
                        other[w] = c
                for w, c in apart(other).items():
                    if (n := known.get(w)) is not None:
                        total += n * c
                    else:
                        rest.append(w)
                        freq.append(c)
                sizes.append(len(data or b""))
                sums.append(total)
                ends.append(len(rest))
            pairs = pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(freq, pa.int64())], ["pretoken", "freq"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["doc_id", "n_bytes", "known", "rest"])

    each = rows.mapInArrow(run, "doc_id long, n_bytes long, known long, rest array<struct<pretoken:binary,freq:long>>").withColumn("row", F.monotonically_increasing_id())
    first = lambda c: F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c)).alias(c)
    pairs = each.select("row", "doc_id", "n_bytes", "known", F.posexplode_outer("rest").alias("at", "x")).select("row", first("doc_id"), first("n_bytes"), first("known"), "x.pretoken", "x.freq")
    rare = counted.filter(~in_head)
    joined = pairs.join(rare.select("pretoken", "n_pieces"), "pretoken", "left")
    got = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.coalesce("known", F.lit(0).cast("long")) + F.coalesce(F.col("freq") * F.col("n_pieces"), F.lit(0).cast("long"))).alias("n_tokens"))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
