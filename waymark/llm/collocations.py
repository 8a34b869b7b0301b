"""Phrase collocations: word sequences that stand together more often than
their parts let expect.

Phrases are counted by fingerprint, one length at a time. Prefix polynomials
over the bytes of a batch of texts give the fingerprint of every word, prefix
polynomials over the words that of every n-gram (Rabin-Karp, in numpy), once
modulo 2^64 and once modulo a prime. A shuffle adds up the first; with each
travel the least and the largest of the second, as a check, and a pointer to
one occurrence (a hash of the text and the place in it). Only the occurrences
of frequent fingerprints are read back as text.

* A fingerprint that stands for two phrases shows as two different checks.
  Such groups are counted anew from their texts, so counts are exact at any
  width of the fingerprint.
* A phrase can't be frequent unless both phrases one word shorter are. Tasks
  learn which are from a Bloom filter of at most `SIEVE_BITS` bits: where it
  is too small for all of them it lets more n-grams pass, which costs shuffle
  and never results. Everything else meets by joins.
* A text of any length is read in stretches of about `STRETCH` bytes that
  overlap by the words of a phrase, and n-grams are added up within a stretch
  before they leave the task. All keys are fingerprints or phrases;
  sums are partial before every shuffle, so no common phrase gathers anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.shared import materialize, only

LEAST = 10
LONGEST = 3
COVERED = 50  # percent of a phrase's occurrences
TOP = 2_000
BITS = 64
SIEVE_BITS = 1 << 28
SIEVE_PER_KEY = 16
CHUNK_BITS = 1 << 19
STRETCH = 1 << 20
BLOCK = 1 << 16  # values per prefix sum
NO_LANG = "und"
SHARES = 32

# Moduli of the polynomials, each with a base for bytes and one for words.
_WRAP, _PRIME = 1 << 64, 2147483647
_BASES = {_WRAP: (0x9E3779B97F4A7C15, 0xD1342543DE82EF95), _PRIME: (911382323, 972663749)}

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32  # A-Z count as a-z
_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = _BREAK


@lru_cache(maxsize=None)
def _powers(base: int, modulus: int) -> np.ndarray:
    """base^0 .. base^(BLOCK-1)."""
    out = np.ones(BLOCK, np.uint64)
    filled, step = 1, base
    while filled < BLOCK:
        out[filled : 2 * filled] = _reduced(out[:filled] * np.uint64(step), modulus)
        filled, step = 2 * filled, step * step % modulus
    return out


def _reduced(values: np.ndarray, modulus: int) -> np.ndarray:
    """Modulo 2^64 numbers reduce themselves."""
    return values if modulus == _WRAP else values % np.uint64(modulus)


def _spans(
    values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, modulus: int, letters: np.ndarray | None = None
) -> np.ndarray:
    """The polynomial of values[start:end] for each span: differences of
    prefix sums, brought back to the same power. Values, or what `letters` has
    for them, are below the modulus; starts and ends ascend. Prefix sums are
    made block by block and kept only where a span starts or ends."""
    up, inverse = _powers(base, modulus), pow(base, -1, modulus)
    left, right = np.empty(len(starts), np.uint64), np.empty(len(ends), np.uint64)
    carry = 0
    for begin in range(0, len(values) + 1, BLOCK):
        part = values[begin : begin + BLOCK]
        part = part if letters is None else letters[part]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_reduced(part * up[: len(part)], modulus), out=sums[1:])
        sums = _reduced(sums, modulus)
        scale = pow(base, begin, modulus)
        for at, out in ((starts, left), (ends, right)):
            some = slice(*np.searchsorted(at, [begin, begin + BLOCK]))
            out[some] = _reduced(sums[at[some] - begin] * np.uint64(scale) + np.uint64(carry), modulus)
        carry = (carry + scale * int(sums[-1])) % modulus
    hops = np.array([pow(inverse, BLOCK * i, modulus) for i in range(len(values) // BLOCK + 1)], np.uint64)
    back = _reduced(_powers(inverse, modulus)[starts % BLOCK] * hops[starts // BLOCK], modulus)
    apart = right - left if modulus == _WRAP else (right + np.uint64(modulus) - left) % np.uint64(modulus)
    return _reduced(apart * back, modulus)


def _mixed(keys: np.ndarray, salts: np.ndarray | None = None) -> np.ndarray:
    """Hash of a 64-bit number and its salt, uniform over 64 bits; without a
    salt no two numbers have the same."""
    x = keys.astype(np.uint64) if salts is None else keys.astype(np.uint64) + salts.astype(np.uint64) * np.uint64(_BASES[_WRAP][0])
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


# What each byte counts as: for the wrapping polynomial numbers without a pattern in their low bits.
_LETTERS = {_WRAP: _mixed(_LOWER + np.uint64(1)), _PRIME: _LOWER + np.uint64(1)}


class Words:
    """The words of a stretch of bytes: where they start and end, the piece
    each lies in, and their polynomials."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray):
        """`cuts`: where texts start in the stretch."""
        kind = _KIND[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind == 0
        cut = np.zeros(len(data) + 1, bool)
        cut[cuts] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        breaks = np.flatnonzero((kind == _BREAK) | cut[:-1])
        self.piece = np.searchsorted(breaks, self.starts, side="right")
        self.hashes = {
            modulus: _spans(data, self.starts, self.ends, bases[0], modulus, _LETTERS[modulus])
            for modulus, bases in _BASES.items()
        }
        self.hashes[_WRAP] = _mixed(self.hashes[_WRAP])

    def ngrams(self, n: int) -> np.ndarray:
        """The first words of all n-grams: n words of one piece."""
        count = max(len(self.starts) - n + 1, 0)
        return np.flatnonzero(self.piece[:count] == self.piece[len(self.piece) - count :])

    def _sums(self, at: np.ndarray, n: int, modulus: int) -> np.ndarray:
        hashes = self.hashes[modulus]
        if n == 1:
            return hashes[at]
        if modulus == _PRIME:
            hashes = (hashes + np.uint64(1)) % np.uint64(modulus)
        return _spans(hashes, at, at + n, _BASES[modulus][1], modulus)

    def prints(self, at: np.ndarray, n: int, salts: np.ndarray, bits: int) -> np.ndarray:
        """Fingerprints of the n-grams from the given first words on; `salts`
        tell the languages of the words apart."""
        return _mixed(self._sums(at, n, _WRAP), salts[at]) >> np.uint64(64 - bits)

    def checks(self, at: np.ndarray, n: int, salts: np.ndarray) -> np.ndarray:
        """Their checks, of 31 bits."""
        return self._sums(at, n, _PRIME) ^ salts[at] >> np.uint64(33)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, where they lie, and where each starts and ends."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), ends


def _stretches(batch: pa.RecordBatch, longest: int, size: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray, int]]:
    """(words, row of each word's text, offset of each word in it, words that
    belong to this stretch). A stretch holds whole texts, or a part of one and
    the words after it that a phrase starting in it may need."""
    texts = batch.column("text")
    everything, ends = _bytes_of(texts)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + size, side="right")) - 1)
        begin, end = int(ends[row]), int(ends[stop])
        if end - begin <= 2 * size:
            words = Words(everything[begin:end], ends[row:stop] - begin)
            rows = np.searchsorted(ends[row : stop + 1] - begin, words.starts, side="right") - 1 + row
            yield words, rows, words.starts + begin - ends[rows], len(words.starts)
        else:
            yield from _parts(everything, begin, end, row, longest, size)
        row = stop


def _word_start(data: np.ndarray, at: int, end: int) -> int:
    """The first place from `at` on that does not continue a word."""
    while at < end:
        gaps = np.flatnonzero(_KIND[data[at - 1 : min(at + 4_095, end - 1)]])
        if len(gaps):
            return at + int(gaps[0])
        at += 4_096
    return end


def _parts(data: np.ndarray, begin: int, end: int, row: int, longest: int, size: int):
    """One long text, cut before words."""
    at = begin
    while at < end:
        stop = _word_start(data, min(at + size, end), end) if at + size < end else end
        more = stop
        for _ in range(longest):  # words after the cut, for phrases that start before it
            while more < end and _KIND[data[more]]:
                more += 1
            more = _word_start(data, more + 1, end) if more + 1 < end else end
        words = Words(data[at:more], np.zeros(1, int))
        own = int(np.searchsorted(words.starts, stop - at))
        yield words, np.full(len(words.starts), row), words.starts + (at - begin), own
        at = stop


class Sieve:
    """A Bloom filter of 64-bit keys with two places each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(len(bits) * 8 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for place in places(keys, self.mask):
            found &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def places(keys: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return keys & mask, (keys >> np.uint64(32)) & mask


def _sieve(keys: DataFrame, count: int) -> bytes:
    """A filter of the column `key`, of 16 bits a key but SIEVE_BITS at most."""
    wanted = min(SIEVE_BITS, max(CHUNK_BITS, 1 << (SIEVE_PER_KEY * max(count, 1) - 1).bit_length()))
    mask = np.uint64(wanted - 1)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(np.concatenate(places(_unsigned(batch.column("key")), mask))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found // CHUNK_BITS), pa.array(found)], names=["chunk", "spot"])

    def gathered(table: pa.Table) -> pa.Table:
        found = table.column("spot").to_numpy() % CHUNK_BITS
        bits = np.zeros(CHUNK_BITS // 8, np.uint8)
        np.bitwise_or.at(bits, found >> 3, (1 << (found & 7)).astype(np.uint8))
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    # A chunk has at most CHUNK_BITS different spots, the driver at most SIEVE_BITS / CHUNK_BITS chunks.
    chunks = keys.select("key").mapInArrow(spots, "chunk long, spot long").distinct()
    out = bytearray(wanted // 8)
    for chunk in chunks.groupBy("chunk").applyInArrow(gathered, "chunk long, bits binary").toLocalIterator():
        out[chunk.chunk * (CHUNK_BITS // 8) : (chunk.chunk + 1) * (CHUNK_BITS // 8)] = chunk.bits
    return bytes(out)


def _salts(langs: list[str]) -> np.ndarray:
    """A number for each language, to tell its keys from the same of others."""
    known = {lang: int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "big") for lang in set(langs)}
    return np.array([known[lang] for lang in langs], np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _unsigned(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _texts(documents: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, text, doc (hash of both) of the rows that have a text."""
    rows = only(documents, text=text, lang=lang).where("text is not null and text <> ''")
    rows = rows.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    return rows.withColumn("doc", F.xxhash64("lang", "text"))


COUNTED = "print long, check long, f long, place long"


def _added_up(prints: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of n-gram, and how many there are of it."""
    if not len(prints):
        return np.empty(0, int), np.empty(0, int)
    order = np.argsort(prints, kind="stable")
    sorted_, kinds = prints[order], checks[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]) | (kinds[1:] != kinds[:-1])
    starts = np.flatnonzero(new)
    return order[starts], np.diff(starts, append=len(order))


def _places_of(docs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The pointer to a place in a text."""
    return _mixed(docs.astype(np.int64).view(np.uint64), offsets.astype(np.uint64))


def count_prints(texts: DataFrame, n: int, bits: int, parts: bytes | None, size: int) -> DataFrame:
    """print, f, check, last_check, place of all n-grams whose parts pass the
    sieve `parts` of (n-1)-grams."""
    sieve_of = texts.sparkSession.sparkContext.broadcast(parts) if parts else None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve(np.frombuffer(sieve_of.value, np.uint8)) if sieve_of else None
        for batch in batches:
            docs, langs = batch.column("doc").to_numpy(zero_copy_only=False), _salts(batch.column("lang").to_pylist())
            for words, rows, offsets, own in _stretches(batch, n, size):
                at, salts = words.ngrams(n), langs[rows]
                at = at[at < own]
                if sieve is not None:
                    shorter = words.ngrams(n - 1)
                    passed = np.zeros(len(words.starts) + 1, bool)
                    passed[shorter] = sieve.has(words.prints(shorter, n - 1, salts, bits))
                    at = at[passed[at] & passed[at + 1]]
                prints, checks = words.prints(at, n, salts, bits), words.checks(at, n, salts)
                first, times = _added_up(prints, checks)
                where = at[first]
                pointers = _places_of(docs[rows[where]], offsets[where])
                yield pa.RecordBatch.from_arrays(
                    [_signed(prints[first]), _signed(checks[first]), pa.array(times), _signed(pointers)],
                    names=["print", "check", "f", "place"],
                )

    return (
        texts.mapInArrow(counted, COUNTED)
        .groupBy("print")
        .agg(
            F.sum("f").alias("f"),
            F.min("check").alias("check"),
            F.max("check").alias("last_check"),
            F.min("place").alias("place"),
        )
    )


SPELLED = "n int, lang string, print long, check long, place long, phrase string, times long"


def spell(texts: DataFrame, longest: int, bits: int, wanted: bytes, doubtful: list[bytes | None], size: int) -> DataFrame:
    """N-grams as text, of two kinds. Those at a place that passes the sieve
    `wanted`, with their fingerprint, check and place; and those whose
    fingerprint passes the sieve of doubtful ones of their length, added up
    per stretch (`times`). Also the number of words (n = 0) per language."""
    context = texts.sparkSession.sparkContext
    wanted_of = context.broadcast(wanted)
    doubtful_of = [x and context.broadcast(x) for x in doubtful]

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_places = Sieve(np.frombuffer(wanted_of.value, np.uint8))
        in_doubt = [x and Sieve(np.frombuffer(x.value, np.uint8)) for x in doubtful_of]
        done: set[int] = set()  # texts of this task whose places were read
        for batch in batches:
            langs, docs = batch.column("lang").to_pylist(), batch.column("doc").to_numpy(zero_copy_only=False)
            lang_salts = _salts(langs)
            everything, begins = _bytes_of(batch.column("text"))
            new = np.array([doc not in done for doc in docs.tolist()], bool)
            new &= np.bincount(np.unique(docs, return_index=True)[1], minlength=len(docs)).astype(bool)
            done.update(docs.tolist())
            for words, rows, offsets, own in _stretches(batch, longest, size):
                found: list[tuple] = []
                added: dict[tuple[int, str, int, bytes], int] = {}
                salts = lang_salts[rows]
                pointers = _places_of(docs[rows[:own]], offsets[:own])
                here = at_places.has(pointers) & new[rows[:own]]

                def phrase(word: int, n: int, words=words, offsets=offsets, rows=rows) -> bytes:
                    shift = int(begins[rows[word]]) + int(offsets[word]) - int(words.starts[word])
                    spans = zip(words.starts[word : word + n].tolist(), words.ends[word : word + n].tolist(), strict=True)
                    return b" ".join(everything[shift + a : shift + b].tobytes().lower() for a, b in spans)

                for n in range(1, longest + 1):
                    at = words.ngrams(n)
                    at = at[at < own]
                    if in_doubt[n - 1]:
                        prints = words.prints(at, n, salts, bits)
                        hits = np.flatnonzero(in_doubt[n - 1].has(prints))
                        for word, print_ in zip(at[hits].tolist(), prints[hits].view(np.int64).tolist(), strict=True):
                            key = (n, langs[rows[word]], print_, phrase(word, n))
                            added[key] = added.get(key, 0) + 1
                    at = at[here[at]]
                    values = (words.prints(at, n, salts, bits), words.checks(at, n, salts), pointers[at])
                    for word, *numbers in zip(at.tolist(), *(x.view(np.int64).tolist() for x in values), strict=True):
                        found.append((n, langs[rows[word]], *numbers, phrase(word, n), None))
                found += [(n, lang, print_, None, None, text, times) for (n, lang, print_, text), times in added.items()]
                _, first, times = np.unique(salts[:own], return_index=True, return_counts=True)
                found += [(0, langs[rows[i]], None, None, None, b"", int(k)) for i, k in zip(first, times, strict=True)]
                columns = list(zip(*found, strict=True)) or [[]] * 7
                kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                columns[5] = [text.decode("utf-8", "replace") for text in columns[5]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
                    names=["n", "lang", "print", "check", "place", "phrase", "times"],
                )

    return texts.mapInArrow(spelled, SPELLED)


def frequent_phrases(
    documents: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS, size: int = STRETCH,
    text: str = "text", lang: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """(n, lang, phrase, f) of all phrases of up to `longest` words that stand
    at least `least` times, and (lang, words) of all words."""
    texts = _texts(documents, text, lang)
    sieve, known, doubtful = None, None, []
    for n in range(1, longest + 1):
        level = materialize(count_prints(texts, n, bits, sieve, size).where(F.col("f") >= least), f"phrase-prints-{n}")
        sieve = _sieve(level.select(F.col("print").alias("key")), level.count())
        twofold = level.where("check <> last_check")
        count = twofold.count()
        doubtful.append(_sieve(twofold.select(F.col("print").alias("key")), count) if count else None)
        level = level.withColumn("n", F.lit(n))
        known = level if known is None else known.unionByName(level)
    sure = known.where("check = last_check")
    wanted = _sieve(sure.select(F.col("place").alias("key")), sure.count())
    spelled = materialize(spell(texts, longest, bits, wanted, doubtful, size), "phrase-texts")
    once = spelled.where("place is not null").drop("times").join(
        sure.select("n", "print", "check", "place", "f"), ["n", "print", "check", "place"]
    )
    anew = (
        spelled.where("n > 0 and place is null")
        .join(known.where("check <> last_check").select("n", "print"), ["n", "print"], "left_semi")
        .groupBy("n", "lang", "phrase")
        .agg(F.sum("times").alias("f"))
        .where(F.col("f") >= least)
    )
    # Copies of a text spell the same phrase.
    phrases = once.groupBy("n", "lang", "phrase").agg(F.max("f").alias("f")).unionByName(anew)
    words = spelled.where("n = 0").groupBy("lang").agg(F.sum("times").alias("words"))
    return materialize(phrases, "phrases"), words


def _part(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(
    documents: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    covered: int = COVERED,
    top: int = TOP,
    bits: int = BITS,
    size: int = STRETCH,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language.

    `a` is how often the phrase stands, `l` and `r` its first words and the
    rest, cut where floor(1000000 * a * a / (l * r)) is least (then after the
    fewest words), which is `score`; `n` counts all words of the language. A
    phrase whose words lie in a longer one that stands at least `covered`
    percent as often is left out. Equal scores go by `a`, then by the phrase's
    bytes. NULL and empty texts have no words, a NULL language is `und`;
    repeated rows count each time. A language without frequent phrases, or an
    empty table, gives no rows; other columns are ignored.
    """
    phrases, words = frequent_phrases(documents, least, longest, bits, size, text, lang)
    candidates = phrases.where("n > 1").select("lang", "phrase", "n", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", "n", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("head"),
        _part(F.col("w"), F.col("k") + 1, F.col("n") - F.col("k")).alias("tail"),
    )
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    a, l, r = (F.col(name).cast("decimal(18,0)") for name in ("a", "l", "r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumns(
        {"over": a * a * F.lit(1_000_000).cast("decimal(7,0)"), "under": l * r}
    )
    scored = scored.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.where("n > 2").select(
        "lang", "a", "w", "n", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m")
    )
    longer = longer.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("s"))
    inside = longer.groupBy("lang", _part(F.col("w"), F.col("s"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longest"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * covered)
    )
    flat = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best_first = (F.desc("score"), F.desc("a"), "phrase")
    # In two steps, so that however many tasks there are, no more than SHARES * top rows of a language meet.
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    shares = flat.withColumn("share", share).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best_first))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best_first)).cast("long")
    ranked = shares.where(F.col("rank") <= top).withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )
