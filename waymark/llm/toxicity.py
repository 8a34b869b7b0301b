"""Toxic documents by a subsequence-kernel support vector machine.

The kernel compares two strings by their common subsequences of three
characters, gaps allowed: a subsequence that spreads over s characters counts
DECAY**s, up to SPAN characters. An insult with characters put in or left out
still shares most of its subsequences with the plain one.

Sentences of labelled documents are trained on as bags of units (words, runs
of spelled-out letters): a toxic document says only that some unit of some
sentence of it is toxic. Units that toxic documents share and clean ones lack
stand for the toxic sentences, units of clean sentences for the others, and
clean units that score too high join in for a second training. Nystroem
landmarks give the kernel a feature space of as many dimensions; there a
linear machine is trained. As a landmark is a fixed vector of subsequence
weights, the trained machine folds into one table of weights by subsequence,
and scoring a unit is looking up its subsequences.

A document scores as its most toxic unit, turned into a probability by a
logistic curve fitted to the labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.ngram_join import ngrams
from waymark.llm.shared import materialize, only

DECAY = 0.6
SPAN = 7
LONGEST = 24  # longer units are scored in overlapping windows
SYMBOLS = 64

MAX_DOCS = 4_000  # labelled documents trained on, per class
MAX_UNITS = 3_000  # units trained on, per class and round
LANDMARKS = 256
LIFT = 8.0
CHANCE = 0.01
COMMON = 0.03  # telling units in this share of the toxic documents need no further reason
ROUNDS = 3
CACHED_UNITS = 500_000

_SPELLED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")


@lru_cache(maxsize=None)
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of a string of that length, and their weights
    (scaled to a vector of length one if none repeats)."""
    places = [
        (i, i + j, i + k)
        for i in range(length)
        for j, k in combinations(range(1, SPAN), 2)
        if i + k < length
    ]
    at = np.array(places, np.int64).reshape(-1, 3).T
    weight = DECAY ** (at[2] - at[0] + 1.0)
    return at, weight / np.sqrt((weight**2).sum() or 1.0)


def _symbol(char: str) -> int:
    """1 to 63: letters and digits by themselves, all others share the rest."""
    code = ord(char)
    if 97 <= code <= 122:
        return code - 95
    if 48 <= code <= 57:
        return code - 20
    return 38 + code % 26


def clean_unit(token: str) -> str:
    return "".join(filter(str.isalnum, token))


def windows(unit: str) -> list[str]:
    if len(unit) <= LONGEST:
        return [unit]
    return [unit[at : at + LONGEST] for at in range(0, len(unit) - LONGEST // 2, LONGEST // 2)]


def units(text: str) -> set[str]:
    """Tokens of a text, lower-cased, and its runs of three or more single
    characters put together."""
    lowered = text.lower()
    found = set(lowered.split())
    found.update("".join(run.split()) for run in _SPELLED.findall(lowered))
    return found


def subsequences(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of strings of equal length together: their positions in the list, the
    subsequence codes (one row per string) and the weights. Start and end of a
    string count as characters."""
    by_length: dict[int, list[int]] = {}
    for at, string in enumerate(strings):
        by_length.setdefault(len(string), []).append(at)
    for length, members in by_length.items():
        places, weight = _triples(length + 2)
        for begin in range(0, len(members), 4096):
            part = members[begin : begin + 4096]
            codes = np.zeros((len(part), length + 2), np.int32)
            codes[:, -1] = 1
            if length:
                codes[:, 1:-1] = [list(map(_symbol, strings[at])) for at in part]
            triple = (codes[:, places[0]] * SYMBOLS + codes[:, places[1]]) * SYMBOLS + codes[:, places[2]]
            yield np.array(part), triple, weight


@dataclass
class Machine:
    """A trained machine: weight by subsequence, bias, logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    _cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_cache": {}}

    def margins(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), self.bias)
        for at, codes, weight in subsequences(strings):
            if codes.shape[1]:
                out[at] += self.weights[codes] @ weight
        return out

    def unit_scores(self, tokens: Iterable[str]) -> list[float]:
        tokens = list(tokens)
        new = [token for token in tokens if token not in self._cache]
        if new:
            if len(self._cache) + len(new) > CACHED_UNITS:
                self._cache.clear()
                new = tokens
            parts = [(token, part) for token in new for part in windows(clean_unit(token))]
            best: dict[str, float] = {}
            for (token, _), margin in zip(parts, self.margins([part for _, part in parts]).tolist(), strict=True):
                best[token] = max(best.get(token, -np.inf), margin)
            self._cache.update(best)
        return [self._cache[token] for token in tokens]

    def margin(self, text: str) -> float:
        return max(self.unit_scores(units(text)), default=self.bias - 1.0)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.offset, -30, 30))))


def _kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of every string with every landmark."""
    out = np.zeros((len(strings), len(landmarks)))
    tables = np.zeros((SYMBOLS**3, 8), np.float32)
    for begin in range(0, len(landmarks), 8):
        tables[:] = 0
        for at, codes, weight in subsequences(landmarks[begin : begin + 8]):
            for row, string in enumerate(at):
                np.add.at(tables[:, string], codes[row], weight)
        for at, codes, weight in subsequences(strings):
            part = np.einsum("btk,t->bk", tables[codes], weight)
            out[at, begin : begin + 8] = part[:, : len(landmarks) - begin]
    return out


def _linear(rows: np.ndarray, target: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps; the bias is a column."""
    rows = np.hstack([rows, np.ones((len(rows), 1))])
    w = np.zeros(rows.shape[1])
    keep = np.eye(rows.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(30):
        inside = target * (rows @ w) < 1
        part = rows[inside] * cost[inside, None]
        new = np.linalg.solve(keep + part.T @ rows[inside], part.T @ target[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def fit_units(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS) -> Machine:
    """The machine that tells toxic units from clean ones."""
    half = landmarks // 2
    chosen = list(dict.fromkeys([*toxic[:half], *clean[: landmarks - min(half, len(toxic))]]))
    strings = [*toxic, *clean]
    target = np.concatenate([np.ones(len(toxic)), -np.ones(len(clean))])
    # Both classes weigh the same altogether.
    cost = np.where(target > 0, 0.5 / max(len(toxic), 1), 0.5 / max(len(clean), 1)) * len(strings)
    values, vectors = np.linalg.eigh(_kernel(chosen, chosen))
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    w, bias = _linear(_kernel(strings, chosen) @ whiten, target, cost)
    table = np.zeros(SYMBOLS**3)
    part = whiten @ w
    for at, codes, weight in subsequences(chosen):
        for row, string in enumerate(at):
            np.add.at(table, codes[row], weight * part[string])
    return Machine(table.astype(np.float32), bias)


def _curve(margins: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, classes weighing the same."""
    slope, offset = 1.0, 0.0
    weight = np.where(toxic > 0, 0.5 / max(toxic.sum(), 1), 0.5 / max((1 - toxic).sum(), 1)) * len(toxic)
    rows = np.stack([margins, np.ones(len(margins))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ [slope, offset], -30, 30)))
        grad = rows.T @ (weight * (p - toxic)) + [1e-2 * slope, 1e-3 * offset]
        hess = (rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(slope, 1e-3)), float(offset)


def held_out(id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5 (NULL: empty text)."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_documents(docs: DataFrame, labels: DataFrame, most: int = MAX_DOCS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, toxic, text: at most `most` labelled documents per class, in
    the order of md5 of their ids; held-out ids and odd labels are left out.
    An id labelled more than once is toxic if any label says so."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    first, second = (known.where(F.col("toxic") == flag).orderBy(order, "doc_id").limit(most) for flag in (0, 1))
    chosen = first.union(second)
    rows = only(docs, doc_id=id, text=text)
    # At most 2 * `most` ids.
    return rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")


def _distinct(sample: DataFrame) -> DataFrame:
    """The sample without copies and most near copies: of documents of a class
    that share the lowest hash of a five-word n-gram, in either of two hash
    orders, the one with the lowest id stays. A text copied with small changes
    would otherwise make all its words look toxic."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngrams((body.as_py() or "").encode(), 5) for body in batch.column(2)]
            low = [int(grams[0] >> np.uint64(1)) if len(grams) else 0 for grams in sets]
            other = [int((grams * np.uint64(0xBF58476D1CE4E5B9)).min() >> np.uint64(1)) if len(grams) else 0 for grams in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(low, pa.int64()), pa.array(other, pa.int64())],
                names=["doc_id", "toxic", "text", "low", "other"],
            )

    rows = sample.mapInArrow(sign, "doc_id long, toxic int, text string, low long, other long")
    for key in ("low", "other"):
        first = Window.partitionBy("toxic", key).orderBy("doc_id")
        rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return rows.select("doc_id", "toxic", "text")


def _split(sample: DataFrame) -> DataFrame:
    """doc_id, toxic, unit: the distinct units of each document."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, flag, body in zip(*batch.columns, strict=True):
                tokens = units(body.as_py() or "")
                parts = {part for token in tokens for part in windows(clean_unit(token)) if len(part) > 2}
                found += [(doc.as_py(), flag.as_py(), part) for part in parts]
            ids, flags, parts = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(flags, pa.int32()), pa.array(parts, pa.string())],
                names=["doc_id", "toxic", "unit"],
            )

    return sample.select("doc_id", "toxic", "text").mapInArrow(split, "doc_id long, toxic int, unit string")


def _explaining(pairs: list[tuple[int, str]]) -> list[str]:
    """Units that explain the toxic documents they occur in: one after the
    other the unit in most documents not yet explained, as long as it is in two."""
    docs_of: dict[str, set[int]] = {}
    for doc, unit in pairs:
        docs_of.setdefault(unit, set()).add(doc)
    chosen, left = [], set(doc for doc, _ in pairs)
    while docs_of:
        unit = max(docs_of, key=lambda u: (len(docs_of[u]), u))
        if len(docs_of[unit]) < 2:
            break
        chosen.append(unit)
        gone = docs_of.pop(unit)
        left -= gone
        docs_of = {u: rest for u, docs in docs_of.items() if (rest := docs - gone)}
    return chosen


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> Machine:
    """Train on the labelled documents. Only a bounded number of units, the
    toxic sample documents they occur in, and one margin per sample document
    come to the driver. Without toxic or without clean documents, or where no
    unit tells them apart, the machine scores everything low."""
    nothing = Machine(np.zeros(SYMBOLS**3, np.float32), -1.0)
    sample = materialize(training_documents(docs, labels, id=id, text=text), "toxicity-sample")
    sample = materialize(_distinct(sample), "toxicity-distinct")
    totals = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return nothing
    incidence = materialize(_split(sample), "toxicity-incidence")
    counted = incidence.groupBy("unit").agg(
        F.sum("toxic").alias("n_toxic"), F.sum(1 - F.col("toxic")).alias("n_clean")
    )
    counted = materialize(counted, "toxicity-units")
    # A unit says something if its share of toxic documents is too high for chance, over all units tried.
    base = n_toxic / (n_toxic + n_clean)
    n = F.col("n_toxic") + F.col("n_clean")
    share = F.col("n_toxic") / n
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    surprise = F.when(share > base, n * (share * F.log(share / base) + rest)).otherwise(0.0)
    lift = (F.col("n_toxic") / n_toxic) / ((F.col("n_clean") + 0.5) / n_clean)
    needed = float(np.log(max(counted.count(), 1) / CHANCE))
    telling = (surprise >= needed) & (lift >= LIFT)
    candidates = counted.where(telling).orderBy(F.desc("n_toxic"), "unit").limit(MAX_UNITS).select("unit")
    pairs = incidence.where("toxic = 1").join(F.broadcast(candidates), "unit").select("doc_id", "unit").collect()
    toxic = _explaining([(row["doc_id"], row["unit"]) for row in pairs])
    clean_units = counted.where((F.col("n_clean") > 0) & ~telling)
    by_hash = clean_units.orderBy(F.md5(F.col("unit").cast("binary"))).limit(MAX_UNITS)
    common = clean_units.orderBy(F.desc("n_clean"), "unit").limit(MAX_UNITS // 3)
    clean = list(dict.fromkeys(row["unit"] for part in (by_hash, common) for row in part.collect()))
    if not toxic or not clean:
        return nothing
    machine = fit_units(toxic, clean)
    occurs = Counter(row["unit"] for row in pairs)
    toxic += sorted(unit for unit, n in occurs.items() if n >= max(COMMON * n_toxic, 5) and unit not in toxic)
    others = sorted(set(occurs) - set(toxic))
    for _ in range(ROUNDS):
        # Telling units on the toxic side join the toxic ones; clean units that look toxic, of all there are, the clean.
        more = [unit for unit, margin in zip(others, machine.margins(others), strict=True) if margin > 0]
        clean = list(dict.fromkeys([*_hardest(clean_units, machine, MAX_UNITS), *clean]))
        machine = fit_units([*toxic, *more], clean)
    margins = score_documents(sample, machine, keep=("toxic",)).select("margin", "toxic").collect()
    machine.slope, machine.offset = _curve(
        np.array([row["margin"] for row in margins]), np.array([row["toxic"] for row in margins], float)
    )
    return machine


def _hardest(units_table: DataFrame, machine: Machine, most: int) -> list[str]:
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = machine.margins(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(margins)], names=["unit", "margin"])

    rated = units_table.select("unit").mapInArrow(rate, "unit string, margin double")
    return [row["unit"] for row in rated.where("margin > -0.9").orderBy(F.desc("margin"), "unit").limit(most).collect()]


def score_documents(docs: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep of every row with its margin, score (0 to 1) and
    predicted (score >= 0.5). NULL and empty texts score below any unit."""
    fields = [field for field in docs.schema if field.name in keep]
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in fields)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.array([machine.margin(body.as_py() or "") for body in batch.column(0)], float)
            scores = 1 / (1 + np.exp(-np.clip(machine.slope * margins + machine.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(margins), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=[*(field.name for field in fields), "margin", "score", "predicted"],
            )

    rows = docs.select(F.col(text).alias("__text"), *(F.col(field.name) for field in fields))
    return rows.mapInArrow(rate, f"{schema}, margin double, score double, predicted int")


def accepted(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose score is below 0.5."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(batch.schema.get_field_index(text))
            yield batch.filter(pa.array([machine.score(body.as_py() or "") < 0.5 for body in bodies], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by a machine trained
    on the labels. Repeated rows stay, an empty table gives no rows; nothing
    but the text enters a score."""
    machine = fit(docs, labels, id, text)
    rows = only(docs, doc_id=id, text=text)
    return score_documents(rows, machine).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
