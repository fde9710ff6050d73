"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts to
Latin ones, accents dropped, digit and sign substitutions inside words undone; a
word with signs at its edges is read both ways, with the signs as letters and without.
The lexicon is learned from labelled rows: whole words, each weighted by its log
odds, and word beginnings of five letters or more that at least two different
words of toxic documents share.  Documents in which a word stands between the same
neighbours count once, so copies and near copies teach no more than one of them.
The evidence of an entry must exceed what the best of all entries tried would
reach by chance.  Two-word phrases around a lexicon word that clean documents use
are learned as exceptions and matched in the same automaton; a hit inside one
does not count.  A text's hits (each word once), normalised by its length, become a
score through a logistic curve fitted on the labelled rows.

Defined results: a null or empty text has no hits and gets the score of a text
without hits; a text of any length is scored whole, in one scan; equal texts get
equal scores, and of entries that start at one place the heavier one counts;
null labels teach nothing; of several labels of an id the toxic one counts;
repeated rows are scored row by row; without any toxic or any clean labelled row
the lexicon is empty and the score is the share of toxic labels (0 without
labels); other columns pass through and an input column with the name of a result
column is replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from febrile.llm.common import free_memory, read_table, text_or_empty, text_slices, tidy, written

#: Bytes of texts that a task turns into Python strings at a time.
SLICE = 200_000

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ѡ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ß": "ss",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
SIGNED = re.compile(r"\S*[@$!|]\S*")
INFIX_SIGNS = re.compile(r"(?<=[^\W_])[@$!|]+(?=[^\W_])")
EDGE_SIGNS = re.compile(r"(?<![^\W_])[@$!]+(?=[^\W\d_])|(?<=[^\W\d_])[@$]+(?![^\W_])")
AS_LETTERS = str.maketrans(SIGNS)


class FoldTable(dict):
    """Code point -> folded letters, filled as code points are met; other signs become blanks."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            c = HOMOGLYPHS.get(c, SUBSTITUTES.get(c, c))
            if unicodedata.combining(c[0]) or unicodedata.category(c[0]) == "Cf":
                continue
            out += c if c.isalpha() else " "
        self[code] = out
        return out


def _letters(found: re.Match) -> str:
    return found.group().translate(AS_LETTERS)


def _readings(found: re.Match) -> str:
    """A word with signs: those inside it as letters, then also those at its edges if it has any."""
    inside = INFIX_SIGNS.sub(_letters, found.group())
    edges = EDGE_SIGNS.sub(_letters, inside)
    return inside if edges == inside else f"{inside} {edges}"


def fold(text: str, table: FoldTable) -> str:
    """Folded words between single or more blanks, with a blank at both ends."""
    return f" {SIGNED.sub(_readings, text).translate(table)} "


@dataclass(frozen=True)
class ToxicityParams:
    prefix_lengths: tuple[int, ...] = (5, 6, 7, 8)
    min_documents: int = 3           # toxic documents with different neighbours around the entry
    min_evidence: float = 10.0       # log likelihood ratio of an entry, beyond the best of as many chance entries
    min_weight: float = 2.3          # log odds of an entry
    exception_documents: int = 5     # clean documents that make a phrase an exception
    max_labels: int = 250_000        # labels (by hash of the id) that teach, about; the rest are not read
    fit_rows: int = 50_000           # labelled rows (by hash) that fit the logistic curve, at most about


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)  # " stem" or " word "
    exceptions: list[str] = field(default_factory=list)      # "first second"
    curve: tuple[float, ...] = (-20.0, 0.0, 0.0)


def entries_of(folded: str, lengths: tuple[int, ...]) -> dict[str, tuple[str, str]]:
    """Each whole word and word beginning of a text -> its first word and that word between its neighbours."""
    out: dict[str, tuple[str, str]] = {}
    words = folded.split()
    for before, word, after in zip(["", *words], words, [*words[1:], ""]):
        if f" {word} " in out:
            continue
        spot = (word, f"{before} {word} {after}")
        out[f" {word} "] = spot
        for k in lengths:
            if len(word) >= k:
                out.setdefault(f" {word[:k]}", spot)
    return out


def automaton(model: ToxicityModel):
    import ahocorasick
    found = ahocorasick.Automaton()
    for entry, weight in model.weights.items():
        found.add_word(entry, (len(entry), weight, False))
    for phrase in model.exceptions:
        found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, True))
    if len(found):
        found.make_automaton()
    return found


def hits(folded: str, matcher) -> dict[int, float]:
    """Start of each hit word -> its largest entry weight; words inside exception phrases are left out."""
    if not len(matcher):
        return {}
    at: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight, exception) in matcher.iter(folded):
        start = end - length + 1
        if exception:
            spared.append((start, end))
        elif weight > at.get(start, 0.0):
            at[start] = weight
    for s, e in spared:
        for start in [x for x in at if s <= x < e]:
            del at[start]
    return at


def measures(text: str, matcher, table: FoldTable) -> tuple[float, float, int]:
    """Total weight of the different words that hit, weight for each hundred words, and the words."""
    folded = fold(text, table)
    total = sum({folded[s + 1:folded.index(" ", s + 1)]: w for s, w in hits(folded, matcher).items()}.values())
    n = len(folded.split())
    return total, 100.0 * total / max(n, 1), n


def _toxic_entries(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """entry, k1: documents of ``rows`` (t) with different neighbours around it; words: whether two words or more have it."""
    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FoldTable()
        for batch in batches:
            for _, texts in text_slices(batch.column(0), SLICE):
                found = [(e, w, xxhash.xxh3_64_intdigest(s) >> 1) for t in texts for e, (w, s) in entries_of(fold(t, table), lengths).items()]
                yield pa.RecordBatch.from_pydict({
                    "entry": pa.array([e for e, _, _ in found], pa.string()), "word": pa.array([w for _, w, _ in found], pa.string()),
                    "spot": pa.array([s for _, _, s in found], pa.int64())})

    once = rows.select("t").mapInArrow(tidy(spots), "entry string, word string, spot long").groupBy("entry", "spot").agg(F.min("word").alias("word"))
    return once.groupBy("entry").agg(F.count("*").alias("k1"), (F.min("word") < F.max("word")).alias("words"))


def _clean_entries(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """entry, k0: documents of ``rows`` (t) that hold it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table = Counter(), FoldTable()
        for batch in batches:
            for _, texts in text_slices(batch.column(0), SLICE):
                for text in texts:
                    seen.update(entries_of(fold(text, table), lengths).keys())
                    if len(seen) > 200_000:  # partial counts leave early, so a task stays small
                        yield _counted(seen)
                        seen.clear()
        yield _counted(seen)

    return rows.select("t").mapInArrow(tidy(count), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("k0"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"entry": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def _fit(k: Column, n: float) -> Column:
    """Log likelihood of k of n under its own rate."""
    rest = F.lit(n) - k
    return F.when(k > 0, k * F.log(k / F.lit(n))).otherwise(0.0) + F.when(rest > 0, rest * F.log(rest / F.lit(n))).otherwise(0.0)


def _chosen(rows: DataFrame, n1: int, n0: int, params: ToxicityParams) -> dict[str, float]:
    """Entry -> weight.  Both counts are joined and judged in Spark; only entries that pass are fetched."""
    toxic = written(_toxic_entries(rows.filter("y = 1"), params.prefix_lengths).filter(
        (F.col("k1") >= params.min_documents) & (F.col("entry").endswith(" ") | F.col("words"))), "toxic-entries")
    clean = _clean_entries(rows.filter("y = 0"), params.prefix_lengths)
    k1, k0 = F.col("k1").cast("double"), F.coalesce(F.col("k0"), F.lit(0)).cast("double")
    weight = F.log((k1 + 0.5) / (n1 + 1)) - F.log((k0 + 0.5) / (n0 + 1))
    evidence = 2 * (_fit(k1, n1) + _fit(k0, n0) - _fit(k1 + k0, n1 + n0))
    least = params.min_evidence + 2 * math.log(max(toxic.count(), 1))
    passed = toxic.join(clean, "entry", "left").select("entry", "k1", weight.alias("w"), evidence.alias("e"))
    found = {r["entry"]: (r["k1"], r["w"]) for r in passed.filter((F.col("w") >= params.min_weight) & (F.col("e") >= least)).collect()}
    weights: dict[str, float] = {}
    for entry in sorted(found, key=lambda e: (e.endswith(" "), len(e), e)):  # beginnings first, short ones before long ones
        seen, w = found[entry]
        stem = entry.strip()
        begun = [f" {stem[:k]}" for k in params.prefix_lengths if k <= len(stem)]
        if not entry.endswith(" ") and any(found[e][0] == seen for e in _longer(found, entry)):
            continue  # a longer beginning is found in as many places
        if w > max((weights.get(b, 0.0) for b in begun), default=0.0) + 0.5:  # a longer form must say more than its beginning
            weights[entry] = round(w, 6)
    return weights


def _longer(found: dict[str, tuple[int, float]], beginning: str) -> list[str]:
    return [e for e in found if not e.endswith(" ") and len(e) > len(beginning) and e.startswith(beginning)]


def learn(labelled: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learn from ``labelled`` (text, toxic 0/1); entry counts cover all its rows."""
    rows = labelled.filter(F.col("toxic").isin(0, 1)).select(text_or_empty().alias("t"), F.col("toxic").cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    model = ToxicityModel()
    if not n1 or not n0:
        share = n1 / max(n1 + n0, 1)
        model.curve = (math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0)
        return model
    model.weights = _chosen(rows, n1, n0, params)
    model.exceptions = _exceptions(rows, model, params)
    model.curve = _fit_curve(rows, model, n1 + n0, params)
    return model


def _exceptions(rows: DataFrame, model: ToxicityModel, params: ToxicityParams) -> list[str]:
    """Phrases of a lexicon word and a neighbour that clean documents use more than toxic ones."""
    if not model.weights:
        return []
    spread = rows.sparkSession.sparkContext.broadcast(model)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, table = automaton(spread.value), FoldTable()
        for batch in batches:
            seen = Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(text, table)
                own = set()
                for start in hits(folded, matcher):
                    end = folded.index(" ", start + 1)
                    if folded[end + 1:end + 2].strip():
                        own.add(folded[start + 1:folded.index(" ", end + 1)])
                    if start and folded[start - 1] != " ":
                        own.add(folded[folded.rfind(" ", 0, start) + 1:end])
                seen.update((phrase, y) for phrase in own)
            yield pa.RecordBatch.from_pydict({
                "phrase": pa.array([p for p, _ in seen], pa.string()), "y": pa.array([y for _, y in seen], pa.int32()),
                "n": pa.array(list(seen.values()), pa.int64())})

    counts = rows.mapInArrow(tidy(phrases), "phrase string, y int, n long").groupBy("phrase").agg(
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"),
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    kept = counts.filter((F.col("clean") >= params.exception_documents) & (F.col("clean") > F.col("toxic")))
    # lexicon words are rare in clean documents by their weight, so few phrases pass; the order keeps the result fixed
    return [r["phrase"] for r in kept.orderBy("phrase").collect()]


def _features(total: np.ndarray, density: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(total), np.log1p(total), np.minimum(density, 25.0) / 25.0], axis=1)


def _fit_curve(rows: DataFrame, model: ToxicityModel, n: int, params: ToxicityParams) -> tuple[float, ...]:
    """Logistic curve over the measures, by Newton steps with a small ridge, on about ``fit_rows`` rows."""
    spread = rows.sparkSession.sparkContext.broadcast(model)
    share = min(1.0, params.fit_rows / n)
    few = rows.filter(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    got = few.select(measurer(spread)("t").alias("m"), "y").select("m.total", "m.density", "y").toPandas()
    x = _features(got["total"].to_numpy(float), got["density"].to_numpy(float))
    y, w = got["y"].to_numpy(float), np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(round(float(v), 6) for v in w)


def measurer(spread):
    """Column function: total, density and words of a text under the broadcast model."""
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher, table = automaton(spread.value), FoldTable()
        for series in texts:
            yield pd.DataFrame([measures(t, matcher, table) for t in series], columns=["total", "density", "words"])
        free_memory()

    return F.pandas_udf(measure, "total double, density double, words long")


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add tox_weight, tox_density and score (0 to 1) to ``docs``; one row in, one row out, no shuffle."""
    added = ["tox_weight", "tox_density", "score"]
    spread = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(*[c for c in docs.columns if c not in added], measurer(spread)(text_or_empty()).alias("__m"))
    out = out.select("*", F.col("__m.total").alias("tox_weight"), F.col("__m.density").alias("tox_density")).drop("__m")
    b, w, d = model.curve
    z = F.lit(b) + F.lit(w) * F.log1p("tox_weight") + F.lit(d) * F.least(F.col("tox_density"), F.lit(25.0)) / 25.0
    return out.withColumn("score", 1 / (1 + F.exp(-z)))


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: remainder 1 of the crc32 of the id's text by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def learned_from(spark: SparkSession, sf_dir: str, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """The model of the ``labels`` and ``documents`` tables, without held-out rows, from ``max_labels`` labels at most."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = params.max_labels / max(labels.count(), 1)
    if share < 1:
        labels = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # about max_labels rows of two numbers
    return learn(written(texts.join(F.broadcast(labels), "doc_id").select("text", "toxic"), "labelled-texts"), params)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learned_from(spark, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"), "tox_weight", "tox_density")
