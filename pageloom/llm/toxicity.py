"""Operator 11. Toxicity: a weighted lexicon matched by Aho-Corasick after folding.

A text is folded to plain words: lower case, look-alike letters of other scripts and
digits or signs inside words put back to the letters they stand for, invisible
characters taken out. One automaton finds all entries of the lexicon (whole words and
beginnings of words) and the exception phrases in one pass over the folded text; a place
inside an exception phrase doesn't count. A text's score is a logistic of the weight
found per word and of how many different words were hit.

Entries and weights are learned: words, and beginnings of words, that significantly more
toxic than clean labelled texts hold, weighted by their log odds. Contexts of two words in
which an entry is mostly met in clean texts become exception phrases.

The model is fitted on at most ``max_labelled`` labelled rows, those with the smallest
hash of their id, and has at most ``max_entries`` entries. Words are counted on executors;
the driver gets the entries and four numbers a labelled row. Rows whose crc32(id as text)
mod 3 is 1 are held out and never used. All rows are scored, whole.

Defined cases: null text is scored as the empty text; labels that are null or of ids
without document are ignored; near copies among the labelled texts count as one text
(they share the least hash of four words in a row); with no labelled row every score is 0.5, with
one class only it is that class's smoothed share; rows are scored independently, so repeated
rows get equal scores; null ids are scored, not held out and without label; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pageloom.llm import textkit as tk
from pageloom.runtime import Scratch, ship

HELD_OUT = "coalesce(pmod(crc32(cast({0} as string)), 3) = 1, false)"
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones, in pairs (letter, what it looks like).
HOMOGLYPHS = "аaвbсcԁdеeёeһhіiїiјjкkӏiмmнhоoрpԛqѕsтtѵvуyхxԝwαaβbεeηnικκkνvοoρpτtυuχxωwıiɡgɑaʟiℓi"
# Digits and signs that stand for letters inside words. l is folded to i, as 1 and | stand for both.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "l": "i"}
# Common phrases in which a word of abuse is none.
EXCEPTIONS = ("trash can", "trash bin", "pond scum", "clown fish")

_LOOK = {ord(HOMOGLYPHS[k]): HOMOGLYPHS[k + 1] for k in range(0, len(HOMOGLYPHS), 2)}
_LOOK |= {0xFF01 + k: chr(0x21 + k) for k in range(94)}  # full-width forms
_LOOK |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)])  # invisible; stacked marks
_INSIDE = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W_](?:[\w@$!|€]*[^\W_])?")
_LETTER = re.compile(r"[^\W\d_]")


def fold(text: str) -> str:
    """Folded words of a text, each between single spaces; a space at both ends."""
    words = (w.translate(_INSIDE) if _LETTER.search(w) else w for w in _WORD.findall(text.lower().translate(_LOOK)))
    return f" {' '.join(w.replace('_', '') for w in words)} "


@dataclass
class Lexicon:
    """Entries ' word ' (whole) or ' stem' (beginning) with weights, exception phrases ' a b ', and the logistic's coefficients."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    intercept: float = 0.0
    by_density: float = 0.0
    by_kinds: float = 0.0

    def automaton(self) -> ahocorasick.Automaton | None:
        made = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            made.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), None))
        if not len(made):
            return None
        made.make_automaton()
        return made

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of (weight found, number of different words hit, words)."""
        density, kinds = shape(x)
        return 1 / (1 + np.exp(-(self.intercept + self.by_density * density + self.by_kinds * kinds)))


#: A short text's few words don't make it dense.
LEAST_WORDS = 20


def shape(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.log(200 * x[:, 0] / (x[:, 2] + LEAST_WORDS) + 1), np.log1p(x[:, 1])


def hits(automaton: ahocorasick.Automaton | None, folded: str) -> dict[int, float]:
    """Weight of each place (offset of the space before a word) with an entry: the largest one there, outside exception phrases."""
    found, spared = {}, []
    if automaton is not None:
        for last, (length, weight) in automaton.iter(folded):
            at = last - length + 1
            if weight is None:
                spared.append((at, last))
            elif weight > found.get(at, 0.0):
                found[at] = weight
    for low, high in spared:
        for at in [at for at in found if low <= at < high] if len(found) < high - low else range(low, high):
            found.pop(at, None)
    return found


def measures(automaton: ahocorasick.Automaton | None, text: str) -> tuple[float, int, int, int]:
    """Weight found, different words hit, words, places hit."""
    folded = fold(text)
    found = hits(automaton, folded)
    kinds = {folded[at + 1 : folded.index(" ", at + 1)] for at in found}
    return math.fsum(found.values()), len(kinds), folded.count(" ") - 1 if len(folded) > 2 else 0, len(found)


def _folded(docs: DataFrame) -> DataFrame:
    """doc_id, y, near, words: the folded words of labelled texts, and the least hash of four of them in a row, which near copies share."""

    @tk.releasing
    def rows(batches):
        for batch, _, _ in tk.slices(batches, "text"):
            words = [fold(t or "").split() for t in batch.column(2).to_pylist()]
            near = [min((zlib.crc32(" ".join(w[k : k + 4]).encode()) for k in range(max(1, len(w) - 3)))) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int64()), pa.array(words, pa.list_(pa.string()))], ["doc_id", "y", "near", "words"])

    return docs.select("doc_id", "y", "text").mapInArrow(rows, "doc_id long, y int, near long, words array<string>")


def _odds(p, n, toxic: float, clean: float):
    """Log odds of a count in toxic texts against one in clean texts, smoothed."""
    return F.log((p + 0.5) / (toxic + 1)) - F.log((n + 0.5) / (clean + 1))


def _learn_entries(folded: DataFrame, toxic: int, clean: int, max_entries: int, least_odds: float, least_gain: float, stem: int) -> dict[str, float]:
    """Words and beginnings of words whose share of toxic texts is significantly larger (twice the log likelihood gained), weighted by log odds."""
    share = toxic / (toxic + clean)
    # a word of near copies counts once
    words = folded.select("y", "near", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    whole = words.select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("entry"), "p", "n")
    stems = words.select(F.explode(F.expr(f"transform(sequence({stem}, greatest(length(word) - 1, {stem})), k -> if(k < length(word), concat(' ', substring(word, 1, k)), null))")).alias("entry"), "p", "n")
    stems = stems.where("entry is not null").groupBy("entry").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, n = F.col("p"), F.col("n")
    gain = 2 * (p * F.log(p / (p + n) / share) + F.when(n > 0, n * F.log(n / (p + n) / (1 - share))).otherwise(0.0))
    weighed = whole.union(stems).where(p > 0).select("entry", _odds(p, n, toxic, clean).alias("weight"), gain.alias("gain"))
    kept = weighed.where((F.col("weight") >= least_odds) & (F.col("gain") >= least_gain)).orderBy(F.desc("gain"), "entry").limit(max_entries)
    return {r["entry"]: r["weight"] for r in kept.collect()}


def _learn_exceptions(folded: DataFrame, model: Lexicon, toxic: int, clean: int, most: int, least_clean: int) -> frozenset[str]:
    """Pairs of words around an entry that clean texts hold at least as often as toxic ones (by share), and ``least_clean`` of them do."""
    sent = folded.sparkSession.sparkContext.broadcast(model)

    @tk.releasing
    def pairs(batches):
        automaton = sent.value.automaton()
        for batch in batches:
            ys, out = [], []
            for y, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = f" {' '.join(words)} "
                starts, at = {}, 0
                for k, w in enumerate(words):
                    starts[at] = k
                    at += len(w) + 1
                seen = set()
                for at in hits(automaton, text):
                    k = starts[at]
                    seen.update(f" {words[j]} {words[j + 1]} " for j in (k - 1, k) if 0 <= j < len(words) - 1)
                ys += [y] * len(seen)
                out += sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(out, pa.string())], ["y", "phrase"])

    counted = folded.select("y", "words").mapInArrow(pairs, "y int, phrase string").groupBy("phrase").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    innocent = counted.where((F.col("n") >= least_clean) & (_odds(F.col("p"), F.col("n"), toxic, clean) <= 0))
    return frozenset(r["phrase"] for r in innocent.orderBy(F.desc("n"), "phrase").limit(most).collect())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients by Newton steps; those of the columns after the first are kept at 0 or above."""
    use = list(range(x.shape[1]))
    while True:
        beta = np.zeros(len(use))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ beta, -30, 30)))
            pull = ridge * np.array([k > 0 for k in use])
            step = np.linalg.solve((x[:, use] * (p * (1 - p))[:, None]).T @ x[:, use] + np.diag(pull + 1e-9), x[:, use].T @ (y - p) - pull * beta)
            beta += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-9:
                break
        low = [k for k, b in zip(use, beta) if k > 0 and b < 0]
        if not low:
            out = np.zeros(x.shape[1])
            out[use] = beta
            return out
        use = [k for k in use if k not in low]


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = 20_000,
    max_entries: int = 20_000,
    least_odds: float = 2.0,
    least_gain: float = 24.0,
    stem: int = 4,
    exceptions: tuple[str, ...] = EXCEPTIONS,
    max_exceptions: int = 2_000,
    least_clean: int = 5,
) -> Lexicon:
    """A lexicon learned from ``labels(id, label)`` for the texts of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(f"y in (0, 1) and doc_id is not null and not {HELD_OUT.format('doc_id')}")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scratch = Scratch(spark, "toxic")
    # at most max_labelled rows are sent to all executors; their folded texts are written once and read by each step of the fit
    folded = scratch.save(_folded(texts.join(F.broadcast(chosen), "doc_id")), "folded")
    n = {r["y"]: r["n"] for r in folded.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    model = Lexicon(exceptions=frozenset(fold(p) for p in exceptions))
    if toxic and clean:
        model.entries = _learn_entries(folded, toxic, clean, max_entries, least_odds, least_gain, stem)
        model.exceptions |= _learn_exceptions(folded, model, toxic, clean, max_exceptions, least_clean)
        spread = folded.select("doc_id", "y", F.concat_ws(" ", "words").alias("text"))
        got = _measured(spread, model, THRESHOLD, "doc_id long, y int").toPandas().sort_values(["doc_id", "y", "weight", "n_words"])
        density, kinds = shape(got[["weight", "kinds", "n_words"]].to_numpy(dtype=float))
        model.intercept, model.by_density, model.by_kinds = _logistic(np.stack([np.ones(len(got)), density, kinds], axis=1), got["y"].to_numpy(dtype=float)).tolist()
    elif toxic or clean:
        model.intercept = math.log((toxic + 0.5) / (clean + 0.5))
    scratch.drop("folded")
    return model


def _measured(docs: DataFrame, model: Lexicon, threshold: float, kept: str) -> DataFrame:
    """The columns ``kept`` (a schema) of docs(..., text) with weight, kinds, n_words, n_hits, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.split()[0] for f in kept.split(", ")]

    @tk.releasing
    def rows(batches):
        automaton = sent.value.automaton()
        for batch, _, _ in tk.slices(batches, "text"):
            x = np.array([measures(automaton, t or "") for t in batch.column(len(names)).to_pylist()], dtype=float).reshape(-1, 4)
            score = sent.value.score(x)
            counts = [pa.array(x[:, k].astype(np.int64)) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(x[:, 0]), *counts, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "weight", "kinds", "n_words", "n_hits", "score", "predicted"]
            )

    return docs.select(*names, "text").mapInArrow(rows, f"{kept}, weight double, kinds long, n_words long, n_hits long, score double, predicted int")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, threshold: float = THRESHOLD, model: Lexicon | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, score, predicted, n_words, n_hits."""
    ship(docs.sparkSession)
    model = model or fit_toxicity(docs, labels, id_col, text_col, label_col, max_labelled)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(HELD_OUT.format(f"`{id_col}`")).alias("held_out"), F.col(text_col).alias("text"))
    return _measured(source, model, threshold, "doc_id long, held_out boolean").select("doc_id", "held_out", "score", "predicted", "n_words", "n_hits")
