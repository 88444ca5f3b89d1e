"""Language identification by mixture inference.

Training: counts of character trigrams (of lower-cased words with a boundary mark on either side), hashed into
``BUCKETS`` cells, per language over all labelled rows; counted per task, summed by Spark.  The model is a table of
BUCKETS x languages log-probabilities, additively smoothed; its size is checked before the broadcast.

Prediction: every word has a trigram likelihood under each language.  A document is a mixture: word w has likelihood
sum_l pi_l p(w|l).  Expectation-maximisation estimates pi over all languages; languages are then removed, weakest
first, with EM run again each time, and the set with the best penalised likelihood, log L - (k-1)/2 * log(words), is
kept.  ``lang_pred`` is the language of the largest share, ``score`` that share.

Filtering: the mixture has one more member that stands for "none of the learned languages" and gives every trigram the same
likelihood, ``foreign_level``; its share is no language's.  So a text in a language that was not learned, or of random
letters, has small shares only.  A share is an estimate from so many words; a row goes if it is below the limit by more than
``ERRORS`` standard errors, so a few odd words or a licence line do not reject a short text.

Defined cases: text that is null or has no letters gets ``und`` with score 0, as does every text if nothing was
learned; ties go to the smaller language name; rows of null language are not learned from; ids may be null or
repeated (one row per input row); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import batch_of, bounded_batches, slices

BUCKETS = 1 << 16
SMOOTHING = 0.05
MAX_MODEL_BYTES = 512 << 20
ROUNDS, EPSILON = 25, 1e-3
#: Standard errors of a share by which it must miss the limit of ``filter_language``.
ERRORS = 2.0
#: Distinct words a task holds before it turns them into trigram counts, and words whose likelihood it remembers.
MEMORY = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
UNDECIDED = "und"


def letter_words(text: str) -> list[str]:
    """Runs of letters of the lower-cased text; numerals that Python counts as word characters are taken out."""
    words = LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    return [x for w in words if (x := w if w.isalpha() else "".join(filter(str.isalpha, w)))]


def trigram_cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash cell of every trigram of the words (each has as many as letters), and where each word's begin."""
    codes = np.frombuffer(("_" + "_".join(words) + "_").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1  # of the boundary mark before each word
    first = np.cumsum(lengths) - lengths
    at = np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))
    mixed = codes[at] * np.uint64(0x9E3779B185EBCA87) + codes[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[at + 2] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64), first


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}
    cells: dict[str, np.ndarray] = {}

    def settle() -> None:
        for lang, counts in words.items():
            if counts:
                known = list(counts)
                at, first = trigram_cells(known)
                times = np.repeat(np.fromiter(counts.values(), np.float64, len(known)), np.diff(np.append(first, len(at))))
                cells.setdefault(lang, np.zeros(BUCKETS))
                cells[lang] += np.bincount(at, times, BUCKETS)
        words.clear()

    held = 0
    for batch in batches:
        for part in slices(batch):
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(letter_words(text))
            held = sum(map(len, words.values()))
            if held > MEMORY:
                settle()
    settle()
    schema = pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])
    for lang, counts in cells.items():
        seen = np.flatnonzero(counts)
        yield batch_of(schema, [lang] * len(seen), seen.astype(np.int32), counts[seen].astype(np.int64))


def foreign_level(counts: np.ndarray, log_p: np.ndarray) -> float | None:
    """Log-likelihood of a trigram in no learned language.

    For each language, half way between how its trigrams fit itself and how they fit the language nearest to it; the least of
    these, so that languages near each other or seldom seen widen what is accepted.  None with fewer than two languages:
    nothing then shows how badly other languages fit.
    """
    seen = counts.sum(0)
    if (seen > 0).sum() < 2:
        return None
    fit = (counts / np.maximum(seen, 1)).T @ log_p
    own = np.diag(fit).copy()
    np.fill_diagonal(fit, -np.inf)
    return float(((own + fit.max(1)) / 2)[seen > 0].min())


class LanguageModel:
    """Languages in name order, log p(cell | language), shape (BUCKETS, languages), and the level of ``foreign_level``."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = SMOOTHING):
        self.languages = languages
        smooth = counts + smoothing
        self.log_p = np.log(smooth / smooth.sum(0, keepdims=True)).astype(np.float32) if languages else counts.astype(np.float32)
        self.foreign = foreign_level(counts, self.log_p)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = SMOOTHING) -> LanguageModel:
    """Learn from every row that has both a text and a language."""
    rows = bounded_batches(docs).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = rows.mapInArrow(_learn, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    sums = sums.groupBy("lang").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # BUCKETS cells at most
    found: dict[str, np.ndarray] = {}
    for row in sums.toLocalIterator():
        if (len(found) + 1) * BUCKETS * 4 > MAX_MODEL_BYTES:
            raise ValueError(f"the model would exceed {MAX_MODEL_BYTES} bytes; lower BUCKETS for so many languages")
        counts = np.zeros(BUCKETS)
        cell, times = zip(*row["cells"], strict=True)
        counts[list(cell)] = times
        found[row["lang"]] = counts
    names = sorted(found)
    return LanguageModel(names, np.stack([found[x] for x in names], 1) if names else np.zeros((BUCKETS, 0)), smoothing)


def em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, pi: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once.

    p: words x languages likelihoods, scaled per word; n: counts; starts: first word of each document; pi: start
    values, 0 for languages that are out.  Returns pi and the log-likelihood of the scaled p.
    """
    sizes = np.diff(np.append(starts, len(n)))
    total = np.add.reduceat(n, starts)
    pi, out = pi.copy(), np.zeros(len(starts))
    doc = np.arange(len(starts))
    for _ in range(rounds):
        joint = p * np.repeat(pi[doc], sizes, axis=0)
        norm = joint.sum(1)
        now = np.add.reduceat(joint * (n / norm)[:, None], starts, axis=0) / total[:, None]
        moved = np.abs(now - pi[doc]).max(1)
        pi[doc] = now
        live = moved > EPSILON
        out[doc] = np.add.reduceat(n * np.log(norm), starts)
        if not live.any():
            break
        if not live.all():
            keep = np.repeat(live, sizes)
            p, n, doc, sizes, total = p[keep], n[keep], doc[live], sizes[live], total[live]
            starts = np.cumsum(sizes) - sizes
    return pi, out


def mixture(ll: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Language shares of each document after penalised selection of its languages; ll: words x languages."""
    docs, languages = len(starts), ll.shape[1]
    sizes = np.diff(np.append(starts, len(n)))
    top = ll.max(1)
    p = np.exp(ll - top[:, None]) + np.float32(1e-30)
    words = np.add.reduceat(n, starts)
    pi, fit = em(p, n, starts, np.full((docs, languages), 1 / languages, p.dtype))
    best = pi.copy()
    score = fit - (languages - 1) / 2 * np.log(words)
    doc, within = np.arange(docs), np.ones((docs, languages), bool)
    for k in range(languages - 1, 0, -1):
        share = np.where(within, pi, np.inf)
        weakest = share == share.min(1, keepdims=True)
        within[doc, languages - 1 - weakest[:, ::-1].argmax(1)] = False  # of equal shares the later name goes
        start = np.where(within, np.maximum(pi, 1e-6), 0)
        pi, fit = em(p, n, starts, start / start.sum(1, keepdims=True), rounds=8 if k > 1 else 1)
        now = fit - (k - 1) / 2 * np.log(words)
        better = now > score
        best[better], score[better] = pi[better], now[better]
    return best


class Predictor:
    """Language shares of texts; with ``foreign`` the shares leave out what no learned language explains."""

    def __init__(self, model: LanguageModel, foreign: bool = False):
        self.model, self.known = model, {}
        self.foreign = model.foreign if foreign else None
        self.table = np.zeros((0, len(model.languages) + (self.foreign is not None)), np.float32)

    def _rows(self, words: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > MEMORY:
            self.known, self.table = {}, self.table[:0]
        new = list({w for doc in words for w in doc}.difference(self.known))
        if new:
            at, first = trigram_cells(new)
            ll = np.add.reduceat(self.model.log_p[at], first, axis=0)
            if self.foreign is not None:
                lengths = np.diff(np.append(first, len(at)))
                ll = np.column_stack([ll, (lengths * self.foreign).astype(np.float32)])
            self.known |= {w: i for i, w in enumerate(new, len(self.table))}
            self.table = np.concatenate([self.table, ll])
        get = self.known.__getitem__
        return [np.fromiter(map(get, doc), np.int64, len(doc)) for doc in words]

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts that have letters, and the shares of their languages."""
        return self.counted_shares(texts)[:2]

    def counted_shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``shares`` and the texts' numbers of words."""
        words = [letter_words(t or "") for t in texts]
        some = np.array([i for i, w in enumerate(words) if w], np.int64)
        if not len(some) or not self.model.languages:
            return some[:0], np.zeros((0, len(self.model.languages))), some[:0]
        counted = [np.unique(r, return_counts=True) for r in self._rows([words[i] for i in some])]
        sizes = np.array([len(u) for u, _ in counted])
        rows, n = np.concatenate([u for u, _ in counted]), np.concatenate([c for _, c in counted]).astype(np.float64)
        pi = mixture(self.table[rows].astype(np.float64), n, np.cumsum(sizes) - sizes)
        return some, pi[:, : len(self.model.languages)], np.array([len(words[i]) for i in some], np.int64)


def _predict(broadcast):
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_languages", pa.int32()), ("shares", pa.map_(pa.string(), pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(broadcast.value)
        names = predictor.model.languages
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                lang, score, shares = [UNDECIDED] * n, [0.0] * n, [[] for _ in range(n)]
                some, pi = predictor.shares(part.column("text").to_pylist())
                for i, row in zip(some.tolist(), pi, strict=True):
                    j = int(row.argmax())
                    lang[i], score[i] = names[j], min(1.0, float(row[j]))
                    shares[i] = [(names[x], float(row[x])) for x in np.flatnonzero(row > EPSILON)]
                yield batch_of(schema, part.column("id"), lang, score, [len(s) for s in shares], shares)

    return run


PREDICTED = "id bigint, lang_pred string, score double, n_languages int, shares map<string,double>"


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, lang_pred, score, n_languages, shares: one row per input row, from the text alone."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return bounded_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(_predict(broadcast), PREDICTED)


def _accept(broadcast, text_col: str, low: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(broadcast.value, foreign=True)
        for batch in batches:
            for part in slices(batch, text_col):
                some, pi, n = predictor.counted_shares(part.column(text_col).to_pylist())
                keep = np.zeros(part.num_rows, bool)
                if len(some):
                    share = pi.max(1)
                    keep[some[share + ERRORS * np.sqrt(np.maximum(share * (1 - share), 0) / n) >= low]] = True
                kept = pa.Table.from_batches([part]).filter(pa.array(keep))
                yield from kept.to_batches()

    return run


def filter_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", low: float = 0.5) -> DataFrame:
    """The rows, all columns kept, whose text has letters and a learned language with a share of ``low`` or more of its words.

    ``ERRORS`` standard errors are added to the share.  Words that fit no learned language count for none.  No row is kept if
    nothing was learned.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return bounded_batches(docs).mapInArrow(_accept(broadcast, text_col, low), docs.schema)


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``."""
    return F.crc32(key.cast("string")) % folds
