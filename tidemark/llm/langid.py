"""Language identification as multilingual mixture inference.

Training counts byte trigrams by language.  A document is a mixture: each of its
trigrams comes from language l with probability pi_l, and expectation-
maximisation estimates pi from the trigram likelihoods.  The language set is
chosen by penalised likelihood: a bound on the fit with all languages shows that
most documents are settled by their best language alone, and the others compare
the nested sets of their heaviest languages, each language charged
``PENALTY * log(trigrams)``.  The prediction is the heaviest language of
the chosen set, and the score its share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _kernels as K
from tidemark.runtime import map_arrow

UNKNOWN = "und"
BITS = 16
#: Languages a model may hold unless ``train`` is told otherwise (128 MB).
MOST_LANGUAGES = 512
#: Added to every count.
SMOOTHING = 0.5
PENALTY = 2.0
ROUNDS, SETTLED = 30, 1e-3

#: Letters as they are (A-Z lowered), bytes of other characters as they are, the rest as space.
_CODES = np.where(K.byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)]), K.LOWER, 0x20).astype(np.uint8)

_LETTERS = K.byte_class([(0x41, 0x5A), (0x61, 0x7A)])


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram, its document) of texts laid end to end.

    Trigrams of only spaces, or with a space in the middle, say little of a
    language and are left out; none crosses a document's end.
    """
    if len(raw) < 3:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    codes = _CODES[raw]
    good = codes[1:-1] != 0x20
    lengths = np.diff(offsets)
    ends = offsets[1:][lengths > 0]
    for back in (1, 2):
        at = ends - back
        good[at[(at >= 0) & (at < len(good))]] = False
    at = np.flatnonzero(good)
    packed = codes[at].astype(np.uint32) << 16 | codes[at + 1].astype(np.uint32) << 8 | codes[at + 2]
    with np.errstate(over="ignore"):
        buckets = ((packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    documents = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[at]
    return buckets, documents


@dataclass
class Model:
    languages: list[str]
    likelihood: np.ndarray
    """float32 (2**BITS, languages): probability of a trigram in each language."""
    prior: np.ndarray
    """Share of the training trigrams in each language."""


def train(docs: DataFrame, learn_from: Column, *, text_col: str = "text", lang_col: str = "lang", most: int = MOST_LANGUAGES) -> Model:
    """Counts over all rows that meet ``learn_from`` with a text and a language.

    Each task adds up its counts by language, Spark sums them, and the sums reach
    the driver a language at a time, in one pass over the texts.  More than
    ``most`` labels are an error, not a cut: a model takes 256 KB a language on
    the driver and in every worker.  No labelled text gives a model without
    languages.
    """
    rows = docs.where(learn_from & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, sums in counts.items():
                at = np.flatnonzero(sums)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["lang", "bucket", "n"])
            counts.clear()

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, of = langs.dictionary.to_pylist(), np.asarray(langs.indices)
            raw, offsets = K.string_buffers(batch.column(1))
            for a, b in K.pieces(offsets):
                buckets, documents = trigrams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                spoken = of[a:b][documents]
                for i in np.unique(spoken):
                    sums = counts.setdefault(names[i], np.zeros(1 << BITS, np.int64))
                    sums += np.bincount(buckets[spoken == i], minlength=1 << BITS)
                if len(counts) > 64:
                    yield from out()
        yield from out()

    summed = map_arrow(rows, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).select("lang", "c.bucket", "c.n")
    held: dict[str, np.ndarray] = {}
    for lang, bucket, n in by_lang.toLocalIterator():
        if len(held) == most:
            raise ValueError(f"more than {most} languages")
        held[lang] = np.zeros(1 << BITS, np.float32)
        held[lang][bucket] = n
    languages = sorted(held)
    smooth = np.empty((1 << BITS, len(languages)), np.float32)
    totals = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        sums = held.pop(lang).astype(np.float64)
        totals[i] = sums.sum()
        smooth[:, i] = (sums + SMOOTHING) / (totals[i] + SMOOTHING * len(sums))
    return Model(languages, smooth, totals / max(1.0, totals.sum()))


def _mixture(likelihood: np.ndarray, weights: np.ndarray, first: np.ndarray, of: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions of documents by expectation-maximisation, their log-likelihoods,
    and a bound that no proportions of the allowed languages exceed.

    ``likelihood`` has a row for each distinct trigram of each document, ``first``
    where each document's rows start, ``allowed`` the languages of each document.
    A document's rounds end when its own shares settle, so its result does not
    depend on the documents beside it.
    """
    totals = np.add.reduceat(weights, first)
    shares = allowed / allowed.sum(axis=1, keepdims=True)
    live = np.arange(len(first))
    part, part_weights, part_first, part_of, now = likelihood, weights, first, of, shares
    done = np.zeros(len(live), bool)
    for _ in range(ROUNDS):
        parts = now[part_of] * part
        parts *= (part_weights / parts.sum(axis=1))[:, None]
        new = np.add.reduceat(parts, part_first, axis=0) / totals[live, None]
        settled = np.abs(new - now).max(axis=1) < SETTLED
        now = new
        shares[live[~done]] = now[~done]
        done |= settled
        if done.all():
            break
        if 2 * done.sum() > len(done):
            rows = ~done[part_of]
            part, part_weights = part[rows], part_weights[rows]
            sizes = np.diff(np.append(part_first, len(part_of)))[~done]
            part_first, part_of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            live, now, done = live[~done], now[~done], np.zeros(len(sizes), bool)
    mixed = (shares[of] * likelihood).sum(axis=1)
    fit = np.add.reduceat(np.log(mixed) * weights, first)
    # The log-likelihood is concave in the shares: with g the mean of p_l / mixture,
    # other shares s gain at most total * log(sum s_l g_l).
    gain = np.add.reduceat(likelihood * (weights / mixed)[:, None], first, axis=0) / totals[:, None]
    return shares, fit, fit + totals * np.log((gain * (allowed > 0)).max(axis=1))


def infer(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language number or -1, score) of texts laid end to end.

    A text without a trigram (one or two letters) gets the language of most
    training trigrams, with its share as the score."""
    n, kinds = len(offsets) - 1, len(model.languages)
    if not kinds:
        return np.full(n, -1), np.zeros(n)
    best, score = np.full(n, model.prior.argmax()), np.full(n, model.prior.max())
    buckets, documents = trigrams(raw, offsets)
    if not len(buckets):
        return best, score
    keys = documents.astype(np.int64) << BITS | buckets
    keys = np.sort(keys.astype(np.int32)) if n < 1 << (31 - BITS) else np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    weights = np.diff(np.append(at, len(keys))).astype(np.float64)
    keys = keys[at]
    owner = keys >> BITS
    known = model.likelihood[keys & ((1 << BITS) - 1)].astype(np.float64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    present = owner[first]
    of = np.cumsum(np.isin(np.arange(len(owner)), first)) - 1
    totals = np.add.reduceat(weights, first)
    shares, _, bound = _mixture(known, weights, first, of, np.ones((len(first), kinds)))
    order = np.argsort(-shares, axis=1, kind="stable")
    alone = np.add.reduceat(np.log(known) * weights[:, None], first, axis=0)
    charge = PENALTY * np.log(totals + 1)
    chosen = alone.argmax(axis=1)
    part = np.ones(len(first))
    chosen_fit = alone.max(axis=1) - charge
    # No set of languages fits better than the bound on all of them.
    unsettled = np.flatnonzero(bound - 2 * charge > chosen_fit)
    if len(unsettled):
        for size in range(2, kinds + 1):
            unsettled = unsettled[bound[unsettled] - size * charge[unsettled] > chosen_fit[unsettled]]
            if not len(unsettled):
                break
            inside = np.isin(of, unsettled)
            some = known[inside]
            some_of = np.searchsorted(unsettled, of[inside])
            some_first = np.flatnonzero(np.concatenate(([True], some_of[1:] != some_of[:-1])))
            allowed = np.zeros((len(unsettled), kinds))
            np.put_along_axis(allowed, order[unsettled, :size], 1.0, axis=1)
            mixed, mixed_fit, _ = _mixture(some, weights[inside], some_first, some_of, allowed)
            better = mixed_fit - size * charge[unsettled] > chosen_fit[unsettled]
            where = unsettled[better]
            chosen[where], part[where] = mixed[better].argmax(axis=1), mixed[better].max(axis=1)
            chosen_fit[where] = mixed_fit[better] - size * charge[where]
    best[present], score[present] = chosen, np.clip(part, 0, 1)
    return best, score


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) added, from the text alone.

    A null text, a text without a letter and any text under a model without
    languages is ``und`` with score 0.  A text's result depends on
    nothing but the text and the model, so repeated texts agree and however rows
    are dealt the result is one.  All columns and rows of ``docs`` stay; columns of
    those two names are replaced.  A very long text is one numpy pass of its own.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*kept)
    size = max(1 << 16, K.PIECE * 8 // max(8, len(model.languages)))
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*model.languages, UNKNOWN]
        for batch in batches:
            raw, offsets = K.string_buffers(batch.column(at))
            for a, b in K.pieces(offsets, size):
                best, score = infer(model, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                letters = _has_letter(part.column(at), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                best = np.where(letters, best, -1)
                score = np.where(best < 0, 0.0, score)
                yield pa.record_batch([*part.columns, pa.array([names[i] for i in best], pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "lang_pred string", "score double"])
    return map_arrow(rows, run, fields)


def _has_letter(column: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    sums = np.concatenate(([0], np.cumsum(_LETTERS[raw])))
    found = np.diff(sums[offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[i] = any(map(str.isalpha, column[i].as_py()))
    return found


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2: the documents not learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
