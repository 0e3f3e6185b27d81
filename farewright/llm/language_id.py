"""Language identification as a mixture: which languages a text is made of, and in what proportions.

Each language has a distribution over byte trigrams of letters, learned from labelled texts. A text
is a mixture of languages; expectation-maximisation finds the proportions that make its trigrams
likeliest. Languages enter one by one, in order of their share in the mixture of all, as long as
the likelihood gained exceeds a penalty for each language (as in BIC).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewright.llm.shared import fresh, pieces, written

BUCKETS = 1 << 16
ROUNDS = 12
#: Added to each count of a trigram.
SMOOTHING = 0.5
#: More labels, or more different trigrams of all labels together, than this are refused: the model, 20 bytes
#: for each of these, goes to every task. A label has some ten thousand, so hundreds of languages fit.
MAX_LANGUAGES, MAX_ENTRIES = 4096, 1 << 24
#: Labels whose sums the driver takes at once.
TAKEN = 64
#: Labels whose counts a task holds at once.
HELD = 32
#: Bytes whose trigrams are taken at once, which bounds the memory for one very long text.
CHUNK = 1 << 20
#: Trigrams are taken within words only; the bytes of everything but letters count as a space.
_WORD, _BREAK = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
UNDETERMINED = "und"


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the byte trigrams of a text's lower-cased words, with a space on each
    side; both empty if there is no letter."""
    counts, stop = None, 0
    while stop < len(text):
        start, cut = stop, _BREAK.search(text, stop + CHUNK)
        stop = cut.start() if cut else len(text)
        words = _WORD.findall(text[start:stop].lower())
        if not any(map(str.isalpha, words)) and not any(map(str.isalpha, "".join(words))):
            continue
        b = np.frombuffer(f" {' '.join(words)} ".encode(), np.uint8).astype(np.uint32)
        mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        found = np.bincount((mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        counts = found if counts is None else counts + found
    if counts is None:
        return np.zeros(0, np.int64), np.zeros(0)
    used = np.flatnonzero(counts)
    return used, counts[used].astype(np.float64)


class Rows:
    """The distributions of all languages over a text's trigrams: a floor for each language, and what is added
    to it where the language has a trigram. Used like the matrix (language, trigram) in products."""

    __array_ufunc__ = None

    def __init__(self, floor: np.ndarray, lang: np.ndarray, at: np.ndarray, gain: np.ndarray, log_gain: np.ndarray, width: int):
        self.floor, self.lang, self.at, self.gain, self.log_gain, self.width = floor, lang, at, gain, log_gain, width

    def __len__(self) -> int:
        return len(self.floor)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return self.floor * x.sum() + np.bincount(self.lang, self.gain * x[self.at], len(self))

    def __rmatmul__(self, share: np.ndarray) -> np.ndarray:
        return share @ self.floor + np.bincount(self.at, self.gain * share[self.lang], self.width)

    def log_dot(self, x: np.ndarray) -> np.ndarray:
        """The logarithms of the matrix times x."""
        return np.log(self.floor) * x.sum() + np.bincount(self.lang, self.log_gain * x[self.at], len(self))

    def of(self, chosen: list[int]) -> np.ndarray:
        """The rows of a few languages as they are."""
        out = np.repeat(self.floor[chosen][:, None], self.width, axis=1)
        for i, k in enumerate(chosen):
            own = self.lang == k
            out[i, self.at[own]] += self.gain[own]
        return out


@dataclass
class Model:
    """languages in code point order; the smoothed floor of each; and by bucket (from start[b] to start[b + 1])
    which languages have it, and how much more likely it is there than the floor."""

    languages: list[str]
    floor: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    log_gain: np.ndarray

    @staticmethod
    def of(languages: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> Model:
        total = np.bincount(lang, n, len(languages)) + SMOOTHING * BUCKETS
        order = np.argsort(bucket, kind="stable")
        lang, bucket, n = lang[order].astype(np.int32), bucket[order], n[order]
        start = np.searchsorted(bucket, np.arange(BUCKETS + 1))
        return Model(languages, SMOOTHING / total, start, lang, n / total[lang], np.log1p(n / SMOOTHING))

    def rows(self, used: np.ndarray) -> Rows:
        count = self.start[used + 1] - self.start[used]
        at = np.repeat(np.arange(len(used)), count)
        place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + self.start[used][at]
        return Rows(self.floor, self.lang[place], at, self.gain[place], self.log_gain[place], len(used))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts trigrams over all labelled texts; rows with a null text or label teach nothing. Only
    sums by language and bucket leave the tasks: one task's are at most BUCKETS for each language. The
    driver takes some languages at a time, MAX_ENTRIES sums in all."""

    def sums_of(total: dict[str, np.ndarray]):
        for label, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([label] * len(used), pa.string()), "bucket": pa.array(used, pa.int32()), "n": pa.array(n[used], pa.int64())})

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                used, n = trigrams(t)
                if label not in total:
                    if len(total) == HELD:
                        yield from sums_of(total)
                        total = {}
                    total[label] = np.zeros(BUCKETS, np.int64)
                total[label][used] += n.astype(np.int64)
        yield from sums_of(total)

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    names = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sums = written(rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    if sums.count() > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} trigrams of all languages")
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(0, len(names), TAKEN):
        got = sums.where(F.col("lang").isin(names[k : k + TAKEN])).toArrow()
        at = {name: k + i for i, name in enumerate(names[k : k + TAKEN])}
        lang = got["lang"].combine_chunks().dictionary_encode()
        own = np.array([at[x] for x in lang.dictionary.to_pylist()], np.int64)
        parts.append((own[lang.indices.to_numpy()] if len(own) else parts[0][0], got["bucket"].to_numpy().astype(np.int64), got["n"].to_numpy()))
    return Model.of(names, *(np.concatenate(x) for x in zip(*parts)))


def proportions(p: np.ndarray | Rows, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM: p[language, trigram], counts[trigram]. The mixing proportions and the log-likelihood."""
    total, share = counts.sum(), np.full(len(p), 1 / len(p))
    for _ in range(rounds if len(p) > 1 else 0):
        share = share * (p @ (counts / (share @ p))) / total
    return share, float(counts @ np.log(share @ p))


def mixture(model: Model, text: str | None, penalty: float = 1.0) -> tuple[list[int], np.ndarray]:
    """The languages chosen for a text and their proportions, largest first; none without a letter.

    Each language costs penalty times the log of the number of trigrams, and none enters that would
    hold less than a hundredth of the text."""
    return fitted(model, text, penalty)[:2]


def fitted(model: Model, text: str | None, penalty: float = 1.0) -> tuple[list[int], np.ndarray, float]:
    """mixture's answer, and its mean log-likelihood of a trigram less that of the uniform distribution.

    The likelihood is concave in the proportions, so its slope at the best single language bounds
    what any other language could gain; where that is within the penalty, no other is tried."""
    used, counts = trigrams(text or "")
    if not len(used) or not model.languages:
        return [], np.zeros(0), 0.0
    p = model.rows(used)
    alone = p.log_dot(counts)
    best = [int(np.argmax(alone))]
    total = counts.sum()
    share, reached, cost = np.ones(1), float(alone[best[0]]), penalty * np.log(total + 1)
    order = []
    if float((p @ (counts / p.of(best)[0])).max()) - total > cost:
        order = np.argsort(-proportions(p, counts)[0], kind="stable")
    for k in (int(k) for k in order if k != best[0]):
        tried, likelihood = proportions(p.of([*best, k]), counts)
        if likelihood - reached <= cost or tried[-1] < 0.01:
            break
        best, share, reached = [*best, k], tried, likelihood
    rank = np.argsort(-share, kind="stable")
    return [best[i] for i in rank], share[rank], reached / total + float(np.log(BUCKETS))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs and four columns: lang_pred, the language with the largest proportion; score, that
    proportion (0 to 1); langs, all chosen languages with their proportions; lang_fit, how much better
    they explain a trigram than the uniform distribution does (in nats; below 0 the text is in none of
    the learned languages).

    A null or empty text, or one without a letter, gets lang_pred und, score 0, fit 0 and no langs; so does
    every text if nothing was learned. Repeated rows each get the same answer; added columns take
    other names if docs has columns of these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    width = len(docs.columns)
    at = docs.columns.index(text) if text in docs.columns else width
    pred, score, langs, fit_, extra = fresh(docs, "lang_pred", "score", "langs", "lang_fit", "whole_text")

    def run(batches):
        model = sent.value
        for batch in pieces(batches):
            names, scores, all_of, fits = [], [], [], []
            for t in batch.column(at).to_pylist():
                chosen, share, gain = fitted(model, t)
                fits.append(gain)
                names.append(model.languages[chosen[0]] if chosen else UNDETERMINED)
                scores.append(min(1.0, float(share[0])) if chosen else 0.0)
                all_of.append([{"lang": model.languages[i], "part": float(s)} for i, s in zip(chosen, share, strict=True)])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("part", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(all_of, kind), pa.array(fits, pa.float64())], names=[*batch.schema.names[:width], pred, score, langs, fit_])

    none = F.array().cast("array<struct<lang: string, part: double>>")
    schema = docs.withColumns({pred: F.lit(""), score: F.lit(0.0), langs: none, fit_: F.lit(0.0)}).schema
    for f in schema.fields:
        f.nullable = True
    return (docs if at < width else docs.withColumn(extra, F.col(text))).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
