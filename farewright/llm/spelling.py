"""Spelling variants: words of a corpus that are one edit apart, and the form each is a variant of.

The vocabulary is a trie, dealt out by prefix. Two words at distance one either share their first PREFIX
code points, and then meet below one node of the trie; or their edit lies within these, and they share
at least as many at the end, and meet in the trie of the reversed words. So a word goes to two subtries
however dense the vocabulary is, and the set of active nodes of a subtrie's root is the root alone.

Below it, active nodes go down level by level for all nodes of a task's subtries at once: the nodes at
distance one from a node are found from those of its parent. A child pairs with its siblings
(replacement), a node with its own children (insertion), and a pair at distance one goes on to the
children that have the same code point in both. Pairs that end at words are the result, each once.

A subtrie of more than GROUP words is split, by length and by the place of the edit: words of one length
(and those one longer) that have the edit in the first half of the places left share what follows it,
the others share what comes before, so each half has longer fixed ends. At the last place a group holds
at most all letters, and pairs of them, so no group has to be cut off.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farewright.llm.shared import written

RUN = "[A-Za-zÀ-ÿ]"
#: Words of fewer code points, or of fewer occurrences, are left out.
MIN_LENGTH, MIN_COUNT = 7, 2
#: A form has so many times the occurrences of its variant.
TIMES = 10
#: Words of a subtrie that are not split further, and words of a task's subtries on average.
GROUP, BUCKET = 10_000, 8_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Beyond any place of an edit.
END = 1 << 30
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_CODES = 1 << 21


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slip: int = 0, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the distinct maximal runs of letters of whole texts, A-Z as a-z, of at least so many
    code points and occurrences.

    slip, if not 0, plants slips of the pen: a run loses the code point h % length where slip divides
    h, the crc32 of doc_id, a colon and the run. A null text has no words; a null doc_id reads as
    nothing before the colon; repeated rows count again. Other columns are left out."""
    runs = re.compile(f"{RUN}{{{min_length},}}")

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: Counter = Counter()
                for w, n in Counter(runs.findall(t)).items():
                    own[w.translate(_LOWER)] += n
                for w, n in own.items():
                    if slip and (h := zlib.crc32(f"{d or ''}:{w}".encode())) % slip == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < min_length:
                            continue
                    counts[w] += n
                if len(counts) >= COUNTED:
                    yield flush()
        yield flush()

    found = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class _Level:
    """The children of one depth's nodes, in the order of (parent, code point). They are the nodes of
    the next depth, by their place."""

    def __init__(self, node: np.ndarray, char: np.ndarray, parents: int):
        self.key, self.of = np.unique(node * _CODES + char, return_inverse=True)
        self.parent, self.char = self.key // _CODES, self.key % _CODES
        self.words = np.bincount(self.of, minlength=len(self.key))
        self.start = np.searchsorted(self.parent, np.arange(parents + 1))
        self.count = np.diff(self.start)


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, count[i] numbers from start[i] on: (i of each, number)."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of]


def _down(u: np.ndarray, v: np.ndarray, a: _Level, b: _Level) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of children, by the same code point, of pairs of nodes whose children a and b hold."""
    of, child = _ranges(a.start[u], a.count[u])
    key = v[of] * _CODES + a.char[child]
    at = np.minimum(np.searchsorted(b.key, key), max(len(b.key) - 1, 0))
    met = b.key[at] == key if len(b.key) else np.zeros(len(key), bool)
    return child[met], at[met]


def near_in_forest(root: np.ndarray, codes: np.ndarray, first: np.ndarray, step: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of words of one root at distance one, each once. Word i is the codes at first[i],
    first[i] + step[i], ..., length[i] of them; words of a root are distinct."""
    none = np.zeros(0, np.int64)
    roots, node = np.unique(root, return_inverse=True)
    alive, out = np.arange(len(root)), []

    def ends(m: int, depth: int, words: np.ndarray, of: np.ndarray) -> np.ndarray:
        term = np.full(m, -1)
        last = length[words] == depth
        term[of[last]] = words[last]
        return term

    def children(words: np.ndarray, of: np.ndarray, depth: int, parents: int) -> tuple[_Level, np.ndarray]:
        on = length[words] > depth
        words, of = words[on], of[on]
        return _Level(of, codes[first[words] + step[words] * depth].astype(np.int64), parents), words

    term = ends(len(roots), 0, alive, node)
    level, alive = children(alive, node, 0, len(roots))
    many = np.bincount(node, minlength=len(roots)) > 1
    su, sv = none, none
    fresh = many[level.parent]
    iu, iv = level.parent[fresh], np.flatnonzero(fresh)
    depth = 0
    while len(su) or len(iu) or (level.words > 1).any():
        # pairs at this depth (s: both here, i: the second one level down), level: the children of here
        below = ends(len(level.key), depth + 1, alive, level.of)
        for x, y in ((term[su], term[sv]), (term[iu], below[iv])):
            both = (x >= 0) & (y >= 0)
            out.append((x[both], y[both]))
        later = level.start[level.parent + 1] - np.arange(len(level.key)) - 1
        a, b = _ranges(np.arange(len(level.key)) + 1, later)
        x, y = _down(su, sv, level, level)
        su, sv = np.concatenate([a, x]), np.concatenate([b, y])
        need = level.words > 1
        need[su] = need[sv] = need[iv] = True
        need[_ranges(level.start[iu], level.count[iu])[1]] = True
        on = need[level.of]
        deeper, alive = children(alive[on], level.of[on], depth + 1, len(level.key))
        x, y = _down(iu, iv, level, deeper)
        fresh = level.words[deeper.parent] > 1
        pair = np.unique(np.concatenate([x, deeper.parent[fresh]]) * (len(deeper.key) + 1) + np.concatenate([y, np.flatnonzero(fresh)]))
        iu, iv = pair // (len(deeper.key) + 1), pair % (len(deeper.key) + 1)
        term, level, depth = below, deeper, depth + 1
    a, b = zip(*out) if out else ((none,), (none,))
    return np.concatenate(a), np.concatenate(b)


def _bucket_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """The near pairs (a, na, b, nb) of one task's groups of words."""
    words = frame["word"].tolist()
    n = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    at = np.cumsum(n) - n
    lo, hi, up, backward = (frame[c].to_numpy() for c in ("lo", "hi", "up", "backward"))
    first = np.where(backward, at + n - hi - 1, at + lo)
    i, j = near_in_forest(frame["key"].to_numpy(), codes, first, np.where(backward, -1, 1), n - lo - hi)
    of, count, kept = frame["of"].to_numpy(), frame["n"].to_numpy(), []
    for x, y, l, h, u, k in zip(i.tolist(), j.tolist(), lo[i].tolist(), hi[i].tolist(), up[i].tolist(), of[i].tolist()):
        a, b = words[x], words[y]
        # The place of the edit is this group's, and its ends are the same (keys are hashes).
        if a[:u] != b[:u] and a[:l] == b[:l] and (not h or a[-h:] == b[-h:]) and (not k or min(len(a), len(b)) == k):
            kept.append((a, count[x], b, count[y]))
    return pd.DataFrame(kept, columns=["a", "na", "b", "nb"])


_MEMBER = ["word", "n", "of", "lo", "hi", "up", "backward"]


def _keyed(members: DataFrame) -> DataFrame:
    """of: the length of the shorter word (0: any); lo, hi: code points at the start and the end that
    the group has in common; up: its edits are before this place."""
    return members.select(*_MEMBER, F.xxhash64("of", "lo", "hi", "up", "backward", F.left("word", F.col("lo")), F.right("word", F.col("hi"))).alias("key"))


def _halved(members: DataFrame) -> DataFrame:
    """Each group by the length of the shorter word, and by where the edit is: in the first half of the
    places, or after it."""
    size = F.length("word")
    own = F.when(F.col("of") > 0, F.array("of")).otherwise(F.array(size, size - 1))
    by = members.withColumn("of", F.explode(own)).where("of > 0")
    places = F.least("up", "of") - F.col("lo")
    p = F.ceil(places / 2).cast("int")
    here = F.struct((F.col("lo") + p).alias("lo"), F.greatest("hi", F.col("of") - F.col("up")).alias("hi"), F.col("up").alias("up"), F.lit(False).alias("backward"))
    before = F.struct(F.col("lo"), (F.col("of") - F.col("lo") - p).alias("hi"), (F.col("lo") + p).alias("up"), F.lit(True).alias("backward"))
    last = F.struct("lo", "hi", "up", "backward")
    return by.withColumn("part", F.explode(F.when(places > 1, F.array(here, before)).otherwise(F.array(last)))).select("word", "n", "of", "part.*")


def near_pairs(vocab: DataFrame, min_length: int = MIN_LENGTH, group: int = GROUP) -> DataFrame:
    """vocab: (word, n), words distinct, of min_length code points or more, and written.
    (a, na, b, nb): all pairs of words that differ by exactly one inserted, deleted or replaced code
    point, each once, in no order."""
    prefix = (min_length - 1) // 2
    side = lambda lo, hi, up, backward: F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(up).alias("up"), F.lit(backward).alias("backward"))
    sides = F.array(side(prefix, 0, END, False), *([side(0, prefix, prefix, True)] if prefix else []))
    left = _keyed(vocab.select("word", "n", F.lit(0).alias("of"), F.explode(sides).alias("s")).select("word", "n", "of", "s.*"))
    small, total = [], 0
    while True:
        left = written(left, "subtries")
        total += left.count()
        # A group of one place is bounded by the letters there are.
        large = written(left.where((F.col("of") == 0) | (F.least("up", "of") - F.col("lo") > 1)).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > group).select("key"), "large")
        if large.isEmpty():
            small.append(left)
            break
        small.append(left.join(large, "key", "left_anti").select(*left.columns))
        left = _keyed(_halved(left.join(large, "key", "left_semi")))
    members = small[0]
    for more in small[1:]:
        members = members.unionByName(more)
    buckets = max(1, -(-total // BUCKET))
    dealt = members.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(_bucket_pairs, "a string, na long, b string, nb long")


def variants(vocab: DataFrame, times: int = TIMES, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of vocab (word, n).

    form: the near word of most occurrences (of several, the first in code-point order) if it has so
    many times the word's own, else null. root: where forms lead, the word itself if it has none."""
    vocab = written(vocab, "vocabulary")
    pairs = near_pairs(vocab, min_length)
    way = lambda w, o, n: F.struct(F.col(w).alias("word"), F.col(o).alias("near"), F.col(n).alias("near_n"))
    each = pairs.select(F.explode(F.array(way("a", "b", "nb"), way("b", "a", "na"))).alias("p")).select("p.*")
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = vocab.join(best, "word", "left")
    has = -F.col("best.less") >= F.col("n") * times
    named = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    # Each step of a chain has at least so many times the occurrences, so a chain is short; pointers double.
    most = named.agg(F.max("n")).first()[0] or 1
    steps, reach = 0, 1
    while reach < most:
        steps, reach = steps + 1, reach * max(times, 2)
    leads = written(named.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "leads")
    for _ in range(max(0, (steps - 1).bit_length())):
        onward = leads.select(F.col("word").alias("root"), F.col("root").alias("next"))
        leads = written(leads.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "leads")
    return named.join(leads, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
